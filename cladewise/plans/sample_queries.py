"""Queries on sampling histories, partitions, priors, histograms and component models."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cladewise.functions import mathx
from cladewise.operators import history as h
from cladewise.registry import query

from . import bindings as b


@query(f"WITH {b.HISTORY} SELECT chain, step, posterior FROM (SELECT *, max(step) OVER (PARTITION BY chain) AS last FROM history) WHERE step - 1 >= 100 AND (last - step) % 7 = 0")
def burnin_thin(spark: SparkSession, folder: str) -> DataFrame:
    return h.thin(b.history(spark, folder), 100, 7).select("chain", "step", "posterior")


@query(f"WITH {b.HISTORY} SELECT chain, step, posterior FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY posterior DESC, step) AS k FROM history WHERE temperature <= 1) WHERE k = 1")
def map_sample_per_chain(spark: SparkSession, folder: str) -> DataFrame:
    return h.map_sample(b.history(spark, folder))


@query(f"WITH {b.HISTORY} SELECT chain, step, round(10.0 * power(0.1, step / 100.0), 6) AS temperature FROM history WHERE step <= 100")
def anneal_schedule(spark: SparkSession, folder: str) -> DataFrame:
    x = b.history(spark, folder).where("step <= 100")
    return x.select("chain", "step", F.round(mathx.anneal(10.0, F.col("step"), 100), 6).alias("temperature"))


_DELTA = f"{b.HISTORY}, dl AS (SELECT chain, step, posterior - lag(posterior) OVER (PARTITION BY chain ORDER BY step) AS delta FROM history)"


@query(f"WITH {_DELTA} SELECT chain, round(avg(CASE WHEN delta >= 0 THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) AS n FROM dl WHERE delta IS NOT NULL GROUP BY chain")
def acceptance_rate(spark: SparkSession, folder: str) -> DataFrame:
    d = h.deltas(b.history(spark, folder)).where("delta IS NOT NULL")
    return d.groupBy("chain").agg(F.round(F.avg((F.col("delta") >= 0).cast("double")), 6).alias("rate"), F.count("*").alias("n"))


@query(f"WITH {_DELTA} SELECT chain, step, round(delta, 6) + 0.0 AS delta FROM dl")
def posterior_delta(spark: SparkSession, folder: str) -> DataFrame:
    return h.deltas(b.history(spark, folder)).select("chain", "step", (F.round("delta", 6) + F.lit(0.0)).alias("delta"))


@query(f"WITH {b.HISTORY} SELECT step, " + ", ".join(f"max(CASE WHEN chain = {k} THEN posterior END) AS chain{k}" for k in range(4)) + " FROM history GROUP BY step")
def history_wide(spark: SparkSession, folder: str) -> DataFrame:
    wide = b.history(spark, folder).groupBy("step").pivot("chain", [0, 1, 2, 3]).agg(F.max("posterior"))
    return wide.select("step", *(F.col(str(k)).alias(f"chain{k}") for k in range(4)))


_CELLS = "cells AS (SELECT event_type AS a, user_id % 7 AS b, count(*) AS n FROM events GROUP BY ALL)"


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return b.table(spark, folder, "events").select("event_id", F.col("event_type").alias("a"), (F.col("user_id") % 7).alias("b"))


@query(f"""WITH {_CELLS} SELECT CAST((SELECT sum(m * m) / 2 FROM (SELECT sum(n) AS m FROM cells GROUP BY a)) + (SELECT sum(m * m) / 2 FROM (SELECT sum(n) AS m FROM cells GROUP BY b))
- (SELECT sum(n * n) FROM cells) AS BIGINT) AS distance""")
def partition_distance(spark: SparkSession, folder: str) -> DataFrame:
    return h.partition_distance(h.contingency(_labels(spark, folder), "a", "b"), "a", "b")


@query("SELECT event_type AS name, user_id % 7 AS length, count(DISTINCT user_id) AS clusters, max(n) AS largest FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY ALL")
def cluster_size_summary(spark: SparkSession, folder: str) -> DataFrame:
    n = b.table(spark, folder, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return n.groupBy(F.col("event_type").alias("name"), (F.col("user_id") % 7).alias("length")).agg(F.count("*").alias("clusters"), F.max("n").alias("largest"))


@query("""WITH s AS (SELECT user_id, count(*) AS size FROM events GROUP BY user_id), t AS (SELECT sum(size) AS n, count(*) AS k FROM s)
SELECT user_id, round(ln(size - 0.1) - ln(n + 0.5), 6) AS pitman_yor, round(ln(0.5 + 0.1 * k) - ln(n + 0.5), 6) AS fresh, round(-ln(0.5 + k), 6) AS uniform FROM s, t""")
def process_prior_weights(spark: SparkSession, folder: str) -> DataFrame:
    s = b.table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("size"))
    t = s.agg(F.sum("size").alias("n"), F.count("*").alias("k"))
    x = s.join(F.broadcast(t))
    size, n, k = F.col("size"), F.col("n"), F.col("k")
    r = lambda c, name: F.round(c, 6).alias(name)
    return x.select("user_id", r(mathx.pitman_yor(size, n, k, 0.5, 0.1), "pitman_yor"), r(mathx.pitman_yor(F.lit(0), n, k, 0.5, 0.1), "fresh"), r(mathx.uniform_process(size, k, 0.5), "uniform"))


_LOGS = " + ".join(f"lgamma(c{k} + 0.2)" for k in range(5)) + " - lgamma(c0 + c1 + c2 + c3 + c4 + 1.0) - 5 * lgamma(0.2) + lgamma(1.0)"


def _weights(spark: SparkSession, folder: str) -> DataFrame:
    c = b.counts(spark, folder, ("user_id", "day"))
    return c.select("user_id", "day", mathx.dirichlet_multinomial(b.count_columns(), [0.2] * 5).alias("w"))


@query(f"""WITH {b.counts_sql('user_id, day')}, w AS (SELECT user_id, day, {_LOGS} AS w FROM counts), m AS (SELECT *, max(w) OVER (PARTITION BY user_id) AS m FROM w)
SELECT user_id, CAST(day AS VARCHAR) AS day, round(exp(w - m) / sum(exp(w - m)) OVER (PARTITION BY user_id), 6) AS p FROM m""")
def log_normalize_weights(spark: SparkSession, folder: str) -> DataFrame:
    per = Window.partitionBy("user_id")
    x = _weights(spark, folder).withColumn("e", F.exp(F.col("w") - F.max("w").over(per)))
    return x.select("user_id", F.col("day").cast("string").alias("day"), F.round(F.col("e") / F.sum("e").over(per), 6).alias("p"))


@query(f"""WITH {b.counts_sql('user_id, day')}, w AS (SELECT user_id, day, {_LOGS} AS w FROM counts), m AS (SELECT *, max(w) OVER (PARTITION BY user_id) AS m FROM w)
SELECT user_id, CAST(day AS VARCHAR) AS day, round(m + ln(sum(exp(w - m)) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING)), 6) + 0.0 AS cumulative FROM m""")
def running_logsumexp(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("day")
    x = h.running_logsumexp(F.col("w"), w)
    return _weights(spark, folder).select("user_id", F.col("day").cast("string").alias("day"), (F.round(x, 6) + F.lit(0.0)).alias("cumulative"))


_BINS = "bins AS (SELECT least(greatest(CAST(floor(value / 5.0) AS BIGINT), 0), 39) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)"


def _histogram(spark: SparkSession, folder: str) -> DataFrame:
    e = b.table(spark, folder, "events").where("value IS NOT NULL")
    bin_ = F.least(F.greatest(F.floor(F.col("value") / 5.0), F.lit(0)), F.lit(39)).cast("long")
    return e.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {_BINS} SELECT bin, n, bin * 5.0 + 2.5 AS midpoint FROM bins")
def weighted_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return _histogram(spark, folder).withColumn("midpoint", F.col("bin") * 5.0 + 2.5)


@query(f"WITH {_BINS} SELECT bin, round(n / (sum(n) OVER () * 5.0), 8) AS pdf, round((n + coalesce(lead(n) OVER (ORDER BY bin), n)) / 2.0 / (sum(n) OVER () * 5.0), 8) AS at_edge FROM bins")
def histogram_pdf(spark: SparkSession, folder: str) -> DataFrame:
    x, everything, order = _histogram(spark, folder), Window.partitionBy(F.lit(1)), Window.partitionBy(F.lit(1)).orderBy("bin")
    mass = F.sum("n").over(everything) * 5.0
    edge = (F.col("n") + F.coalesce(F.lead("n").over(order), F.col("n"))) / 2.0
    return x.select("bin", F.round(F.col("n") / mass, 8).alias("pdf"), F.round(edge / mass, 8).alias("at_edge"))


COMPONENTS = ([1.0, 1.0, 1.0, 1.0, 5.0], [2.0, 1.0, 1.0, 2.0, 1.0], [0.3, 0.3, 0.3, 0.3, 0.3])


def _component_sql(alpha: list[float]) -> str:
    n = "c0 + c1 + c2 + c3 + c4"
    return " + ".join(f"lgamma(c{k} + {a}) - {math.lgamma(a)!r}" for k, a in enumerate(alpha)) + f" - lgamma({n} + {sum(alpha)}) + {math.lgamma(sum(alpha))!r}"


@query(f"""WITH {b.counts_sql('user_id, day')}, v AS (SELECT user_id, day, {", ".join(f"round({_component_sql(a)}, 6) + 0.0 AS l{k}" for k, a in enumerate(COMPONENTS))} FROM counts)
SELECT user_id, CAST(day AS VARCHAR) AS day, CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END AS component, greatest(l0, l1, l2) AS logml FROM v""")
def background_component_argmax(spark: SparkSession, folder: str) -> DataFrame:
    c = b.counts(spark, folder, ("user_id", "day"))
    logs = [F.round(mathx.dirichlet_multinomial(b.count_columns(), a), 6) + F.lit(0.0) for a in COMPONENTS]
    c = c.select("user_id", F.col("day").cast("string").alias("day"), *(x.alias(f"l{k}") for k, x in enumerate(logs)))
    best = F.greatest("l0", "l1", "l2")
    return c.select("user_id", "day", F.when(F.col("l0") == best, 0).when(F.col("l1") == best, 1).otherwise(2).alias("component"), best.alias("logml"))


@query("""WITH p AS (SELECT o_custkey % 11 AS cluster, count(*) AS n, avg(o_totalprice / 1000) AS mx, avg((o_orderkey % 1000) / 10.0) AS my FROM orders GROUP BY 1)
SELECT cluster, n, round(mx * n * 100 / (n * 100 + 25.0), 6) AS post_x, round(my * n * 100 / (n * 100 + 25.0), 6) AS post_y, round(1 / (n / 25.0 + 0.01) + 25.0, 6) AS predictive_var FROM p""")
def gaussian_posterior_predictive(spark: SparkSession, folder: str) -> DataFrame:
    """Conjugate mean of 2-D points by cluster: known variance 25, prior mean 0 and variance 100, per coordinate."""
    o = b.table(spark, folder, "orders")
    p = o.groupBy((F.col("o_custkey") % 11).alias("cluster")).agg(F.count("*").alias("n"), F.avg(F.col("o_totalprice") / 1000).alias("mx"), F.avg((F.col("o_orderkey") % 1000) / 10.0).alias("my"))
    shrink = F.col("n") * 100 / (F.col("n") * 100 + 25.0)
    return p.select("cluster", "n", F.round(F.col("mx") * shrink, 6).alias("post_x"), F.round(F.col("my") * shrink, 6).alias("post_y"), F.round(1 / (F.col("n") / 25.0 + 0.01) + 25.0, 6).alias("predictive_var"))


_TOTAL = "(c0 + c1 + c2 + c3 + c4)"


@query(f"WITH {b.counts_sql('user_id, day')} SELECT user_id, " + ", ".join(f"round(sum(c{k} * CAST({_TOTAL} AS DOUBLE)) / sum({_TOTAL}), 6) AS e{k}" for k in range(5)) + " FROM counts GROUP BY user_id")
def variational_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Mean exponent of each coordinate, weighted by coefficients: a polynomial's approximation by one term."""
    c = b.counts(spark, folder, ("user_id", "day"))
    columns = b.count_columns()
    n = sum(columns[1:], columns[0])
    return c.groupBy("user_id").agg(*(F.round(F.sum(x * n) / F.sum(n), 6).alias(f"e{k}") for k, x in enumerate(columns)))


@query(f"""WITH {b.counts_sql('user_id, day')}, t AS (SELECT user_id, c0 % 3 AS a, c1 % 3 AS b, CAST(count(*) AS DOUBLE) AS c FROM counts GROUP BY ALL)
SELECT x.user_id, x.a + y.a AS a, x.b + y.b AS b, sum(x.c * y.c) AS c FROM t x JOIN t y USING (user_id) GROUP BY ALL HAVING sum(x.c * y.c) <> 0""")
def polynomial_multiply(spark: SparkSession, folder: str) -> DataFrame:
    """Square of each user's polynomial given as rows (exponents, coefficient); like terms are merged first."""
    c = b.counts(spark, folder, ("user_id", "day"))
    t = c.groupBy("user_id", (F.col("c0") % 3).alias("a"), (F.col("c1") % 3).alias("b")).agg(F.count("*").cast("double").alias("c"))
    u = t.select("user_id", F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("c").alias("c2"))
    m = t.join(u, "user_id").groupBy("user_id", (F.col("a") + F.col("a2")).alias("a"), (F.col("b") + F.col("b2")).alias("b")).agg(F.sum(F.col("c") * F.col("c2")).alias("c"))
    return m.where("c <> 0")


@query(f"""WITH {b.HISTORY}, w AS (SELECT step, {", ".join(f"max(CASE WHEN chain = {k} THEN posterior END) AS y{k}" for k in range(4))} FROM history GROUP BY step)
SELECT 0 AS step, 'x y1 y2 y3 y4' AS line UNION ALL
SELECT CAST(step AS INT), printf('%d %.6f %.6f %.6f %.6f', step, y0, y1, y2, y3) FROM w WHERE y0 IS NOT NULL AND y1 IS NOT NULL AND y2 IS NOT NULL AND y3 IS NOT NULL""")
def posterior_value_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The four chains' posterior values as lines of a table."""
    return h.value_lines(b.history(spark, folder), 4)


@query(f"""WITH {b.counts_sql()}, g AS (SELECT user_id, {", ".join(f"(floor((c{k} + 0.234) * 100 - 0.5) + 1) / 100 AS g{k}" for k in range(5))}, (floor((c0 + c1 + c2 + c3 + c4 + 5 * 0.234) * 100 - 0.5) + 1) / 100 AS total FROM counts)
SELECT user_id, round({" + ".join(f"lgamma(g{k})" for k in range(5))} - lgamma(total), 6) + 0.0 AS lbeta FROM g""")
def grid_log_beta(spark: SparkSession, folder: str) -> DataFrame:
    """Log beta functions of counts and pseudocounts from log gamma values on a grid of hundredths."""
    c = b.counts(spark, folder)
    return c.select("user_id", (F.round(mathx.grid_lbeta([x + 0.234 for x in b.count_columns()]), 6) + F.lit(0.0)).alias("lbeta"))
