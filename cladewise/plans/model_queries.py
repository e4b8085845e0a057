"""Queries on densities, polynomials, mixtures, motif clusters and paths between trees."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cladewise.functions import mathx, signed_log
from cladewise.operators import binding_sites, motifs, partitions, refinement, saved, site_search
from cladewise.registry import query

from . import bindings as b
from .sample_queries import COMPONENTS, _component_sql

r6 = lambda x: F.round(x, 6) + F.lit(0.0)

_SAMPLES = "samples AS (SELECT event_id AS item, sample, (user_id * (sample + 1)) % (sample + 5) AS cluster FROM events, (SELECT unnest(range(6)) AS sample))"
_DISTANCES = f"""{_SAMPLES}, half AS (SELECT sample, sum(n * n) / 2 AS half, sum(n) AS items FROM (SELECT sample, cluster, count(*) AS n FROM samples GROUP BY ALL) GROUP BY sample),
both_ AS (SELECT i, j, sum(n * n) AS n FROM (SELECT x.sample AS i, y.sample AS j, x.cluster AS a, y.cluster AS b, count(*) AS n FROM samples x JOIN samples y ON x.item = y.item AND x.sample < y.sample GROUP BY ALL) GROUP BY i, j),
dist AS (SELECT i, j, (x.half + y.half - both_.n) / (x.items * (x.items - 1) / 2) AS d FROM both_ JOIN half x ON x.sample = i JOIN half y ON y.sample = j)"""


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    e = b.table(spark, folder, "events").withColumn("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    return e.select("sample", F.col("event_id").alias("item"), ((F.col("user_id") * (F.col("sample") + 1)) % (F.col("sample") + 5)).alias("cluster"))


@query(f"WITH {_DISTANCES} SELECT i, j, round(d, 6) AS distance FROM dist")
def partition_distance_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return partitions.pair_distances(_samples(spark, folder)).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {_DISTANCES}, l AS (SELECT s AS sample, round(sum(d * d), 9) AS mean_loss, round(sum(d), 9) AS median_loss FROM (SELECT i AS s, d FROM dist UNION ALL SELECT j, d FROM dist) GROUP BY s)
SELECT sample, round(mean_loss, 6) AS mean_loss, round(median_loss, 6) AS median_loss, row_number() OVER (ORDER BY mean_loss, sample) = 1 AS is_mean, row_number() OVER (ORDER BY median_loss, sample) = 1 AS is_median FROM l""")
def partition_estimates(spark: SparkSession, folder: str) -> DataFrame:
    e = partitions.estimates(partitions.pair_distances(_samples(spark, folder)))
    return e.withColumn("mean_loss", F.round("mean_loss", 6)).withColumn("median_loss", F.round("median_loss", 6))


_ESTIMATE = f"{_SAMPLES}, estimate AS (SELECT item, cluster FROM samples WHERE sample = 2)"


@query(f"""WITH {_ESTIMATE}, cells AS (SELECT sample, e.cluster AS own, s.cluster AS theirs, count(*) AS n FROM samples s JOIN estimate e USING (item) GROUP BY ALL),
sizes AS (SELECT cluster, count(*) AS size FROM estimate GROUP BY cluster),
change AS (SELECT h.sample, h.own, h.theirs, (SELECT size FROM sizes WHERE cluster = 0) - z.size + 1 - 2 * (coalesce(t.n, 0) - h.n + 1) AS change
FROM cells h LEFT JOIN cells t ON t.own = 0 AND t.sample = h.sample AND t.theirs = h.theirs JOIN sizes z ON z.cluster = h.own WHERE h.own <> 0)
SELECT item, e.cluster, CAST(sum(change) AS BIGINT) AS gain FROM estimate e JOIN samples s USING (item) JOIN change c ON c.sample = s.sample AND c.own = e.cluster AND c.theirs = s.cluster GROUP BY item, e.cluster""")
def deletion_gains(spark: SparkSession, folder: str) -> DataFrame:
    """Change of a partition's summed distance to all samples for each element that would leave its cluster for the background."""
    samples = _samples(spark, folder)
    return refinement.deletion_gains(samples, samples.where("sample = 2").select("item", "cluster"))


@query()
def refined_partition(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the clusters of one sample before and after elements left for the background, as long as that brings it closer to all samples."""
    samples = _samples(spark, folder)
    estimate = samples.where("sample = 2").select("item", "cluster")
    refined, _ = refinement.refine(samples, estimate)
    after = refined.groupBy("cluster").agg(F.count("*").alias("after"))
    return estimate.groupBy("cluster").agg(F.count("*").alias("before")).join(after, "cluster", "full").select("cluster", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


_ELEMENTS = "elements AS (SELECT doc_id AS seq, doc_id % 3 AS cluster, doc_id % 20 AS pos, doc_id % 2 = 1 AS reverse FROM seqs WHERE length(seq) >= 40)"


def _elements(spark: SparkSession, folder: str) -> DataFrame:
    s = b.sequences(spark, folder).where(F.length("seq") >= 40)
    d = F.col("doc_id")
    return s.select(d.alias("seq"), (d % 3).alias("cluster"), (d % 20).cast("int").alias("pos"), (d % 2 == 1).alias("reverse"))


_COUNTED = ", ".join(f"CAST(sum(CASE WHEN letter = '{c}' THEN 1 ELSE 0 END) AS BIGINT) AS c{k}" for k, c in enumerate("GATC-"))


@query(f"""WITH {b.SITES}, {_ELEMENTS}, met AS (SELECT cluster, CASE WHEN reverse THEN 9 - (s.pos - e.pos) ELSE s.pos - e.pos END AS "offset",
CASE WHEN reverse THEN translate(letter, 'GATC', 'CTAG') ELSE letter END AS letter FROM elements e JOIN sites s ON s.doc_id = e.seq AND s.pos BETWEEN e.pos AND e.pos + 9),
m AS (SELECT cluster, "offset", {_COUNTED} FROM met GROUP BY ALL)
SELECT *, {", ".join(f"round((c{k} + 1.0) / (c0 + c1 + c2 + c3 + c4 + 5), 6) AS p{k}" for k in range(5))} FROM m""")
def motif_count_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and smoothed frequencies of the clusters' positions; reverse elements are read as complements backwards."""
    sites = b.sites(spark, folder).select(F.col("doc_id").alias("seq"), "pos", *((F.col("letter") == c).cast("long").alias(f"c{k}") for k, c in enumerate("GATC-")))
    m = motifs.motif_counts(_elements(spark, folder), sites, 10)
    p = motifs.posterior_mean([F.col(f"c{k}") for k in range(5)], [1.0] * 5)
    return m.select("*", *(F.round(x, 6).alias(f"p{k}") for k, x in enumerate(p)))


_STATE = f"""{b.SITES}, {_ELEMENTS}, met AS (SELECT cluster, CASE WHEN reverse THEN 9 - (s.pos - e.pos) ELSE s.pos - e.pos END AS "offset",
CASE WHEN reverse THEN translate(letter, 'GATC', 'CTAG') ELSE letter END AS letter FROM elements e JOIN sites s ON s.doc_id = e.seq AND s.pos BETWEEN e.pos AND e.pos + 9),
m AS (SELECT cluster, "offset", {_COUNTED} FROM met GROUP BY ALL)"""
_COLUMN_LOGML = " + ".join(f"lgamma(c{k} + 1.0)" for k in range(5)) + f" - lgamma(c0 + c1 + c2 + c3 + c4 + 5.0) + {math.lgamma(5.0)!r}"
#: Pseudocounts of single background letters, share of starts of sites, and concentration of the process.
GROUND, RATE, CONCENTRATION = [1.0, 1.0, 1.0, 1.0, 5.0], 0.01, 0.5


def _state(spark: SparkSession, folder: str) -> DataFrame:
    sites = b.sites(spark, folder).select(F.col("doc_id").alias("seq"), "pos", *((F.col("letter") == c).cast("long").alias(f"c{k}") for k, c in enumerate("GATC-")))
    return motifs.motif_counts(_elements(spark, folder), sites, 10)


@query(f"""WITH {_STATE} SELECT cluster, round(sum({_COLUMN_LOGML}), 5) + 0.0 AS logml FROM m GROUP BY cluster""")
def cluster_log_marginals(spark: SparkSession, folder: str) -> DataFrame:
    """Log marginal of each motif's letters, every offset under a uniform Dirichlet prior."""
    found = binding_sites.cluster_log_marginals(_state(spark, folder), [1.0] * 5)
    return found.withColumn("logml", F.round("logml", 5) + F.lit(0.0))


@query(f"""WITH {_STATE}, f AS (SELECT sum({_COLUMN_LOGML}) AS motifs, {", ".join(f"sum(c{k}) AS s{k}" for k in range(5))} FROM m),
n AS (SELECT {", ".join(f"count(*) FILTER (letter = '{c}') AS n{k}" for k, c in enumerate("GATC-"))} FROM sites),
z AS (SELECT CAST(sum(n) AS BIGINT) AS sites, count(*) AS clusters, sum(lgamma(CAST(n AS DOUBLE))) AS members FROM (SELECT cluster, count(*) AS n FROM elements GROUP BY cluster)),
l AS (SELECT *, motifs {" ".join(f"+ (n{k} - s{k}) * ({math.log(a / sum(GROUND))!r})" for k, a in enumerate(GROUND))} AS likelihood FROM f, n, z)
SELECT sites, clusters, round(likelihood, 3) AS likelihood, round(likelihood + ({" + ".join(f"n{k} - s{k}" for k in range(5))}) * ({math.log1p(-RATE)!r}) + sites * ({math.log(RATE)!r})
+ clusters * ({math.log(CONCENTRATION)!r}) + {math.lgamma(CONCENTRATION)!r} - lgamma(sites + {CONCENTRATION}) + members, 3) AS posterior FROM l""")
def sampler_state_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    """Likelihood and posterior of a state that is given: sites of three motifs, every other letter background."""
    counts, s = _state(spark, folder), b.sequences(spark, folder)
    letters = s.agg(*(F.sum((F.length("seq") - F.length(F.replace("seq", F.lit(c)))).cast("long")).alias(f"n{k}") for k, c in enumerate("GATC-")))
    sizes = _elements(spark, folder).groupBy("cluster").agg(F.count("*").alias("n"))
    x = binding_sites.state_log_likelihood(counts, sizes, letters, [1.0] * 5, GROUND, RATE, CONCENTRATION)
    return x.withColumns({c: F.round(c, 3) for c in ("likelihood", "posterior")})


@query()
def tfbs_trace(spark: SparkSession, folder: str) -> DataFrame:
    """Sweeps of the sampler of motifs and sites over every document's letters, after a burn-in that cools."""
    trace, _ = binding_sites.sample(b.sequences(spark, folder), binding_sites.Model(lengths=(6, 8)), steps=2, burnin=2, seed=3)
    return trace


@query()
def map_site_search(spark: SparkSession, folder: str) -> DataFrame:
    """Trace of a search for the most probable state of motifs and sites in every document's letters, from the first places of three given words."""
    words = F.element_at(F.array(*map(F.lit, ("TTATT", "ATTAA", "ACATT"))), (F.col("doc_id") % 3 + 1).cast("int"))
    s = b.sequences(spark, folder)
    sites = s.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("cluster"), (F.instr("seq", words) - 1).alias("pos"), F.lit(False).alias("reverse")).where("pos >= 0")
    _, trace = site_search.optimise(s, sites, [5, 5, 5], binding_sites.Model(lengths=(5, 8)), rounds=4, tries=2)
    return trace.withColumn("posterior", F.round("posterior", 3))


@query()
def population_trace(spark: SparkSession, folder: str) -> DataFrame:
    """Two chains of the sampler over every document's letters, stopped behind their first sweep and gone on with from the stored states."""
    store, model, s = saved.Saved(spark, "population").base, binding_sites.Model(lengths=(6, 8)), b.sequences(spark, folder)
    site_search.population(s, model, 2, 1, store, seed=3)
    return site_search.population(s, model, 2, 1, store, seed=3)


@query(f"WITH {b.SEQ}, {_ELEMENTS} SELECT cluster, seq, pos, reverse, seq % 15 AS start, pos - seq % 15 AS into_region FROM elements WHERE pos BETWEEN seq % 15 AND seq % 15 + 11")
def locate_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Elements inside the regions [start, start + 12) of their sequence."""
    regions = b.table(spark, folder, "documents").select(F.col("doc_id").alias("seq"), (F.col("doc_id") % 15).alias("start"))
    met = _elements(spark, folder).join(regions, "seq").where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + 12))
    return met.select("cluster", "seq", F.col("pos").cast("long").alias("pos"), "reverse", "start", (F.col("pos") - F.col("start")).alias("into_region"))


@query("""WITH g AS (SELECT o_custkey AS seq, o_orderkey AS pos, least(coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - o_orderkey, 1000), 1000) AS free FROM orders)
SELECT seq, pos, free, free >= 200 AS fits FROM g""")
def free_range(spark: SparkSession, folder: str) -> DataFrame:
    """Room from a start to the next one of the sequence, 1000 at most, and whether a motif of 200 fits."""
    starts = b.table(spark, folder, "orders").select(F.col("o_custkey").alias("seq"), F.col("o_orderkey").alias("pos"))
    return motifs.free_room(starts, "seq", "pos", 1000).withColumn("fits", F.col("free") >= 200)


@query("""WITH s AS (SELECT o_custkey AS seq, o_orderkey AS pos FROM orders WHERE o_orderkey % 3 <> 1), c AS (SELECT o_custkey AS seq, o_orderkey AS pos FROM orders)
SELECT c.seq, c.pos, NOT EXISTS (SELECT 1 FROM s WHERE s.seq = c.seq AND s.pos > c.pos AND s.pos < c.pos + 500) AS valid FROM c""")
def valid_foreground_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a motif of 500 fits at a place before the next start of its sequence."""
    c = b.table(spark, folder, "orders").select(F.col("o_custkey").alias("seq"), F.col("o_orderkey").alias("pos"))
    return motifs.valid_starts(c, c.where("pos % 3 <> 1"), "seq", "pos", 500)


@query(f"WITH {_STATE} SELECT cluster, round(avg(c0 + c1 + c2 + c3), 6) AS average FROM m GROUP BY cluster")
def average_counts(spark: SparkSession, folder: str) -> DataFrame:
    return motifs.average_counts(_state(spark, folder)).withColumn("average", F.round("average", 6))


_PARTITION = "SELECT user_id % 5 AS cluster, user_id AS seq, event_id AS pos FROM events WHERE user_id IS NOT NULL"


@query(f"""WITH p AS ({_PARTITION}) SELECT cluster, seq, pos FROM p WHERE pos % 4 <> 0 UNION SELECT (cluster + 1) % 5, seq, pos FROM p WHERE pos % 4 = 0""")
def partition_edit(spark: SparkSession, folder: str) -> DataFrame:
    """Every fourth element leaves its subset and joins the next one."""
    e = b.table(spark, folder, "events").where("user_id IS NOT NULL")
    p = e.select((F.col("user_id") % 5).alias("cluster"), F.col("user_id").alias("seq"), F.col("event_id").alias("pos"))
    some = p.where("pos % 4 = 0")
    return partitions.edited(p, some, some.withColumn("cluster", (F.col("cluster") + 1) % 5))


@query("SELECT DISTINCT user_id AS seq, event_id // 3 AS pos FROM events WHERE event_type IN ('click', 'view') AND user_id IS NOT NULL UNION SELECT DISTINCT user_id, event_id // 2 FROM events WHERE value > 20 AND user_id IS NOT NULL")
def used_sites(spark: SparkSession, folder: str) -> DataFrame:
    """Sites that one of two partitions uses."""
    e = b.table(spark, folder, "events").where("user_id IS NOT NULL")
    site = lambda n: (F.col("user_id").alias("seq"), F.floor(F.col("event_id") / n).cast("long").alias("pos"))
    return partitions.used_sites(e.where("event_type IN ('click', 'view')").select(*site(3)), e.where("value > 20").select(*site(2)))


@query("""WITH s AS (SELECT user_id, count(*) AS size FROM events WHERE user_id IS NOT NULL GROUP BY user_id), t AS (SELECT CAST(sum(size) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS k FROM s)
SELECT user_id, round(ln((size + 1.0) / (n + 1) * (n - k + 1) / n), 6) AS member, round(ln(k * (k - 1) / (n * (n + 1))), 6) AS fresh FROM s, t WHERE k > 1""")
def poppe_process_weights(spark: SparkSession, folder: str) -> DataFrame:
    s = b.table(spark, folder, "events").where("user_id IS NOT NULL").groupBy("user_id").agg(F.count("*").alias("size"))
    x = s.join(F.broadcast(s.agg(F.sum("size").cast("double").alias("n"), F.count("*").cast("double").alias("k")))).where("k > 1")
    weight = lambda size: F.round(mathx.poppe_process(size, F.col("n"), F.col("k")), 6)
    return x.select("user_id", weight(F.col("size")).alias("member"), weight(F.lit(0)).alias("fresh"))


@query(f"""WITH s AS (SELECT event_type, user_id, count(*) AS size FROM events WHERE user_id IS NOT NULL GROUP BY ALL) SELECT event_type,
round(count(*) * ({math.log(0.5)!r}) + {math.lgamma(0.5)!r} - lgamma(CAST(sum(size) AS DOUBLE) + 0.5) + sum(lgamma(CAST(size AS DOUBLE))), 4) AS joint FROM s GROUP BY event_type""")
def process_joint_prior(spark: SparkSession, folder: str) -> DataFrame:
    """Joint prior of a partition of each event type's events by user."""
    s = b.table(spark, folder, "events").where("user_id IS NOT NULL").groupBy("event_type", "user_id").agg(F.count("*").alias("size"))
    return s.groupBy("event_type").agg(F.round(mathx.process_joint(F.col("size"), 0.5), 4).alias("joint"))


@query("SELECT user_id, round(fsum(value), 6) + 0.0 AS total FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def kahan_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Sums with a running correction, in order of event: a user's values are one row."""
    own = F.array_sort(F.collect_list(F.struct("event_id", "value")))
    e = b.table(spark, folder, "events").where("user_id IS NOT NULL").groupBy("user_id").agg(own.alias("own"))
    return e.select("user_id", r6(mathx.kahan_sum(F.transform("own", lambda x: x["value"]))).alias("total"))


_SIGNED = ", ".join(f"coalesce(CAST(sign({x}) AS INT), 0) AS {n}_sign, round(CASE WHEN {x} <> 0 THEN ln(abs({x})) END, 6) + 0.0 AS {n}_log" for n, x in (("total", "(a + b)"), ("difference", "(a - b)"), ("product", "(a * b)"), ("ratio", "(CASE WHEN b <> 0 THEN a / b END)"), ("cube", "(b * b * b)")))


@query(f"""WITH x AS (SELECT o_orderkey, o_totalprice - 150000 AS a, CAST(o_custkey % 201 - 100 AS DOUBLE) AS b FROM orders WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL)
SELECT o_orderkey, a < b AS less, {_SIGNED} FROM x""")
def signed_log_arithmetic(spark: SparkSession, folder: str) -> DataFrame:
    """Arithmetic on numbers kept as sign and log."""
    x = b.table(spark, folder, "orders").where("o_totalprice IS NOT NULL AND o_custkey IS NOT NULL")
    x = x.select("o_orderkey", signed_log.of(F.col("o_totalprice") - 150000).alias("a"), signed_log.of((F.col("o_custkey") % 201 - 100).cast("double")).alias("b"))
    p, q = F.col("a"), F.col("b")
    results = {"total": signed_log.add(p, q), "difference": signed_log.subtract(p, q), "product": signed_log.multiply(p, q), "ratio": signed_log.divide(p, q), "cube": signed_log.power(q, 3)}
    columns = [c for n, v in results.items() for c in (F.coalesce(v["sign"], F.lit(0)).alias(f"{n}_sign"), r6(v["log"]).alias(f"{n}_log"))]  # the ratio is null where the divisor is 0
    return x.select("o_orderkey", signed_log.less(p, q).alias("less"), *columns)


_N = "(c0 + c1 + c2 + c3 + c4)"
DENSITY = [1.0, 2.0, 3.0, 0.5, 1.5]
_DENSITY = sum(map(math.lgamma, DENSITY)) - math.lgamma(sum(DENSITY))


def _theta() -> list[Column]:
    return motifs.posterior_mean(b.count_columns(), [1.0] * 5)


@query(f"""WITH {b.counts_sql('user_id, day')} SELECT user_id, CAST(day AS VARCHAR) AS day,
round({" + ".join(f"({a - 1}) * ln((c{k} + 1.0) / ({_N} + 5))" for k, a in enumerate(DENSITY))} - ({_DENSITY!r}), 6) + 0.0 AS dirichlet,
round({" + ".join(f"c{k} * ln((c{k} + 1.0) / ({_N} + 5))" for k in range(5))}, 6) + 0.0 AS multinomial FROM counts""")
def simplex_log_densities(spark: SparkSession, folder: str) -> DataFrame:
    """Log densities of smoothed frequencies: Dirichlet, and multinomial without its coefficient."""
    c = b.counts(spark, folder, ("user_id", "day"))
    return c.select("user_id", F.col("day").cast("string").alias("day"), r6(mathx.dirichlet_log_pdf(_theta(), DENSITY)).alias("dirichlet"), r6(F.log(mathx.multinomial_pdf(_theta(), b.count_columns()))).alias("multinomial"))


def _harmonic(n: str) -> str:
    return f"coalesce(list_sum(list_transform(range(1, CAST({n} AS BIGINT) + 1), lambda k: 1.0 / k)), 0.0)"


_MEANS = [f"(c{k} + 1.0) / ({_N} + 5)" for k in range(5)]


@query(f"""WITH {b.counts_sql()} SELECT user_id, {", ".join(f"round({m}, 6) AS mean{k}, round({m} * (1 - {m}) / ({_N} + 6), 8) AS var{k}" for k, m in enumerate(_MEANS))},
round(-{_MEANS[0]} * {_MEANS[1]} / ({_N} + 6), 8) + 0.0 AS cov01, round({_harmonic(_N + " + 5")} - ({" + ".join(f"{m} * {_harmonic(f'c{k} + 1')}" for k, m in enumerate(_MEANS))}), 6) AS entropy_mean FROM counts""")
def dirichlet_moments(spark: SparkSession, folder: str) -> DataFrame:
    """Moments of the posterior of each user's letter probabilities, and its mean entropy in nats."""
    alpha = [x + 1.0 for x in b.count_columns()]
    mean, var, cov, entropy = mathx.dirichlet_moments(alpha)
    columns = [c for k in range(5) for c in (F.round(mean[k], 6).alias(f"mean{k}"), F.round(var[k], 8).alias(f"var{k}"))]
    return b.counts(spark, folder).select("user_id", *columns, (F.round(cov(0, 1), 8) + F.lit(0.0)).alias("cov01"), F.round(entropy, 6).alias("entropy_mean"))


@query("""WITH x AS (SELECT c_custkey, abs(c_acctbal) / 10000 AS d FROM customer WHERE abs(c_acctbal) >= 1)
SELECT c_custkey, round(1 - exp(-d), 6) AS mutated, round((1 - exp(-d)) * 0.25 + exp(-d), 6) AS same, round((1 - exp(-d)) * 0.25, 6) AS other,
round(1.0 / d - 2.0, 6) AS log_slope, round(4 * d * exp(-2 * d) * (1.0 / d - 2.0), 6) + 0.0 AS slope FROM x""")
def mutation_model(spark: SparkSession, folder: str) -> DataFrame:
    """Probabilities along a branch with uniform letters, and slopes of its gamma density of shape 2 and scale 0.5."""
    x = b.table(spark, folder, "customer").select("c_custkey", (F.abs("c_acctbal") / 10000).alias("d")).where("d >= 0.0001")
    p = mathx.mutation_probability(F.col("d"))
    return x.select(
        "c_custkey", F.round(p, 6).alias("mutated"), F.round(p * 0.25 + (1 - p), 6).alias("same"), F.round(p * 0.25, 6).alias("other"),
        F.round(mathx.gamma_log_pdf_derivative(F.col("d"), 2.0, 0.5), 6).alias("log_slope"), r6(mathx.gamma_pdf_derivative(F.col("d"), 2.0, 0.5)).alias("slope"),
    )


_TERMS = f"{b.counts_sql('user_id, day')}, t AS (SELECT user_id, c0 % 3 AS a, c1 % 3 AS b, CAST(count(*) AS DOUBLE) AS c FROM counts GROUP BY ALL)"


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    c = b.counts(spark, folder, ("user_id", "day"))
    return c.groupBy("user_id", (F.col("c0") % 3).alias("a"), (F.col("c1") % 3).alias("b")).agg(F.count("*").cast("double").alias("c"))


@query(f"WITH {_TERMS}, u AS (SELECT * FROM t UNION ALL SELECT user_id - 1, a, b, -c FROM t) SELECT user_id, a, b, sum(c) AS c FROM u GROUP BY ALL HAVING sum(c) <> 0")
def polynomial_subtract(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's polynomial less that of the next user; terms that cancel go."""
    t = _terms(spark, folder)
    u = t.unionByName(t.select((F.col("user_id") - 1).alias("user_id"), "a", "b", (-F.col("c")).alias("c")))
    return u.groupBy("user_id", "a", "b").agg(F.sum("c").alias("c")).where("c <> 0")


@query(f"""WITH {_TERMS} SELECT user_id, count(*) AS n_terms, round(sum(c / total * power(0.3, a) * power(0.7, b)), 6) AS value, round(ln(sum(c * power(0.3, a) * power(0.7, b))), 6) AS log_value
FROM (SELECT *, sum(c) OVER (PARTITION BY user_id) AS total FROM t) GROUP BY user_id""")
def polynomial_eval(spark: SparkSession, folder: str) -> DataFrame:
    """Value at (0.3, 0.7), with normalised coefficients, and log of the value with plain ones."""
    at = F.sum(F.col("c") * F.pow(F.lit(0.3), "a") * F.pow(F.lit(0.7), "b"))
    return _terms(spark, folder).groupBy("user_id").agg(F.count("*").alias("n_terms"), F.round(at / F.sum("c"), 6).alias("value"), F.round(F.log(at), 6).alias("log_value"))


_SITE = f"{b.counts_sql('user_id, day')}, s AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY day) - 1) % 3 AS prior FROM counts)"


@query(f"WITH {_SITE} SELECT user_id, count(*) AS n_sites, round(sum(CASE prior {' '.join(f'WHEN {k} THEN {_component_sql(a)}' for k, a in enumerate(COMPONENTS))} END), 5) AS logml FROM s GROUP BY user_id")
def cyclic_prior_marginal(spark: SparkSession, folder: str) -> DataFrame:
    """Sum over the sites of an alignment; the priors take turns by place."""
    c = b.counts(spark, folder, ("user_id", "day")).withColumn("prior", (F.row_number().over(Window.partitionBy("user_id").orderBy("day")) - 1) % 3)
    value = F.lit(None).cast("double")
    for k, a in enumerate(COMPONENTS):
        value = F.when(F.col("prior") == k, mathx.dirichlet_multinomial(b.count_columns(), a)).otherwise(value)
    return c.groupBy("user_id").agg(F.count("*").alias("n_sites"), F.round(F.sum(value), 5).alias("logml"))


#: Weights of a background and two clusters: log of the foreground's share and of the process prior at sizes 60 and 30 of 90.
_FRESH = [math.log(0.9), math.log(0.1) + math.log(60 - 0.1) - math.log(90 + 0.5), math.log(0.1) + math.log(30 - 0.1) - math.log(90 + 0.5)]
_DRAW = "((user_id * 37 + c0 * 11 + c1 * 7) % 1000 + 0.5) / 1000"


@query(f"""WITH {b.counts_sql('user_id, day')}, v AS (SELECT user_id, day, {_DRAW} AS u, {", ".join(f"{_component_sql(a)} + {_FRESH[k]!r} AS w{k}" for k, a in enumerate(COMPONENTS))} FROM counts),
p AS (SELECT user_id, day, u, exp(w0 - m) AS e0, exp(w1 - m) AS e1, exp(w2 - m) AS e2 FROM (SELECT *, greatest(w0, w1, w2) AS m FROM v))
SELECT user_id, CAST(day AS VARCHAR) AS day, CASE WHEN u * (e0 + e1 + e2) <= e0 THEN 0 WHEN u * (e0 + e1 + e2) <= e0 + e1 THEN 1 ELSE 2 END AS component, round(e0 / (e0 + e1 + e2), 6) AS background FROM p""")
def mixture_draw(spark: SparkSession, folder: str) -> DataFrame:
    """The component that a given uniform number draws from cumulative mixture weights, and the background's probability."""
    weights = [mathx.dirichlet_multinomial(b.count_columns(), a) + _FRESH[k] for k, a in enumerate(COMPONENTS)]
    v = b.counts(spark, folder, ("user_id", "day")).select("user_id", "day", F.expr(_DRAW).cast("double").alias("u"), *(w.alias(f"w{k}") for k, w in enumerate(weights)))
    most = F.greatest("w0", "w1", "w2")
    v = v.select("user_id", F.col("day").cast("string").alias("day"), "u", *(F.exp(F.col(f"w{k}") - most).alias(f"e{k}") for k in range(3)))
    total = F.col("e0") + F.col("e1") + F.col("e2")
    at = F.col("u") * total
    drawn = F.when(at <= F.col("e0"), 0).when(at <= F.col("e0") + F.col("e1"), 1).otherwise(2)
    return v.select("user_id", "day", drawn.alias("component"), F.round(F.col("e0") / total, 6).alias("background"))


@query(f"""WITH {b.counts_sql('user_id, day')}, v AS (SELECT *, {", ".join(f"round({_component_sql(a)}, 6) + 0.0 AS l{k}" for k, a in enumerate(COMPONENTS))} FROM counts)
SELECT CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END AS component, count(*) AS n, {", ".join(f"CAST(sum(c{k}) AS BIGINT) AS c{k}" for k in range(5))}, round(sum(greatest(l0, l1, l2)), 3) AS logml FROM v GROUP BY 1""")
def hard_em_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """One hard assignment step of a background mixture: what each component gets."""
    logs = [r6(mathx.dirichlet_multinomial(b.count_columns(), a)).alias(f"l{k}") for k, a in enumerate(COMPONENTS)]
    v = b.counts(spark, folder, ("user_id", "day")).select("*", *logs)
    best = F.greatest("l0", "l1", "l2")
    v = v.withColumn("component", F.when(F.col("l0") == best, 0).when(F.col("l1") == best, 1).otherwise(2))
    return v.groupBy("component").agg(F.count("*").alias("n"), *(F.sum(f"c{k}").alias(f"c{k}") for k in range(5)), F.round(F.sum(best), 3).alias("logml"))


@query(f"""WITH {b.HISTORY}, s AS (SELECT step, chain, posterior, lead(posterior) OVER (PARTITION BY step ORDER BY chain) AS other FROM history)
SELECT chain, step, round(least(1.0, exp((other - posterior) / (1 + chain / 2.0) + (posterior - other) / (1 + (chain + 1) / 2.0))), 6) AS accept FROM s WHERE other IS NOT NULL""")
def temperature_swaps(spark: SparkSession, folder: str) -> DataFrame:
    """Probability that two neighbouring chains of a ladder exchange their states at a step."""
    hot = lambda c: 1 + c / 2.0
    s = b.history(spark, folder).withColumn("other", F.lead("posterior").over(Window.partitionBy("step").orderBy("chain"))).where("other IS NOT NULL")
    gain = (F.col("other") - F.col("posterior")) / hot(F.col("chain")) + (F.col("posterior") - F.col("other")) / hot(F.col("chain") + 1)
    return s.select("chain", "step", F.round(F.least(F.lit(1.0), F.exp(gain)), 6).alias("accept"))


@query(f"WITH {b.SPLITS} SELECT tree, count(*) AS n_edges, CAST(sum(CASE WHEN d >= 10 THEN 1 ELSE 0 END) AS BIGINT) AS n_kept, round(sqrt(sum(CASE WHEN d >= 10 THEN d * d ELSE 0.0 END)), 6) AS norm FROM splits GROUP BY tree")
def short_edge_cut(spark: SparkSession, folder: str) -> DataFrame:
    """Edges shorter than 10 are cut from every tree; number and Euclidean length of the others."""
    kept = F.col("d") >= 10
    norm = F.sqrt(F.sum(F.when(kept, F.col("d") * F.col("d")).otherwise(0.0)))
    return b.splits(spark, folder).groupBy("tree").agg(F.count("*").alias("n_edges"), F.sum(kept.cast("long")).alias("n_kept"), F.round(norm, 6).alias("norm"))


_CONE = f"""{b.SPLITS}, e AS (SELECT tree AS pair, split, d AS x, NULL AS y FROM splits UNION ALL SELECT tree - 1, split, NULL, d FROM splits),
p AS (SELECT pair, split, max(x) AS x, max(y) AS y FROM e GROUP BY ALL), n AS (SELECT pair, sqrt(sum(CASE WHEN y IS NULL THEN x * x ELSE 0.0 END)) AS a, sqrt(sum(CASE WHEN x IS NULL THEN y * y ELSE 0.0 END)) AS b,
sum(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN (x - y) * (x - y) ELSE 0.0 END) AS common FROM p GROUP BY pair HAVING count(x) > 0 AND count(y) > 0)"""


#: Rows of lineitem in a task of the cone queries.
CONE_ROWS = 500_000


def _cone(spark: SparkSession, folder: str) -> DataFrame:
    """(pair, split, x, y): lengths of an edge in a tree and in the one of the next number.

    One exchange by pair serves these sums and all sums by pair. Its number of tasks grows with the table, so that a task's memory doesn't.
    """
    rows, none = b.table(spark, folder, "lineitem"), F.lit(None).cast("double")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // CONE_ROWS))
    d = F.col("l_quantity")
    sides = F.explode(F.array(F.struct(F.col("l_orderkey").alias("pair"), d.alias("x"), none.alias("y")), F.struct((F.col("l_orderkey") - 1).alias("pair"), none.alias("x"), d.alias("y"))))
    e = rows.select(F.col("l_suppkey").alias("split"), sides.alias("s")).select("s.pair", "split", "s.x", "s.y").repartition(tasks, "pair")
    return e.groupBy("pair", "split").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


def _norms(p: DataFrame) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    n = p.groupBy("pair").agg(
        F.sqrt(F.sum(F.when(y.isNull(), x * x).otherwise(0.0))).alias("a"), F.sqrt(F.sum(F.when(x.isNull(), y * y).otherwise(0.0))).alias("b"),
        F.sum(F.when(x.isNotNull() & y.isNotNull(), (x - y) * (x - y)).otherwise(0.0)).alias("common"), F.count(x).alias("nx"), F.count(y).alias("ny"),
    )
    return n.where("nx > 0 AND ny > 0").select("pair", "a", "b", "common")


def _with_norms(p: DataFrame) -> DataFrame:
    """The rows of pairs that have both trees, with the norms of the edges of either tree alone."""
    x, y, own = F.col("x"), F.col("y"), Window.partitionBy("pair")
    norm = lambda c, other: F.sqrt(F.sum(F.when(other.isNull(), c * c).otherwise(0.0)).over(own))
    p = p.select("pair", "split", "x", "y", norm(x, y).alias("a"), norm(y, x).alias("b"), F.count(x).over(own).alias("nx"), F.count(y).over(own).alias("ny"))
    return p.where("nx > 0 AND ny > 0")


@query(f"WITH {_CONE} SELECT pair, round(sqrt((a + b) * (a + b) + common), 6) AS length, round(CASE WHEN b > 0 THEN a / b END, 6) AS ratio FROM n")
def cone_path_length(spark: SparkSession, folder: str) -> DataFrame:
    """Length of the path through the trees' common edges: all edges of one shrink before those of the other grow. An upper bound of the distance."""
    n = _norms(_cone(spark, folder))
    length = F.sqrt((F.col("a") + F.col("b")) * (F.col("a") + F.col("b")) + F.col("common"))
    return n.select("pair", F.round(length, 6).alias("length"), F.round(F.when(F.col("b") > 0, F.col("a") / F.col("b")), 6).alias("ratio"))


@query(f"""WITH {_CONE}, q AS (SELECT pair, split, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 0.6 * x + 0.4 * y WHEN y IS NULL AND 0.6 * a > 0.4 * b THEN x * (0.6 * a - 0.4 * b) / a
WHEN x IS NULL AND 0.6 * a <= 0.4 * b THEN y * (0.4 * b - 0.6 * a) / b END AS d FROM p JOIN n USING (pair)) SELECT pair, split, round(d, 5) AS d FROM q WHERE d > 0""")
def cone_path_point(spark: SparkSession, folder: str) -> DataFrame:
    """The tree at 0.4 of that path."""
    p = _with_norms(_cone(spark, folder)).where("pair IS NOT NULL")
    x, y, left, grown = F.col("x"), F.col("y"), 0.6 * F.col("a"), 0.4 * F.col("b")
    d = F.when(x.isNotNull() & y.isNotNull(), 0.6 * x + 0.4 * y).when(y.isNull() & (left > grown), x * (left - grown) / F.col("a")).when(x.isNull() & (left <= grown), y * (grown - left) / F.col("b"))
    return p.select("pair", "split", d.alias("d")).where("d > 0").withColumn("d", F.round("d", 5))


@query(f"""WITH {_CONE} SELECT pair, split, CASE WHEN y IS NULL THEN 0 ELSE 1 END AS side, round(CASE WHEN y IS NULL THEN x * x / (a * a) ELSE y * y / (b * b) END, 6) AS weight
FROM p JOIN n USING (pair) WHERE (x IS NULL) <> (y IS NULL)""")
def cover_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of the edges of one tree alone in the graph of incompatible edges; they sum to 1 on each side."""
    p = _with_norms(_cone(spark, folder)).where("isnull(x) <> isnull(y)")
    w = F.when(F.col("y").isNull(), F.col("x") * F.col("x") / (F.col("a") * F.col("a"))).otherwise(F.col("y") * F.col("y") / (F.col("b") * F.col("b")))
    return p.select("pair", "split", F.when(F.col("y").isNull(), 0).otherwise(1).alias("side"), F.round(w, 6).alias("weight"))


@query("SELECT k, round(1 / (2 * (1 + k / 4.0)), 6) AS step, round(1 / (1 + k / 4.0) / (1 + 1 / (1 + k / 4.0)), 6) AS mean_share FROM (SELECT unnest(range(100)) AS k)")
def mean_step_schedule(spark: SparkSession, folder: str) -> DataFrame:
    step = 1 / (2 * (1 + F.col("id") / 4.0))
    return spark.range(100).select(F.col("id").alias("k"), F.round(step, 6).alias("step"), F.round(2 * step / (1 + 2 * step), 6).alias("mean_share"))
