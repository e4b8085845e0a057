"""Queries on background models that are fitted to the columns of all alignment blocks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.operators import alignment_blocks, backgrounds, integrated, logo, saved
from cladewise.registry import query

from . import bindings as b
from .sample_queries import COMPONENTS, _component_sql

COLUMNS = [f"c{k}" for k in range(5)]
#: Weights of the components, halved from one to the next, and shape and scale of the prior of pseudocounts.
WEIGHTS = [0.5**k / 1.75 for k in range(len(COMPONENTS))]
SHAPE, SCALE = 2.0, 2.0


def column_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(aln, pos, c0..c4): how many species have each letter in a column; missing ones count nowhere."""
    blocks = b.alignment_blocks(spark, folder)
    tally = lambda k: F.size(F.filter("codes", lambda x: x == k)).cast("long")
    return blocks.select("aln", "pos", *(tally(k).alias(c) for k, c in enumerate(COLUMNS)))


_PATTERNS = (
    f"{b.CELLS}, columns_ AS (SELECT aln, pos, {', '.join(f'count(*) FILTER (code = {k}) AS c{k}' for k in range(5))} FROM cells GROUP BY aln, pos), "
    "patterns AS (SELECT c0, c1, c2, c3, c4, count(*) AS n FROM columns_ GROUP BY ALL)"
)
_SCORED = ", ".join(f"{_component_sql(a)} + ({math.log(w)!r}) AS s{k}" for k, (a, w) in enumerate(zip(COMPONENTS, WEIGHTS)))
_ARGMAX = "CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END"
_PSEUDOCOUNTS = ", ".join(f"({k}, {j}, {x!r}::DOUBLE, {sum(a)!r}::DOUBLE)" for k, a in enumerate(COMPONENTS) for j, x in enumerate(a))
#: digamma(v + a) - digamma(a) of a whole number v is a sum of v reciprocals.
_RISE = "coalesce(list_sum(list_transform(range({v}), lambda i: 1.0 / ({a} + i))), 0.0)"


@query(f"""WITH {_PATTERNS}, scored AS (SELECT *, {_SCORED} FROM patterns),
assigned AS (SELECT {_ARGMAX} AS component, [c0, c1, c2, c3, c4] AS c, c0 + c1 + c2 + c3 + c4 AS total, n FROM scored),
a(component, coordinate, alpha, whole) AS (VALUES {_PSEUDOCOUNTS}),
part AS (SELECT a.component, coordinate, alpha, n, {_RISE.format(v='c[coordinate + 1]', a='alpha')} - {_RISE.format(v='total', a='whole')} AS x FROM a JOIN assigned USING (component)),
g AS (SELECT component, coordinate, any_value(alpha) AS alpha, CAST(sum(n) AS BIGINT) AS sites, sum(n * x) + ({SHAPE - 1}) / any_value(alpha) - {1 / SCALE} AS slope FROM part GROUP BY component, coordinate)
SELECT component, coordinate, sites, round(slope, 5) + 0.0 AS slope, round(CASE WHEN alpha + 0.1 * sign(slope) > 0 THEN alpha + 0.1 * sign(slope) ELSE 0.05 END, 6) AS alpha FROM g""")
def default_background_step(spark: SparkSession, folder: str) -> DataFrame:
    """Columns assigned to the background's components, the slope of the log posterior by their pseudocounts, and one step by its signs."""
    now, w = np.array(COMPONENTS), np.array(WEIGHTS)
    assigned = backgrounds.assignments(backgrounds.count_patterns(column_counts(spark, folder), COLUMNS), COLUMNS, now, w)
    gradient, sums = backgrounds.pseudocount_gradient(backgrounds.value_statistics(assigned, COLUMNS), now.shape, SHAPE, SCALE)
    slope = gradient(now)
    sites = sums["n"]
    new, _ = backgrounds.sign_step(now, slope, None, np.full(now.shape, 0.1))
    rows = [(k, j, int(sites[k]), round(float(slope[k, j]), 5) + 0.0, round(float(new[k, j]), 6)) for k, j in np.ndindex(*now.shape) if sites[k]]
    return spark.createDataFrame(rows, "component int, coordinate int, sites long, slope double, alpha double")


@query()
def default_background_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Fitted pseudocounts of the background's components, from all columns."""
    fit, _ = backgrounds.fit_pseudocounts(column_counts(spark, folder), COLUMNS, list(COMPONENTS), WEIGHTS, SHAPE, SCALE)
    return fit.withColumn("alpha", F.round("alpha", 6))


ROUNDS = 3


def _digamma_sql(x: str) -> str:
    z = f"({x} + 8.0)"
    back = " + ".join(f"1.0 / ({x} + {k}.0)" for k in range(8))
    s = f"(1.0 / ({z} * {z}))"
    return f"(ln({z}) - 0.5 / {z} - {s} * (1.0 / 12 - {s} * (1.0 / 120 - {s} * (1.0 / 252 - {s} / 240))) - ({back}))"


def _rounds_sql() -> str:
    start = ", ".join(f"({k}, {w!r}::DOUBLE, " + ", ".join(f"{x!r}::DOUBLE" for x in a) + ")" for k, (a, w) in enumerate(zip(COMPONENTS, WEIGHTS)))
    names = ", ".join(f"t{j}" for j in range(5))
    out = [f"t0_(component, w, {names}) AS (VALUES {start})"]
    for r in range(ROUNDS):
        logs = ", ".join(f"{_digamma_sql(f't{j}')} - {_digamma_sql('(t0 + t1 + t2 + t3 + t4)')} AS e{j}" for j in range(5))
        out.append(f"e{r}_ AS (SELECT component, w, {logs} FROM t{r}_)")
        score = " + ".join(f"c{j} * e{j}" for j in range(5)) + " + ln(w)"
        out.append(f"z{r}_ AS (SELECT c0, c1, c2, c3, c4, any_value(n) AS n, arg_max(component, (s, -component)) AS component FROM (SELECT p.*, component, {score} AS s FROM patterns p, e{r}_) GROUP BY c0, c1, c2, c3, c4)")
        out.append(f"m{r}_ AS (SELECT component, CAST(sum(n) AS BIGINT) AS sites, {', '.join(f'sum(n * c{j}) AS c{j}' for j in range(5))} FROM z{r}_ GROUP BY component)")
        totals = ", ".join(f"b.t{j} + coalesce(m.c{j}, 0) AS t{j}" for j in range(5))
        out.append(f"t{r + 1}_ AS (SELECT component, w, {totals} FROM t0_ b LEFT JOIN m{r}_ m USING (component))")
    return ", ".join(out)


@query(f"""WITH {_PATTERNS}, {_rounds_sql()}
SELECT t.component, coalesce(sites, 0) AS sites, {", ".join(f"coalesce(CAST(c{j} AS DOUBLE), 0.0) AS c{j}" for j in range(5))} FROM t0_ t LEFT JOIN m{ROUNDS - 1}_ USING (component)""")
def mixture_background_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """A mixture's sites and counts after three rounds of assignments to all columns."""
    found, _ = backgrounds.fit_mixture(column_counts(spark, folder), COLUMNS, list(COMPONENTS), WEIGHTS, ROUNDS)
    return found


@query()
def mixture_background_trace(spark: SparkSession, folder: str) -> DataFrame:
    """Rounds of the same mixture until no column changes its component: how many did, and the log probability."""
    _, trace = backgrounds.fit_mixture(column_counts(spark, folder), COLUMNS, list(COMPONENTS), WEIGHTS)
    return trace.withColumn("log_likelihood", F.round("log_likelihood", 4))


_PRIOR = [1.0, 1.0, 1.0, 1.0, 2.0]
_WHOLE = f"(c0 + c1 + c2 + c3 + c4 + {sum(_PRIOR)})"


@query(f"""WITH {_PATTERNS}, most AS (SELECT max(c0 + c1 + c2 + c3 + c4) AS most FROM columns_)
SELECT aln, pos, round({" + ".join(f"(c{k} + {p}) / {_WHOLE} * ({_digamma_sql(f'(c{k} + {p + 1})')} - ({math.log(p / sum(_PRIOR))!r}))" for k, p in enumerate(_PRIOR))} - {_digamma_sql(f'({_WHOLE} + 1.0)')}, 6) + 0.0 AS entropy,
round((c0 + c1 + c2 + c3 + c4) / most::DOUBLE, 6) AS weight FROM columns_, most""")
def logo_data(spark: SparkSession, folder: str) -> DataFrame:
    """Relative entropy and weight of every alignment column, as a logo shows them."""
    found = logo.logo_entropy(column_counts(spark, folder), COLUMNS, _PRIOR)
    return found.select("aln", "pos", (F.round("entropy", 6) + F.lit(0.0)).alias("entropy"), F.round("weight", 6).alias("weight"))


@query()
def logo_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Credible intervals of the columns' relative entropies, one row per distinct column."""
    found = logo.entropy_intervals(column_counts(spark, folder), COLUMNS, _PRIOR)
    return found.withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query("""WITH RECURSIVE r AS (SELECT source AS file, doc_id, lang AS taxon, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM documents),
p AS (SELECT *, lag(pos) OVER (PARTITION BY file, taxon ORDER BY pos) AS prev FROM r),
jump AS (SELECT r.file, r.pos, min(p.pos) AS stop FROM r JOIN p ON p.file = r.file AND p.prev >= r.pos AND p.taxon IS NOT NULL GROUP BY r.file, r.pos),
starts AS (SELECT DISTINCT file, CAST(0 AS BIGINT) AS pos FROM r UNION ALL SELECT s.file, j.stop FROM starts s JOIN jump j ON j.file = s.file AND j.pos = s.pos)
SELECT r.file, r.doc_id, r.pos, count(*) - 1 AS block FROM r JOIN starts s ON s.file = r.file AND s.pos <= r.pos GROUP BY r.file, r.doc_id, r.pos""")
def block_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of the documents of each source, in order of id: one ends where a language comes again."""
    d = b.table(spark, folder, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("at"), F.lit(0).alias("rec"), "doc_id", F.col("lang").alias("taxon"))
    return alignment_blocks.blocks_of(d).select("file", "doc_id", "pos", "block")


@query()
def cached_background(spark: SparkSession, folder: str) -> DataFrame:
    """Marginals of the columns' counts under gamma pseudocounts, from a stored table with a fingerprint of what it was made of."""
    make, store = lambda: integrated.gamma_prior(5, 5.0, 0.2, integrated.DRAWS, 1), saved.Saved(spark, "marginals").base
    counts = column_counts(spark, folder)
    found = integrated.stored_marginals(counts, COLUMNS, make, {"prior": "gamma", "shape": 5.0, "scale": 0.2, "draws": integrated.DRAWS, "seed": 1}, store)
    return found.select("aln", "pos", F.round("logml", 6).alias("logml"))
