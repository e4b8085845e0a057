"""Background models with fitted parameters: mixtures of Dirichlet-multinomials over letter counts of sites.

Both fits work on the distinct count vectors with their numbers (``count_patterns``), a table whose size is that of the patterns, not of
the data. Every round is one aggregation over it; what reaches the driver is one row per component, or the statistics below.

* ``fit_pseudocounts`` alternates hard assignments and an ascent of every component's pseudocounts under a gamma prior. The ascent
  needs, of all vectors, only how often a component's coordinate (and the vectors' sum) has each value.
* ``fit_mixture`` keeps pseudocounts and assigns vectors by the components' counts until no assignment changes. All vectors
  move at once. A component's marginal probability is convex in its counts, so its tangent, by which vectors choose,
  bounds it from below: the log probability never falls.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.functions import mathx

#: Rows of the statistics up to which the ascent runs on the driver; beyond them every gradient is one job over their table.
FEW_STATISTICS = 200_000
#: Which coordinate of the statistics is the vectors' sum.
TOTAL = -1
SUMS = ("n", "score", "changed")
FIT = "component int, coordinate int, alpha double, sites long"
TRACE = "round int, changed long, log_likelihood double"


def count_patterns(counts: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct vectors of ``columns`` with their number ``n``; vectors with a null are left out."""
    return counts.where(" AND ".join(f"{c} IS NOT NULL" for c in columns)).groupBy(*columns).agg(F.count("*").alias("n"))


def _first_greatest(scores: list[Column]) -> Column:
    """Index of the greatest of some columns, the first of equal ones."""
    most = F.greatest(*scores) if len(scores) > 1 else scores[0]
    out = F.when(scores[0] == most, 0)
    for k, s in enumerate(scores[1:], 1):
        out = out.when(s == most, k)
    return out


def _beside(rows: DataFrame, **tables: np.ndarray) -> DataFrame:
    """``rows`` with one more column a table (rows x columns of numbers), the same in every row.

    Parameters that change from round to round are data, so that the plan's code is the same and compiled once.
    """
    one = rows.sparkSession.createDataFrame([tuple(t.tolist() for t in tables.values())], ", ".join(f"{name} array<array<double>>" for name in tables))
    return rows.crossJoin(F.broadcast(one))  # one row


def _marginal_table(alpha: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each component its pseudocounts, their sum, and its log weight without the log of the pseudocounts' beta function."""
    return np.array([[*a, sum(a), math.log(w) - sum(map(math.lgamma, a)) + math.lgamma(sum(a))] for a, w in zip(alpha.tolist(), weights.tolist())])


def component_scores(columns: list[str], table: str, n_components: int) -> list[Column]:
    """Log marginal probability of a vector under each component of a ``_marginal_table``, with the component's log weight."""
    m, total = len(columns), "(" + " + ".join(columns) + ")"
    rows = [" + ".join(mathx.lgamma_text(f"({c} + {table}[{k}][{j}])") for j, c in enumerate(columns)) for k in range(n_components)]
    return [F.expr(f"{x} + {table}[{k}][{m + 1}] - " + mathx.lgamma_text(f"({total} + {table}[{k}][{m}])")) for k, x in enumerate(rows)]


def assignments(patterns: DataFrame, columns: list[str], alpha: np.ndarray, weights: np.ndarray, previous: np.ndarray | None = None) -> DataFrame:
    """``patterns`` with ``component``, the one of greatest score (the first of equal ones), that ``score``, and whether it was ``changed`` since pseudocounts ``previous``.

    Both assignments are functions of a row, so none is stored.
    """
    now = _marginal_table(alpha, weights)
    rows = _beside(patterns, now=now, before=now if previous is None else _marginal_table(previous, weights))
    scores = {f"__{table}{k}": s for table in ("now", "before") for k, s in enumerate(component_scores(columns, table, len(alpha)))}
    names = {table: [F.col(f"__{table}{k}") for k in range(len(alpha))] for table in ("now", "before")}
    component, best = _first_greatest(names["now"]), F.greatest(*names["now"]) if len(alpha) > 1 else names["now"][0]
    changed = F.lit(previous is None) | (component != _first_greatest(names["before"]))
    return rows.select(*columns, "n", *(s.alias(c) for c, s in scores.items())).select(*columns, "n", component.alias("component"), best.alias("score"), changed.alias("changed"))


def value_statistics(assigned: DataFrame, columns: list[str]) -> DataFrame:
    """(component, coordinate, value, n, score, changed): how many sites of a component have which value in a coordinate; coordinate -1 is their sum.

    ``score`` sums the sites' scores, and ``changed`` counts those that changed their component.
    """
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    cells = F.array(*(F.struct(F.lit(j).alias("coordinate"), x.cast("double").alias("value")) for j, x in [(TOTAL, total), *((j, F.col(c)) for j, c in enumerate(columns))]))
    rows = assigned.select("component", "n", "score", "changed", F.explode(cells).alias("c")).select("component", "c.coordinate", "c.value", "n", "score", "changed")
    sums = (F.sum("n").alias("n"), F.sum(F.col("n") * F.col("score")).alias("score"), F.sum(F.col("n") * F.col("changed").cast("int")).alias("changed"))
    return rows.groupBy("component", "coordinate", "value").agg(*sums)


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    back, z = sum(1 / (x + k) for k in range(8)), x + 8
    s = 1 / (z * z)
    return np.log(z) - 0.5 / z - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s / 240))) - back


def log_gamma_slope(alpha: np.ndarray, shape: float, scale: float) -> np.ndarray:
    return (shape - 1) / alpha - 1 / scale


Gradient = Callable[[np.ndarray], np.ndarray]


def pseudocount_gradient(statistics: DataFrame, size: tuple[int, int], shape: float, scale: float) -> tuple[Gradient, pd.DataFrame]:
    """The gradient of the log posterior by the pseudocounts (components x coordinates) as a function of them, and n, score and changed of every component.

    The likelihood's part is a sum of digamma(value + a) - digamma(a), over a coordinate's values with a its pseudocount, minus
    the same over the sums with a the component's total.
    """
    n_components, n_coordinates = size
    few = statistics.limit(FEW_STATISTICS + 1).toPandas()
    if len(few) <= FEW_STATISTICS:
        sums = few[few["coordinate"] == TOTAL]
        k, j, v, n = (few[c].to_numpy() for c in ("component", "coordinate", "value", "n"))

        def gradient(alpha: np.ndarray) -> np.ndarray:
            a = np.where(j == TOTAL, alpha.sum(1)[k], alpha[k, np.maximum(j, 0)])
            part = n * (digamma(v + a) - digamma(a))
            out = np.zeros((n_components, n_coordinates + 1))
            np.add.at(out, (k, np.where(j == TOTAL, n_coordinates, j)), part)
            return out[:, :-1] - out[:, -1:] + log_gamma_slope(alpha, shape, scale)

        return gradient, _by_component(sums, n_components)
    sums = statistics.where(F.col("coordinate") == TOTAL).groupBy("component").agg(*(F.sum(c).alias(c) for c in SUMS)).toPandas()  # one row a component

    def gradient_by_job(alpha: np.ndarray) -> np.ndarray:
        table = F.array(*(F.array(*(F.lit(float(x)) for x in [*row, row.sum()])) for row in alpha))
        a = table[F.col("component")][F.when(F.col("coordinate") == TOTAL, n_coordinates).otherwise(F.col("coordinate"))]
        rows = statistics.select("component", "coordinate", "value", "n", a.alias("a"))
        rows = rows.groupBy("component", "coordinate").agg(F.sum(F.col("n") * (mathx.digamma(F.col("value") + F.col("a")) - mathx.digamma(F.col("a")))).alias("x"))
        out = np.zeros((n_components, n_coordinates + 1))
        for r in rows.collect():  # components x coordinates
            out[r["component"], n_coordinates if r["coordinate"] == TOTAL else r["coordinate"]] = r["x"]
        return out[:, :-1] - out[:, -1:] + log_gamma_slope(alpha, shape, scale)

    return gradient_by_job, _by_component(sums, n_components)


def _by_component(sums: pd.DataFrame, n_components: int) -> pd.DataFrame:
    return sums.groupby("component")[list(SUMS)].sum().reindex(range(n_components), fill_value=0)


def sign_step(alpha: np.ndarray, slope: np.ndarray, before: np.ndarray | None, step: np.ndarray, rate: float = 0.5, least: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """One step by the gradient's signs: (new pseudocounts, new steps). A step grows while its sign stays and shrinks when it turns; none goes below ``least``."""
    new = np.where(alpha + np.sign(slope) * step > 0, alpha + np.sign(slope) * step, least)
    if before is not None:
        turn = np.sign(slope * before)
        step = step * np.where(turn > 0, 1 + rate, np.where(turn < 0, 1 - rate, 1.0))
    return new, step


def ascend(gradient: Gradient, alpha: np.ndarray, first: float = 0.1, rate: float = 0.5, least: float = 0.05, enough: float = 0.1, steps: int = 10_000) -> np.ndarray:
    """Pseudocounts at which the gradient's absolute entries sum to less than ``enough``, or after so many steps, or where all steps have vanished."""
    step, before = np.full(alpha.shape, first), None
    for _ in range(steps):
        slope = gradient(alpha)
        # an entry at its lower end that points further down can't move
        held = (alpha <= least) & (slope < 0)
        if np.abs(np.where(held, 0.0, slope)).sum() < enough or step.max() < 1e-12:
            break
        new, step = sign_step(alpha, np.where(held, 0.0, slope), before, step, rate, least)
        alpha, before = new, slope
    return alpha


def fit_pseudocounts(
    counts: DataFrame, columns: list[str], alpha: list[list[float]], weights: list[float], shape: float = 2.0, scale: float = 2.0, rounds: int = 50,
) -> tuple[DataFrame, DataFrame]:
    """(component, coordinate, alpha, sites) of a fitted background, and its trace (round, changed, log_likelihood).

    Each round assigns every vector to its component of greatest score and climbs to pseudocounts of zero slope. It ends when no vector
    changes its component, or after ``rounds`` rounds. ``weights`` stay. The log likelihood is that of the assigned vectors and, by
    the gamma prior (``shape``, ``scale``), of the pseudocounts. A component without vectors goes to the prior's mode. An empty table
    leaves prior modes; vectors with nulls take no part, zero vectors add nothing, and equal vectors share a component.
    """
    spark = counts.sparkSession
    patterns = count_patterns(counts, columns).persist()
    now, w = np.array(alpha, float), np.array(weights, float) / sum(weights)
    previous, trace, sites = None, [], np.zeros(len(now))
    try:
        for k in range(rounds):
            statistics = value_statistics(assignments(patterns, columns, now, w, previous), columns)
            gradient, sums = pseudocount_gradient(statistics, now.shape, shape, scale)
            prior = float(((shape - 1) * np.log(now) - now / scale - math.lgamma(shape) - shape * math.log(scale)).sum())
            sites = sums["n"].to_numpy()
            trace.append((k, int(sums["changed"].sum()), float(sums["score"].sum()) + prior))
            if k and not trace[-1][1]:
                break
            previous, now = now, ascend(gradient, now)
    finally:
        patterns.unpersist()
    rows = [(k, j, float(now[k, j]), int(sites[k])) for k in range(now.shape[0]) for j in range(now.shape[1])]
    return spark.createDataFrame(rows, FIT), spark.createDataFrame(trace, TRACE)


def _expected_logs(totals: np.ndarray) -> np.ndarray:
    return digamma(totals) - digamma(totals.sum(1, keepdims=True))


def _tangent_table(totals: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.hstack([_expected_logs(totals), np.log(weights)[:, None]])


def tangent_component(columns: list[str], table: str, n_components: int) -> Column:
    """The component whose tangent at its counts and pseudocounts gives a vector most; a zero vector goes by weight."""
    entry = lambda k, j: F.col(table)[k][j]
    return _first_greatest([sum((F.col(c) * entry(k, j) for j, c in enumerate(columns)), entry(k, len(columns))) for k in range(n_components)])


def mixture_log_probability(totals: np.ndarray, alpha: np.ndarray, sites: np.ndarray, weights: np.ndarray) -> float:
    """Log probability of assigned vectors: each component's counts under its pseudocounts, and the weights of the assignments."""
    mbeta = lambda x: sum(map(math.lgamma, x)) - math.lgamma(sum(x))
    return sum(mbeta(t) - mbeta(a) for t, a in zip(totals.tolist(), alpha.tolist())) + float((sites * np.log(weights)).sum())


def fit_mixture(counts: DataFrame, columns: list[str], alpha: list[list[float]], weights: list[float], rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(component, sites, one column of summed counts per coordinate), and the trace (round, changed, log_likelihood).

    Vectors start by the pseudocounts alone. It ends when no vector changes its component (the log likelihood rises until then, so
    that comes) or after ``rounds`` rounds. Nulls, zeros and equal vectors as in ``fit_pseudocounts``; an empty table gives zeros.
    """
    spark = counts.sparkSession
    patterns = count_patterns(counts, columns).persist()
    a, w = np.array(alpha, float), np.array(weights, float) / sum(weights)
    previous, totals, trace, sums, sites = None, a, [], np.zeros(a.shape), np.zeros(len(a))
    try:
        k = 0
        while rounds is None or k < rounds:
            now = _tangent_table(totals, w)
            both = _beside(patterns, now=now, before=now if previous is None else _tangent_table(previous, w))
            component, before = (tangent_component(columns, t, len(a)) for t in ("now", "before"))
            changed = (F.lit(previous is None) | (component != before)).cast("int")
            rows = both.select(*columns, "n", component.alias("component"), changed.alias("changed")).groupBy("component")
            found = rows.agg(F.sum("n").alias("sites"), F.sum(F.col("n") * F.col("changed")).alias("changed"), *(F.sum(F.col("n") * F.col(c)).alias(c) for c in columns)).collect()
            sums, sites = np.zeros(a.shape), np.zeros(len(a))
            for r in found:  # one row a component
                sums[r["component"]], sites[r["component"]] = [r[c] for c in columns], r["sites"]
            moved = sum(r["changed"] for r in found)
            previous, totals = totals, a + sums
            trace.append((k, int(moved), mixture_log_probability(totals, a, sites, w)))
            k += 1
            if k > 1 and not moved or not found:
                break
    finally:
        patterns.unpersist()
    schema = "component int, sites long, " + ", ".join(f"{c} double" for c in columns)
    return spark.createDataFrame([(k, int(sites[k]), *map(float, sums[k])) for k in range(len(a))], schema), spark.createDataFrame(trace, TRACE)
