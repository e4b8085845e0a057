"""Divergence of a Dirichlet distribution from a column's posterior, by recursive stratified sampling, and the best scale of its parameters.

The posterior of the letters' probabilities given a column is a mixture of Dirichlet distributions (one a term of the column's polynomial), so
its divergence from another Dirichlet distribution has no closed form. The simplex is mapped to a cube, which is cut in halves again and
again: a stratum samples a part of its calls, cuts the side that leaves the least spread, and gives its halves calls by their spread. Columns are rows, dealt
evenly by key: a column is cut and sampled in one go, as its calls are bounded. The error is that of the strata's means.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .saved import Saved
from .trees import column_polynomial, log_marginal, parse_newick

TARGET = "key long, xi array<double>, exponents array<array<int>>, coefficients array<double>, logml double"
#: Part of a stratum's calls that looks for the best cut, and the fewest calls of a half.
LOOK, FEWEST = 0.05, 16
#: Points of a stratum whose random numbers are kept for the next column, and points that are evaluated at a time.
KEPT, POINTS = 4096, 8192


def column_targets(patterns: DataFrame, newick: str, taxa: list[str], alpha: list[float]) -> DataFrame:
    """(key, xi, exponents, coefficients, logml) of distinct columns (key, codes, xi): what a divergence needs of them."""

    def polynomials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = parse_newick(newick)
        for batch in batches:
            polys = [column_polynomial(root, dict(zip(taxa, c)), len(alpha)) for c in batch.column(1).to_pylist()]
            columns = [[list(map(list, p)) for p in polys], [list(p.values()) for p in polys], [log_marginal(p, alpha) for p in polys]]
            kinds = [pa.list_(pa.list_(pa.int32())), pa.list_(pa.float64()), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["key", "xi", "exponents", "coefficients", "logml"])

    return patterns.select("key", "codes", "xi").mapInArrow(polynomials, TARGET)


def on_simplex(u: np.ndarray) -> np.ndarray:
    """Points of the unit cube to the simplex of one more coordinate, evenly; none is zero."""
    k = u.shape[1] + 1
    out, left = np.empty((len(u), k)), np.ones(len(u))
    for i in range(k - 1):
        own = left * -np.expm1(np.log(np.maximum(u[:, i], 1e-300)) / (k - 1 - i))
        out[:, i], left = own, left - own
    out[:, -1] = left
    return np.maximum(out, 1e-300)


def _dirichlet_log(x: np.ndarray) -> float:
    return math.lgamma(x.sum()) - sum(map(math.lgamma, x.tolist()))


class Target:
    """The integrand over the cube: the density under ``xi`` times the log of its ratio to the posterior's, which is small where both agree."""

    def __init__(self, xi: list[float], exponents: list[list[int]], coefficients: list[float], logml: float, alpha: list[float]) -> None:
        self.xi, self.alpha = np.array(xi), np.array(alpha)
        self.exponents, self.logs = np.array(exponents, float).reshape(-1, len(alpha)), np.log(np.array(coefficients))
        self.base = _dirichlet_log(self.alpha) - logml
        self.volume = math.lgamma(len(alpha))  # even points have a density of their own on the simplex
        self.scale = _dirichlet_log(self.xi) - self.volume

    def __call__(self, u: np.ndarray) -> np.ndarray:
        logs = np.log(on_simplex(u))
        terms = logs @ self.exponents.T + self.logs
        most = terms.max(1)
        p = most + np.log(np.exp(terms - most[:, None]).sum(1)) + logs @ (self.alpha - 1) + self.base
        q = logs @ (self.xi - 1) + self.scale
        return np.exp(q) * (q + self.volume - p)


#: Number, lowest and highest corner, and calls of a part of the cube.
Stratum = tuple[int, np.ndarray, np.ndarray, int]


def _draws(seed: int, sides: int) -> Callable[[int, int, int], np.ndarray]:
    """Random points of the unit cube by stratum and level, the same for all columns; fewer are the first ones of more."""
    known: dict[tuple[int, int], np.ndarray] = {}

    def draws(stratum: int, level: int, n: int) -> np.ndarray:
        found = known.get((stratum, level))
        if found is None or len(found) < n:
            found = np.random.Generator(np.random.PCG64([seed, stratum, level])).random((n, sides))
            if n <= KEPT:
                known[stratum, level] = found
        return found[:n]

    return draws


def _values(target: Target, strata: list[Stratum], sizes: list[int], level: int, draws: Callable[[int, int, int], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Points and values of each stratum, some strata at a time."""
    at = 0
    while at < len(strata):
        to, n = at + 1, sizes[at]
        while to < len(strata) and n + sizes[to] <= POINTS:
            n, to = n + sizes[to], to + 1
        points = [low + (high - low) * draws(k, level, size) for (k, low, high, _), size in zip(strata[at:to], sizes[at:to])]
        values = target(np.concatenate(points))
        ends = np.cumsum(sizes[at:to]).tolist()
        yield from ((u, values[end - len(u) : end]) for u, end in zip(points, ends))
        at = to


def best_cut(u: np.ndarray, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[int, float]:
    """The side whose halves have the least summed spread, and the left half's share of calls."""
    left = u < (low + high) / 2
    halves = np.concatenate([left, ~left], 1)
    n = halves.sum(0)
    apart = (values[:, None] - values @ halves / np.maximum(n, 1)) * halves
    # shares that make the error least, if the spread falls with calls as it does inside further cuts
    spread = ((apart * apart).sum(0) / np.maximum(n, 1)) ** (1 / 3)
    sides = len(low)
    total = np.where(np.minimum(n[:sides], n[sides:]) > 1, spread[:sides] + spread[sides:], math.inf)
    side = int(total.argmin())
    share = float(spread[side] / total[side]) if 0 < total[side] < math.inf else 0.5
    return side, min(0.9, max(0.1, share))


def _halves(target: Target, strata: list[Stratum], level: int, draws: Callable[[int, int, int], np.ndarray]) -> list[Stratum]:
    """The strata of the next level; those of few calls stay whole."""
    cut = [x for x in strata if x[3] >= 4 * FEWEST]
    out = [x for x in strata if x[3] < 4 * FEWEST]
    for (stratum, low, high, calls), (u, values) in zip(cut, _values(target, cut, [max(FEWEST, int(LOOK * x[3])) for x in cut], level, draws)):
        side, share = best_cut(u, values, low, high)
        middle, left = (low[side] + high[side]) / 2, calls - int(LOOK * calls)
        for k, n in enumerate((round(share * left), left - round(share * left))):
            a, b = low.copy(), high.copy()
            (b if k == 0 else a)[side] = middle
            out.append((2 * stratum + k, a, b, max(FEWEST, n)))
    return out


def _sampled(alpha: list[float], calls: int, levels: int, seed: int):
    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = len(alpha) - 1
        draws = _draws(seed, sides)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                target = Target(r["xi"], r["exponents"], r["coefficients"], r["logml"], alpha)
                strata: list[Stratum] = [(1, np.zeros(sides), np.ones(sides), calls)]
                for level in range(levels):
                    strata = _halves(target, strata, level, draws)
                mean, square = 0.0, 0.0
                for (_, low, high, _), (_, values) in zip(strata, _values(target, strata, [x[3] for x in strata], levels, draws)):
                    volume, middle = math.prod((high - low).tolist()), values.sum() / len(values)
                    apart = values - middle
                    mean, square = mean + volume * middle, square + volume**2 * (apart @ apart) / (len(values) - 1) / len(values)
                rows.append((r["key"], float(mean), float(square)))
            key, mean, square = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(mean, pa.float64()), pa.array(square, pa.float64())], ["key", "mean", "square"])

    return sampled


def divergences(targets: DataFrame, alpha: list[float], calls: int = 100_000, levels: int = 6, seed: int = 0) -> DataFrame:
    """(key, divergence, error): Kullback-Leibler divergence of Dirichlet(xi) from the posterior, with the standard error of its estimate.

    ``calls`` a column, those that look for cuts included, in up to 2**``levels`` strata. The same seed gives the same numbers. All alpha and xi must
    be above 0; densities that grow without bound at an edge (xi below 1) make errors larger than stated. An empty table gives no rows.
    """
    tasks = 4 * targets.sparkSession.sparkContext.defaultParallelism
    dealt = targets.select(*(c.split()[0] for c in TARGET.split(", "))).repartition(tasks, "key")
    sums = dealt.mapInArrow(_sampled(alpha, calls, levels, seed), "key long, mean double, square double")
    return sums.groupBy("key").agg(F.sum("mean").alias("divergence"), F.sqrt(F.sum("square")).alias("error"))


def scale_search(targets: DataFrame, alpha: list[float], steps: int = 10, calls: int = 20_000, levels: int = 4, first: float = 0.01, seed: int = 0) -> DataFrame:
    """(key, scale, divergence, error): for each column the scale of ``xi`` with the least divergence that a search along the line met.

    A step is longer by a twentieth where the last one gained, and turns and halves where it didn't. All columns take a step in the same jobs, and
    all steps use the same random numbers.
    """
    saved = Saved(targets.sparkSession, "scale-search")
    base = saved.save(targets)
    rows = base.select("key", F.lit(1.0).alias("scale"), F.lit(first).alias("step"), F.lit(None).cast("double").alias("last"), F.lit(None).cast("double").alias("best"), F.lit(1.0).alias("best_scale"), F.lit(None).cast("double").alias("best_error"))
    for _ in range(steps):
        now = base.join(rows.select("key", "scale"), "key").withColumn("xi", F.transform("xi", lambda x: x * F.col("scale"))).drop("scale")
        met = rows.join(divergences(now, alpha, calls, levels, seed), "key")
        better = F.col("best").isNull() | (F.col("divergence") < F.col("best"))
        step = F.when(F.col("last").isNull(), F.col("step")).when(F.col("divergence") < F.col("last"), 1.05 * F.col("step")).otherwise(-0.5 * F.col("step"))
        rows = saved.save(met.select(
            "key", (F.col("scale") * (1 - step)).alias("scale"), step.alias("step"), F.col("divergence").alias("last"), F.when(better, F.col("divergence")).otherwise(F.col("best")).alias("best"),
            F.when(better, F.col("scale")).otherwise(F.col("best_scale")).alias("best_scale"), F.when(better, F.col("error")).otherwise(F.col("best_error")).alias("best_error"),
        ))
    return rows.select("key", F.col("best_scale").alias("scale"), F.col("best").alias("divergence"), F.col("best_error").alias("error"))
