"""One Dirichlet distribution in place of a column's polynomial: the closest one in Kullback-Leibler divergence."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trees import Poly, column_polynomial, parse_newick

TOLERANCE, MOST_STEPS = 1e-7, 1000


def digamma(x: float) -> float:
    back = 0.0
    while x < 8:
        back, x = back + 1 / x, x + 1
    s = 1 / (x * x)
    return math.log(x) - 0.5 / x - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s / 240))) - back


def trigamma(x: float) -> float:
    more = 0.0
    while x < 8:
        more, x = more + 1 / (x * x), x + 1
    s = 1 / (x * x)
    return more + 1 / x + s / 2 + s / x * (1 / 6 - s * (1 / 30 - s * (1 / 42 - s / 30)))


def newton(f, slope, x: float, y: float, steps: int = 50) -> float:
    """The place where f is y, for a growing f of positive numbers."""
    for _ in range(steps):
        new = x - (f(x) - y) / slope(x)
        new = new if new > 0 else x / 2
        if abs(new - x) <= 1e-13 * x:
            return new
        x = new
    return x


def inverse_digamma(y: float) -> float:
    return newton(digamma, trigamma, math.exp(y) + 0.5 if y >= -2.22 else -1 / (y - digamma(1.0)), y)


def expected_logs(poly: Poly, alpha: list[float]) -> list[float]:
    """Mean logs of the letters' probabilities under the posterior, a mixture of one Dirichlet distribution a term."""
    terms = [([e + a for e, a in zip(es, alpha)], c) for es, c in poly.items() if c > 0]
    logs = [math.log(c) + sum(map(math.lgamma, v)) - math.lgamma(sum(v)) for v, c in terms]
    most = max(logs)
    w = [math.exp(x - most) for x in logs]
    total = sum(w)
    return [sum(x / total * (digamma(v[i]) - digamma(sum(v))) for x, (v, _) in zip(w, terms)) for i in range(len(alpha))]


def closest_dirichlet(logs: list[float]) -> list[float]:
    """Parameters whose mean logs are the given ones."""
    xi = [1.0] * len(logs)
    for _ in range(MOST_STEPS):
        base = digamma(sum(xi))
        new = [inverse_digamma(base + x) for x in logs]
        done = max(abs(a - b) for a, b in zip(new, xi)) < TOLERANCE
        xi = new
        if done:
            break
    return xi


def _polygammas(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``digamma`` and ``trigamma`` of an array."""
    back, more, x = np.zeros(x.shape), np.zeros(x.shape), x.copy()
    while (small := x < 8).any():
        part = np.where(small, 1 / x, 0.0)
        back, more, x = back + part, more + part * part, x + small
    s = 1 / (x * x)
    return np.log(x) - 0.5 / x - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s / 240))) - back, more + 1 / x + s / 2 + s / x * (1 / 6 - s * (1 / 30 - s * (1 / 42 - s / 30)))


def _inverse_digammas(y: np.ndarray, steps: int = 50) -> np.ndarray:
    x = np.where(y >= -2.22, np.exp(np.maximum(y, -2.22)) + 0.5, -1 / np.minimum(y - digamma(1.0), -1e-9))
    todo = np.arange(len(y))
    for _ in range(steps):
        own = x[todo]
        value, slope = _polygammas(own)
        new = own - (value - y[todo]) / slope
        new = np.where(new > 0, new, own / 2)
        x[todo] = new
        todo = todo[np.abs(new - own) > 1e-13 * own]
        if not len(todo):
            break
    return x


def closest_dirichlets(logs: np.ndarray) -> np.ndarray:
    """``closest_dirichlet`` of each row, side by side."""
    xi, todo = np.ones(logs.shape), np.arange(len(logs))
    for _ in range(MOST_STEPS):
        if not len(todo):
            break
        own = xi[todo]
        new = _inverse_digammas((_polygammas(own.sum(1))[0][:, None] + logs[todo]).ravel()).reshape(own.shape)
        xi[todo] = new
        todo = todo[np.abs(new - own).max(1) >= TOLERANCE]
    return xi


def pattern_approximations(patterns: DataFrame, newick: str, taxa: list[str], alpha: list[float]) -> DataFrame:
    """(codes, n, xi) of each distinct column; xi - alpha are the counts that stand for the column. All alpha must be above 0."""

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = parse_newick(newick)
        for batch in batches:
            polys = [column_polynomial(root, dict(zip(taxa, c)), len(alpha)) for c in batch.column(0).to_pylist()]
            xi = closest_dirichlets(np.array([expected_logs(p, alpha) for p in polys]).reshape(-1, len(alpha))).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(xi, pa.list_(pa.float64()))], ["codes", "n", "xi"])

    # columns take long for their bytes, so the number of tasks is given
    dealt = patterns.select("codes", F.col("n").cast("long").alias("n")).repartition(4 * patterns.sparkSession.sparkContext.defaultParallelism, "codes")
    return dealt.mapInArrow(fitted, "codes array<int>, n long, xi array<double>")
