"""Dirichlet process mixture of bivariate normal distributions with a known covariance, sampled in blocks.

Given the mixture's weights and means the points are independent, so a sweep over all points is one
Spark job: each point takes the component of the largest score with Gumbel noise from a
hash of its id, a batch of points at a time. The weights (broken sticks, until what is left weighs less than ``rest``, whatever the number of components) and means
are drawn on the driver from one row of sums per component. Nothing is stored by point; the assignments of any sweep can be computed again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRACE = "step int, clusters int, largest long, likelihood double"


@dataclass
class Model:
    """Concentration, covariance of the points, and mean and covariance of the clusters' means."""

    alpha: float = 1.0
    sigma: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 0.0), (0.0, 1.0))
    sigma0: tuple[tuple[float, float], tuple[float, float]] = ((100.0, 0.0), (0.0, 100.0))
    mu0: tuple[float, float] = (0.0, 0.0)
    rest: float = 1e-9


@dataclass
class State:
    weights: np.ndarray
    means: np.ndarray
    step: int = 0


def log_density(x: Column, y: Column, mx: Column, my: Column, sigma) -> Column:
    inv, (dx, dy) = np.linalg.inv(np.array(sigma)), (x - mx, y - my)
    square = float(inv[0, 0]) * dx * dx + float(inv[0, 1] + inv[1, 0]) * dx * dy + float(inv[1, 1]) * dy * dy
    return -0.5 * square - float(np.log(2 * np.pi) + 0.5 * np.log(np.linalg.det(sigma)))


def assigned(points: DataFrame, state: State, model: Model, seed: int) -> DataFrame:
    """``points`` (i, x, y) with ``cluster`` and ``logp``, the log density under that cluster. Points with a null are left out."""
    kept = np.flatnonzero(state.weights > 1e-12)
    logs, means = np.log(state.weights[kept]), state.means[kept]
    inv = np.linalg.inv(np.array(model.sigma))
    base = float(np.log(2 * np.pi) + 0.5 * np.log(np.linalg.det(model.sigma)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).cast(pa.float64()).to_numpy() for c in (1, 2))
            best, cluster, density = (np.full(len(x), v, t) for v, t in ((-np.inf, float), (-1, np.int32), (0.0, float)))
            for n, k in enumerate(kept.tolist()):
                u = ((batch.column(3 + n).to_numpy() & ((1 << 52) - 1)) + 0.5) / float(1 << 52)
                dx, dy = x - means[n, 0], y - means[n, 1]
                p = -0.5 * (inv[0, 0] * dx * dx + (inv[0, 1] + inv[1, 0]) * dx * dy + inv[1, 1] * dy * dy) - base
                score = logs[n] + p - np.log(-np.log(u))
                better = score >= best  # of equal scores the last component's
                best, density = np.where(better, score, best), np.where(better, p, density)
                cluster[better] = k
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(cluster), pa.array(density)], ["i", "x", "y", "cluster", "logp"])

    hashes = (F.xxhash64(F.lit(seed), F.lit(state.step), F.lit(k), F.col("i")).alias(f"h{k}") for k in kept.tolist())
    rows = points.select("i", "x", "y").dropna().select("i", "x", "y", *hashes)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(placed, f"i {kinds['i']}, x {kinds['x']}, y {kinds['y']}, cluster int, logp double")


def _drawn(sums: dict[int, tuple[int, float, float]], model: Model, rng: np.random.Generator, step: int) -> State:
    """``sums``: number and coordinate sums of the components that have points, numbered from 0."""
    n = np.array([sums[k][0] for k in range(len(sums))], float)
    behind = n[::-1].cumsum()[::-1] - n
    weights, left = [], 1.0
    while len(weights) < len(n) or left > model.rest:
        k = len(weights)
        stick = rng.beta(1 + n[k], model.alpha + behind[k]) if k < len(n) else rng.beta(1, model.alpha)
        weights.append(left * stick)
        left *= 1 - stick
    weights[-1] += left
    weights = np.array(weights)
    inv, inv0 = np.linalg.inv(np.array(model.sigma)), np.linalg.inv(np.array(model.sigma0))
    means = []
    for k in range(len(weights)):
        cov = np.linalg.inv((n[k] if k < len(n) else 0.0) * inv + inv0)
        total = np.array(sums.get(k, (0, 0.0, 0.0))[1:])
        means.append(rng.multivariate_normal(cov @ (inv @ total + inv0 @ np.array(model.mu0)), cov))
    return State(weights, np.array(means), step)


def sample(points: DataFrame, model: Model, steps: int, seed: int = 0) -> tuple[DataFrame, State]:
    """Trace of the sweeps, and the state to assign points with (``assigned``) or to look at.

    Clusters are numbered in order of size before each draw of weights, which lets the sticks mix. Without points the prior is sampled.
    """
    rng = np.random.default_rng(seed)
    state, rows = _drawn({}, model, rng, 0), []
    for step in range(steps):
        found = assigned(points, state, model, seed).groupBy("cluster").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum("logp").alias("logp")).collect()
        ordered = sorted(found, key=lambda r: (-r["n"], r["cluster"]))
        rows.append((step, len(found), max((r["n"] for r in found), default=0), float(sum(r["logp"] for r in found))))
        state = _drawn({k: (r["n"], r["sx"], r["sy"]) for k, r in enumerate(ordered)}, model, rng, step + 1)
    return points.sparkSession.createDataFrame(rows, TRACE), state
