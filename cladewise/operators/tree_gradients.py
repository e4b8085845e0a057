"""Gradients of the log posterior in the branch lengths, and what climbs or samples by them.

A column's marginal probability is linear in the chance p of each branch's mutation, so its derivative is
the difference between the values at p = 1 and p = 0. Gradients are sums over the distinct columns, made by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .saved import Saved
from .tree_sampler import _shape, log_prior, nodes
from .trees import Node, column_polynomial, log_marginal, parse_newick, to_newick

TRACE = "step int, posterior double, accepted boolean, newick string"
#: Branches never become shorter.
LEAST = 1e-20


def column_gradient(root: Node, codes: dict[str, int], alpha: list[float]) -> tuple[float, list[float]]:
    """Log marginal probability of a column and its derivatives by the length of every node below the root, parents first."""
    log_value = lambda: log_marginal(p, alpha) if (p := column_polynomial(root, codes, len(alpha))) else -math.inf
    here, out = log_value(), []
    for n in nodes(root):
        d = n.d
        ends = []
        for n.d in (math.inf, 0.0):
            ends.append(math.exp(log_value() - here))
        n.d = d
        out.append(math.exp(-d) * (ends[0] - ends[1]))
    return here, out


def alike_columns(patterns: DataFrame) -> DataFrame:
    """(codes, own): distinct columns (codes, n) grouped by which species share a letter; ``own`` lists the letters, in order of first place, and numbers.

    A column's polynomial is the same up to the letters' names, so it is evaluated once a group. A group has at most as many members as its
    letters can be named, whatever the data's size.
    """
    letters = F.array_distinct(F.filter("codes", lambda x: x >= 0))
    rows = patterns.select("codes", letters.alias("letters"), F.col("n").cast("long").alias("n"))
    alike = F.transform("codes", lambda x: F.when(x < 0, -1).otherwise((F.array_position("letters", x) - 1).cast("int")))
    return rows.select(alike.alias("codes"), "letters", "n").groupBy("codes").agg(F.collect_list(F.struct("letters", "n")).alias("own"))


def _ends(root: Node, codes: dict[str, int], letters: int) -> tuple[np.ndarray, np.ndarray]:
    """Exponents (terms x letters) and coefficients: of the column's polynomial, then, for every node below the root, of those with its branch certainly mutated and never."""
    polys = [column_polynomial(root, codes, letters)]
    for n in nodes(root):
        d = n.d
        for n.d in (math.inf, 0.0):
            polys.append(column_polynomial(root, codes, letters))
        n.d = d
    place = {e: k for k, e in enumerate(dict.fromkeys(e for p in polys for e in p))}
    out = np.zeros((len(polys), len(place)))
    for row, p in zip(out, polys):
        for e, c in p.items():
            row[place[e]] = c
    return np.array(list(place), np.int64).reshape(-1, letters), out


def posterior_gradient(patterns: DataFrame, root: Node, taxa: list[str], alpha: list[float], shape: float, scale: float) -> tuple[float, np.ndarray]:
    """Log posterior and its gradient by the branch lengths, over distinct columns (codes, n) or their ``alike_columns``, in one job."""
    alike = patterns if "own" in patterns.columns else alike_columns(patterns)
    lengths = [n.d for n in nodes(root)]
    text = _shape(root)
    lg = lambda x: math.lgamma(x) if x > 0 else 0.0  # noqa: E731  letters without prior weight and count are left out

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parse_newick(text)
        for n, d in zip(nodes(own), lengths):
            n.d = d
        slope_of = np.exp(-np.array(lengths))
        rise = np.array([[lg(a + e) - lg(a) for e in range(len(taxa) + 1)] for a in alpha])
        whole = np.array([lg(sum(alpha) + e) - lg(sum(alpha)) for e in range(len(taxa) + 1)])
        for batch in batches:
            total = np.zeros(len(lengths) + 1)
            for codes, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                exponents, coefficients = _ends(own, dict(zip(taxa, codes)), len(alpha))
                for m in members:
                    letters = m["letters"]
                    logs = rise[letters, exponents[:, : len(letters)]].sum(1) - whole[exponents.sum(1)]
                    values = coefficients @ np.exp(logs)
                    slope = slope_of * (values[1::2] - values[2::2]) / values[0]
                    total += m["n"] * np.r_[math.log(values[0]), slope]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["k", "x"])

    sums = alike.mapInArrow(summed, "k int, x double").groupBy("k").agg(F.sum("x").alias("x"))
    total = np.zeros(len(lengths) + 1)
    for r in sums.collect():
        total[r["k"]] = r["x"]
    d = np.array(lengths)
    prior = np.where(d > 0, (shape - 1) / np.maximum(d, LEAST) - 1 / scale, 0.0)
    return total[0] + log_prior(root, shape, scale), total[1:] + prior


def _stored(patterns: DataFrame) -> DataFrame:
    """``alike_columns``, written once and dealt evenly, as every step reads them."""
    spark = patterns.sparkSession
    return Saved(spark, "columns").save(alike_columns(patterns).repartition(4 * spark.sparkContext.defaultParallelism))


def _at(root: Node, lengths: np.ndarray) -> Node:
    for n, d in zip(nodes(root), lengths):
        n.d = float(d)
    return root


def gradient_ascent(
    patterns: DataFrame, newick: str, taxa: list[str], alpha: list[float], steps: int, least_change: float = 5e-4,
    shape: float = 1.0, scale: float = 0.1, first: float = 1e-3, rate: float = 0.1,
) -> DataFrame:
    """Trace of an ascent that uses the gradient's signs: a branch's step grows while its sign stays and shrinks when it turns.

    It ends after ``steps`` steps or when the lengths together change by less than ``least_change``.
    """
    root, alike = parse_newick(newick), _stored(patterns)
    step, before, rows = np.full(len(nodes(root)), first), None, []
    for k in range(steps):
        value, slope = posterior_gradient(alike, root, taxa, alpha, shape, scale)
        rows.append((k, float(value), True, to_newick(root)))
        sign = np.sign(slope)
        if before is not None:
            step = step * np.where(sign * before > 0, 1 + rate, np.where(sign * before < 0, 1 - rate, 1.0))
        d = np.array([n.d for n in nodes(root)])
        new = np.maximum(d + sign * step, LEAST)
        _at(root, new)
        before = sign
        if np.abs(new - d).sum() < least_change:
            break
    return patterns.sparkSession.createDataFrame(rows, TRACE)


def hamiltonian(
    patterns: DataFrame, newick: str, taxa: list[str], alpha: list[float], steps: int, leaps: int = 1, size: float = 0.01,
    keep: float = 0.0, shape: float = 1.0, scale: float = 0.1, seed: int = 0,
) -> DataFrame:
    """Trace of Hamiltonian moves of all lengths of one topology; ``keep`` is the share of momentum that stays from step to step."""
    rng = np.random.default_rng(seed)
    root, alike = parse_newick(newick), _stored(patterns)
    d = np.array([n.d for n in nodes(root)])
    momentum = rng.normal(size=len(d))
    value, slope = posterior_gradient(alike, root, taxa, alpha, shape, scale)
    rows = []
    for k in range(steps):
        momentum = keep * momentum + math.sqrt(1 - keep * keep) * rng.normal(size=len(d))
        place, push, there, force = d, momentum, value, slope
        for _ in range(leaps):
            push = push + size / 2 * force
            place = np.maximum(place + size * push, LEAST)
            there, force = posterior_gradient(alike, _at(root, place), taxa, alpha, shape, scale)
            push = push + size / 2 * force
        gain = there - value + (momentum @ momentum - push @ push) / 2
        accepted = math.log(1 - rng.random()) < gain
        if accepted:
            d, momentum, value, slope = place, push, there, force
        else:
            momentum = -momentum
        rows.append((k, float(value), bool(accepted), to_newick(_at(root, d))))
    return patterns.sparkSession.createDataFrame(rows, TRACE)
