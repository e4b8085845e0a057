"""Metropolis-Hastings chains over trees whose likelihood is summed by Spark.

The driver holds one tree a chain. A step evaluates the proposals of all chains in one job over the
distinct columns, so that alignments of any length are never gathered.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trees import Node, column_polynomial, log_marginal, parse_newick, to_newick

SCHEMA = "chain int, step int, temperature double, posterior double, accepted boolean, swapped boolean, newick string"


def nodes(root: Node) -> list[Node]:
    """All nodes below the root, parents first."""
    return [x for c in root.children for x in (c, *nodes(c))]


def log_prior(root: Node, shape: float, scale: float) -> float:
    """Log gamma density of the branch lengths that are larger than 0."""
    d = [n.d for n in nodes(root) if n.d > 0]
    return sum((shape - 1) * math.log(x) - x / scale - math.lgamma(shape) - shape * math.log(scale) for x in d)


def _shape(node: Node) -> str:
    """The tree's text without lengths, every inner node in place."""
    text = lambda n: (f"({','.join(map(text, n.children))})" if n.children else "") + n.name
    return text(node) + ";"


def log_posteriors(patterns: DataFrame, roots: list[Node], taxa: list[str], alpha: list[float], shape: float, scale: float) -> list[float]:
    """Of every tree, from the distinct columns (codes, n) or their ``alike_columns``, in one job with partial sums."""
    from .tree_gradients import alike_columns

    alike = patterns if "own" in patterns.columns else alike_columns(patterns)
    # lengths go apart from the text, which has six decimals and leaves edges of length 0 out
    texts, lengths = [_shape(r) for r in roots], [[n.d for n in nodes(r)] for r in roots]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [parse_newick(t) for t in texts]
        for root, ds in zip(own, lengths):
            for n, d in zip(nodes(root), ds):
                n.d = d
        for batch in batches:
            sums = [0.0] * len(own)
            for codes, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # letters of the same prior weights give the same value
                kinds: dict[tuple[float, ...], int] = {}
                for m in members:
                    order = [*m["letters"], *(k for k in range(len(alpha)) if k not in m["letters"])]
                    prior = tuple(alpha[k] for k in order)
                    kinds[prior] = kinds.get(prior, 0) + m["n"]
                for k, root in enumerate(own):
                    poly = column_polynomial(root, dict(zip(taxa, codes)), len(alpha))
                    sums[k] += sum(n * log_marginal(poly, list(prior)) for prior, n in kinds.items())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(own)), pa.int32()), pa.array(sums, pa.float64())], ["tree", "x"])

    total = alike.select("codes", "own").mapInArrow(summed, "tree int, x double").groupBy("tree").agg(F.sum("x").alias("x"))
    likelihood = {r["tree"]: r["x"] for r in total.collect()}
    return [likelihood.get(k, 0.0) + log_prior(r, shape, scale) for k, r in enumerate(roots)]


def moved(root: Node, rng: np.random.Generator, spread: float, share: float) -> Node | None:
    """A changed copy: an exchange of a node's child with its sibling in ``share`` of the cases, else a new length; null below 0."""
    out = copy.deepcopy(root)
    inner = [(n, c) for n in [out, *nodes(out)] for c in n.children if c.children and len(n.children) > 1 + (n is out and not out.children[-1].children)]
    if inner and rng.random() < share:
        parent, node = inner[rng.integers(len(inner))]
        outgroup = parent is out and not out.children[-1].children
        siblings = [k for k, c in enumerate(parent.children[: len(parent.children) - outgroup]) if c is not node]
        i, j = siblings[rng.integers(len(siblings))], int(rng.integers(len(node.children)))
        parent.children[i], node.children[j] = node.children[j], parent.children[i]
        return out
    every = nodes(out)
    one = every[rng.integers(len(every))]
    one.d += rng.normal(0, spread)
    return out if one.d >= 0 else None


def metropolis_hastings(
    patterns: DataFrame, newick: str, taxa: list[str], alpha: list[float], steps: int, temperatures: list[float],
    shape: float = 1.0, scale: float = 0.1, spread: float = 0.1, share: float = 0.25, seed: int = 0,
) -> DataFrame:
    """The trace of one chain for each temperature, with exchanges between neighbouring temperatures after every step.

    The last child of the root, where it is a leaf, is the outgroup and keeps its place.
    Without columns the chains sample the prior. ``patterns`` is read once; the steps read its stored ``alike_columns``.
    """
    from .tree_gradients import _stored

    patterns = _stored(patterns)
    rng = np.random.default_rng(seed)
    state = [parse_newick(newick) for _ in temperatures]
    now = log_posteriors(patterns, state, taxa, alpha, shape, scale)
    rows = []
    for step in range(steps):
        proposals = [moved(s, rng, spread, share) for s in state]
        value = log_posteriors(patterns, [p or s for p, s in zip(proposals, state)], taxa, alpha, shape, scale)
        accepted = [p is not None and math.log(1 - rng.random()) < (v - old) / t for p, v, old, t in zip(proposals, value, now, temperatures)]
        for k, yes in enumerate(accepted):
            if yes:
                state[k], now[k] = proposals[k], value[k]
        swapped = -1
        if len(state) > 1:
            i = int(rng.integers(len(state) - 1))
            gain = (now[i] - now[i + 1]) * (1 / temperatures[i + 1] - 1 / temperatures[i])
            if math.log(1 - rng.random()) < gain:
                state[i], state[i + 1], now[i], now[i + 1], swapped = state[i + 1], state[i], now[i + 1], now[i], i
        rows += [(k, step, t, now[k], accepted[k], swapped >= 0 and k - swapped in (0, 1), to_newick(state[k])) for k, t in enumerate(temperatures)]
    return patterns.sparkSession.createDataFrame(rows, SCHEMA)
