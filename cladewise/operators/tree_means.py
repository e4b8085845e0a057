"""Means and medians in the space of trees, by walks along geodesics.

A walk goes toward one tree at a time, and every tree takes part. For means the trees are split by hash into blocks of
bounded size; each block is walked for a number of passes, thousands of blocks side by side in a task (``tree_arrays``), and the blocks' ends are combined by weight in a
tree of merges. A median of blocks' medians is not the median of all, so a walk to a median passes over all trees in one task.

``geometric_median`` has no such task. One job a pass measures all trees from the present place and lets each pull its own copy of it by the same
length; the place goes to the mean of the copies. With the harmonic mean of the distances as the length that is
Weiszfeld's iteration, in which every tree's pull weighs by the inverse of its distance. Copies lie close together, so the mean of
theirs is found in blocks as well as in one go.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tree_arrays
from .saved import Saved
from .trees import Edges, array_reader, geodesic, parse_newick, split_reader, splits_of

SCHEMA = "walk int, kind string, mask long, d double"
ENDS = "walk int, block long, weight double, masks array<long>, edges array<double>, leaves array<double>"
#: Trees that a block has on average, and ends that one task merges.
BLOCK_TREES, FAN = 256, 16
#: Walks of blocks that a task takes side by side, and the trees whose arrays it holds at a time.
SIDE_BY_SIDE, HELD = 8192, 1 << 21


def step_size(k: int, slow: float = 1.0) -> float:
    return 1 / (2 * (1 + k / slow))


def toward_mean(k: int, weight: float, length: float) -> float:
    """Share of the way of step ``k``; with equal weights the walk's place is the inductive mean of the trees so far."""
    pull = 2 * step_size(k) * weight
    return pull / (1 + pull)


def toward_median(k: int, weight: float, length: float) -> float:
    return min(1.0, step_size(k) * weight / length) if length > 0 else 0.0


def walk(trees: list[tuple[Edges, list[float]]], weights: list[float], steps: int, share, start: tuple[Edges, list[float]] | None = None) -> tuple[Edges, list[float]]:
    """Start at the first tree, or at ``start``, and go toward the next ones in turn."""
    place, first = (trees[0], 1) if start is None else (start, 0)
    for k in range(steps):
        n = (k + first) % len(trees)
        path = geodesic(place, trees[n])
        place = path.point(share(k, weights[n], path.length()))
    return place


def merge(ends: list[tuple[Edges, list[float]]], weights: list[float]) -> tuple[Edges, list[float]]:
    """Combined by shares of weight, in one pass."""
    if any(w > 0 for w in weights):
        ends, weights = [e for e, w in zip(ends, weights) if w > 0], [w for w in weights if w > 0]
    place, total = ends[0], weights[0]
    for end, w in zip(ends[1:], weights[1:]):
        total += w
        place = geodesic(place, end).point(w / total if total > 0 else 0.0)
    return place


def random_walks(trees: DataFrame, names: list[str], kind: str = "mean", walks: int = 4, steps: int = 100, seed: int = 0) -> DataFrame:
    """(walk, kind, mask, d): edges (``split``: the mask of its leaves) and leaves (``leaf``: its number) of each walk's end.

    ``trees`` has (tree, newick) and may have ``weight`` (1 where missing or null). Every walk takes all trees, ``steps``
    passes over each block in an order by hash. Rows without a newick text give nothing; without trees there are no rows.
    """
    share = {"mean": toward_mean, "median": toward_median}[kind]
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in trees.columns else F.lit(1.0)
    rows = trees.where("newick IS NOT NULL").select("tree", "newick", weight.alias("weight"))
    blocks = 1 if kind == "median" else max(1, -(-rows.count() // BLOCK_TREES))
    cores = trees.sparkSession.sparkContext.defaultParallelism
    block = F.pmod("h", F.lit(blocks)).alias("block")

    def ended(own: pd.DataFrame, weight: float, place: tuple[Edges, list[float]]) -> pd.DataFrame:
        edges = sorted(place[0].items())
        row = (int(own["walk"].iloc[0]), int(own["block"].iloc[0]), weight, [e for e, _ in edges], [d for _, d in edges], list(place[1]))
        return pd.DataFrame([row], columns=["walk", "block", "weight", "masks", "edges", "leaves"])

    def walked(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["h", "tree", "newick"])
        found, weights = [splits_of(parse_newick(t), names) for t in own["newick"]], own["weight"].tolist()
        start = merge(found, weights)  # the steps to a median are too short to come from afar
        return ended(own, float(own["weight"].sum()), walk(found, weights, steps * len(own), share, start))

    def merged(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("block").assign(block=own["block"].min() // FAN)
        places = [({int(m): d for m, d in zip(r.masks, r.edges)}, list(r.leaves)) for r in own.itertuples()]
        return ended(own, float(own["weight"].sum()), merge(places, own["weight"].tolist()))

    if kind == "median":
        every = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"))
        ends = every.withColumn("h", F.xxhash64("tree", "newick", "walk", F.lit(seed))).select("*", block).groupBy("walk", "block").applyInPandas(walked, ENDS)
    else:
        # a text is read once, before the walks, and its rows stay small; the number of tasks is given, as sizes in bytes don't tell how long the walks are
        hashes = F.array(*(F.xxhash64("tree", "newick", F.lit(w), F.lit(seed)) for w in range(walks)))
        parsed = _parsed(rows.select(F.struct("tree", F.xxhash64("tree", "newick").alias("text"), hashes.alias("h")).alias("key"), "newick", "weight").repartition(4 * cores), names)
        placed = parsed.select("key.tree", "key.text", F.posexplode("key.h").alias("walk", "h"), *PREPARED_COLUMNS).select("*", block)
        tasks = cores * -(-walks * blocks // (SIDE_BY_SIDE * cores))
        dealt = placed.repartition(tasks, "walk", "block").sortWithinPartitions("walk", "block", "h", "tree", "text").select("walk", "block", *PREPARED_COLUMNS)
        ends = dealt.mapInArrow(_walks_side_by_side(steps), ENDS)
    while blocks > 1:
        blocks = -(-blocks // FAN)
        part = F.floor(F.col("block") / FAN).alias("part")
        ends = ends.select("*", part).repartition(min(4 * cores, walks * blocks), "walk", "part").groupBy("walk", "part").applyInPandas(lambda own: merged(own.drop(columns="part")), ENDS)
    edges = F.transform(F.arrays_zip("masks", "edges"), lambda x: F.struct(F.lit("split").alias("kind"), x["masks"].alias("mask"), x["edges"].alias("d")))
    leaves = F.transform("leaves", lambda d, n: F.struct(F.lit("leaf").alias("kind"), n.cast("long").alias("mask"), d.alias("d")))
    return ends.select("walk", F.explode(F.concat(edges, leaves)).alias("x")).select("walk", "x.kind", "x.mask", "x.d")


# medians by one job a pass

Place = tuple[Edges, list[float]]
#: How much shorter pulls become where they gain nothing, and the shortest ones, as a share of the harmonic mean of the distances.
SHRINK, LEAST_PULL = 6, 0.003
PREPARED = "weight double, masks array<long>, edges array<double>, leaves array<double>"
PREPARED_COLUMNS = ["weight", "masks", "edges", "leaves"]
#: Trees side by side (as in ``tree_arrays``) are one row: masks, weights, lengths that all leaves of a number share (null where they differ) and the other
#: lengths; trees whose edges are too many for an array are one row of Arrow data, as in PREPARED. ``trees`` and bytes that a row has at most.
PACKED = "masks array<long>, weights binary, shared array<double>, lengths binary, apart binary"
PACKED_TREES, PACKED_BYTES = 1 << 16, 8_000_000
PULLED = "part long, weight double, loss double, inverse double, masks array<long>, edges array<double>, leaves array<double>"
TRACE = "pass int, loss double, pull double"


def _between(place: Place, other: Place, share: float) -> Place:
    """The point at ``share`` of the way; trees of the same edges lie on a straight line."""
    if place[0].keys() == other[0].keys():
        return {e: (1 - share) * d + share * other[0][e] for e, d in place[0].items()}, [(1 - share) * x + share * y for x, y in zip(place[1], other[1])]
    return geodesic(place, other).point(share)


def _parsed(rows: DataFrame, names: list[str]) -> DataFrame:
    """(key, weight, masks, edges, leaves) of rows (key, newick, weight)."""
    key = rows.schema["key"].dataType.simpleString()

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = split_reader(names)
        for batch in batches:
            found = [read(t) for t in batch.column(1).to_pylist()]
            arrays = [[list(e) for e, _ in found], [list(e.values()) for e, _ in found], [x for _, x in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(a, pa.list_(t)) for a, t in zip(arrays, (pa.int64(), pa.float64(), pa.float64())))], ["key", *PREPARED_COLUMNS])

    return rows.mapInArrow(parsed, f"key {key}, {PREPARED}")


def _packed(trees: DataFrame, names: list[str]) -> DataFrame:
    """PACKED rows of all trees (newick, maybe weight: 1 where missing or null), dealt evenly; trees without weight take no part."""
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in trees.columns else F.lit(1.0)
    rows = trees.where("newick IS NOT NULL").select("newick", weight.alias("weight")).where("weight > 0")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together, one = array_reader(names), split_reader(names)
        held: list[tuple[list[int], np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            every = sorted({m for masks, _, _ in held for m in masks})
            lengths = np.zeros((len(every) + len(names), sum(len(w) for _, _, w in held)))
            at = 0
            for masks, own, w in held:
                lengths[[*np.searchsorted(every, masks).tolist(), *range(len(every), len(lengths))], at : at + len(w)] = own
                at += len(w)
            yield _packed_row(every, lengths, np.concatenate([w for _, _, w in held]))
            held.clear()

        for batch in batches:
            for k in range(0, batch.num_rows, PACKED_TREES):
                texts, weights = batch.column(0).slice(k, PACKED_TREES), batch.column(1).slice(k, PACKED_TREES).to_numpy()
                arrays = together(texts)
                if arrays is None:
                    found = [one(t) for t in texts.to_pylist()]
                    lists = [[list(e) for e, _ in found], [list(e.values()) for e, _ in found], [x for _, x in found]]
                    part = pa.RecordBatch.from_arrays([pa.array(weights), *(pa.array(a, pa.list_(t)) for a, t in zip(lists, (pa.int64(), pa.float64(), pa.float64())))], PREPARED_COLUMNS)
                    arrays = _arrays(part)
                    if arrays is None:
                        yield _apart_row(part)
                        continue
                masks, lengths = arrays
                every = {*masks, *(m for own, _, _ in held for m in own)}
                n = len(weights) + sum(len(w) for _, _, w in held)
                if held and (len(every) > tree_arrays.MOST_EDGES or n > PACKED_TREES or 8 * n * (len(every) + len(names)) > PACKED_BYTES):
                    yield from flush()
                held.append((masks, lengths, weights))
        if held:
            yield from flush()

    return rows.repartition(4 * trees.sparkSession.sparkContext.defaultParallelism).mapInArrow(packed, PACKED)


def _packed_row(masks: list[int], lengths: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    low = lengths[len(masks) :].min(1)
    shared = low == lengths[len(masks) :].max(1)
    rest = lengths[[*range(len(masks)), *(len(masks) + np.flatnonzero(~shared)).tolist()]]
    row = [masks, weights.tobytes(), [x if same else None for x, same in zip(low.tolist(), shared)], rest.tobytes(), None]
    return _packed_batch(row)


def _apart_row(rows: pa.RecordBatch) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_batch(rows)
    return _packed_batch([None, None, None, None, sink.getvalue().to_pybytes()])


def _packed_batch(row: list) -> pa.RecordBatch:
    kinds = [pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["masks", "weights", "shared", "lengths", "apart"])


def _arrays(rows: pa.Table | pa.RecordBatch, more: list[int] = []) -> tuple[list[int], np.ndarray] | None:
    """All edges that occur, those of ``more`` too, and an array as in ``tree_arrays``; None where they are too many."""
    flat = lambda name: pa.concat_arrays([c.flatten() for c in rows.column(name).chunks]) if isinstance(rows, pa.Table) else rows.column(name).flatten()
    masks, at = np.unique(flat("masks").to_numpy(), return_inverse=True)
    if len(masks) + len(more) > tree_arrays.MOST_EDGES:
        return None
    every = sorted({*masks.tolist(), *more})
    counts = np.concatenate([c.value_lengths().to_numpy() for c in rows.column("masks").chunks]) if isinstance(rows, pa.Table) else rows.column("masks").value_lengths().to_numpy()
    leaves = flat("leaves").to_numpy().reshape(rows.num_rows, -1)
    out = np.zeros((len(every) + leaves.shape[1], rows.num_rows))
    out[np.searchsorted(every, masks)[at] if len(at) else at, np.repeat(np.arange(rows.num_rows), counts)] = flat("edges").to_numpy()
    out[len(every) :] = leaves.T
    return every, out


def _tree(masks: list[int], column: np.ndarray) -> Place:
    n = len(masks)
    return {m: float(d) for m, d in zip(masks, column[:n]) if d > 0}, column[n:].tolist()


def _ends(rows: pa.Table, first: np.ndarray, sizes: np.ndarray, steps: int) -> list[Place]:
    """Ends of the walks over trees ``first[k]`` to ``first[k] + sizes[k] - 1``."""
    arrays, weights = _arrays(rows), rows.column("weight").to_numpy()
    if arrays is None:
        places = [({m: d for m, d in zip(r["masks"], r["edges"])}, r["leaves"]) for r in rows.select(["masks", "edges", "leaves"]).to_pylist()]
        return [walk(places[a : a + n], weights[a : a + n].tolist(), steps * n - 1, toward_mean) for a, n in zip(first.tolist(), sizes.tolist())]
    masks, trees = arrays
    # lengths that all trees share stay as they are
    low = trees.min(1)
    moves = np.flatnonzero((low < trees.max(1)) | (np.arange(len(low)) < len(masks)))
    found = np.repeat(low[:, None], len(first), 1)
    found[moves] = tree_arrays.mean_walks(tree_arrays.Space(masks), trees[moves], weights, first, sizes, steps)
    return [_tree(masks, found[:, k]) for k in range(len(first))]


def _walks_side_by_side(steps: int):
    """Walks toward means over blocks of rows (walk, block, weight, masks, edges, leaves) in order of block: one row (ENDS) each."""

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.int64()), *[pa.list_(pa.float64())] * 2]

        def done(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
            first, sizes = cuts[:-1], np.diff(cuts)
            ends = [(sorted(edges.items()), leaves) for edges, leaves in _ends(rows, first, sizes, steps)]
            walk, block, weight = (rows.column(c).to_numpy() for c in ("walk", "block", "weight"))
            columns = [walk[first], block[first], np.add.reduceat(weight, first), [[m for m, _ in e] for e, _ in ends], [[d for _, d in e] for e, _ in ends], [x for _, x in ends]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["walk", "block", *PREPARED_COLUMNS])

        def cuts_of(rows: pa.Table) -> np.ndarray:
            walk, block = rows.column("walk").to_numpy(), rows.column("block").to_numpy()
            return np.r_[0, np.flatnonzero((walk[1:] != walk[:-1]) | (block[1:] != block[:-1])) + 1, len(walk)]

        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                rows = pa.Table.from_batches(held)
                cuts = cuts_of(rows)
                if len(cuts) > 2:  # the last block may go on
                    yield done(rows.slice(0, cuts[-2]), cuts[:-1])
                    held = rows.slice(cuts[-2]).to_batches()
                    n = int(cuts[-1] - cuts[-2])
        if n:
            rows = pa.Table.from_batches(held)
            yield done(rows, cuts_of(rows))

    return walked


def _row(place: Place) -> tuple[list[int], list[float], list[float]]:
    return list(place[0]), list(place[0].values()), list(place[1])


def _mean_of_parts(pulled: DataFrame, parts: int) -> tuple[Place, float, float, float] | None:
    """The parts' places merged by weight in a tree, with the sums of weights, losses and inverse distances."""

    def merged(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("part")
        place, total = None, 0.0
        for r in own.itertuples():
            here, total = ({int(m): d for m, d in zip(r.masks, r.edges)}, list(r.leaves)), total + r.weight
            place = here if place is None else _between(place, here, r.weight / total)
        return pd.DataFrame([(int(own["part"].iloc[0]) // FAN, total, own["loss"].sum(), own["inverse"].sum(), *_row(place))], columns=own.columns)

    while parts > 1:
        parts = -(-parts // FAN)
        pulled = pulled.groupBy(F.floor(F.col("part") / FAN).alias("of")).applyInPandas(lambda own: merged(own), PULLED)
    r = pulled.first()
    return r and (({int(m): d for m, d in zip(r["masks"], r["edges"])}, list(r["leaves"])), r["weight"], r["loss"], r["inverse"])


def _pulled(rows: pa.Table, place: Place | None, length: float) -> Iterator[tuple[Place, float, float, float]]:
    """Means of pulled copies with their weight, and the sums of weighted distances and inverse distances: one for all rows, or one a row where their edges are too many for an array."""
    arrays = _arrays(rows, list(place[0]) if place else [])
    if arrays is None:
        for weight, masks, edges, leaves in zip(*(c.to_pylist() for c in rows.columns)):
            yield _pulled_one((dict(zip(masks, edges)), leaves), weight, place, length)
        return
    masks, trees = arrays
    start = None if place is None else np.array([*(place[0].get(m, 0.0) for m in masks), *place[1]])
    mean, *sums = _pulled_together(masks, trees, rows.column("weight").to_numpy(), start, length)
    yield _tree(masks, mean), *sums


def _pulled_one(copy: Place, weight: float, place: Place | None, length: float) -> tuple[Place, float, float, float]:
    d = 0.0
    if place is not None:
        way = geodesic(place, copy)
        d = way.length()
        copy = way.point(min(1.0, length / d)) if d > 0 else place
    return copy, weight, weight * d, weight / max(d, 1e-12)


def _pulled_together(masks: list[int], trees: np.ndarray, weights: np.ndarray, start: np.ndarray | None, length: float) -> tuple[np.ndarray, float, float, float]:
    space, d = tree_arrays.Space(masks), np.zeros(len(weights))
    if start is not None:
        d = space.lengths(start[:, None], trees)
        trees = space.between(start[:, None], trees, np.minimum(1.0, length / np.maximum(d, 1e-300)))
    mean, weight = space.mean(trees, weights)
    return mean, weight, float(weights @ d), float((weights / np.maximum(d, 1e-12)).sum())


def _pulled_packed(batch: pa.RecordBatch, place: Place | None, length: float) -> Iterator[tuple[Place, float, float, float]]:
    """``_pulled`` for PACKED rows."""
    for k in range(batch.num_rows):
        apart = batch.column(4)[k]
        if apart.is_valid:
            yield from _pulled(pa.ipc.open_stream(apart.as_buffer()).read_all(), place, length)
            continue
        masks, shared = (batch.column(c)[k].as_py() for c in (0, 2))
        weights, lengths = (np.frombuffer(batch.column(c)[k].as_buffer()) for c in (1, 3))
        lengths = lengths.reshape(-1, len(weights))
        every = sorted({*masks, *(place[0] if place else [])})
        # lengths that all trees share with the place stay as they are
        moves = [j for j, x in enumerate(shared) if x is None or place is not None and x != place[1][j]]
        if len(every) == len(masks) and len(moves) == shared.count(None):
            trees = lengths
        else:
            trees, own = np.zeros((len(every) + len(moves), len(weights))), iter(lengths[len(masks) :])
            trees[np.searchsorted(every, masks).tolist()] = lengths[: len(masks)]
            for row, j in enumerate(moves, len(every)):
                trees[row] = next(own) if shared[j] is None else shared[j]

        def whole(column: np.ndarray) -> Place:
            edges, leaves = _tree(every, column)
            moved = dict(zip(moves, leaves))
            return edges, [moved.get(j, x) for j, x in enumerate(shared)]

        if len(every) > tree_arrays.MOST_EDGES:
            for column, weight in zip(trees.T, weights.tolist()):
                yield _pulled_one(whole(column), weight, place, length)
            continue
        start = None if place is None else np.array([*(place[0].get(m, 0.0) for m in every), *(place[1][j] for j in moves)])
        mean, *sums = _pulled_together(every, trees, weights, start, length)
        yield whole(mean), *sums


def _pull(trees: DataFrame, place: Place | None, length: float) -> tuple[Place, float, float, float] | None:
    """One job: the mean of copies of ``place`` that every tree has pulled by ``length``, as above; without a place, the mean of the trees."""
    parts = trees.rdd.getNumPartitions()

    def pulled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        mean, total, loss, inverse = None, 0.0, 0.0, 0.0
        for batch in batches:
            for here, weight, d, close in _pulled_packed(batch, place, length):
                mean = here if mean is None else _between(mean, here, weight / (total + weight))
                total, loss, inverse = total + weight, loss + d, inverse + close
        if mean is not None:
            columns = [[TaskContext.get().partitionId()], [total], [loss], [inverse], *([x] for x in _row(mean))]
            kinds = [pa.int64(), *[pa.float64()] * 3, pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "weight", "loss", "inverse", "masks", "edges", "leaves"])

    return _mean_of_parts(trees.mapInArrow(pulled, PULLED), parts)


def geometric_median(trees: DataFrame, names: list[str], passes: int = 60, enough: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """(walk, kind, mask, d) of the tree with the least weighted sum of distances to all ``trees``, as ``random_walks`` gives ends, and the trace (pass, loss, pull).

    From the trees' mean on it goes by the harmonic mean of the distances. Where a pass gains less than ``enough`` of the loss, it goes back to the
    best place and pulls a SHRINK-th as far, since the mean of copies in many orthants is off by a part of the pull; it ends below LEAST_PULL
    of the harmonic mean, or after ``passes`` passes. Rows without a newick text or a positive weight take no part; without trees there are no rows.
    """
    spark = trees.sparkSession
    own = Saved(spark, "median").save(_packed(trees, names))
    start = _pull(own, None, 0.0)
    if start is None:
        return spark.createDataFrame([], SCHEMA), spark.createDataFrame([], TRACE)
    place = best = start[0]
    _, weight, _, inverse = _pull(own, place, 0.0)
    pull, shrink, least, trace = weight / inverse, 1.0, math.inf, []
    for k in range(passes):
        after, weight, loss, inverse = _pull(own, place, pull)
        trace.append((k, loss, pull))
        enough_gained = loss < least * (1 - enough)
        if loss < least:
            best, least = place, loss
        if not enough_gained:
            shrink /= SHRINK
            if shrink < LEAST_PULL:
                break
        pull = shrink * weight / inverse
        place = after if enough_gained else _pull(own, best, pull)[0]
    rows = [(0, "split", int(m), float(d)) for m, d in best[0].items()] + [(0, "leaf", k, float(d)) for k, d in enumerate(best[1])]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(trace, TRACE)
