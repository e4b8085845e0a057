"""Operator 12, MinHash near-duplicate detection with sequential Bayesian verification.

1.  One pass over the texts gives each document its set's digest, ``BANDS`` keys of ``ROWS`` minima each and one
    byte of every minimum. Copies (equal sets) are represented by one row from here on.
2.  Sets that share a band key are candidates. A pair exactly at the limit shares none with probability
    (1 - limit^ROWS)^BANDS = 4e-8.
3.  Candidates are compared by batches of ``BATCH`` bytes. With a uniform prior over the share of equal bytes, the
    posterior probability that the similarity reaches the limit after m of n equal ones is P(Bin(n + 1, t) <= m);
    a pair goes as soon as that falls below ``MISS``. Survivors are decided by intersecting the full sorted sets.
4.  A first round compares each set with a leader in two of its bands. Band keys that still hold more than one
    component give units of bounded size (as in the n-gram join), each held by one task with its sets. There the pairs of sets from
    different components are pruned and decided, a joined component's further pairs aren't, and only links that join leave the task.

A hash shared by chance only makes a candidate more. What can be lost is a link whose bands all differ or whose bytes agree far too seldom: at
the limit itself about 1e-7 a pair, and less above it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, joined_to_groups, shuffle_partitions
from .components import components
from .ngram_join import _leaders, _merged, _tiles, _units, _verified
from .vectors import binary, gather, joined, mix, runs, set_digest, shingles_of, signed, slices, words_of

WORDS, LIMIT = 5, 85
ROWS, BANDS = 6, 36
HASHES, BATCH = ROWS * BANDS, 24
#: The posterior probability of a link below which a pair is given up.
MISS = 1e-7
#: Shingles hashed at a time, so that they stay in a core's cache.
CHUNK = 1 << 15
_RANDOM = np.random.Generator(np.random.PCG64(20260302))
FLIP = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
TURN = _RANDOM.integers(0, 1 << 31, HASHES, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def minima(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The least of every hash over each set of shingles, one row a set; an empty set has the largest values."""
    n = np.diff(bounds)
    out = np.full((len(n), HASHES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(n)
    x = (mix(values) >> np.uint64(32)).astype(np.uint32)
    first = 0
    while first < len(full):
        start = int(bounds[full[first]])
        last = max(first + 1, int(np.searchsorted(bounds[full + 1], start + CHUNK, "right")))
        own = full[first:last]
        here = x[start : int(bounds[own[-1] + 1])]
        at = bounds[own] - start
        h, low = np.empty_like(here), np.empty_like(here)
        for k in range(HASHES):
            np.bitwise_xor(here, FLIP[k], out=h)
            np.multiply(h, TURN[k], out=h)
            np.right_shift(h, 15, out=low)
            np.bitwise_xor(h, low, out=h)
            np.multiply(h, np.uint32(0x2C1B3C6D), out=h)
            out[own, k] = np.minimum.reduceat(h, at)
        first = last
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of every row of minima."""
    out = np.zeros((len(least), BANDS), np.uint64)
    for r in range(ROWS):
        out = mix(out + least[:, r::ROWS].astype(np.uint64) + np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
    return out


def least_matches(limit: float, n: int, miss: float = MISS) -> int:
    """The fewest equal bytes of ``n`` at which a link of similarity ``limit`` or more keeps a posterior probability of ``miss``.

    Bytes of different minima agree once in 256 times, which lifts the limit on the share of equal ones a little.
    """
    t = limit + (1 - limit) / 256
    below = 0.0
    for m in range(n + 1):
        below += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log1p(-t))
        if below >= miss:
            return m
    return n


def survivors(one: np.ndarray, others: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``others`` (one byte a hash) that stay possible partners after every batch, and their numbers of equal bytes.

    ``one`` is a row, or as many rows as ``others`` has.
    """
    left = np.arange(len(others))
    equal = np.zeros(len(others), np.int64)
    for k, bar in enumerate(least):
        at = slice(k * BATCH, (k + 1) * BATCH)
        mine = one[at] if one.ndim == 1 else one[left, at]
        equal = equal + (others[left, at] == mine).sum(1)
        stay = equal >= bar
        left, equal = left[stay], equal[stay]
        if not len(left):
            break
    return left, equal


def _bars(limit: int, miss: float) -> list[int]:
    return [least_matches(limit / 100, k, miss) for k in range(BATCH, HASHES + 1, BATCH)]


def document_signatures(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id, rkey (a hash of doc_id and text), n_shingles, skey (digest of the set, null for an empty one), band keys and bytes of minima, packed."""
    names = ["doc_id", "rkey", "n_shingles", "skey", "bands", "bits"]

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(2)):
                values, bounds = shingles_of(words_of(texts), size)
                n = np.diff(bounds)
                least = minima(values, bounds)
                empty = n == 0
                bands = band_keys(least)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(signed(bands).ravel()))
                key = pa.array(signed(set_digest(values, bounds)), mask=empty)
                columns = [batch.column(0)[texts.rows], batch.column(1)[texts.rows], pa.array(n, pa.int64()), key, lists, binary([x.tobytes() for x in least.astype(np.uint8)])]
                yield pa.RecordBatch.from_arrays(columns, names)

    doc_id = docs["doc_id"].cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, docs["text"]).alias("rkey"), docs["text"].alias("text"))
    return rows.mapInArrow(signatures, "doc_id long, rkey long, n_shingles long, skey long, bands array<long>, bits binary")


def _banded(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """Sets that share a band key with another: skey, rkey, times, n, ``prefix`` (the shared keys) and bits."""
    reps = scratch.save(reps)
    tiles = reps.select("skey", F.explode("bands").alias("tile"))
    shared = tiles.groupBy("tile").agg(F.count("*").alias("c")).where("c > 1").select("tile")
    own = tiles.join(shared.hint("merge"), "tile").groupBy("skey").agg(F.sort_array(F.collect_list("tile")).alias("prefix"))
    return scratch.save(reps.join(own.hint("merge"), "skey").select("skey", "rkey", "times", "n", "prefix", "bits"))


def _full_sets(docs: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """skey, n and ``shared``, the sorted shingles, of the candidates, from the texts of the rows that represent them."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(0)):
                values, bounds = shingles_of(words_of(texts), size)
                key = signed(set_digest(values, bounds))
                parts = [values[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.diff(bounds), pa.int64()), binary(parts)], ["skey", "n", "shared"])

    rows = docs.select(F.xxhash64(docs["doc_id"].cast("long"), docs["text"]).alias("rkey"), docs["text"].alias("text"))
    out = rows.join(sets.select("rkey").hint("merge"), "rkey", "left_semi").select("text").mapInArrow(arrays, "skey long, n long, shared binary")
    if sets.where("times > 1").limit(1).isEmpty():
        return out
    return out.groupBy("skey").agg(F.first("n").alias("n"), F.first("shared").alias("shared"))


def _pruned(pairs: DataFrame, sets: DataFrame, bars: list[int]) -> DataFrame:
    """Pairs (a, b) that survive every batch."""

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (joined([x for x in batch.column(c)], np.uint8).reshape(-1, HASHES) for c in (2, 3))
            left, _ = survivors(p, q, bars)
            yield batch.select([0, 1]).take(pa.array(left))

    side = lambda k: sets.select(F.col("skey").alias(k), F.col("bits").alias(f"w{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "wa", "wb").mapInArrow(pruned, "a long, b long")


def unit_links(unit: pa.Table, limit: int, bars: list[int]) -> list[tuple[int, int]]:
    """Links that join the components of one unit: each pair of sets from different ones is pruned by batches, and survivors are decided on their full sets.

    Sets come in order of size. Once a link has joined two components their other pairs need no decision.
    """
    side, skey, comps, sizes = (unit[c].to_numpy() for c in ("side", "skey", "component", "n"))
    if (comps == comps[0]).all():
        return []
    bits = joined(unit["bits"].combine_chunks(), np.uint8).reshape(-1, HASHES)
    _, elements = np.unique(joined(unit["shared"].combine_chunks(), np.uint64), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    own = np.zeros(int(elements.max()) + 1, bool)
    root = np.unique(comps, return_inverse=True)[1]
    across = bool((side != side[0]).any())
    upto = np.searchsorted(sizes, sizes * 100 // limit, "right")
    out = []
    for k in range(len(sizes) - 1):
        rest = np.arange(k + 1, int(upto[k]))
        rest = rest[(root[rest] != root[k]) & ((side[rest] != side[k]) if across else True)]
        rest = rest[survivors(bits[k], bits[rest], bars)[0]]
        if not len(rest):
            continue
        mine = elements[starts[k] : starts[k] + sizes[k]]
        own[mine] = True
        n = sizes[rest]
        both = np.add.reduceat(own[elements[gather(starts[rest], n)]].astype(np.int64), np.cumsum(n) - n)
        own[mine] = False
        for r in rest[100 * both >= limit * (sizes[k] + n - both)].tolist():
            if root[r] != root[k]:
                out.append((int(skey[k]), int(skey[r])))
                root[root == root[r]] = root[k]
    return out


def _linking(limit: int, bars: list[int]):
    def linking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of unit; one unit is held at a time."""
        now, held = None, []

        def links() -> Iterator[pa.RecordBatch]:
            found = unit_links(pa.Table.from_batches(held), limit, bars) if held else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

        for batch in batches:
            for s, c in zip(*(x.tolist() for x in runs(batch.column(0).to_numpy()))):
                part = batch.slice(s, c)
                if now != part.column(0)[0].as_py():
                    yield from links()
                    now, held = part.column(0)[0].as_py(), []
                held.append(part)
        yield from links()

    return linking


def _linked_units(units: DataFrame, sets: DataFrame, labels: DataFrame, limit: int, bars: list[int]) -> DataFrame:
    """Links (a, b) from all units, each held by one task with its sets."""
    own = units.join(labels, "skey", "left").withColumn("component", F.coalesce("component", "skey"))
    rich = own.join(sets.select("skey", "n", "bits", "shared"), "skey").select("unit", "side", "skey", "component", "n", "bits", "shared")
    ordered = rich.repartition(shuffle_partitions(sets.sparkSession), "unit").sortWithinPartitions("unit", "n", "skey")
    return ordered.mapInArrow(_linking(limit, bars), "a long, b long")


def _rooted(docs: DataFrame, size: int, limit: int, miss: float) -> DataFrame:
    """doc_id, n_shingles and ``root``, the component of the document's set (null for an empty one)."""
    scratch, bars = Scratch(docs.sparkSession, "minhash"), _bars(limit, miss)
    rows = scratch.save(document_signatures(docs, size))
    filled = rows.where("skey IS NOT NULL")
    first = filled.groupBy("skey").agg(F.min("rkey").alias("rkey"))
    one = filled.groupBy("skey", "rkey").agg(F.count("*").alias("times"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    banded = _banded(one.join(first, ["skey", "rkey"]), scratch)
    full = _full_sets(docs, banded, size)
    sets = scratch.save(banded.join(full.select("skey", "shared"), "skey").select("skey", "n", "prefix", "bits", "shared"))
    led = scratch.save(_verified(_pruned(_leaders(sets), sets, bars), sets, limit).where("link"))
    labels = components(led, scratch)
    weighed = sets.withColumn("bits", F.concat("bits", "shared"))  # a unit's bytes are those of both
    units = _units(_tiles(weighed, labels, F.col("prefix")), sets, limit, scratch)
    links = scratch.save(_linked_units(units, sets, labels, limit, bars))
    if not links.limit(1).isEmpty():
        labels = _merged(labels, links, scratch)
    return rows.join(labels, "skey", "left").select("doc_id", "n_shingles", F.coalesce("component", "skey").alias("root"))


def near_duplicates(docs: DataFrame, size: int = WORDS, limit: int = LIMIT, miss: float = MISS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents link when 100 * intersection >= ``limit`` * union of their sets of ``size``-word shingles (the whole sequence where
    there are fewer words); component_id is the smallest doc_id reachable by links, and the row that has it is kept. A text
    without words (null, empty or white space) links with nothing and is kept. A null doc_id is never the smallest; a row without one is
    kept if its component has no doc_id at all. Rows that repeat a doc_id and its text all have that id's result. Very long texts are
    taken whole, one at a time. An empty table gives no rows; columns beyond doc_id and text aren't read.
    """
    scratch = Scratch(docs.sparkSession, "minhash-report")
    roots = scratch.save(_rooted(docs, size, limit, miss))
    found = roots.where("root IS NOT NULL")
    least = scratch.save(found.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")))
    out = joined_to_groups(found, least, ["root"], "rows", roots.count()).unionByName(roots.where("root IS NULL"), allowMissingColumns=True)
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: The same components for DuckDB; doc_id must be unique.
REPORT_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM reached r JOIN both_ways e ON r.id = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
FROM documents d LEFT JOIN sizes n USING (doc_id) JOIN (SELECT id, min(root) AS root FROM reached GROUP BY id) m ON m.id = d.doc_id
"""
