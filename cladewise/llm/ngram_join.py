"""Operator 4, n-gram Jaccard join in size-banded tiles with bitmap signatures.

Exact: no pair of different texts whose similarity reaches the limit is lost, and every link is
decided by intersecting the sorted arrays of both documents.

1.  A set that links has at most n - ceil(limit * n) shingles of its own. A first shuffle takes the
    shingles of one part of the hash space alone, 32 bits each, and counts for every set those that
    others have too. Sets with more shingles of their own in that part than all may be are done, and
    so are most of them; no partner of another set is among them.
    The distinct shingles of the rest go, packed by hash bucket, to a second shuffle that finds for every
    shingle the number of distinct sets it lies in. Copies (equal sets) count once. Shingles of one
    set alone can't be shared, so only the others go back to their documents. Shingles that a first
    count finds in more than one of ``HOT_SHARE`` documents skip both shuffles: they are shared and
    come last in the order, so nothing need be counted.
2.  In the order (number of sets, hash) two sets that link share a shingle among their first
    n - ceil(limit * n) + 1 ones. Most documents have that many shingles of their own and are done.
3.  For the rest a tile is one of those first shingles and a band of sizes; only neighbouring bands can
    link. A first round compares each document with a leader in two of its tiles; documents that are
    joined by then need no comparison any more.
4.  Tiles that still hold more than one component give their pairs if they hold few documents
    (``PAIR_DOCS``); each pair of fitting sizes is taken once, however many tiles it shares. Larger ones are cut into units of
    bounded bytes, which stream through the tasks. In both, popcounts come before the arrays: within a unit, popcounts of bitmaps bound the overlap from above. Of the partners
    that the bound leaves open a set names the best few, which are intersected; in the next round it goes
    on where it stopped, naming twice as many, until none has more to name. Large groups of near
    copies are joined in a few rounds and never give all their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, joined_to_groups, shuffle_partitions, text_or_empty
from .components import components
from .vectors import binary, gather, joined, mix, runs, set_digest, shingles_of, signed, slices, words_of

WORDS, LIMIT = 5, 75
#: Documents of a tile, and bytes of their bitmaps, that are compared with each other at a time.
BLOCK_DOCS, BLOCK_BYTES = 1024, 8_000_000
#: Documents up to which a tile's pairs are listed, without their bitmaps.
PAIR_DOCS = 64
#: Bits of a signature for each element that a set of the band's largest size has.
BITS_PER_ELEMENT, LEAST_BITS = 8, 512
#: Tiles of a set in the early rounds, the most of those rounds, and partners that a set names in the first round over all tiles.
FEW_TILES, EARLY_ROUNDS, NAMED = 6, 3, 8
FLUSH = 1_500_000
#: A shingle that lies in more than one of so many documents is hot (so there are at most so many times a text's shingles of them),
#: and the least number of documents for that. A flush of ``FLUSH`` shingles reports those it holds ``SEEN`` times at least.
HOT_SHARE, HOT_LEAST, SEEN = 200, 10_000, 8
OFTEN = np.iinfo(np.uint32).max
#: A round that names fewer than one in so many sets takes those sets out before it shuffles their shingles.
NEEDED_SHARE = 8
#: The part of the hash space that the first shuffle takes: at least this share, and so many times the share of its own shingles that a set that links can have.
PART_SHARE, PART_TIMES = 0.375, 1.5
#: Shingles of a bucket, in the part and of whole sets, where the shuffle's partitions would get more.
PART_BUCKET, WHOLE_BUCKET = 1_000_000, 500_000
#: Bits of the filter for each set that is left, the most of all (32 MB), and those that Spark's bitmaps hold; the filter's size has no part in the result.
BITS_A_SET, MOST_BITS, BITMAP = 32, 1 << 28, 1 << 15


def in_part(values: np.ndarray, limit: int) -> np.ndarray:
    """Which shingles lie in the part of the hash space that is looked at first; their upper 16 bits decide."""
    share = min(1.0, max(PART_SHARE, PART_TIMES * (1 - limit / 100)))
    return (values >> np.uint64(48)) < np.uint64(round(share * (1 << 16)))


def document_sets(docs: DataFrame, size: int = WORDS, seen: int = SEEN, limit: int = LIMIT) -> DataFrame:
    """doc_id, tkey (a hash of the text), n_shingles, ``n_part`` of them in the part, and ``skey``, a digest that stands for the set (null for an empty one).

    Further rows have ``shingle`` and ``times`` alone: a shingle that lies in so many of the documents of one flush, ``seen`` at least.
    """

    names = ["doc_id", "tkey", "n_shingles", "n_part", "skey", "shingle", "times"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def frequent() -> pa.RecordBatch:
            values = np.sort(np.concatenate(held))
            start, count = runs(values)
            often = count >= seen
            none = pa.nulls(int(often.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(signed(values[start[often]])), pa.array(count[often])], names)

        for batch in batches:
            for texts in slices(batch.column(2)):
                values, bounds = shingles_of(words_of(texts), size)
                n, part = np.diff(bounds), np.diff(np.r_[0, np.cumsum(in_part(values, limit))][bounds])
                key = pa.array(signed(set_digest(values, bounds)), mask=n == 0)
                none = pa.nulls(len(n), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[texts.rows], batch.column(1)[texts.rows], pa.array(n, pa.int64()), pa.array(part, pa.int64()), key, none, none], names)
                held.append(values)
                total += len(values)
                if total >= FLUSH:
                    yield frequent()
                    held, total = [], 0
        if total:
            yield frequent()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("tkey"), docs["text"].alias("text"))
    return rows.mapInArrow(sets, "doc_id long, tkey long, n_shingles long, n_part long, skey long, shingle long, times long")


def _hot(rows: DataFrame, least: int) -> np.ndarray:
    """Shingles that ``document_sets`` reports in more than one of HOT_SHARE documents: at most HOT_SHARE times the mean number of a text's shingles."""
    reported = rows.where("times IS NOT NULL").groupBy("shingle").agg(F.sum("times").alias("times")).where(F.col("times") >= least)
    if reported.limit(1).isEmpty():
        return np.zeros(0, np.uint64)
    bar = max(least, rows.where("times IS NULL").count() // HOT_SHARE)
    return np.sort(reported.where(F.col("times") > bar).select("shingle").toPandas()["shingle"].to_numpy(np.int64).view(np.uint64))


PACKED = "bucket int, hot boolean, keys binary, sizes binary, counts binary, values binary"


def _pack(bucket: np.ndarray, doc: np.ndarray, keys: np.ndarray, sizes: np.ndarray, values: list[np.ndarray]) -> Iterator[tuple]:
    """Rows of each bucket: its documents' keys, sizes and counts, then their values; rows must be in order of document."""
    order = np.argsort(bucket, kind="stable")
    start, count = runs(bucket[order])
    for s, c in zip(start.tolist(), count.tolist()):
        own = order[s : s + c]
        ds, dc = runs(doc[own])
        d = doc[own][ds]
        yield int(bucket[own[0]]), keys[d].tobytes(), sizes[d].astype(np.uint32).tobytes(), dc.astype(np.uint32).tobytes(), *(v[own].tobytes() for v in values)


def _distinct(*columns: np.ndarray) -> np.ndarray:
    """Places of the first of each group of equal rows."""
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    return np.sort(order[new])


def _flushes(batches: Iterator[pa.RecordBatch], size: int, bits: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """About ``FLUSH`` shingles at a time, equal sets once: the shingles, the place of each one's set, and all sets' digests and sizes.

    With ``bits`` come those texts alone whose hash passes the filter.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    total = 0

    def flush() -> tuple[np.ndarray, ...]:
        values = np.concatenate([v for v, _ in held])
        n = np.concatenate([np.diff(b) for _, b in held])
        keys = np.concatenate([set_digest(v, b) for v, b in held])
        one = _distinct(keys, n)
        return values[gather((np.cumsum(n) - n)[one], n[one])], np.repeat(one, n[one]), keys, n

    for batch in batches:
        column = batch.column(0)
        if bits is not None:
            at = batch.column(1).to_numpy() & (8 * len(bits) - 1)
            column = column.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0))
        for texts in slices(column):
            held.append(shingles_of(words_of(texts), size))
            total += len(held[-1][0])
            if total >= FLUSH:
                yield flush()
                held, total = [], 0
    if total:
        yield flush()


def _bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    """The low 16 bits of a hash give its bucket."""
    return ((values & np.uint64(0xFFFF)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int32)


def _part_buckets(docs: DataFrame, size: int, limit: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """Shingles of the part packed by bucket, and the number of the hot ones of each set, by bucket of the set.

    The 32 bits above a bucket's go along: shingles that agree in them are taken for shared, and the set is looked at once more.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, doc, keys, n in _flushes(batches, size):
            own = in_part(values, limit)
            values, doc = values[own], doc[own]
            common = np.isin(values, hot)
            v, d = values[~common], doc[~common]
            rows = [(r[0], False, r[1], r[3], r[4]) for r in _pack(_bucket_of(v, buckets), d, keys, n, [(v >> np.uint64(16)).astype(np.uint32)])]
            d = doc[common]
            rows += [(r[0], True, r[1], r[3], b"") for r in _pack(_bucket_of(mix(keys[d]), buckets), d, keys, n, [])]
            counts = [np.frombuffer(r[3], np.uint32) for r in rows]
            counts = [(c.astype(np.uint8) if c.max() < 256 else c).tobytes() for c in counts]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), binary([r[2] for r in rows]), binary(counts), binary([r[4] for r in rows])], ["bucket", "hot", "keys", "counts", "values"])

    return docs.select(docs["text"].alias("text")).mapInArrow(packed, "bucket int, hot boolean, keys binary, counts binary, values binary")


def _seen_in_part(table: pa.Table) -> pa.Table:
    """(skey, seen) of the sets of one bucket: how many of their shingles there lie in other sets too."""

    def sets_of(own: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = ([x.as_buffer() for x in own[c]] for c in ("keys", "counts"))
        counts = [np.frombuffer(c, np.uint8 if 8 * c.size == k.size else np.uint32).astype(np.int64) for k, c in zip(keys, counts)]
        return joined(own["keys"], np.uint64), np.concatenate([np.zeros(0, np.int64), *counts])

    cold, hot = table.filter(pc.invert(table["hot"])), table.filter(table["hot"])
    keys, counts = sets_of(cold)
    one = _distinct(keys)
    values = joined(cold["values"], np.uint32)[gather((np.cumsum(counts) - counts)[one], counts[one])]
    order = np.argsort(values, kind="stable")
    _, times = runs(values[order])
    doc = np.repeat(np.arange(len(one)), counts[one])[order[np.repeat(times > 1, times)]]
    seen = np.bincount(doc, minlength=len(one))
    also, times = sets_of(hot)
    once = _distinct(also)
    skey, seen = np.concatenate([keys[one][seen > 0], also[once]]), np.concatenate([seen[seen > 0], times[once]])
    return pa.table({"skey": pa.array(signed(skey)), "seen": pa.array(seen, pa.int64())})


def _left(rows: DataFrame, seen: DataFrame, limit: int) -> DataFrame:
    """(tkey, n): one text of each set that may still have a partner, after the part was looked at."""
    sets = rows.where("skey IS NOT NULL").groupBy("skey", F.col("n_shingles").alias("n")).agg(F.min("tkey").alias("tkey"), F.min("n_part").alias("n_part"))
    seen = seen.groupBy("skey").agg(F.sum("seen").alias("seen"))
    alone = F.col("n_part") - F.coalesce("seen", F.lit(0))
    return sets.join(seen, "skey", "left").where(alone <= F.col("n") - F.floor((limit * F.col("n") + 99) / 100)).select("tkey", "n")


def _filter(left: DataFrame, sets: int) -> np.ndarray:
    """A bitmap of the texts' hashes, at most MOST_BITS bits: the tasks give it in blocks."""
    bits = BITMAP
    while bits < min(MOST_BITS, BITS_A_SET * sets):
        bits *= 2
    place = F.col("tkey").bitwiseAND(F.lit(bits - 1))
    blocks = left.select(F.shiftright(place, 15).alias("block"), place.bitwiseAND(F.lit(BITMAP - 1)).alias("bit"))
    out = np.zeros(bits // 8, np.uint8)
    for row in blocks.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        out[row["block"] * BITMAP // 8 : (row["block"] + 1) * BITMAP // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _shingle_buckets(docs: DataFrame, size: int, buckets: int, hot: np.ndarray, bits: np.ndarray) -> DataFrame:
    """Shingles of the texts that pass the filter, packed by bucket; equal sets of a flush go once.

    The low 16 bits of a hash give its bucket, the other 48 go along. A hot shingle's bucket comes from the set too, and it goes along whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, doc, keys, n in _flushes(batches, size, shared.value):
            common = np.isin(values, hot)
            rows = []
            for kind, own in ((False, ~common), (True, common)):
                v, d = values[own], doc[own]
                sent = v if kind else v.view(np.uint8).reshape(-1, 8)[:, 2:]
                rows += [(r[0], kind, *r[1:]) for r in _pack(_bucket_of(mix(v ^ keys[d]) if kind else v, buckets), d, keys, n, [sent])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), *(binary([r[k] for r in rows]) for k in range(2, 6))], ["bucket", "hot", "keys", "sizes", "counts", "values"])

    return docs.select(docs["text"].alias("text"), F.xxhash64(docs["text"]).alias("tkey")).mapInArrow(packed, PACKED)


def _shared(buckets: int):
    def sets_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return joined(table["keys"], np.uint64), joined(table["sizes"], np.uint32), joined(table["counts"], np.uint32).astype(np.int64)

    def shared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Shingles of one bucket that lie in two sets or more, packed by bucket of the set."""
        cold, hot = table.filter(pc.invert(table["hot"])), table.filter(table["hot"])
        keys, sizes, counts = sets_of(cold)
        raw = joined(cold["values"], np.uint8).reshape(-1, 6)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, 2:] = raw
        # the low bits only tell shingles of different buckets apart
        values = wide.view(np.uint64).ravel() | np.uint64(key[0].as_py())
        starts = np.cumsum(counts) - counts
        one = _distinct(keys, sizes)
        values = values[gather(starts[one], counts[one])]
        doc = np.repeat(one, counts[one])
        order = np.argsort(values, kind="stable")
        start, count = runs(values[order])
        often = np.zeros(len(values), np.uint32)
        often[order] = np.repeat(count, count)
        keep = often > 1
        values, doc, often = values[keep], doc[keep], often[keep]
        order = np.argsort(doc, kind="stable")
        parts = [(doc[order], keys, sizes, values[order], often[order])]
        if len(hot):
            keys, sizes, counts = sets_of(hot)
            values, doc = joined(hot["values"], np.uint64), np.repeat(np.arange(len(keys)), counts)
            one = _distinct(values, keys[doc], sizes[doc])
            # the sets are told apart, so the same set's shingles need not lie together
            parts.append((np.arange(len(one)), keys[doc[one]], sizes[doc[one]], values[one], np.full(len(one), OFTEN, np.uint32)))
        rows = [r for d, k, n, v, o in parts for r in _pack((mix(k) % np.uint64(buckets)).astype(np.int32)[d], d, k, n, [v, o])]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32())} | {c: binary([r[k] for r in rows]) for k, c in enumerate(("keys", "sizes", "counts", "values", "often"), 1)})

    return shared


def signature_bits(n: int) -> int:
    bits = LEAST_BITS
    while bits < BITS_PER_ELEMENT * n:
        bits *= 2
    return bits


def signature(values: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap of hashed elements as 64-bit words. Folding it in halves gives the bitmap of half as many bits."""
    out = np.zeros(bits, bool)
    out[(mix(values) % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def fold(words: np.ndarray, n_words: int) -> np.ndarray:
    while len(words) > n_words:
        half = len(words) // 2
        words = words[:half] | words[half:]
    return words


def _candidates(limit: int):
    def candidates(table: pa.Table) -> pa.Table:
        """Sets that may have a partner: the shingles of their prefix that others have too, and all shared ones, sorted."""
        keys, sizes = joined(table["keys"], np.uint64), joined(table["sizes"], np.uint32).astype(np.int64)
        counts = joined(table["counts"], np.uint32).astype(np.int64)
        values, often = joined(table["values"], np.uint64), joined(table["often"], np.uint32)
        order = np.lexsort((sizes, keys))
        starts = np.cumsum(counts) - counts
        first, parts = runs(np.stack([keys, sizes.astype(np.uint64)], 1)[order].view([("k", np.uint64), ("n", np.uint64)]).ravel()) if len(keys) else runs(keys)
        out: list[tuple] = []
        for f, c in zip(first.tolist(), parts.tolist()):
            own = order[f : f + c]
            n, there = int(sizes[own[0]]), int(counts[own].sum())
            prefix = n - (limit * n + 99) // 100 + 1 - (n - there)
            if prefix <= 0:
                continue
            where = gather(starts[own], counts[own])
            v, o = values[where], often[where]
            ahead = np.lexsort((v, o))[:prefix]
            out.append((int(keys[own[0]].view(np.int64)), n, signed(v[ahead]), np.sort(v).tobytes(), signature(v, signature_bits(n)).tobytes()))
        return pa.table({"skey": pa.array([r[0] for r in out], pa.int64()), "n": pa.array([r[1] for r in out], pa.int64()), "prefix": pa.array([r[2] for r in out], pa.list_(pa.int64())), "shared": binary([r[3] for r in out]), "bits": binary([r[4] for r in out])})

    return candidates


def linked(x: np.ndarray, y: np.ndarray, nx: int, ny: int, limit: int) -> bool:
    """Whether two sets reach the limit, from their sorted shared elements and full sizes."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= limit * (nx + ny - both)


def _verified(pairs: DataFrame, sets: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b) of sets with ``link``: whether they reach the limit."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            link = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), n, m, limit) for x, y, n, m in zip(batch.column(4), batch.column(5), na, nb)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(link, pa.bool_())], ["a", "b", "link"])

    one = sets.select(F.col("skey").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    two = sets.select(F.col("skey").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    full = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb")
    return full.mapInArrow(verified, "a long, b long, link boolean")


def _needed(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The sets that occur in ``pairs``, or all of them where those are many. The keys are a saved table, so that Spark knows whether they are few enough to leave the sets where they lie."""
    keys = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("skey")).distinct())
    if NEEDED_SHARE * keys.count() > sets.count():
        return sets
    return scratch.save(sets.select("skey", "n", "shared").join(keys, "skey", "left_semi"))


def upper_bound(p: np.ndarray, q: np.ndarray, seen_p, seen_q):
    """The most elements that two sets can have in common, from their bitmaps of one width (rows of ``q``) and numbers of shared elements.

    Every bit that one bitmap has alone is an element that the other set lacks.
    """
    alone = lambda x, y: np.bitwise_count(x & ~y).sum(-1).astype(np.int64)
    return np.minimum(seen_p - alone(p, q), seen_q - alone(q, p))


def _bounded(pairs: DataFrame, sets: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b) whose bitmaps leave a link possible."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n, m, i, j in zip(batch.column(2), batch.column(3), *(batch.column(c).to_pylist() for c in range(4, 8))):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                words = min(len(p), len(q))
                bound = int(upper_bound(fold(p, words), fold(q, words), i, j))
                keep.append(100 * bound >= limit * (n + m - bound))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda k: sets.select(F.col("skey").alias(k), F.col("n").alias(f"n{k}"), (F.octet_length("shared") / 8).cast("long").alias(f"s{k}"), F.col("bits").alias(f"w{k}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "wa", "wb", "na", "nb", "sa", "sb")
    return full.mapInArrow(bounded, "a long, b long")


def _listed(units: DataFrame, sets: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b) of different components in one of the small units whose sizes and numbers of shared elements leave a link possible."""
    light = sets.select("skey", "n", (F.octet_length("shared") / 8).cast("long").alias("s"))
    rows = units.join(labels, "skey", "left").withColumn("component", F.coalesce("component", "skey")).join(light, "skey")
    one, two = (rows.select("unit", F.col("skey").alias(k), *(F.col(c).alias(f"{c}{k}") for c in ("component", "n", "s"))) for k in "ab")
    sizes = 100 * F.least("na", "nb") >= limit * F.greatest("na", "nb")
    shared = (100 + limit) * F.least("sa", "sb") >= limit * (F.col("na") + F.col("nb"))
    return one.join(two, "unit").where((F.col("a") < F.col("b")) & (F.col("componenta") != F.col("componentb")) & sizes & shared).select("a", "b").distinct()


def _leaders(sets: DataFrame) -> DataFrame:
    """Pairs of each set with the leader of its rarest and of its most frequent tile."""
    ends = F.array_distinct(F.array(F.element_at("prefix", 1), F.element_at("prefix", -1)))
    tiles = sets.select("skey", F.explode(ends).alias("tile"))
    lead = tiles.groupBy("tile").agg(F.min(F.struct(F.xxhash64("skey", "tile").alias("h"), "skey")).alias("lead"), F.count("*").alias("c")).where("c > 1")
    pairs = tiles.join(lead, "tile").where(F.col("skey") != F.col("lead.skey"))
    return pairs.select(F.least("skey", "lead.skey").alias("a"), F.greatest("skey", "lead.skey").alias("b")).distinct()


def _load(docs, weight) -> Column:
    """Blocks that so many documents with bitmaps of so many bytes need."""
    return F.greatest(F.ceil(docs / BLOCK_DOCS), F.ceil(weight / BLOCK_BYTES)).cast("int")


def _tiles(sets: DataFrame, labels: DataFrame, taken: Column) -> DataFrame:
    """(tile, skey, component, w): ``component`` is null for a set that is joined with no other one."""
    known = sets.select("skey", F.octet_length("bits").alias("w"), taken.alias("tiles")).join(labels, "skey", "left")
    return known.select("skey", "component", "w", F.explode("tiles").alias("tile"))


def _units(tiles: DataFrame, sets: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """(unit, side, skey): the parts of the tiles that hold more than one component, of bounded size.

    A small tile is one unit. A large one is cut by band into blocks, those of a large component apart from
    those of all others; a unit is a block, or two blocks of one band or of neighbouring ones, and none lies within one component.
    A set that is at most 100 / limit times as large as another lies in its band or the next one.
    """
    component = F.coalesce("component", "skey")
    mixed = tiles.groupBy("tile").agg(F.min(component).alias("x"), F.max(component).alias("y"), F.count("*").alias("c"), F.sum("w").alias("w"))
    mixed = mixed.where("x <> y").select("tile", (_load(F.col("c"), F.col("w")) > 1).alias("large"))
    rows = scratch.save(tiles.join(mixed, "tile"))
    whole = rows.where("NOT large").select(F.xxhash64("tile").alias("unit"), F.lit(0).alias("side"), "skey")
    rows = rows.where("large").withColumn("component", component)
    if rows.limit(1).isEmpty():
        return _distinct_units(whole, scratch)
    step = math.log(max(1.01, 100 / limit)) * 1.0001
    rows = rows.join(sets.select("skey", F.floor(F.log("n") / step).alias("band")), "skey")
    at = ["tile", "band"]
    per = rows.groupBy(*at, "component").agg(F.count("*").alias("c"), F.sum("w").alias("w"))
    big = per.select(*at, "component", _load(F.col("c"), F.col("w")).alias("own")).where("own > 1")
    rest = per.where(_load(F.col("c"), F.col("w")) <= 1).groupBy(*at).agg(_load(F.sum("c"), F.sum("w")).alias("parts"))
    rows = rows.join(big, [*at, "component"], "left").join(rest, at, "left")
    apart = F.struct("component", F.pmod(F.xxhash64("skey"), F.col("own")).alias("k"))
    among = F.struct(F.lit(None).cast("long").alias("component"), F.pmod(F.xxhash64("component"), F.col("parts")).alias("k"))
    block = F.when(F.col("own").isNotNull(), F.xxhash64(*at, F.lit("apart"), apart)).otherwise(F.xxhash64(*at, F.lit("among"), among))
    rows = scratch.save(rows.select(*at, "skey", "component", block.alias("block")))
    blocks = scratch.save(rows.groupBy(*at, "block").agg(F.min("component").alias("x"), F.max("component").alias("y")))
    one, two = (blocks.select("tile", *(F.col(c).alias(f"{c}{k}") for c in ("band", "block", "x", "y"))) for k in (1, 2))
    near = F.col("band2") - F.col("band1")
    pairs = one.join(two, "tile").where(((near == 1) | (near == 0) & (F.col("block1") <= F.col("block2"))) & (F.least("x1", "x2") != F.greatest("y1", "y2")))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("block1").alias("block")), F.struct(F.lit(1).alias("side"), F.col("block2").alias("block")))
    sides = F.when(F.col("block1") == F.col("block2"), F.slice(sides, 1, 1)).otherwise(sides)
    units = pairs.select(F.xxhash64("block1", "block2").alias("unit"), F.explode(sides).alias("s")).select("unit", "s.side", "s.block")
    cut = rows.select("block", "skey").join(units, "block").select("unit", "side", "skey")
    return _distinct_units(whole.unionByName(cut), scratch)


def _distinct_units(units: DataFrame, scratch: Scratch) -> DataFrame:
    """Without units of the same sets and sides as another one: a passage that documents share gives them many tiles, and one is enough."""
    units = scratch.save(units)
    member = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "side", "skey"))
    alike = units.groupBy("unit").agg(F.count("*").alias("c"), member(1).alias("x"), member(2).alias("y"))
    return scratch.save(units.join(alike.groupBy("c", "x", "y").agg(F.min("unit").alias("unit")).select("unit"), "unit"))


def _parted(units: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Units whose pairs are too many to list, and those of few sets."""
    few = units.groupBy("unit").agg(F.count("*").alias("c"), F.max("side").alias("side")).where((F.col("c") <= PAIR_DOCS) & (F.col("side") == 0)).select("unit")
    return scratch.save(units.join(few, "unit", "left_anti")), scratch.save(units.join(few, "unit"))


def _partners(unit: pa.Table, limit: int, most: int) -> Iterator[tuple]:
    """Sets of one unit, in order of size, with partners from other components whose sizes and bitmaps leave a link possible.

    A set names the first ``most`` partners by bound and key behind those it has named before; ``more`` tells that there are others.
    """
    side, skey, comps, sizes, seen = (unit[c].to_numpy() for c in ("side", "skey", "component", "n", "n_shared"))
    if (comps == comps[0]).all():
        return
    after, key_after = unit["bound"].to_numpy(), unit["last"].to_numpy()
    bits = [np.frombuffer(x.as_buffer(), np.uint64) for x in unit["bits"]]
    across = bool((side != side[0]).any())
    upto = np.searchsorted(sizes, sizes * 100 // limit, "right")  # partners no larger than n / limit
    widths: dict[int, np.ndarray] = {}
    for k in range(len(sizes) - 1):
        if after[k] < 0:
            continue
        rest = np.arange(k + 1, int(upto[k]))
        rest = rest[comps[rest] != comps[k]]
        if across:
            rest = rest[side[rest] != side[k]]
        if not len(rest):
            continue
        words = len(bits[k])
        if words not in widths:
            widths[words] = np.stack([fold(b, words) if len(b) >= words else np.zeros(words, np.uint64) for b in bits])
        mine, theirs = widths[words][k], widths[words][rest]
        bound = upper_bound(mine, theirs, seen[k], seen[rest])
        both = int(sizes[k]) + sizes[rest]
        fits = (100 * bound >= limit * (both - bound)) & ((bound < after[k]) | (bound == after[k]) & (skey[rest] > key_after[k]))
        rest, bound = rest[fits], bound[fits]
        if len(rest):
            best = np.lexsort((skey[rest], -bound))[:most]
            yield int(skey[k]), skey[rest[best]], len(rest) > most, int(bound[best[-1]]), int(skey[rest[best[-1]]])


def _naming(limit: int, most: int):
    names = ["unit", "skey", "partners", "more", "bound", "last"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int64(), pa.int64()]

    def naming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of unit; one unit is held at a time."""
        now, held, out = None, [], []

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            unit = batch.column(0).to_numpy()
            start, count = runs(unit)
            for s, c in zip(start.tolist(), count.tolist()):
                if now != unit[s]:
                    if held:
                        out += [(now, *r) for r in _partners(pa.Table.from_batches(held), limit, most)]
                    now, held = int(unit[s]), []
                held.append(batch.slice(s, c))
            if len(out) >= 2000:
                yield table()
                out = []
        if held:
            out += [(now, *r) for r in _partners(pa.Table.from_batches(held), limit, most)]
        if out:
            yield table()

    return naming


NAMING = "unit long, skey long, partners array<long>, more boolean, bound long, last long"


def _joined_by_rounds(sets: DataFrame, units: DataFrame, labels: DataFrame, checked: DataFrame, limit: int, most: int, rounds: int | None, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Labels and checked pairs after rounds over the units.

    ``rounds``: None goes on until no set has more partners to name, which decides every pair; a number is the most rounds, which also end when one joins nothing.
    """
    side = sets.select("skey", "n", (F.octet_length("shared") / 8).cast("long").alias("n_shared"), "bits")
    rows = units.withColumns({"bound": F.lit(1 << 40), "last": F.lit(0).cast("long")})
    done = 0
    while True:
        own = rows.join(labels, "skey", "left").withColumn("component", F.coalesce("component", "skey"))
        if done:  # links of the last round may have made a unit one component
            own = scratch.save(own)
            own = own.join(own.groupBy("unit").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("unit"), "unit")
        full = own.join(side, "skey").select("unit", "side", "skey", "component", "n", "n_shared", "bound", "last", "bits")
        ordered = full.repartition(shuffle_partitions(sets.sparkSession), "unit").sortWithinPartitions("unit", "n", "skey")
        named = scratch.save(ordered.mapInArrow(_naming(limit, most), NAMING))
        pairs = named.select("skey", F.explode("partners").alias("other")).select(F.least("skey", "other").alias("a"), F.greatest("skey", "other").alias("b")).distinct()
        pairs = scratch.save(pairs.join(checked, ["a", "b"], "left_anti"))
        new = scratch.save(_verified(pairs, _needed(pairs, sets, scratch), limit))
        checked = checked.unionByName(new.select("a", "b"))
        joins = not new.where("link").limit(1).isEmpty()
        if joins:
            labels = _merged(labels, new.where("link"), scratch)
        done += 1
        more = named.where("more")
        if more.limit(1).isEmpty() or rounds is not None and (done == rounds or not joins):
            return labels, checked
        rows = units.join(more.select("unit").distinct(), "unit").join(more.select("unit", "skey", "bound", "last"), ["unit", "skey"], "left")
        rows = rows.withColumns({"bound": F.coalesce("bound", F.lit(-1)), "last": F.coalesce("last", F.lit(0))})
        most *= 2 if rounds is None else 1


def _merged(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels after further links, by components of components."""
    ends = links.select(F.col("a").alias("skey")).unionByName(links.select(F.col("b").alias("skey"))).distinct()
    known = scratch.save(ends.join(labels, "skey", "full").select("skey", F.coalesce("component", "skey").alias("component")))
    to = lambda side: known.select(F.col("skey").alias(side), F.col("component").alias(f"c{side}"))
    across = links.select("a", "b").join(to("a"), "a").join(to("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    above = components(across, scratch).select(F.col("skey").alias("up"), F.col("component").alias("top"))
    return scratch.save(known.join(above, known["component"] == above["up"], "left").select("skey", F.coalesce("top", "component").alias("component")))


def _rooted(docs: DataFrame, size: int, limit: int, hot_least: int, seen: int) -> DataFrame:
    """doc_id, tkey, n_shingles and ``root``, the component of the document's set (null for an empty one)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    found = scratch.save(document_sets(docs, size, seen, limit))
    rows = found.where("times IS NULL").select("doc_id", "tkey", "n_shingles", "n_part", "skey")
    hot = _hot(found, hot_least)
    enough = lambda shingles, most: min(1 << 16, max(shuffle_partitions(spark), 1 + (shingles or 0) // most))
    buckets = enough(rows.agg(F.sum("n_part")).first()[0], PART_BUCKET)
    seen_in_part = _part_buckets(docs, size, limit, buckets, hot).groupBy("bucket").applyInArrow(_seen_in_part, "skey long, seen long")
    left = scratch.save(_left(rows, seen_in_part, limit))
    count, shingles = left.agg(F.count("*"), F.sum("n")).first()
    buckets = enough(shingles, WHOLE_BUCKET)
    packed = "bucket int, keys binary, sizes binary, counts binary, values binary, often binary"
    back = _shingle_buckets(docs, size, buckets, hot, _filter(left, count)).groupBy("bucket").applyInArrow(_shared(buckets), packed)
    schema = "skey long, n long, prefix array<long>, shared binary, bits binary"
    sets = scratch.save(back.groupBy("bucket").applyInArrow(_candidates(limit), schema))
    led = scratch.save(_verified(_leaders(sets), sets, limit))
    labels, checked = components(led.where("link"), scratch), led.select("a", "b")
    n = F.size("prefix")
    spread = F.transform(F.sequence(F.lit(0), F.lit(FEW_TILES - 1)), lambda k: F.element_at("prefix", (1 + F.floor(k * (n - 1) / (FEW_TILES - 1))).cast("int")))
    # some rounds over few of the large tiles join what lies close together, so that fewer tiles still hold more than one component
    few, _ = _parted(_units(_tiles(sets, labels, F.array_distinct(spread)), sets, limit, scratch), scratch)
    if not few.limit(1).isEmpty():
        labels, checked = _joined_by_rounds(sets, few, labels, checked, limit, 1, EARLY_ROUNDS, scratch)
    large, small = _parted(_units(_tiles(sets, labels, F.col("prefix")), sets, limit, scratch), scratch)
    pairs = scratch.save(_bounded(_listed(small, sets, labels, limit).join(checked, ["a", "b"], "left_anti"), sets, limit))
    found = scratch.save(_verified(pairs, sets, limit))
    checked = checked.unionByName(found.select("a", "b"))
    if not found.where("link").limit(1).isEmpty():
        labels = _merged(labels, found.where("link"), scratch)
    if not large.limit(1).isEmpty():
        labels, _ = _joined_by_rounds(sets, large, labels, checked, limit, NAMED, None, scratch)
    return rows.join(labels, "skey", "left").select("doc_id", "tkey", "n_shingles", F.coalesce("component", "skey").alias("root"))


def jaccard_components(docs: DataFrame, size: int = WORDS, limit: int = LIMIT, hot_least: int = HOT_LEAST, seen: int = SEEN) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Two documents link when 100 * intersection >= ``limit`` * union of their sets of ``size``-word shingles;
    component_id is the smallest doc_id reachable by links. A text without words (null, empty or white
    space) has an empty set and is its own component. Rows that repeat a doc_id are one document if their
    texts link and otherwise end in one component only through links; a null doc_id never is the smallest.
    Sets are told apart by a 64-bit digest and their size; shingles by 48 bits of hash and their bucket.
    Columns beyond doc_id and text are not read.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join-report")
    roots = scratch.save(_rooted(docs, size, limit, hot_least, seen).select("doc_id", "n_shingles", "root"))
    found = roots.where("root IS NOT NULL")
    least = scratch.save(found.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")))
    out = joined_to_groups(found, least, ["root"], "rows", roots.count()).unionByName(roots.where("root IS NULL"), allowMissingColumns=True)
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, size: int = WORDS, limit: int = LIMIT) -> DataFrame:
    """``docs`` with one document of every component, all columns as they were.

    The row of the smallest doc_id stays (nulls last; of several texts under that doc_id, the one of the smallest hash).
    Rows without words link with nothing and all stay, repeated ones too. Of rows that repeat a doc_id and its text one stays; only where
    such rows exist does that take another shuffle of the texts. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join-kept")
    roots = scratch.save(_rooted(docs, size, limit, HOT_LEAST, SEEN).where("root IS NOT NULL").select("doc_id", "tkey", "root"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey"))
    first = scratch.save(roots.groupBy("root").agg(least.alias("first"), F.count("*").alias("rows")))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tkey") == F.col("first.tkey"))
    gone = joined_to_groups(roots, first, ["root"], "rows", roots.count()).where(~stays).select(F.col("doc_id").alias("__id"), F.col("tkey").alias("__key")).distinct()
    text = F.xxhash64(docs["text"])
    repeated = roots.groupBy("doc_id", "tkey").count().where("count > 1")
    out = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (text == gone["__key"]), "left_anti")
    if repeated.limit(1).isEmpty():
        return out
    own = F.when(F.regexp_like(text_or_empty(docs["text"]), F.lit(r"[^\x20\x09-\x0D]")), F.lit(None).cast("long")).otherwise(F.monotonically_increasing_id())
    names = [f"`{c}`" for c in docs.columns]
    marked = out.select(*names, text.alias("__text"), own.alias("__own"))
    return marked.dropDuplicates(["doc_id", "__text", "__own"]).select(*names)


#: The same components for DuckDB; doc_id must be unique.
REPORT_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)
      UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON r.id = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) m ON m.id = d.doc_id
"""
