"""Operator 6, suffix-array deduplication of long byte strings across all documents.

A sparse suffix array over anchors. An anchor is a place whose 32-byte string has the smallest hash
among the 169 such strings of some 200-byte window, so equal windows hold the same anchor at the
same distance. Anchors whose 32 bytes occur once in the corpus are dropped after one shuffle of
packed hashes. Around each of the others up to 168 bytes before it and 200 from it on are sorted in
both directions, among the anchors of the same 32 bytes, by deep-shallow sorting: multikey quicksort
to a shallow depth, blind tries below it. From the sorted orders and their longest common prefixes
every window around an anchor gets exact classes of equal strings; windows in a class with two
occurrences or more are covered. A task sorts some thousand contexts at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions, text_or_empty
from .vectors import binary, gather, joined, mix, prefix_hash, runs, signed, slices, span_hash

LENGTH, GRAM = 200, 32
#: Depth in bytes to which multikey quicksort orders strings before blind tries take over.
SHALLOW = 40
FLUSH = 400_000
#: Contexts sorted at a time; all those of one 32-byte string are sorted together.
CHUNK = 8192
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best over values[i:i+width] for every i; len(values) - width + 1 results."""
    out, have = values, 1
    while 2 * have <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = best(out[: len(out) - (width - have)], out[width - have :])
    return out


def anchors_of(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors in ``data`` and hashes of the strings there; windows never cross the bounds of a text."""
    n, span = len(data), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix = prefix_hash(data)
    at = np.arange(n - gram + 1)
    h = span_hash(prefix, at, at + gram) | np.uint64(1)
    low = _sliding(h, span, np.minimum)  # by window start
    ok = np.zeros(n + 1, np.int32)
    starts, ends = bounds[:-1], bounds[1:]
    long_enough = ends - starts >= length
    np.add.at(ok, starts[long_enough], 1)
    np.add.at(ok, ends[long_enough] - length + 1, -1)
    low = np.where(np.cumsum(ok)[: len(low)] > 0, low, np.uint64(0))
    pad = np.zeros(span - 1, np.uint64)
    high = _sliding(np.concatenate([pad, low, pad]), span, np.maximum)  # over the windows that hold each place
    where = np.flatnonzero(high[: len(h)] == h)
    return where, h[where]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(hashes) % np.uint64(buckets)).astype(np.int32)


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    start, count = runs(bucket[order])
    for s, c in zip(start.tolist(), count.tolist()):
        yield int(bucket[order[s]]), order[s : s + c]


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    return pa.table({names[0]: pa.array([r[0] for r in rows], pa.int32())} | {c: binary([r[k] for r in rows]) for k, c in enumerate(names[1:], 1)})


ANCHORS = ["bucket", "keys", "sizes", "places", "hashes"]
PLACES = ["bucket", "keys", "sizes", "places"]
CONTEXTS = ["bucket", "grams", "lefts", "lengths", "blob", "counts", "keys", "sizes", "places"]
SPANS = ["bucket", "keys", "sizes", "starts", "ends"]


def _schema(names: list[str]) -> str:
    return ", ".join([f"{names[0]} int", *(f"{n} binary" for n in names[1:])])


def _packed_anchors(texts: DataFrame, buckets: int) -> DataFrame:
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, sizes, places, hashes = (np.concatenate(x) for x in zip(*held))
            rows = [(b, keys[o].tobytes(), sizes[o].tobytes(), places[o].tobytes(), hashes[o].tobytes()) for b, o in _split(_bucket(hashes, buckets))]
            yield from _table(rows, ANCHORS).to_batches()

        for batch in batches:
            key, size = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().astype(np.uint32)
            for texts_ in slices(batch.column(2)):
                where, hashes = anchors_of(texts_.data, texts_.bounds)
                doc = np.searchsorted(texts_.bounds, where, "right") - 1
                held.append((key[texts_.rows][doc], size[texts_.rows][doc], (where - texts_.bounds[doc]).astype(np.uint32), hashes))
                total += len(where)
                if total >= FLUSH:
                    yield from flush()
                    held, total = [], 0
        if total:
            yield from flush()

    return texts.select("key", "size", "text").mapInArrow(packed, _schema(ANCHORS))


def _repeated(buckets: int):
    def repeated(table: pa.Table) -> pa.Table:
        """Anchors whose string occurs at two places or more of distinct texts, packed by text."""
        keys, hashes = joined(table["keys"], np.uint64), joined(table["hashes"], np.uint64)
        sizes, places = joined(table["sizes"], np.uint32), joined(table["places"], np.uint32)
        order = np.lexsort((places, sizes, keys, hashes))
        keys, hashes, sizes, places = keys[order], hashes[order], sizes[order], places[order]
        if len(keys):
            new = np.r_[True, (hashes[1:] != hashes[:-1]) | (keys[1:] != keys[:-1]) | (sizes[1:] != sizes[:-1]) | (places[1:] != places[:-1])]
            keys, hashes, sizes, places = keys[new], hashes[new], sizes[new], places[new]
        start, count = runs(hashes)
        keep = np.repeat(count > 1, count)
        keys, sizes, places = keys[keep], sizes[keep], places[keep]
        rows = [(b, keys[o].tobytes(), sizes[o].tobytes(), places[o].tobytes()) for b, o in _split(_bucket(keys, buckets))]
        return _table(rows, PLACES)

    return repeated


def _by_text(table: pa.Table) -> pa.Table:
    """One row per text with its places."""
    keys, sizes, places = joined(table["keys"], np.uint64), joined(table["sizes"], np.uint32), joined(table["places"], np.uint32)
    order = np.lexsort((places, sizes, keys))
    keys, sizes, places = keys[order], sizes[order], places[order]
    change = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (sizes[1:] != sizes[:-1])]) if len(keys) else np.zeros(0, np.int64)
    ends = [*change[1:].tolist(), len(keys)]
    parts = [places[s:e].tobytes() for s, e in zip(change.tolist(), ends)]
    return pa.table({"key": pa.array(signed(keys)[change]), "size": pa.array(sizes[change].astype(np.int64)), "places": binary(parts)})


def _contexts(texts: DataFrame, buckets: int) -> DataFrame:
    """Bytes around the repeated anchors of each text; equal contexts of a batch go as one with their occurrences."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, size = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().astype(np.uint32)
            lists = [np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64) for x in batch.column(3)]
            for t in slices(batch.column(2)):
                own = lists[t.rows]
                doc = np.repeat(np.arange(len(t)), [len(x) for x in own])
                place = np.concatenate(own)
                at = place + t.bounds[doc]
                start, end = np.maximum(t.bounds[doc], at - (LENGTH - GRAM)), np.minimum(t.bounds[doc + 1], at + LENGTH)
                prefix = prefix_hash(t.data)
                whole, gram = span_hash(prefix, start, end), span_hash(prefix, at, at + GRAM) | np.uint64(1)
                left = at - start
                order = np.lexsort((left, whole))
                new = np.r_[True, (whole[order][1:] != whole[order][:-1]) | (left[order][1:] != left[order][:-1])]
                first, count = np.flatnonzero(new), np.diff(np.r_[np.flatnonzero(new), len(order)])
                lead = order[first]
                rows = []
                for b, o in _split(_bucket(gram[lead], buckets)):
                    mine = lead[o]
                    length = end[mine] - start[mine]
                    occ = order[gather(first[o], count[o])]
                    rows.append((b, gram[mine].tobytes(), left[mine].astype(np.uint16).tobytes(), length.astype(np.uint16).tobytes(), t.data[gather(start[mine], length)].tobytes(), count[o].astype(np.uint32).tobytes(), key[t.rows][doc[occ]].tobytes(), size[t.rows][doc[occ]].tobytes(), place[occ].astype(np.uint32).tobytes()))
                yield from _table(rows, CONTEXTS).to_batches()

    return texts.select("key", "size", "text", "places").mapInArrow(contexts, _schema(CONTEXTS))


class BlindTrie:
    """A trie that stores only where strings part. Inserting looks at the branching bytes alone, compares
    once with the string it arrives at, and parts an edge where they first differ."""

    __slots__ = ("strings", "root")

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.root: list | None = None  # leaf: [-1, members]; inner node: [place, children by byte]
        for k in range(len(strings)):
            self._insert(k)

    def _insert(self, k: int) -> None:
        s = self.strings[k]
        if self.root is None:
            self.root = [-1, [k]]
            return
        node = self.root
        while node[0] >= 0:
            c = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(c) or next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        n = min(len(s), len(other))
        apart = int.from_bytes(s[:n]) ^ int.from_bytes(other[:n])
        common = n - (apart.bit_length() + 7) // 8
        if common == len(s) == len(other):
            node[1].append(k)
            return
        above, node = None, self.root
        while 0 <= node[0] < common:
            above, via = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][via]
        c = s[common] if common < len(s) else -1
        if node[0] == common:
            node[1][c] = [-1, [k]]
            return
        there = node
        while there[0] >= 0:
            there = next(iter(there[1].values()))
        other = self.strings[there[1][0]]
        parted = [common, {c: [-1, [k]], (other[common] if common < len(other) else -1): node}]
        if above is None:
            self.root = parted
        else:
            above[1][via] = parted

    def ordered(self) -> list[int]:
        out: list[int] = []
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                out.extend(node[1])
            else:
                stack.extend(child for _, child in sorted(node[1].items(), reverse=True))
        return out


def multikey_quicksort(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``words`` inside their groups, and for each place the first place of the rows it is tied with.

    ``group``: the first row of each row's group; groups lie together. Every step takes all groups that are still
    tied and parts each by one character (eight bytes) into rows below, at and above its pivot; those at the pivot go on to the next character.
    """
    n, width = words.shape
    order, head, depth = np.arange(n), group.copy(), np.zeros(n, np.int64)
    at = np.arange(n)
    while True:
        _, count = runs(head[at])
        at = at[(np.repeat(count, count) > 1) & (depth[at] < width)]
        if not len(at):
            return order, head
        start, count = runs(head[at])
        rows = order[at]
        value = words[rows, depth[at]]
        ends = np.stack([value[start], value[start + count // 2], value[start + count - 1]])
        pivot = np.repeat(np.sort(ends, axis=0)[1], count)
        below, same = value < pivot, value == pivot
        n_below, n_same = np.add.reduceat(below, start, dtype=np.int64), np.add.reduceat(same, start, dtype=np.int64)
        first = np.repeat(at[start], count)
        middle, last = first + np.repeat(n_below, count), first + np.repeat(n_below + n_same, count)
        home = np.where(below, first, np.where(same, middle, last))
        place = np.empty(len(at), np.int64)
        for part in (below, same, ~(below | same)):
            own = home[part]
            s, c = runs(own)
            place[part] = own + np.arange(len(own)) - np.repeat(s, c)
        order[place], head[place] = rows, home
        depth[place] = depth[at] + same


def deep_shallow(padded: np.ndarray, sizes: np.ndarray, group: np.ndarray | None = None, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the rows of ``padded`` (bytes, zeros behind ``sizes``) within their groups, and the common prefix of each with the one before.

    Groups tied at depth ``shallow`` after multikey quicksort are ordered by blind tries.
    """
    n, width = padded.shape
    words = padded[:, : shallow // 8 * 8].copy().view(">u8").astype(np.uint64) if n else np.zeros((0, 0), np.uint64)
    order, head = multikey_quicksort(words, np.zeros(n, np.int64) if group is None else group)
    start, count = runs(head)
    for s, c in zip(start[count > 1].tolist(), count[count > 1].tolist()):
        rows = order[s : s + c]
        trie = BlindTrie([padded[r, : sizes[r]].tobytes() for r in rows])
        order[s : s + c] = rows[trie.ordered()]
    common = np.zeros(n, np.int64)
    if n > 1:
        differ = padded[order[1:]] != padded[order[:-1]]
        first = np.where(differ.any(1), differ.argmax(1), width)
        common[1:] = np.minimum(first, np.minimum(sizes[order[1:]], sizes[order[:-1]]))
    return order, common


def _classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """For each string the number of its class of equal prefixes of that depth."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def repeated_windows(right: np.ndarray, rsize: np.ndarray, left: np.ndarray, lsize: np.ndarray, times: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each context the smallest and largest distance of a repeated window's start before its anchor; -1 if none is.

    Contexts of one group (see ``multikey_quicksort``) begin with the same 32 bytes, those of two groups don't.
    """
    n = len(rsize)
    ro, rc = deep_shallow(right, rsize, group)
    lo, lc = deep_shallow(left, lsize, group)
    least, most = np.full(n, -1), np.full(n, -1)
    for o in range(LENGTH - GRAM + 1):
        there = np.flatnonzero((lsize >= o) & (rsize >= LENGTH - o))
        if not len(there):
            continue
        both = _classes(lo, lc, o)[there] * (n + 1) + _classes(ro, rc, LENGTH - o)[there]
        by = np.argsort(both, kind="stable")
        start, count = runs(both[by])
        total = np.add.reduceat(times[there][by], start)
        hit = there[by[np.repeat(total > 1, count)]]
        most[hit] = o
        least[hit] = np.where(least[hit] < 0, o, least[hit])
    return least, most


def _rows_from(blob: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width`` bytes from each start, zeros behind each size. ``blob`` has ``width`` bytes more than its last row needs."""
    out = np.lib.stride_tricks.sliding_window_view(blob, width)[start]
    out[np.arange(width) >= size[:, None]] = 0
    return out


def _chunks(gram: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The contexts in order of their 32 bytes, about ``most`` at a time; equal ones stay together."""
    order = np.argsort(gram, kind="stable")
    start, count = runs(gram[order])
    done = 0
    for s, c in zip(start.tolist(), count.tolist()):
        if s > done and s + c - done > most:
            yield order[done:s]
            done = s
    if done < len(order):
        yield order[done:]


def _covered(buckets: int):
    def covered(table: pa.Table) -> pa.Table:
        """Covered spans of texts around the anchors of one bucket, packed by text."""
        gram = joined(table["grams"], np.uint64)
        lsize, length = joined(table["lefts"], np.uint16).astype(np.int64), joined(table["lengths"], np.uint16).astype(np.int64)
        times = joined(table["counts"], np.uint32).astype(np.int64)
        begin = np.cumsum(length) - length
        margin = np.zeros(LENGTH, np.uint8)
        blob = np.concatenate([margin, joined(table["blob"], np.uint8), margin])
        back = blob[::-1]
        least, most = np.full(len(gram), -1), np.full(len(gram), -1)
        for own in _chunks(gram, CHUNK):
            anchor = begin[own] + lsize[own] + LENGTH
            rsize = length[own] - lsize[own]
            start, count = runs(gram[own])
            right = _rows_from(blob, anchor, rsize, LENGTH)
            left = _rows_from(back, len(blob) - anchor, lsize[own], LENGTH - GRAM)
            least[own], most[own] = repeated_windows(right, rsize, left, lsize[own], times[own], np.repeat(start, count))
        keys, sizes, places = joined(table["keys"], np.uint64), joined(table["sizes"], np.uint32), joined(table["places"], np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(gram)), times)
        hit = most[owner] >= 0
        owner, keys, sizes, places = owner[hit], keys[hit], sizes[hit], places[hit]
        start, end = (places - most[owner]).astype(np.uint32), (places + LENGTH - least[owner]).astype(np.uint32)
        rows = [(b, keys[o].tobytes(), sizes[o].tobytes(), start[o].tobytes(), end[o].tobytes()) for b, o in _split(_bucket(keys, buckets))]
        return _table(rows, SPANS)

    return covered


def _merged(table: pa.Table) -> pa.Table:
    """One row per text: its maximal covered spans."""
    keys, sizes = joined(table["keys"], np.uint64), joined(table["sizes"], np.uint32)
    starts, ends = joined(table["starts"], np.uint32).astype(np.int64), joined(table["ends"], np.uint32).astype(np.int64)
    order = np.lexsort((starts, sizes, keys))
    keys, sizes, starts, ends = keys[order], sizes[order], starts[order], ends[order]
    out = []
    if len(keys):
        new = np.r_[True, (keys[1:] != keys[:-1]) | (sizes[1:] != sizes[:-1])]
        text = np.cumsum(new) - 1
        reach = np.maximum.accumulate(ends + text * (1 << 33)) - text * (1 << 33)  # furthest end so far within the text
        fresh = new | np.r_[True, starts[1:] > reach[:-1]]
        at = np.flatnonzero(fresh)
        a, b = starts[at], np.maximum.reduceat(ends, at)
        first, count = runs(text[at])
        for f, c in zip(first.tolist(), count.tolist()):
            out.append((signed(keys)[at[f]], int(sizes[at[f]]), np.stack([a[f : f + c], b[f : f + c]], 1).astype(np.int64).tobytes()))
    return pa.table({"key": pa.array([r[0] for r in out], pa.int64()), "size": pa.array([r[1] for r in out], pa.int64()), "spans": binary([r[2] for r in out])})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, n_spans, shas = [], [], []
        for text, spans in zip(batch.column(2), batch.column(3)):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            pairs = np.frombuffer(spans.as_buffer(), np.int64).reshape(-1, 2).tolist()
            sha, at = hashlib.sha256(), 0
            for a, b in pairs:
                sha.update(data[at:a])
                at = b
            sha.update(data[at:])
            removed.append(sum(b - a for a, b in pairs))
            n_spans.append(len(pairs))
            shas.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(shas)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_or_empty(docs["text"])
    return docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("key"), F.octet_length(text).cast("long").alias("size"), text.alias("text"))


def covered_spans(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows of all documents (doc_id, key, size, sha, copies) and covered spans by (doc_id, key, size) of texts that occur once."""
    buckets = 4 * shuffle_partitions(docs.sparkSession)
    keyed = _keyed(docs)
    rows = scratch.save(keyed.select("doc_id", "key", "size", F.sha2("text", 256).alias("sha")))
    texts = rows.groupBy("key", "size").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    long_texts = keyed.where(F.col("size") >= LENGTH)
    places = _packed_anchors(long_texts, buckets).groupBy("bucket").applyInArrow(_repeated(buckets), _schema(PLACES))
    places = places.groupBy("bucket").applyInArrow(_by_text, "key long, size long, places binary")
    wanted = scratch.save(places.join(texts, ["key", "size"]))
    side = wanted.select(F.col("key").alias("k"), F.col("size").alias("s"), "rep", "places")
    held = long_texts.join(side, (F.col("key") == F.col("k")) & (F.col("size") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    spans = _contexts(held, buckets).groupBy("bucket").applyInArrow(_covered(buckets), _schema(SPANS))
    spans = spans.groupBy("bucket").applyInArrow(_merged, "key long, size long, spans binary")
    spans = scratch.save(spans.join(texts.where("copies = 1"), ["key", "size"]).select("key", "size", F.col("rep").alias("doc_id"), "spans"))
    return rows.join(texts.where("copies > 1").select("key", "size", "copies"), ["key", "size"], "left"), spans


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte covered by a 200-byte string that also starts anywhere else in the input, same document
    included, is removed. A null text counts as empty. A text of 200 bytes or more that two rows share
    goes whole; one of these rows stands for all of them when others are compared. Texts are told
    apart by a 64-bit hash and their size. Columns beyond doc_id and text are not read.
    """
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    rows, spans = covered_spans(docs, scratch)
    own = spans.select(F.col("key").alias("k"), F.col("size").alias("s"), F.col("doc_id").alias("d"), "spans")
    same = (F.col("key") == F.col("k")) & (F.col("size") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d"))
    cut = _keyed(docs).where(F.col("size") >= LENGTH).join(own, same)
    cut = cut.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("size").alias("n_bytes"), "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    gone = F.col("copies").isNotNull() & (F.col("size") >= LENGTH)
    rest = rows.join(own.select("k", "s", "d"), same, "left_anti")
    rest = rest.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("size").alias("n_bytes"),
        F.when(gone, F.col("size")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        gone.cast("long").alias("n_spans"),
        F.when(gone, F.lit(EMPTY_SHA)).otherwise(F.col("sha")).alias("kept_sha256"),
    )
    return rest.unionByName(cut)
