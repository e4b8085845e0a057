"""Operator 13, spelling variants by full neighbourhood generation.

Every word of the vocabulary emits each distinct string one deletion, replacement or insertion away, over the letters
that the vocabulary has; those found in the vocabulary are its near words, by a join on equal strings that needs no
verification of distance.

The strings are first generated as hashes only (one edit changes a polynomial hash by a few additions), in numpy over
blocks of words of equal length. A filter of bits over the vocabulary, of bounded size, lets the true ones and a few
others pass; only those become strings and meet the vocabulary in the join. So the result does not depend on the filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import BASE, INVERSE, U, mix

#: The runs that are words' raw forms, and one run in so many loses a letter.
NOT_RUN = "[^A-Za-zÀ-ÿ]+"
ALTERED = 97
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: Bits of the filter for each word, and the most bits of all (128 MB); the filter's size has no part in the result.
BITS_A_WORD, MOST_BITS, BLOCK_BITS = 48, 1 << 30, 1 << 16
#: Edited strings that are hashed at a time.
BLOCK = 1 << 20
_LETTERS = np.random.Generator(np.random.PCG64(20260313)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, altered: int = ALTERED) -> DataFrame:
    """(word, n): lower-cased runs of letters of all texts, where one in ``altered`` (by a checksum of doc_id and run) has lost one letter.

    A null text has none; a null doc_id counts as an empty one in the checksum.
    """
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    runs = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("id"), F.explode(F.split(F.translate(docs["text"], upper, lower), NOT_RUN)).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    runs = runs.where(F.length("run") >= least_length).select("run", h.alias("h"), F.length("run").alias("l"))
    at = (F.col("h") % F.col("l")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.col("l")))
    words = runs.select(F.when(F.col("h") % altered == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of words of equal length, one row of letters each."""
    length = codes.shape[1]
    return mix((_LETTERS[codes] * _powers(length)).sum(1, dtype=np.uint64) + U(length))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[U(1), np.full(max(n - 1, 0), BASE, np.uint64)])[:n]


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words of each length and their letters, all below 256."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        yield own, np.frombuffer("".join(words[k] for k in own).encode("latin-1"), np.uint8).reshape(-1, int(length))


def edited(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of all distinct strings one edit away from words of equal length: (kind, hash, which are distinct, letters of the last axis).

    Arrays are words x places, for deletions, or words x places x letters. A letter of a row of equal ones is deleted
    once, at its first; a letter is inserted before an equal one never, so once behind a row of them.
    """
    n, length = codes.shape
    up = _powers(length + 1)
    own = _LETTERS[codes] * up[:length]
    before = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(own, 1, dtype=np.uint64)], 1)
    total, letter = before[:, -1:], _LETTERS[alphabet]
    shrunk = mix(before[:, :-1] + (total - before[:, 1:]) * INVERSE + U(length - 1))
    first = np.ones((n, length), bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    yield "delete", shrunk, first, alphabet[:0]
    replaced = mix((total - own)[:, :, None] + (up[:length, None] * letter)[None] + U(length))
    yield "replace", replaced, codes[:, :, None] != alphabet, alphabet
    grown = mix((before + (total - before) * BASE)[:, :, None] + (up[:, None] * letter)[None] + U(length + 1))
    new = np.ones(grown.shape, bool)
    new[:, :-1] = codes[:, :, None] != alphabet
    yield "insert", grown, new, alphabet


def _places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Two places of a hash in a filter of so many bits, a power of two."""
    yield (h & U(bits - 1)).astype(np.int64)
    yield (mix(h) >> U(64 - bits.bit_length() + 1)).astype(np.int64)


def passes(table: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Indices of the hashes whose bits are both set."""
    left = np.arange(len(h))
    for place in (0, 1):
        at = list(_places(h[left], bits))[place]
        left = left[(table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
    return left


def vocabulary_filter(words: DataFrame) -> tuple[np.ndarray, int]:
    """The filter of the words' hashes: the tasks give it in blocks of 8 KB, at most MOST_BITS in all."""
    bits = BLOCK_BITS
    while bits < min(MOST_BITS, BITS_A_WORD * words.count()):
        bits *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, codes in by_length(batch.column(0).to_pylist()):
                at = np.unique(np.concatenate(list(_places(hashes(codes), bits))))
                yield pa.RecordBatch.from_arrays([pa.array(at // BLOCK_BITS), pa.array(at % BLOCK_BITS)], ["block", "bit"])

    def block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = np.zeros(BLOCK_BITS, bool)
        own[table["bit"].to_numpy()] = True
        return pa.table({"block": pa.array([key[0].as_py()]), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()])})

    out = np.zeros(bits // 8, np.uint8)
    found = words.select("word").mapInArrow(places, "block long, bit long").groupBy("block").applyInArrow(block, "block long, bits binary")
    for row in found.toLocalIterator():
        out[row["block"] * BLOCK_BITS // 8 : (row["block"] + 1) * BLOCK_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return out, bits


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of words that differ by one inserted, deleted or replaced letter, in both directions.

    ``words``: distinct (word, n) of letters below U+0100, saved, as it is read several times.
    """
    spark = words.sparkSession
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).distinct().where("letter <> ''").collect()  # at most 256
    alphabet = np.array(sorted(ord(r["letter"]) for r in letters), np.uint8)
    table, bits = vocabulary_filter(words)
    shared = spark.sparkContext.broadcast(table)

    def strings(word: str, kind: str, place: np.ndarray, letter: np.ndarray) -> Iterator[str]:
        if kind == "delete":
            return (word[:i] + word[i + 1 :] for i in place.tolist())
        skip = kind == "replace"
        return (word[:i] + chr(c) + word[i + skip :] for i, c in zip(place.tolist(), letter.tolist()))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1)
            for own, codes in by_length(words):
                step = max(1, BLOCK // ((codes.shape[1] + 1) * max(1, len(alphabet))))
                for s in range(0, len(own), step):
                    source, near = [], []
                    for kind, h, distinct, over in edited(codes[s : s + step], alphabet):
                        at = np.flatnonzero(distinct)
                        at = at[passes(shared.value, h.ravel()[at], bits)]
                        where = np.unravel_index(at, h.shape)
                        letter = over[where[2]] if len(where) == 3 else where[1]
                        cut = np.flatnonzero(np.r_[True, where[0][1:] != where[0][:-1]]) if len(at) else at
                        for b, e in zip(cut.tolist(), [*cut[1:].tolist(), len(at)]):
                            k = int(own[s + int(where[0][b])])
                            near += strings(words[k], kind, where[1][b:e], letter[b:e])
                            source += [k] * (e - b)
                    if near:
                        source = pa.array(source, pa.int64())
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(source), counts.take(source), pa.array(near, pa.string())], ["word", "n", "near"])

    found = words.select("word", "n").mapInArrow(candidates, "word string, n long, near string")
    return found.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def variant_groups(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, altered: int = ALTERED) -> DataFrame:
    """One row per word of the texts' vocabulary: word, n, n_near, form, form_n, root.

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if it has ``ratio`` times the word's n or more, else null;
    ``root`` is where following forms ends. Forms at least double n from step to step, so roots are found in few rounds that each
    double the steps taken. Null and empty texts have no words, equal rows count each, very long texts are split whole in one row; a run's length
    is not limited. An empty table gives no rows. Columns beyond doc_id and text aren't read.
    """
    if ratio < 2:
        raise ValueError("a form must have at least twice its word's count, or chains of forms could be long or circular")
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.save(word_counts(docs, least_length, least_count, altered))
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    form = F.when(-F.col("best.order") >= ratio * F.col("n"), F.col("best.near"))
    table = scratch.save(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.order")).alias("form_n")))
    up = scratch.save(table.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        over = up.select(F.col("word").alias("root"), F.col("root").alias("top"))
        further = scratch.save(up.join(over, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        done = further.where("moved").limit(1).isEmpty()
        scratch.drop(up)
        up = further.select("word", "root")
        scratch.paths[id(up)] = scratch.paths.pop(id(further))
        scratch._held.append(up)
        if done:
            return table.join(up, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


#: The same rows for DuckDB. The checksum is built from its definition: bits over a polynomial, table first, then bytes.
REPORT_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i AS b, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  GROUP BY ALL HAVING length(run) >= 5),
bytes AS (
  SELECT *, list_transform(range(1, octet_length(m) + 1), lambda i: ('0x' || substr(hex(m), 2 * i - 1, 2))::BIGINT) AS m8
  FROM (SELECT *, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS m FROM runs)),
hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, m8), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM bytes, crc),
words AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
holes AS (SELECT DISTINCT word, n, left(word, i) || '_' || substr(word, i + 2) AS hole, left(word, i) || substr(word, i + 2) AS rest, i
          FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT h.word, h.n, w.word, w.n FROM holes h JOIN words w ON h.rest = w.word
  UNION SELECT w.word, w.n, h.word, h.n FROM holes h JOIN words w ON h.rest = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.at AS root
FROM forms f JOIN chain c USING (word) JOIN forms e ON e.word = c.at AND e.form IS NULL
"""
