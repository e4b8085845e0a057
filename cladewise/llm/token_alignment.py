"""Operator 11, alignment of two tokenizers' tokens by a dangling-suffix transducer.

The transducer reads the tokens of both sides of one text. Its state is the side that leads and the bytes by which it
leads; the trailing side moves next. Transitions are memoised by state and token. When nothing dangles, a group closes:
its last two tokens end at the same byte, which links them.

Texts are cut into units where neither tokenizer can join what stands left and right of the cut (``cuts_are_safe``); a unit's ids, groups and
links are remembered, so that a frequent word is encoded and aligned once a task. Where a unit's bytes don't come out right, its
whole text is encoded and aligned in one piece.

Of two tokens that end at the same byte, the shorter one's bytes are a suffix of the other's. So the id pairs that can
ever link number at most the summed lengths of both vocabularies' entries (under two million), whatever the corpus: their
counts over the corpus may be collected and broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_symbols
from .common import Scratch

#: Code points of the longest unit that is remembered, and the most units that a worker remembers before it starts anew.
LONGEST, REMEMBERED = 64, 250_000
#: Units that are encoded end to end at a time.
TOGETHER = 20_000
#: White space that isn't one space or line feed between other characters.
ODD = r"(?:\s{2,}|[^\S \n]|\s\Z)"
ODD_SPACE = re.compile(ODD).search
UNITS = re.compile(rf"(?:[ \n]?\S+|{ODD}\S*)(?:{ODD}\S*)*").findall
INNER_SPACE = re.compile(r"\S\s|\s\s|[^\S\n]").search
#: A's pattern of words, and the decimal digits of ids.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WIDTH = np.array([len(str(i)) for i in range(1 << 16)])
DIGITS = np.array([f"{i:<6}".encode() for i in range(1 << 16)]).view(np.uint8).reshape(-1, 6)
#: Letters whose classes are the same in every version of Unicode that an encoder may follow.
QUICK = re.compile(r"[\0-\u024F]*").fullmatch
#: The mark before a unit that its key would not tell.
UNUSUAL = "\0"
#: B's fixed values: the character that stands for a space, and the form of its single bytes.
MARK, BYTE = "▁", "<0x"


class State(dict):
    """A state of the transducer: side 0 or 1 moves next, and ``residual`` is what the other one leads by. Maps the next token to a state."""

    __slots__ = ("side", "residual", "machine")

    def __init__(self, machine: Transducer, side: int, residual: bytes) -> None:
        self.machine, self.side, self.residual = machine, side, residual

    def __missing__(self, token: int) -> State | None:
        to = self[token] = self.machine.step(self, token)
        return to


class Transducer:
    """Aligns two id sequences by the bytes of their tokens; ``tables`` has the bytes of either side's ids."""

    def __init__(self, tables: tuple[list[bytes], list[bytes]]) -> None:
        self.tables = tables
        self.states: dict[tuple[int, bytes], State] = {}
        self.closed = self.state(0, b"")

    def state(self, side: int, residual: bytes) -> State:
        key = (side, residual) if residual else (0, b"")  # nothing dangles: the first side moves
        if key not in self.states:
            self.states[key] = State(self, *key)
        return self.states[key]

    def step(self, state: State, token: int) -> State | None:
        """The state after the trailing side's next token; None where the two sides' bytes differ."""
        moved, residual = self.tables[state.side][token], state.residual
        if state is self.closed:
            return self.state(1, moved)
        if residual.startswith(moved):
            return self.state(state.side, residual[len(moved) :])
        if moved.startswith(residual):
            return self.state(1 - state.side, moved[len(residual) :])
        return None

    def groups(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]] | None:
        """How many tokens of either side end with each group; None where the bytes differ."""
        closed, ends_a, ends_b = self.closed, [], []
        i = j = 0
        try:
            while i < len(a):
                state = closed[a[i]]
                i += 1
                while state is not closed:
                    if state.side:
                        state = state[b[j]]
                        j += 1
                    else:
                        state = state[a[i]]
                        i += 1
                ends_a.append(i)
                ends_b.append(j)
        except (IndexError, AttributeError):  # a side has no more tokens, or the bytes differ and the state is None
            return None
        return (ends_a, ends_b) if j == len(b) else None


#: What is remembered of a unit or found for a text: numbers of A's tokens, B's tokens and groups, the groups as text, and packed links (a * 2**16 + b).
Aligned = tuple[int, int, int, bytes, bytes]


class Aligner:
    """Two tokenizers and what is remembered of units.

    A unit's key is the unit without its leading space; one that starts with a line feed is its own key, and any other goes behind a mark.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        byte_of = {s: n for n, s in enumerate(byte_symbols())}
        vocab = self.a.get_vocab()
        bytes_a = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            bytes_a[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.transducer = Transducer((bytes_a, bytes_b))
        self.bytes_a, self.length_a = bytes_a, np.array([len(x) for x in bytes_a])
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.quick_a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={bytes_a[i]: i for p, i in vocab.items() if p not in special}, special_tokens={})
        self.apart = cuts_are_safe(pieces)
        self.young: dict[str, Aligned | None] = {}
        self.old: dict[str, Aligned | None] = {}

    def encoded(self, text: str, quick: bool) -> tuple[list[int], list[int]]:
        """Both sides' ids of a text that has its space in front, or starts with a line feed; B adds a space, which before a line feed is a piece of its own.

        ``quick``: the text has letters of QUICK alone, for which the faster of two encoders of A's vocabulary gives the same ids.
        """
        b = self.b.encode(text[1:] if text[0] == " " else text)
        a = self.quick_a.encode_ordinary(text) if quick else self.a.encode(text, add_special_tokens=False).ids
        return a, b if text[0] == " " else b[1:]

    def end_to_end(self, text: str, quick: bool, wanted: np.ndarray) -> list[Aligned] | None:
        """What lies between the bytes ``wanted``, of which the last one is the text's end; None where a side's bytes differ or no group ends there."""
        a, b = self.encoded(text, quick)
        if b"".join([self.bytes_a[i] for i in a]) != text.encode():
            return None
        found = self.transducer.groups(a, b)
        if found is None:
            return None
        a, b, ends_a, ends_b = (np.array(x, np.int64) for x in (a, b, *found))
        at = np.cumsum(self.length_a[a])[ends_a - 1]
        last = np.searchsorted(at, wanted)
        if (at[last] != wanted).any():
            return None
        links = (a[ends_a - 1] << 16 | b[ends_b - 1]).astype(np.uint32).tobytes()
        # digits and separators of all tokens, in the order of groups, A before B
        count_a, count_b = np.diff(np.r_[0, ends_a]), np.diff(np.r_[0, ends_b])
        to_a = np.arange(len(a)) + np.repeat(ends_b - count_b, count_a)
        to_b = np.arange(len(b)) + np.repeat(ends_a, count_b)
        ids, sep = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[to_a], ids[to_b] = a, b
        sep[to_a[ends_a - 1]], sep[to_b[ends_b - 1]] = ord("|"), ord(";")
        digits, width = DIGITS[ids], WIDTH[ids]
        digits[np.arange(len(ids)), width] = sep
        shown = digits[np.arange(6) <= width[:, None]].tobytes()
        upto = np.cumsum(width + 1)[to_b[ends_b - 1]]
        first = np.r_[0, last[:-1] + 1]
        columns = (np.diff(np.r_[0, ends_a[last]]), np.diff(np.r_[0, ends_b[last]]), first, last + 1, np.r_[0, upto[last[:-1]]], upto[last] - 1)
        return [(x, y, e - f, shown[s:t], links[4 * f : 4 * e]) for x, y, f, e, s, t in zip(*(c.tolist() for c in columns))]

    def aligned(self, text: str) -> Aligned | None:
        """One unit, or a text behind its space, by itself; None where the bytes of a side differ from it."""
        found = self.end_to_end(text, False, np.array([len(text.encode())]))
        return found and found[0]

    def learn(self, keys: list[str], odd: set[str]) -> Iterator[tuple[str, Aligned | None]]:
        """Units by key. Those without odd space are aligned end to end, for they stand apart in that text as in any other."""
        plain = [k for k in keys if k not in odd]
        quick = [k for k in plain if k.isascii() or QUICK(k)]
        for own, is_quick in ((quick, True), (list(set(plain).difference(quick)), False)):
            for s in range(0, len(own), TOGETHER):
                units = list(map(unit_of, own[s : s + TOGETHER]))
                found = self.end_to_end("".join(units), is_quick, np.cumsum([len(u.encode()) for u in units]))
                yield from zip(own[s : s + TOGETHER], found or map(self.aligned, units))
        yield from ((k, self.aligned(unit_of(k))) for k in keys if k in odd)

    def cut(self, text: str, odd: set[str]) -> list[str] | None:
        """Keys of a text's units, those with odd space also into ``odd``; None if the text can't be cut."""
        if not self.apart:
            return None
        if ODD_SPACE(text) is None and text[0] not in " \n" and UNUSUAL not in text:
            return text.replace("\n", " \n").split(" ")
        keys = [key_of(u) for u in UNITS(" " + text)]
        odd.update(k for k in keys if k[0] == UNUSUAL or INNER_SPACE(k))
        return keys

    def align(self, texts: list[str]) -> Iterator[list[Aligned] | None]:
        """For each text its aligned units, in order; None for a text without tokens. Units of a slice are remembered, and those of the last REMEMBERED ones."""
        odd: set[str] = set()
        cut = [self.cut(t, odd) if t else None for t in texts]
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        new = set().union(*(keys for keys in cut if keys)).difference(self.young)
        for k in new.intersection(self.old):
            self.young[k] = self.old[k]
        self.young.update(self.learn([k for k in new.difference(self.old) if len(k) <= LONGEST], odd))
        for text, keys in zip(texts, cut):
            if not text:
                yield None
                continue
            found = list(map(self.young.get, keys)) if keys else [None]
            if None in found and keys:  # long units, and such as the tokenizers change
                found = [self.aligned(unit_of(k)) if f is None else f for k, f in zip(keys, found)]
            if None in found:
                one = self.aligned(" " + text)
                found = one and [one]
            yield found


def unit_of(key: str) -> str:
    return key if key[:1] == "\n" else key[1:] if key[:1] == UNUSUAL else " " + key


def key_of(unit: str) -> str:
    if unit[0] == "\n":
        return unit
    return unit[1:] if unit[0] == " " and unit[1:2] not in ("\n", UNUSUAL, "") else UNUSUAL + unit


def cuts_are_safe(pieces: list[str]) -> bool:
    """Whether single spaces and line feeds between other characters part a text into units that both tokenizers encode apart from each other.

    A's pattern of words always parts there. B joins two characters only where one of its pieces has them side by side, so the
    cuts are free of joins if no piece has a space behind another character or a line feed beside one. Otherwise a text is one unit.
    """
    return not any(MARK in p.lstrip(MARK) or "\n" in p and p != "\n" for p in pieces)


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _texts(column: pa.Array, most: int = 1_000_000) -> Iterator[tuple[slice, list[str]]]:
    """Texts (null: empty) in slices of about so many code points; a longer text is alone."""
    lengths = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start = 0
    while start < len(column):
        base = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield slice(start, end), [t or "" for t in column[start:end].to_pylist()]
        start = end


def aligned_tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, a_ids, b_ids, a_ends, b_ends: both sides' ids and, for each group, how many ids of either side end with it.

    A is a byte-level vocabulary file, B a piece model that adds a space; space and text are what both encode. Texts that are null, empty, or
    whose bytes either tokenizer changes have empty arrays. Long texts are handled alone; columns beyond doc_id and text aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in batches:
            for at, texts in _texts(batch.column(1)):
                rows: list[tuple[list, ...]] = []
                for units in both.align(texts):
                    a, b, x, y = [], [], [], []
                    for _, _, _, shown, _ in units or []:
                        for group in shown.decode().split(";"):
                            one, two = (list(map(int, ids.split(","))) for ids in group.split("|"))
                            a += one
                            b += two
                            x.append(len(a))
                            y.append(len(b))
                    rows.append((a, b, x, y))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at], *(pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in range(4))], ["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


def _aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document with its sizes, digest and packed links; further rows have ``pair`` and ``times`` alone: links that a slice counted."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "pair", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in batches:
            for at, texts in _texts(batch.column(1)):
                sizes, digests, links = np.zeros((len(texts), 3), np.int64), [], []
                for k, units in enumerate(both.align(texts)):
                    if units is None:
                        digests.append("")
                        links.append(b"")
                        continue
                    n_a, n_b, n_groups, shown, own = zip(*units)
                    sizes[k] = sum(n_a), sum(n_b), sum(n_groups)
                    digests.append(hashlib.sha256(b";".join(shown)).hexdigest())
                    links.append(b"".join(own))
                n = len(texts)
                none = pa.nulls(n, pa.int64())
                columns = [batch.column(0)[at], *(pa.array(sizes[:, c]) for c in range(3)), pa.array(digests), pa.array(links, pa.binary()), none, none]
                yield pa.RecordBatch.from_arrays(columns, names)
                pair, times = np.unique(np.frombuffer(b"".join(links), np.uint32), return_counts=True)
                none = lambda kind: pa.nulls(len(pair), kind)
                yield pa.RecordBatch.from_arrays([*(none(pa.int64()) for _ in range(4)), none(pa.string()), none(pa.binary()), pa.array(pair.astype(np.int64)), pa.array(times)], names)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, pair long, times long")


def alignment_report(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    An id pair's count is the number of links of the whole table that hold it (rows that repeat count each); ``count_sum`` sums
    it over a document's links, ``n_best`` is the number of links whose count is the highest of their B id. Texts that are null,
    empty or changed by a tokenizer have zeros and an empty digest. Null doc_ids stay as they are; very long texts are aligned
    whole; an empty table gives no rows. Columns beyond doc_id and text aren't read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-alignment")
    found = scratch.save(_aligned(docs, path_a, path_b))
    # as many rows as there are pairs that can link: bounded by the vocabularies
    counts = found.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("times").alias("times")).toArrow().sort_by("pair")
    pair, times = counts["pair"].to_numpy().astype(np.uint32), counts["times"].to_numpy().astype(np.int64)
    highest = np.zeros(1 << 16, np.int64)
    np.maximum.at(highest, pair & 0xFFFF, times)
    shared = spark.sparkContext.broadcast((pair, times, times == highest[pair & 0xFFFF]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, times, best = shared.value
        for batch in batches:
            values = [np.searchsorted(pair, np.frombuffer(x.as_buffer(), np.uint32)) for x in batch.column(5)]
            own = [np.array([f(x) for x in values], np.int64) for f in (len, lambda x: best[x].sum(), lambda x: times[x].sum())]
            columns = [batch.column(k) for k in range(4)] + [pa.array(x) for x in own] + [batch.column(4)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    rows = found.where("pair IS NULL").select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    return rows.mapInArrow(look, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
