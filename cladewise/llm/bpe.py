"""Operator 7, BPE encoding by backtracking over Aho-Corasick matches, decoding by an offset table.

Encoding a word takes the longest token that matches at each place and steps back to a shorter one
where two neighbours could not stand beside each other in a result of the merges; that is read
from the merges themselves (``Vocabulary.compatible``) and kept in a table of pairs. The result is
that of applying the merges in order, without a queue of pairs.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed values of the vocabulary's own definition: its pattern of words, and white space.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+".replace(r"\s", r"\p{White_Space}"))
SPACE = regex.compile(r"\p{White_Space}+")
#: Characters on which str.split() breaks although they aren't white space in Unicode's sense.
ODD_BREAKS = regex.compile("[\x1c-\x1f]")
END = "</w>"
#: Words whose tokens a worker remembers before it starts anew.
REMEMBERED = 400_000
#: Characters of the longest word or chunk that is remembered, which bounds the memory's bytes.
LONGEST = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in plain else chr(256 + extra))
        extra += b not in plain
    return out


class Vocabulary:
    """A byte-level BPE vocabulary with word ends. Tokens are numbered by rank: symbols first, then merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        base = [*symbols, *(s + END for s in symbols)]
        merges = [tuple(m) for m in model["merges"]]
        names = [*base, *(a + b for a, b in merges)]
        rank = {n: i for i, n in enumerate(names)}
        self.ids = np.array([model["vocab"][n] for n in names], np.uint32)
        self.left = [*range(len(base)), *(rank[a] for a, _ in merges)]
        self.right = [*range(len(base)), *(rank[b] for _, b in merges)]
        self.pair = {(self.left[k], self.right[k]): k for k in range(len(base), len(names))}
        self.n_base = len(base)
        self.known: dict[tuple[int, int], bool] = {}
        # inside the automaton a byte is one character, and a byte that ends a word another one
        keys = [self._key(n, byte_of) for n in names]
        self.length = [len(k) for k in keys]
        self.automaton = ahocorasick.Automaton()
        for r, key in enumerate(keys):
            if self._reached(r):
                self.automaton.add_word(key, r)
        self.automaton.make_automaton()
        # offset table for decoding, by id: the names' bytes, each with one space behind
        by_id = {int(i): n for i, n in zip(self.ids, names)} | {i: s for s, i in self.special.items()}
        pieces = [by_id.get(i, "").encode() + b" " for i in range(max(by_id) + 1)]
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.offsets = np.cumsum([0, *map(len, pieces)])

    @staticmethod
    def _key(name: str, byte_of: dict[str, int]) -> str:
        last = name.endswith(END) and len(name) > len(END)
        chars = [byte_of[c] for c in (name[: -len(END)] if last else name)]
        return "".join(chr(256 + b + 256 * (last and k == len(chars) - 1)) for k, b in enumerate(chars))

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave token ``a`` beside token ``b``: no merge across the border comes early enough.

        Both tokens are undone from the later merge to the earlier, on the border's side.
        """
        found = self.known.get((a, b))
        if found is not None:
            return found
        x, y, before = a, b, len(self.left)
        answer = None
        while answer is None:
            across = self.pair.get((x, y))
            if across is not None and across < before:
                answer = False
            elif x >= self.n_base and (x > y or y < self.n_base):
                before, x = x, self.right[x]
            elif y >= self.n_base:
                before, y = y + 1, self.left[y]
            else:
                answer = True
        if len(self.known) > 4 * REMEMBERED:
            self.known.clear()
        self.known[a, b] = answer
        return answer

    def _reached(self, r: int) -> bool:
        """Whether merging gives the token from its own characters."""
        return r < self.n_base or self._merged(self.left[r], self.right[r], r)

    def _merged(self, a: int, b: int, r: int) -> bool:
        x, y, before = a, b, r
        while True:
            across = self.pair.get((x, y))
            if across is not None and across < before:
                return False
            if x >= self.n_base and (x > y or y < self.n_base):
                before, x = x, self.right[x]
            elif y >= self.n_base:
                before, y = y + 1, self.left[y]
            else:
                return True

    def encode_symbols(self, word: str) -> list[int]:
        """Ranks of the tokens of a word given in the automaton's characters."""
        matches: list[list[int]] = [[] for _ in word]
        for end, r in self.automaton.iter(word):
            matches[end - self.length[r] + 1].append(r)  # from short to long
        open_, out, tried, at, n = [True] * (len(word) + 1), [], [], 0, len(word)
        k = len(matches[0]) - 1
        while at < n:
            own = matches[at]
            while k >= 0:
                token = own[k]
                if open_[at + self.length[token]] and (not out or self.compatible(out[-1], token)):
                    break
                k -= 1
            if k >= 0:
                out.append(token)
                tried.append(k)
                at += self.length[token]
                k = len(matches[at]) - 1 if at < n else 0
            else:
                open_[at] = False
                at -= self.length[out.pop()]
                k = tried.pop() - 1
        return out

    def encode_word(self, word: str) -> bytes:
        data = word.encode("utf-8")
        symbols = "".join([chr(256 + b) for b in data[:-1]]) + chr(512 + data[-1])
        return self.ids[self.encode_symbols(symbols)].astype("<u4").tobytes()


class _Chunks(dict):
    """Ids of a run of characters without white space, as little-endian bytes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.words = vocabulary, {}

    def __missing__(self, chunk: str) -> bytes:
        text = unicodedata.normalize("NFC", chunk)
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        words, parts = self.words, []
        for word in WORD.findall(text):
            ids = words.get(word)
            if ids is None:
                ids = self.vocabulary.encode_word(word)
                if len(words) >= REMEMBERED:
                    words.clear()
                if len(word) <= LONGEST:
                    words[word] = ids
            parts.append(ids)
        if len(self) >= REMEMBERED:
            self.clear()
        ids = b"".join(parts)
        if len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids


class Codec:
    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.chunks = _Chunks(self.vocabulary)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; strings of special tokens give their ids."""
        parts = []
        special = self.vocabulary.special
        for part in self.vocabulary.special_split.split(text) if "<|" in text else (text,):
            if part in special:
                parts.append(np.array([special[part]], "<u4").tobytes())
            else:
                runs = SPACE.split(part) if ODD_BREAKS.search(part) else part.split()
                parts.extend(map(self.chunks.__getitem__, filter(None, runs)))
        return b"".join(parts)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens with a space between, gathered through the offset table."""
        if not len(ids):
            return b""
        offsets = self.vocabulary.offsets
        starts = offsets[ids]
        sizes = offsets[ids.astype(np.int64) + 1] - starts
        ends = np.cumsum(sizes)
        where = np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)
        return self.vocabulary.blob[where[:-1]].tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256; a null text has no tokens.

    ``path`` is the vocabulary's file on every executor. No shuffle; texts and words of any length are encoded whole. Rows that
    repeat give the same row each, an empty table gives none, and columns beyond doc_id and text are not read.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                data = own.encode(text.as_py() or "")
                counts.append(len(data) // 4)
                ids_sha.append(hashlib.sha256(data).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(np.frombuffer(data, "<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(digests, SCHEMA)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ``ids``, the tokens of the whole text."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = [np.frombuffer(own.encode(t.as_py() or ""), "<u4").astype(np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(encoded, "doc_id long, ids array<int>")


def decode_documents(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and ``text`` from ``ids``: the tokens' strings with a space between."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(np.array(x.as_py() or [], np.uint32)).decode("utf-8") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, text string")
