"""Operator 10, scoring by a gated recurrent language model.

The corpus' words are counted exactly over all training documents (packed by hash bucket, one
shuffle). The model predicts classes and then words: frequent words (``HEAD``) are spread over classes
whose members a second softmax tells apart; every other word is in a class by its last letters,
inside which its probability is its count's share. A GRU in numpy is fitted by truncated
backpropagation on every training document, which are dealt to the rounds by hash: in each round every task
starts from the same parameters, runs over its own documents of the round with one optimiser, and the tasks'
parameters, as packed arrays, are averaged by Spark in a tree.
Scoring carries the state across windows through whole documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions, text_or_empty
from .vectors import LOWER, Texts, binary, gather, joined, mix, runs, slices, words_of

#: Frequent words with the end of the text among them, their classes, and classes of all other words.
HEAD, HEAD_CLASSES, TAIL_BITS = 1024, 32, 5
TAIL_CLASSES = 1 << TAIL_BITS
PER_CLASS = HEAD // HEAD_CLASSES
CLASSES, INPUTS = HEAD_CLASSES + TAIL_CLASSES, HEAD + TAIL_CLASSES
EMBED, HIDDEN = 12, 12
#: Rounds of averaging.
ROUNDS = 3
#: Most parallel streams of a task, tokens of a window, windows that a chunk of tokens has at least, tokens of a chunk, and the rate of learning.
STREAMS, WINDOW, LEAST_WINDOWS, CHUNK, RATE = 384, 16, 64, 400_000, 0.01
#: Tokens counted at a time in search of frequent words; of each, words that are rarer than one in ``RARE`` aren't reported.
COUNTED_TOKENS, RARE = 3_000_000, 500_000
#: Tokens scored side by side.
GROUP_TOKENS = 3_000_000
END = 0
#: Keeps logarithms of sums finite.
TINY = np.finfo(np.float32).tiny
FOLDS, HELD_OUT = 7, 2
END_WORD = np.uint64(0x656E64)
FLUSH = 1_000_000

SHAPES = {"emb": (INPUTS, EMBED), "wx": (EMBED, 3 * HIDDEN), "wh": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "wc": (CLASSES, HIDDEN), "bc": (CLASSES,), "wi": (HEAD, HIDDEN), "bi": (HEAD,)}


def word_ids(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit id of each word, whose top 6 bits are the class of its last two letters, and the words' bounds by text."""
    words = words_of(texts)
    data = LOWER[texts.data]
    last = data[words.end - 1].astype(np.uint64)
    before = np.where(words.end - words.start > 1, data[np.maximum(words.end - 2, 0)], 0).astype(np.uint64)
    tail = mix(last * np.uint64(257) + before) >> np.uint64(64 - TAIL_BITS)
    return (words.hashes >> np.uint64(TAIL_BITS)) | (tail << np.uint64(64 - TAIL_BITS)), words.bounds


def _tail_class(ids: np.ndarray) -> np.ndarray:
    return (ids >> np.uint64(64 - TAIL_BITS)).astype(np.int64)


def tokens_of(texts: Texts, head: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Model inputs of all tokens, each text's end included, with bounds; and ids of tail words with their text.

    ``head``: sorted ids of frequent words, ``place``: their numbers.
    """
    ids, bounds = word_ids(texts)
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.minimum(np.searchsorted(head, ids), len(head) - 1) if len(head) else np.zeros(len(ids), np.int64)
    known = head[at] == ids if len(head) else np.zeros(len(ids), bool)
    number = np.where(known, place[at] if len(head) else 0, HEAD + _tail_class(ids))
    out = np.full(len(ids) + len(counts), END, np.int16)
    out[np.arange(len(ids)) + doc] = number
    return out, bounds + np.arange(len(counts) + 1), ids[~known], doc[~known]


@dataclass
class Model:
    """Parameters as named arrays of 32-bit floats, with the words that are inputs of their own."""

    params: dict[str, np.ndarray]
    head: np.ndarray
    place: np.ndarray

    @staticmethod
    def new(head_ids: np.ndarray, counts: np.ndarray, tail_counts: np.ndarray, seed: int = 5) -> Model:
        """Random weights; output biases are logarithms of frequencies, so that an unfitted model is a class-based unigram one."""
        rng = np.random.Generator(np.random.PCG64(seed))
        p = {k: (rng.normal(0, 0.1, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in SHAPES.items()}
        c = np.zeros(HEAD)
        c[: len(counts)] = counts
        p["bi"] = np.log(c + 0.5).astype(np.float32)
        p["bc"] = np.log(np.concatenate([c.reshape(HEAD_CLASSES, PER_CLASS).sum(1), tail_counts]) + 0.5).astype(np.float32)
        words = head_ids[1:]  # number 0 is the end
        order = np.argsort(words)
        return Model(p, words[order], (order + 1).astype(np.int64))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.params[k].ravel() for k in SHAPES])

    def with_flat(self, values: np.ndarray) -> Model:
        out, at = {}, 0
        for k, s in SHAPES.items():
            n = int(np.prod(s))
            out[k] = values[at : at + n].reshape(s).astype(np.float32)
            at += n
        return Model(out, self.head, self.place)


def _step(p: dict[str, np.ndarray], xa: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of the GRU from the input's part of the gates and the state before."""
    u = h @ p["wh"]
    g = 1 / (1 + np.exp(-(xa[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])))
    r, z = g[:, :HIDDEN], g[:, HIDDEN:]
    n = np.tanh(xa[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
    return n + z * (h - n), r, z, n, u[:, 2 * HIDDEN :]


def _exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of exponentials, their sums (a product with ones, faster than a sum over a short axis), and the exponents taken."""
    if x.size and x.max() > 60:  # else no exponential of a 32-bit float overflows
        x = x - x.max(1, keepdims=True)
    e = np.exp(x)
    return e, e @ np.ones(x.shape[1], x.dtype) + TINY, x


def _classes_of(target: np.ndarray) -> np.ndarray:
    return np.where(target < HEAD, target // PER_CLASS, target - HEAD + HEAD_CLASSES)


def _by_class(cls: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, int]]]:
    """Rows of frequent words in order of class, and each class' part of them with the class' first word."""
    head = np.flatnonzero(target < HEAD)
    order = head[np.argsort(cls[head].astype(np.uint8), kind="stable")]
    start, count = runs(cls[order])
    return order, [(slice(s, s + c), k * PER_CLASS) for s, c, k in zip(start.tolist(), count.tolist(), cls[order[start]].tolist())]


def log_probabilities(p: dict[str, np.ndarray], h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each target's class, times that of the word inside it for frequent words."""
    cls = _classes_of(target)
    _, total, x = _exp(h @ p["wc"].T + p["bc"])
    out = np.take(x, np.arange(0, x.size, CLASSES) + cls) - np.log(total)
    order, parts = _by_class(cls, target)
    own, place, inside = h[order], target[order] % PER_CLASS, np.empty(len(order), h.dtype)
    for rows, k in parts:
        _, total, x = _exp(own[rows] @ p["wi"][k : k + PER_CLASS].T + p["bi"][k : k + PER_CLASS])
        inside[rows] = np.take(x, np.arange(0, x.size, PER_CLASS) + place[rows]) - np.log(total)
    out[order] += inside
    return out


def score_tokens(p: dict[str, np.ndarray], tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural log-probability of each text's tokens, the state running through the whole text."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    sizes, starts = sizes[order], bounds[:-1][order]
    total = np.zeros(len(order))
    inputs = p["emb"] @ p["wx"] + p["b"]  # the input's part of the gates, once per possible input
    h = np.zeros((len(order), HIDDEN), np.float32)
    before = np.full(len(order), END)
    at, longest = 0, int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")  # texts longer than t
    while at < longest:
        states, targets, who = [], [], []
        rows = 0
        while at < longest and rows < 60_000:
            k = int(alive[at])
            h = _step(p, inputs[before[:k]], h[:k])[0]
            before = tokens[starts[:k] + at].astype(np.int64)
            states.append(h)
            targets.append(before)
            who.append(np.arange(k))
            rows += k
            at += 1
        value = log_probabilities(p, np.concatenate(states), np.concatenate(targets))
        total += np.bincount(np.concatenate(who), value, len(order))
    out = np.empty(len(order))
    out[order] = total
    return out


def gradients(p: dict[str, np.ndarray], given: np.ndarray, target: np.ndarray, h0: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Gradients of the mean loss over one window (time x streams), the last state, and the loss.

    A state is set to zero where the input is an end of text; the window's first state is a constant.
    """
    steps, width = given.shape
    inputs = (p["emb"] @ p["wx"] + p["b"])[given]
    going = given != END
    h, kept, hs = h0, [], np.empty((steps, width, HIDDEN), h0.dtype)
    for t in range(steps):
        h = h * going[t][:, None]
        new, r, z, n, u = _step(p, inputs[t], h)
        kept.append((h, r, z, n, u))
        hs[t] = h = new
    last, hs = h, hs.reshape(-1, HIDDEN)
    flat = target.ravel()
    count = len(flat)
    cls = _classes_of(flat)
    d, total, x = _exp(hs @ p["wc"].T + p["bc"])
    at = np.arange(0, d.size, CLASSES) + cls
    loss = float(np.log(total).sum() - np.take(x, at).sum())
    d *= (1 / (total * count))[:, None]
    d.reshape(-1)[at] -= 1 / count
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["wc"], g["bc"] = d.T @ hs, np.ones(count, d.dtype) @ d
    dh_out = d @ p["wc"]
    order, parts = _by_class(cls, flat)
    own, place, back = hs[order], flat[order] % PER_CLASS, np.empty((len(order), HIDDEN), h0.dtype)
    for rows, k in parts:
        e, total, x = _exp(own[rows] @ p["wi"][k : k + PER_CLASS].T + p["bi"][k : k + PER_CLASS])
        at = np.arange(0, e.size, PER_CLASS) + place[rows]
        loss += float(np.log(total).sum() - np.take(x, at).sum())
        e *= (1 / (total * count))[:, None]
        e.reshape(-1)[at] -= 1 / count
        g["wi"][k : k + PER_CLASS] = e.T @ own[rows]
        g["bi"][k : k + PER_CLASS] = np.ones(len(e), e.dtype) @ e
        back[rows] = e @ p["wi"][k : k + PER_CLASS]
    dh_out[order] += back
    dh_out = dh_out.reshape(steps, width, HIDDEN)
    da = np.empty((steps, width, 3 * HIDDEN), h0.dtype)
    du = np.empty((steps, width, 3 * HIDDEN), h0.dtype)
    dh, back = np.zeros((width, HIDDEN), h0.dtype), np.ascontiguousarray(p["wh"].T)
    for t in range(steps - 1, -1, -1):
        h, r, z, n, u = kept[t]
        dh = dh + dh_out[t]
        keep = dh * z
        dn = (dh - keep) * (1 - n * n)
        du[t, :, HIDDEN : 2 * HIDDEN] = keep * (h - n) * (1 - z)
        dr = dn * r
        du[t, :, 2 * HIDDEN :] = dr
        du[t, :, :HIDDEN] = dr * u * (1 - r)
        da[t, :, 2 * HIDDEN :] = dn
        dh = (keep + du[t] @ back) * going[t][:, None]
    da[:, :, : 2 * HIDDEN] = du[:, :, : 2 * HIDDEN]
    g["wh"] = np.concatenate([k[0] for k in kept]).T @ du.reshape(-1, 3 * HIDDEN)
    flat_a, ids = da.reshape(-1, 3 * HIDDEN), given.ravel()
    by_input = np.zeros((INPUTS, 3 * HIDDEN), h0.dtype)
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    start, _ = runs(ids[order])
    by_input[ids[order][start]] = np.add.reduceat(flat_a[order], start)
    g["b"] = flat_a.sum(0)
    g["wx"] = p["emb"].T @ by_input
    g["emb"] = by_input @ p["wx"].T
    return g, last, loss / count


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float = RATE) -> None:
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, params: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.t += 1
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = min(1.0, 1.0 / (size + 1e-12))
        for k, x in g.items():
            x = x * np.float32(scale)
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.01 * (x * x - self.v[k])
            params[k] -= (self.rate / (1 - 0.9**self.t)) * self.m[k] / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-6)


def fit(params: dict[str, np.ndarray], adam: Adam, stream: np.ndarray) -> None:
    """Truncated backpropagation over a stream of texts, dealt to parallel streams; changes ``params``."""
    width = int(min(STREAMS, max(1, len(stream) // (LEAST_WINDOWS * WINDOW))))
    length = len(stream) // width
    if length < 1:
        return
    grid = stream[: width * length].reshape(width, length).T.astype(np.int64)
    given = np.vstack([np.full((1, width), END), grid[:-1]])
    h = np.zeros((width, HIDDEN), np.float32)
    for at in range(0, length, WINDOW):
        g, h, _ = gradients(params, given[at : at + WINDOW], grid[at : at + WINDOW], h)
        adam.update(params, g)


def _frequent_words(docs: DataFrame) -> DataFrame:
    """(word, n): occurrences of words in all documents, as far as they are not rare where they were counted; and (class, n): all words of each tail class."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, ends = [], 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            classes = np.bincount(_tail_class(ids), minlength=TAIL_CLASSES)
            words, count = np.unique(ids, return_counts=True)
            often = count * RARE > len(ids)
            words, count = np.r_[words[often], END_WORD], np.r_[count[often], ends]
            none = pa.nulls(len(words), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(words.view(np.int64)), pa.nulls(TAIL_CLASSES, pa.int64())]), pa.concat_arrays([none, pa.array(np.arange(TAIL_CLASSES))]), pa.array(np.r_[count, classes])],
                ["word", "class", "n"],
            )

        for batch in batches:
            for texts in slices(batch.column(0)):
                held.append(word_ids(texts)[0])
                total, ends = total + len(held[-1]), ends + len(texts)
                if total >= COUNTED_TOKENS:
                    yield flush()
                    held, total, ends = [], 0, 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(counted, "word long, class long, n long").groupBy("word", "class").agg(F.sum("n").alias("n"))


def _averaged(parts: DataFrame, scratch: Scratch) -> bytes | None:
    """The weighted mean of packed arrays (k, values, weight), 64 at a time until one is left."""

    def added(table: pa.Table) -> pa.Table:
        weight = table["weight"].to_numpy()
        total = sum(np.frombuffer(x.as_buffer(), np.float64) * w for x, w in zip(table["values"], weight))
        return pa.table({"k": pa.array([table["k"][0].as_py() // 64], pa.int64()), "values": binary([(total / weight.sum()).tobytes()]), "weight": pa.array([weight.sum()])})

    while True:
        parts = scratch.save(parts.groupBy(F.floor(F.col("k") / 64)).applyInArrow(added, "k long, values binary, weight double"))
        rows = parts.limit(2).collect()
        if len(rows) < 2:
            return bytes(rows[0]["values"]) if rows else None


def _fit_round(docs: DataFrame, model: Model, scratch: Scratch) -> Model:
    """Every task fits the model on its documents; Spark averages the parameters, weighted by tokens."""

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, held, total, seen = {k: v.copy() for k, v in model.params.items()}, [], 0, 0
        adam = Adam(params)
        for batch in batches:
            for texts in slices(batch.column(0)):
                held.append(tokens_of(texts, model.head, model.place)[0])
                total += len(held[-1])
                if total >= CHUNK:
                    for at in range(0, total, CHUNK):
                        fit(params, adam, np.concatenate(held)[at : at + CHUNK] if len(held) > 1 else held[0][at : at + CHUNK])
                    seen, held, total = seen + total, [], 0
        if total:
            fit(params, adam, np.concatenate(held))
        if seen + total:
            values = Model(params, model.head, model.place).flat().astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), binary([values.tobytes()]), pa.array([float(seen + total)])], ["k", "values", "weight"])

    mean = _averaged(docs.select("text").mapInArrow(fitted, "k long, values binary, weight double"), scratch)
    return model if mean is None else model.with_flat(np.frombuffer(mean))


COUNTED = "bucket int, docs binary, trained binary, counts binary, words binary, times binary"
SUMS = "bucket int, docs binary, sums binary, known binary, masses binary, heads binary, tokens long, distinct long"


def _packed_words(docs: DataFrame, model: Model, buckets: int) -> DataFrame:
    """Tail words of each document with their numbers, packed by bucket; counts of frequent words of training documents apart."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        heads, total = np.zeros(HEAD, np.int64), 0

        def flush() -> pa.RecordBatch:
            doc, train, word, times = (np.concatenate(x) for x in zip(*held))
            bucket = ((word & np.uint64(0xFFFF)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            start, count = runs(bucket[order])
            rows = []
            for s, c in zip(start.tolist(), count.tolist()):
                own = order[s : s + c]
                ds, dc = runs(doc[own])
                high = word[own].view(np.uint8).reshape(-1, 8)[:, 2:]
                rows.append((int(bucket[own[0]]), doc[own][ds].tobytes(), train[own][ds].tobytes(), dc.astype(np.uint32).tobytes(), high.tobytes(), times[own].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(binary([r[k] for r in rows]) for k in range(1, 6))], ["bucket", "docs", "trained", "counts", "words", "times"])

        for batch in batches:
            keys, trains = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for texts in slices(batch.column(2)):
                key, train = keys[texts.rows], trains[texts.rows]
                tokens, bounds, word, doc = tokens_of(texts, model.head, model.place)
                mine = tokens[np.repeat(train, np.diff(bounds))]
                heads += np.bincount(mine[mine < HEAD], minlength=HEAD)
                order = np.lexsort((word, doc))
                word, doc = word[order], doc[order]
                new = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])]) if len(word) else np.zeros(0, np.int64)
                times = np.diff(np.r_[new, len(word)])
                word, doc = word[new], doc[new]
                most = np.iinfo(np.uint16).max
                parts = np.maximum(1, -(-times // most))  # a word that one text repeats more often goes as several entries
                if (parts > 1).any():
                    which = np.repeat(np.arange(len(word)), parts)
                    nth = gather(np.zeros(len(parts), np.int64), parts)
                    times = np.minimum(most, times[which] - nth * most)
                    word, doc = word[which], doc[which]
                held.append((key[doc], train[doc], word, times.astype(np.uint16)))
                total += len(word)
                if total >= FLUSH:
                    yield flush()
                    held, total = [], 0
        if total:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *(binary([x]) for x in (b"", b"", b"", b"", heads.tobytes()))], ["bucket", "docs", "trained", "counts", "words", "times"])

    return docs.select("key", "train", "text").mapInArrow(packed, COUNTED)


def _summed(buckets: int):
    def summed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Counts of one bucket's words, and their logarithms summed by document."""
        names = ["bucket", "docs", "sums", "known", "masses", "heads", "tokens", "distinct"]
        bucket = key[0].as_py()
        if bucket < 0:
            heads = joined(table["times"], np.int64).reshape(-1, HEAD).sum(0)
            rows = [(-1, b"", b"", b"", b"", heads.tobytes(), int(heads.sum()), int((heads > 0).sum()))]
        else:
            raw = joined(table["words"], np.uint8).reshape(-1, 6)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, 2:] = raw
            word = wide.view(np.uint64).ravel()
            times = joined(table["times"], np.uint16).astype(np.int64)
            per = joined(table["counts"], np.uint32).astype(np.int64)
            doc = np.repeat(joined(table["docs"], np.uint64), per)
            train = np.repeat(joined(table["trained"], bool), per)
            order = np.argsort(word, kind="stable")
            start, count = runs(word[order])
            of_word = np.add.reduceat((times * train)[order], start)
            c = np.empty(len(word), np.int64)
            c[order] = np.repeat(of_word, count)
            known = of_word > 0
            masses = np.bincount(_tail_class(word[order][start])[known], (of_word + 1.0)[known], TAIL_CLASSES)
            order = np.argsort(doc, kind="stable")
            start, _ = runs(doc[order])
            sums = np.add.reduceat((times * np.log10(c + 1.0))[order], start)
            n_known = np.add.reduceat((times * (c > 0))[order], start)
            doc = doc[order][start]
            where = (mix(doc) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(where, kind="stable")
            start, count = runs(where[order])
            rows = []
            for k, (s, n) in enumerate(zip(start.tolist(), count.tolist())):
                own = order[s : s + n]
                apart = (masses.tobytes(), b"", int(of_word.sum()), int(known.sum())) if k == 0 else (b"", b"", 0, 0)
                rows.append((int(where[own[0]]), doc[own].tobytes(), sums[own].tobytes(), n_known[own].tobytes(), *apart))
        kinds = [pa.int32(), *[pa.binary()] * 5, pa.int64(), pa.int64()]
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return summed


def _by_document(table: pa.Table) -> pa.Table:
    docs, sums, known = joined(table["docs"], np.uint64), joined(table["sums"], np.float64), joined(table["known"], np.int64)
    order = np.argsort(docs, kind="stable")
    start, _ = runs(docs[order])
    if not len(start):
        return pa.table({"key": pa.array([], pa.int64()), "tail_sum": pa.array([], pa.float64()), "tail_known": pa.array([], pa.int64())})
    return pa.table({"key": docs[order][start].view(np.int64), "tail_sum": np.add.reduceat(sums[order], start), "tail_known": np.add.reduceat(known[order], start)})


SCORED = "doc_id long, held_out boolean, key long, n_tokens long, head_sum double, head_known long, model double"


def _scored(docs: DataFrame, model: Model, heads: np.ndarray, masses: np.ndarray) -> DataFrame:
    """For each document what the network and the counts of frequent words give, in powers of ten."""
    log_head, log_mass = np.log10(heads + 1.0), np.log10(masses + 1.0)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0

        def flush() -> pa.RecordBatch:
            ids, outs, keys, tokens, sizes = zip(*held)
            tokens, sizes = np.concatenate(tokens).astype(np.int64), np.concatenate(sizes)
            bounds = np.r_[0, np.cumsum(sizes)]
            model_sum = score_tokens(model.params, tokens, bounds) / np.log(10)
            is_head = tokens < HEAD
            here = np.where(is_head, log_head[np.minimum(tokens, HEAD - 1)], 0.0)
            seen = np.where(is_head, heads[np.minimum(tokens, HEAD - 1)] > 0, False)
            lost = np.where(is_head, 0.0, log_mass[np.maximum(tokens - HEAD, 0)])
            start = bounds[:-1]
            add = lambda x: np.add.reduceat(x, start)  # noqa: E731  every text has its end, so none is empty
            arrays = [pa.concat_arrays(ids), pa.concat_arrays(outs), pa.concat_arrays(keys), pa.array(sizes), pa.array(add(here)), pa.array(add(seen.astype(np.int64))), pa.array(model_sum - add(lost))]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "key", "n_tokens", "head_sum", "head_known", "model"])

        for batch in batches:
            for texts in slices(batch.column(3)):
                tokens, bounds, _, _ = tokens_of(texts, model.head, model.place)
                held.append((*(batch.column(k)[texts.rows] for k in range(3)), tokens, np.diff(bounds)))
                total += len(tokens)
                if total >= GROUP_TOKENS:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    return docs.select("doc_id", "held_out", "key", "text").mapInArrow(scored, SCORED)


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents with crc32(doc_id as text) mod 7 = 2 are held out of all counts and of the fit; a null doc_id
    counts as the empty string there. A null text is empty and has one token, the end. Rows that repeat
    are scored alike and counted each. With no training documents at all every word is unknown. Words
    are told apart by 59 bits of hash and the class of their last letters.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "language-model")
    buckets = min(1 << 16, shuffle_partitions(spark))
    text = text_or_empty(docs["text"])
    crc = F.crc32(F.encode(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), "UTF-8"))
    out = crc % FOLDS == HELD_OUT
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), out.alias("held_out"), (~out).alias("train"), F.xxhash64(docs["doc_id"], text).alias("key"), F.xxhash64(F.lit(3), docs["doc_id"]).alias("pick"), text.alias("text"))
    training = rows.where("train")
    counts = scratch.save(_frequent_words(training))
    end = int(END_WORD)
    top = counts.where(F.col("word") != end).orderBy(F.desc("n"), "word").limit(HEAD - 1).collect()
    classes = {r["class"]: r["n"] for r in counts.where("class IS NOT NULL").collect()}
    ends = counts.where(F.col("word") == end).agg(F.sum("n")).first()[0] or 0
    head_ids = np.array([end, *(r["word"] for r in top)], np.int64).view(np.uint64)
    head_counts = np.array([ends, *(r["n"] for r in top)], np.float64)
    tails = np.array([classes.get(k, 0) for k in range(TAIL_CLASSES)], np.float64)
    np.subtract.at(tails, _tail_class(head_ids[1:]), head_counts[1:])
    model = Model.new(head_ids, head_counts, tails)
    for k in range(rounds):
        model = _fit_round(training.where(F.pmod("pick", F.lit(rounds)) == k), model, scratch)
    sums = scratch.save(_packed_words(rows, model, buckets).groupBy("bucket").applyInArrow(_summed(buckets), SUMS))
    facts = sums.where("octet_length(masses) > 0 OR octet_length(heads) > 0").select("masses", "heads", "tokens", "distinct").toPandas()
    heads = sum((np.frombuffer(x, np.int64) for x in facts["heads"] if len(x)), np.zeros(HEAD, np.int64))
    masses = sum((np.frombuffer(x, np.float64) for x in facts["masses"] if len(x)), np.zeros(TAIL_CLASSES))
    n, v = int(facts["tokens"].sum()), int(facts["distinct"].sum())
    scored = scratch.save(_scored(rows, model, heads, masses))
    by_doc = sums.where("bucket >= 0").select("bucket", "docs", "sums", "known").groupBy("bucket").applyInArrow(_by_document, "key long, tail_sum double, tail_known long")
    same = scored.groupBy("key").agg(F.count("*").alias("same"))
    tail = same.join(by_doc, "key", "left").select("key", (F.coalesce("tail_sum", F.lit(0.0)) / F.col("same")).alias("tail_sum"), (F.coalesce("tail_known", F.lit(0)) / F.col("same")).cast("long").alias("tail_known"))
    base = float(np.log10(n + 1 * (v + 1)))
    return scored.join(tail, "key").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.col("tail_known")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.col("tail_sum") - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("model") + F.col("tail_sum")).alias("score"),
    )
