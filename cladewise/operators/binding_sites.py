"""Sampler of motifs and their sites in sequences, in blocks.

Given the motifs' letter probabilities and weights, sequences are independent. A sweep over all of them is one
Spark job: in each sequence a forward pass sums over all ways to place sites of any motif on either strand
without overlap, and a backward pass draws one. Counts by motif, offset and letter, one small table, go to the driver,
which draws probabilities and weights anew, adds fresh motifs from the prior, and tries to shift, resize and merge motifs.
The number of motifs has no bound but what the process prior gives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.functions import mathx

from . import side_by_side
from .saved import Saved

LETTERS = "GATC-"
#: Row of the reverse strand's letter; the sixth is for a missing letter, which any motif takes.
COMPLEMENT = np.array([3, 2, 1, 0, 4, 5])
_CODE = np.full(256, 5, np.int64)
_CODE[[ord(c) for c in LETTERS]] = range(5)
TRACE = "step int, temperature double, clusters int, sites long, likelihood double, posterior double"
DRAWN = "cluster int, offset int, letter int, n long"
SITES = "doc_id long, cluster int, pos int, reverse boolean"


@dataclass
class Model:
    """``rate``: prior share of positions that begin a site; ``alpha``, ``discount``: of the process; pseudocounts of motifs and background."""

    lengths: tuple[int, int] = (6, 10)
    rate: float = 0.01
    alpha: float = 1.0
    discount: float = 0.0
    motif: tuple[float, ...] = (0.5, 0.5, 0.5, 0.5, 0.1)
    background: tuple[float, ...] = (1.0, 1.0, 1.0, 1.0, 5.0)
    fresh: int = 2


@dataclass
class Motif:
    """``counts``: letters of its sites by offset, with those beside them up to ``flank`` places on both ends."""

    length: int
    size: int = 0
    counts: np.ndarray | None = None
    theta: np.ndarray | None = None

    @property
    def flank(self) -> int:
        return math.ceil(self.length / 2)

    def core(self) -> np.ndarray:
        return self.counts[self.flank : self.flank + self.length]


@dataclass
class State:
    motifs: list[Motif]
    weights: np.ndarray
    background: np.ndarray
    step: int = 0
    temperature: float = 1.0
    likelihood: float = field(default=0.0)


def log_marginal(counts: np.ndarray, alpha: np.ndarray) -> float:
    """Of rows of letter counts, each under a Dirichlet prior of its own."""
    lg = np.vectorize(math.lgamma)
    counts = np.atleast_2d(counts)
    return float((lg(counts + alpha).sum(1) - lg(counts.sum(1) + alpha.sum())).sum() - len(counts) * (lg(alpha).sum() - math.lgamma(alpha.sum())))


def _ratios(codes: np.ndarray, state: State, model: Model) -> list[tuple[int, np.ndarray, list[tuple[int, bool]]]]:
    """For each length: log weight, against the background, of each motif and strand at each start."""
    ground = np.append(np.log(state.background), 0.0)
    out = {}
    for k, m in enumerate(state.motifs):
        if len(codes) < m.length:
            continue
        table = np.hstack([np.log(m.theta), np.zeros((m.length, 1))]) - ground
        base = math.log(model.rate * state.weights[k] / 2 + 1e-300) - m.length * math.log1p(-model.rate)
        starts = len(codes) - m.length + 1
        for reverse in (False, True):
            own = table[::-1][:, COMPLEMENT] if reverse else table
            score = sum(own[j][codes[j : j + starts]] for j in range(m.length))
            rows, tags = out.setdefault(m.length, ([], []))
            rows.append(base + score)
            tags.append((k, reverse))
    return [(length, np.array(rows) / state.temperature, tags) for length, (rows, tags) in sorted(out.items())]


def draw_sites(seq: str, state: State, model: Model, rng: np.random.Generator) -> list[tuple[int, int, bool]]:
    """(start, motif, reverse) of the sites of one sequence, drawn from all ways to place them."""
    return _drawn(_codes_of(seq), state, model, rng)


def _drawn(codes: np.ndarray, state: State, model: Model, rng: np.random.Generator) -> list[tuple[int, int, bool]]:
    ratios = _ratios(codes, state, model)
    n, total = len(codes), [0.0]  # total[i]: log of the summed weights of the first i letters
    summed = [(length, np.logaddexp.reduce(rows, 0).tolist()) for length, rows, _ in ratios]
    for i in range(1, n + 1):
        x = total[-1]
        for length, r in summed:
            if i >= length:
                more = r[i - length] + total[i - length]
                if more > x - 40:
                    x = max(x, more) + math.log1p(math.exp(-abs(x - more)))
        total.append(x)
    found, i, u = [], n, rng.random(2 * n + 2).tolist()
    while i > 0:
        left = u.pop()
        for (length, r), (_, rows, tags) in zip(summed, ratios):
            if i >= length:
                p = math.exp(min(0.0, r[i - length] + total[i - length] - total[i]))
                if left < p:
                    column = rows[:, i - length]
                    shares = np.cumsum(np.exp(column - column.max()))
                    found.append((i - length, *tags[int(np.searchsorted(shares, u.pop() * shares[-1], "right").clip(0, len(tags) - 1))]))
                    i -= length
                    break
                left -= p
        else:
            i -= 1
    return found


#: Log weight of a site against the background above which sums of weights are kept as logarithms, a sequence at a time.
HEAVY = 300.0


def _word_scores(words: np.ndarray, length: int, state: State, model: Model) -> tuple[np.ndarray, list[tuple[int, bool]]]:
    """Log weight, against the background, of each motif of this length and strand (rows) at words of as many letters."""
    ground, rows, tags = np.append(np.log(state.background), 0.0), [], []
    for k, m in enumerate(state.motifs):
        if m.length == length:
            table = np.hstack([np.log(m.theta), np.zeros((m.length, 1))]) - ground
            base = math.log(model.rate * state.weights[k] / 2 + 1e-300) - m.length * math.log1p(-model.rate)
            for reverse in (False, True):
                own = table[::-1][:, COMPLEMENT] if reverse else table
                rows.append(base + sum(own[j][words[:, j]] for j in range(m.length)))
                tags.append((k, reverse))
    return np.array(rows) / state.temperature, tags


def draw_all(seqs: list[np.ndarray], keys: list[int], state: State, model: Model, seed: int) -> tuple[side_by_side.Lined, tuple[np.ndarray, ...]]:
    """The sites (row, motif, start, reverse) that ``draw_sites`` draws of each sequence with its own random numbers, side by side for all."""
    lined = side_by_side.Lined(seqs)
    rngs = [np.random.Generator(np.random.PCG64([seed, state.step, keys[k] & 0xFFFFFFFFFFFFFFFF])) for k in lined.order.tolist()]
    weights, heavy = {}, False
    for length in sorted({m.length for m in state.motifs}):
        if len(lined.codes) >= length:
            (own,) = lined.by_word(length, lambda words, n=length: (np.logaddexp.reduce(_word_scores(words, n, state, model)[0], 0),))
            own[lined.left < length] = -np.inf
            heavy = heavy or own.max() > HEAVY
            weights[length] = own
    if heavy:
        found = [(row, k, start, reverse) for row, rng in enumerate(rngs) for start, k, reverse in _drawn(seqs[lined.order[row]], state, model, rng)]
        return lined, tuple(np.array([x[c] for x in found], bool if c == 3 else np.int64) for c in range(4))
    shares = side_by_side.site_shares(lined, {n: np.exp(x) for n, x in weights.items()})
    uniform = np.concatenate([rng.random(2 * n + 2) for rng, n in zip(rngs, lined.size.tolist())])
    row, length, start, u = side_by_side.drawn_sites(lined, shares, uniform, np.cumsum(2 * lined.size + 2) - 1)
    motif, reverse = np.zeros(len(row), np.int64), np.zeros(len(row), bool)
    for n in np.unique(length).tolist():
        own = np.flatnonzero(length == n)
        scores, tags = _word_scores(lined.windows(n)[lined.start[row[own]] + start[own]], n, state, model)
        share = np.cumsum(np.exp(scores - scores.max(0)), 0)
        pick = (share <= u[own] * share[-1]).sum(0).clip(0, len(tags) - 1)
        motif[own], reverse[own] = np.array([k for k, _ in tags])[pick], np.array([r for _, r in tags])[pick]
    return lined, (row, motif, start, reverse)


def _codes_of(seq: str) -> np.ndarray:
    return _CODE[np.frombuffer(seq.encode(), np.uint8)]


def sample_sites(sequences: DataFrame, state: State, model: Model, seed: int) -> DataFrame:
    """(doc_id, cluster, pos, reverse): sites of every sequence (doc_id, seq), the same whenever they are drawn with this state and seed. No shuffle."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((doc, key, _codes_of(seq)) for batch in batches for doc, key, seq in zip(*(c.to_pylist() for c in batch.columns)))
        for own in side_by_side.held(rows):
            docs, keys, seqs = zip(*own)
            lined, (row, k, start, reverse) = draw_all(seqs, keys, state, model, seed)
            yield sites_batch(docs, lined, row, k, start, reverse)

    rows = sequences.where("seq <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "seq").alias("key"), "seq")
    return rows.mapInArrow(drawn, SITES)


def sites_batch(docs: list, lined: side_by_side.Lined, row: np.ndarray, k: np.ndarray, start: np.ndarray, reverse: np.ndarray) -> pa.RecordBatch:
    doc = pa.array(docs, pa.int64()).take(pa.array(lined.order[row]))
    return pa.RecordBatch.from_arrays([doc, pa.array(k.astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(reverse)], ["doc_id", "cluster", "pos", "reverse"])


def letters_batch(counts: list[np.ndarray], sizes: np.ndarray, lengths: list[int]) -> pa.RecordBatch:
    """Counts by motif, offset (flanks included) and letter; cluster -1: sites by motif as offset."""
    found = [(-1, k, 0, int(n)) for k, n in enumerate(sizes) if n]
    for k, table in enumerate(counts):
        flank = math.ceil(lengths[k] / 2)
        found += [(k, int(i) - flank, int(j), int(table[i, j])) for i, j in zip(*np.nonzero(table))]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], pa.int64() if c == 3 else pa.int32()) for c in range(4)], ["cluster", "offset", "letter", "n"])


def counted_letters(rows: DataFrame, lengths: list[int], sites_of) -> DataFrame:
    """(cluster, offset, letter, n): letters of sites by motif and offset, flanks included; cluster -1: sites by motif as offset.

    ``sites_of`` gives, from an iterator of batches, lined sequences with their sites (row, motif, start, reverse).
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sizes = [np.zeros((n + 2 * math.ceil(n / 2), 5), np.int64) for n in lengths], np.zeros(len(lengths), np.int64)
        for lined, sites in sites_of(batches):
            side_by_side.add_letters(lined, sites, lengths, COMPLEMENT, counts, sizes)
        yield letters_batch(counts, sizes, lengths)

    return rows.mapInArrow(counted, DRAWN).groupBy("cluster", "offset", "letter").agg(F.sum("n").alias("n"))


def site_letters(sequences: DataFrame, state: State, model: Model, seed: int) -> DataFrame:
    """(cluster, offset, letter, n): letters of the drawn sites by motif and offset, flanks included; cluster -1: sites by motif as offset."""

    def sites_of(batches: Iterator[pa.RecordBatch]):
        rows = ((key, _codes_of(seq)) for batch in batches for key, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for own in side_by_side.held(rows):
            keys, seqs = zip(*own)
            yield draw_all(seqs, keys, state, model, seed)

    return counted_letters(sequences.where("seq <> ''").select(F.xxhash64("doc_id", "seq").alias("key"), "seq"), [m.length for m in state.motifs], sites_of)


def _accepted(gain: float, temperature: float, rng: np.random.Generator) -> bool:
    return math.log(rng.random() + 1e-300) < gain / temperature


def _shifted(m: Motif, by: int, length: int, alpha: np.ndarray, ground: np.ndarray) -> tuple[Motif, float]:
    """The motif from ``by`` offsets on in ``length`` places, and the gain in log likelihood: columns that come in leave the background and the other way round."""
    at = m.flank + by
    core = m.counts[at : at + length]
    plain = lambda c: float((c * np.log(ground)).sum())
    gain = log_marginal(core, alpha) - plain(core) - log_marginal(m.core(), alpha) + plain(m.core())
    moved = Motif(length, m.size)
    moved.counts = np.zeros((length + 2 * moved.flank, 5))
    moved.counts[moved.flank : moved.flank + length] = core
    return moved, gain


def _moves(motifs: list[Motif], state: State, model: Model, rng: np.random.Generator) -> list[Motif]:
    """Every motif may shift, then change its length by one, then join another one of the same length."""
    alpha, (least, most) = np.array(model.motif), model.lengths
    out: list[Motif] = []
    for m in motifs:
        by = int(rng.integers(1, m.flank + 1)) * (1 if rng.random() < 0.5 else -1)
        moved, gain = _shifted(m, by, m.length, alpha, state.background)
        if not _accepted(gain, state.temperature, rng):
            length = m.length + (1 if m.length == least or m.length < most and rng.random() < 0.5 else -1)
            if not least <= length <= most:
                out.append(m)
                continue
            moved, gain = _shifted(m, 0, length, alpha, state.background)
            moved = moved if _accepted(gain, state.temperature, rng) else m
        out.append(moved)
    k = 0
    while k < len(out):
        a, others = out[k], [b for b in out if b is not out[k] and b.length == out[k].length]
        logs = [math.log(model.alpha) + math.lgamma(a.size) + log_marginal(a.core(), alpha)]
        logs += [math.lgamma(a.size + b.size) - math.lgamma(b.size) + log_marginal(a.core() + b.core(), alpha) - log_marginal(b.core(), alpha) for b in others]
        x = np.array(logs) / state.temperature
        pick = int(rng.choice(len(x), p=np.exp(x - np.logaddexp.reduce(x))))
        if pick:
            b = others[pick - 1]
            b.counts, b.size = a.counts + b.counts, a.size + b.size
            out.pop(k)
        else:
            k += 1
    return out


def _next(motifs: list[Motif], ground: np.ndarray, model: Model, rng: np.random.Generator, step: int, temperature: float) -> State:
    alpha, d = np.array(model.motif), model.discount
    sizes = [m.size - d for m in motifs]
    new = [Motif(int(rng.integers(model.lengths[0], model.lengths[1] + 1))) for _ in range(model.fresh)]
    weights = rng.dirichlet([*sizes, *[(model.alpha + d * len(motifs)) / model.fresh] * model.fresh])
    for m in [*motifs, *new]:
        counts = m.core() if m.counts is not None else np.zeros((m.length, 5))
        m.theta = np.maximum(np.array([rng.dirichlet(alpha + c) for c in counts]), 1e-12)
    share = np.array(model.background) + ground
    return State([*motifs, *new], np.maximum(weights, 1e-300), share / share.sum(), step, temperature)


def process_joint(sizes: list[int], alpha: float) -> float:
    return len(sizes) * math.log(alpha) + math.lgamma(alpha) - math.lgamma(sum(sizes) + alpha) + sum(map(math.lgamma, sizes))


def sample(sequences: DataFrame, model: Model, steps: int, burnin: int = 0, t0: float = 5.0, seed: int = 0) -> tuple[DataFrame, State]:
    """Trace of the sweeps, and the state behind the last, with whose motifs ``sample_sites`` places sites.

    The first ``burnin`` sweeps cool from temperature ``t0`` to 1. The background has the shares of all letters. The likelihood is that of the
    motifs' counts under their prior and of all other letters; the posterior adds the prior of sites and of the process. Sequences without letters add nothing; without any the prior is sampled.
    """
    rng, sequences = np.random.default_rng(seed), dealt(sequences)
    everything = letter_totals(sequences)
    state, rows = _next([], everything, model, rng, 0, temperature(0, burnin, t0)), []
    for _ in range(steps + burnin):
        row, state = sweep(sequences, model, state, everything, seed, rng, burnin, t0)
        rows.append(row)
    return sequences.sparkSession.createDataFrame(rows, TRACE), state


def dealt(sequences: DataFrame) -> DataFrame:
    """Sequences with letters, made once for all sweeps and dealt evenly to tasks, however few parts their source has."""
    spark = sequences.sparkSession
    own = sequences.where("seq <> ''").select("doc_id", "seq").repartition(4 * spark.sparkContext.defaultParallelism)
    return Saved(spark, "sequences").save(own)


def temperature(step: int, burnin: int, t0: float) -> float:
    return t0 ** (1 - step / burnin) if step < burnin else 1.0


def letter_totals(sequences: DataFrame) -> np.ndarray:
    lengths = (F.coalesce(F.sum(F.length("seq") - F.length(F.replace("seq", F.lit(c)))), F.lit(0)) for c in LETTERS)
    return np.array(sequences.agg(*lengths).first(), float)


def sweep(sequences: DataFrame, model: Model, state: State, everything: np.ndarray, seed: int, rng: np.random.Generator, burnin: int, t0: float) -> tuple[tuple, State]:
    """The trace's row of one sweep, and the state for the next; all sites are drawn in one job."""
    motifs = motifs_of(site_letters(sequences, state, model, seed), [m.length for m in state.motifs])
    likelihood, posterior = posterior_of(motifs, everything, state.background, model)
    row = (state.step, state.temperature, len(motifs), sum(m.size for m in motifs), likelihood, posterior)
    motifs = _moves(motifs, state, model, rng)
    return row, _next(motifs, everything, model, rng, state.step + 1, temperature(state.step + 1, burnin, t0))


def motifs_of(letters: DataFrame, lengths: list[int]) -> list[Motif]:
    """Motifs with sites, from counts as those of ``site_letters``: a table of motifs x offsets x letters."""
    found = [Motif(length, 0, np.zeros((length + 2 * math.ceil(length / 2), 5))) for length in lengths]
    for r in letters.collect():
        if r["cluster"] == -1:
            found[r["offset"]].size = r["n"]
        else:
            found[r["cluster"]].counts[r["offset"] + found[r["cluster"]].flank, r["letter"]] = r["n"]
    return [m for m in found if m.size]


def posterior_of(motifs: list[Motif], everything: np.ndarray, background: np.ndarray, model: Model) -> tuple[float, float]:
    """Log likelihood and posterior: motifs' counts under their prior, all other letters under the background, and the priors of sites and process."""
    alpha = np.array(model.motif)
    rest = everything - sum((m.core().sum(0) for m in motifs), np.zeros(5))
    likelihood = sum(log_marginal(m.core(), alpha) for m in motifs) + float((rest * np.log(background)).sum())
    sizes = [m.size for m in motifs]
    return likelihood, likelihood + float(rest.sum()) * math.log1p(-model.rate) + sum(sizes) * math.log(model.rate) + process_joint(sizes, model.alpha)


def cluster_log_marginals(counts: DataFrame, alpha: list[float]) -> DataFrame:
    """(cluster, logml) from ``motif_counts`` (cluster, offset, c0..c4): each offset under a Dirichlet prior."""
    column = mathx.dirichlet_multinomial([F.col(f"c{k}") for k in range(5)], alpha)
    return counts.groupBy("cluster").agg(F.sum(column).alias("logml"))


def state_log_likelihood(counts: DataFrame, sizes: DataFrame, letters: DataFrame, alpha: list[float], background: list[float], rate: float, concentration: float) -> DataFrame:
    """One row: sites, clusters, likelihood and posterior of a fixed state.

    ``counts`` as above, ``sizes`` (cluster, n), ``letters`` one row n0..n4 of all letters of the sequences. Letters outside sites are background, each by itself.
    """
    covered = counts.agg(*(F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"s{k}") for k in range(5)))
    motifs = cluster_log_marginals(counts, alpha).agg(F.coalesce(F.sum("logml"), F.lit(0.0)).alias("motifs"))
    tally = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sites"), F.count("*").alias("clusters"), F.coalesce(F.sum(mathx.lgamma(F.col("n").cast("double"))), F.lit(0.0)).alias("members"))
    x = letters.join(covered).join(motifs).join(tally)  # one row each
    rest = [F.col(f"n{k}") - F.col(f"s{k}") for k in range(5)]
    likelihood: Column = F.col("motifs")
    for r, a in zip(rest, background):
        likelihood = likelihood + r * math.log(a / sum(background))
    outside = rest[0] + rest[1] + rest[2] + rest[3] + rest[4]
    joint = F.col("clusters") * math.log(concentration) + math.lgamma(concentration) - mathx.lgamma(F.col("sites") + concentration) + F.col("members")
    posterior = F.col("likelihood") + outside * math.log1p(-rate) + F.col("sites") * math.log(rate) + joint
    return x.withColumn("likelihood", likelihood).select("sites", "clusters", "likelihood", posterior.alias("posterior"))
