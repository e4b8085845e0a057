"""Search for the most probable state of the binding-site model, and populations of its samplers that can be resumed.

The log posterior of a state is, but for linear terms, a sum of log beta functions of its counts: letters by motif and offset, and
sites by motif. Those are convex, so their tangents at the present counts bound the posterior from below. A round places the sites of all
sequences anew so that the tangents' sum is greatest, each sequence by itself in one job: the posterior can't fall, although
all sequences move at once. Motifs then try to shift, change their length or join; a try counts only if the posterior
behind its own placement is higher.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import binding_sites as bs
from . import side_by_side
from .backgrounds import digamma

TRACE = "round int, move string, clusters int, sites long, posterior double"
Tables = list[tuple[int, float, np.ndarray]]


def tangent_tables(motifs: list[bs.Motif], background: np.ndarray, model: bs.Model) -> Tables:
    """(length, base, table) of each motif: a site's score is the base and, by offset, the table's entries of its letters; the last is of a missing one."""
    total = sum(m.size for m in motifs) + model.alpha
    ground = np.log(background) + math.log1p(-model.rate)
    out = []
    for m in motifs:
        counts = m.core() + np.array(model.motif)
        table = digamma(counts) - digamma(counts.sum(1, keepdims=True)) - ground
        base = math.log(model.rate) + float(digamma(np.array(float(m.size))) - digamma(np.array(total)))
        out.append((m.length, base, np.hstack([table, np.zeros((m.length, 1))])))
    return out


def best_sites(seqs: list[np.ndarray], tables: Tables) -> list[list[tuple[int, int, bool]]]:
    """(start, motif, reverse) of the sites of each sequence's best placement, from the last one on; of equal scores fewer sites, then the first motif."""
    lined, (row, motif, start, reverse) = best_placed(seqs, tables)
    out: list[list[tuple[int, int, bool]]] = [[] for _ in seqs]
    for k, *site in zip(lined.order[row].tolist(), start.tolist(), motif.tolist(), reverse.tolist()):
        out[k].append(tuple(site))
    return out


def best_placed(seqs: list[np.ndarray], tables: Tables) -> tuple[side_by_side.Lined, tuple[np.ndarray, ...]]:
    """The sites (row, motif, start, reverse) of each sequence's best placement, side by side for all."""
    lined, scores, owner = side_by_side.Lined(seqs), {}, {}

    def best(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        score, who = np.full(len(words), -np.inf), np.zeros(len(words), np.int32)
        for k, (own_length, base, table) in enumerate(tables):
            for reverse in (False, True) if own_length == length else ():
                own = table[::-1][:, bs.COMPLEMENT] if reverse else table
                more = base + sum(own[j][words[:, j]] for j in range(length))
                better = more > score
                score[better], who[better] = more[better], 2 * k + reverse
        return score, who

    for length in sorted({t[0] for t in tables}):
        if len(lined.codes) >= length:
            scores[length], owner[length] = lined.by_word(length, lambda words, n=length: best(words, n))
            scores[length][lined.left < length] = -np.inf
    row, length, start = side_by_side.best_placement(lined, scores)
    tag = np.zeros(len(row), np.int64)
    for n, who in owner.items():
        own = length == n
        tag[own] = who[lined.start[row[own]] + start[own]]
    return lined, (row, tag // 2, start, tag % 2 == 1)


def placed(sequences: DataFrame, tables: Tables) -> DataFrame:
    """(doc_id, cluster, pos, reverse): the best sites of every sequence (doc_id, seq). No shuffle."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((doc, bs._codes_of(seq)) for batch in batches for doc, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for own in side_by_side.held(rows):
            docs, seqs = zip(*own)
            lined, sites = best_placed(seqs, tables)
            yield bs.sites_batch(docs, lined, *sites)

    return sequences.where("seq <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "seq").mapInArrow(place, bs.SITES)


def placed_letters(sequences: DataFrame, tables: Tables) -> DataFrame:
    """Letters of the best sites, which are not stored: placement is a function of the tables."""

    def sites_of(batches: Iterator[pa.RecordBatch]):
        for own in side_by_side.held((bs._codes_of(seq),) for batch in batches for seq in batch.column(0).to_pylist()):
            yield best_placed([x[0] for x in own], tables)

    return bs.counted_letters(sequences.where("seq <> ''").select("seq"), [t[0] for t in tables], sites_of)


def given_letters(sequences: DataFrame, sites: DataFrame, lengths: list[int]) -> DataFrame:
    """Letters of the sites of a table (doc_id, cluster, pos, reverse), ``cluster`` a place in ``lengths``; a sequence's sites travel as one list."""
    own = sites.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "cluster", "reverse")).alias("sites"))

    def sites_of(batches: Iterator[pa.RecordBatch]):
        rows = ((found, bs._codes_of(seq)) for batch in batches for seq, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for held in side_by_side.held(rows):
            lined = side_by_side.Lined([codes for _, codes in held])
            sites = [(row, x["cluster"], x["pos"], x["reverse"]) for row, k in enumerate(lined.order.tolist()) for x in held[k][0]]
            yield lined, tuple(np.array([x[c] for x in sites], bool if c == 3 else np.int64) for c in range(4))

    return bs.counted_letters(sequences.select("doc_id", "seq").join(own, "doc_id").select("seq", "sites"), lengths, sites_of)


def _tries(motifs: list[bs.Motif], background: np.ndarray, model: bs.Model) -> list[tuple[float, str, list[bs.Motif]]]:
    """(gain, move, motifs) of shifts, changes of length and joins that gain before sites are placed anew, the greatest gain first."""
    alpha, (least, most), out = np.array(model.motif), model.lengths, []
    for k, m in enumerate(motifs):
        others = motifs[:k] + motifs[k + 1 :]
        for by in (b for b in range(-m.flank, m.flank + 1) if b):
            moved, gain = bs._shifted(m, by, m.length, alpha, background)
            out.append((gain, f"shift {by}", [moved, *others]))
        for by, length in ((0, m.length + 1), (-1, m.length + 1), (0, m.length - 1), (1, m.length - 1)):
            if least <= length <= most:
                moved, gain = bs._shifted(m, by, length, alpha, background)
                out.append((gain, f"length {length}", [moved, *others]))
        for other in others[k:]:
            if other.length == m.length:
                both = bs.Motif(m.length, m.size + other.size, m.counts + other.counts)
                gain = bs.log_marginal(both.core(), alpha) - bs.log_marginal(m.core(), alpha) - bs.log_marginal(other.core(), alpha)
                gain += math.lgamma(both.size) - math.lgamma(m.size) - math.lgamma(other.size) - math.log(model.alpha)
                out.append((gain, "join", [both, *(x for x in others if x is not other)]))
    return sorted((t for t in out if t[0] > 1e-9), key=lambda t: -t[0])


def optimise(sequences: DataFrame, sites: DataFrame, lengths: list[int], model: bs.Model, rounds: int = 50, tries: int = 8) -> tuple[DataFrame, DataFrame]:
    """(doc_id, cluster, pos, reverse) of a local optimum, and the trace (round, move, clusters, sites, posterior), which never falls.

    It starts at ``sites`` (cluster: a place in ``lengths``) and places all sites anew until that gains nothing, then tries at most ``tries`` moves of
    motifs, and ends when none of them gains or after ``rounds`` rounds. Without sites it returns none. ``sequences`` (doc_id, seq) has
    distinct ids; sites must not overlap or reach beyond their sequence.
    """
    spark, sequences = sequences.sparkSession, bs.dealt(sequences)
    everything = bs.letter_totals(sequences)
    background = (np.array(model.background) + everything) / (sum(model.background) + everything.sum())
    value = lambda motifs: bs.posterior_of(motifs, everything, background, model)[1]
    row = lambda k, move, motifs: (k, move, len(motifs), int(sum(m.size for m in motifs)), value(motifs))
    now, tables = bs.motifs_of(given_letters(sequences, sites, lengths), lengths), None
    trace = [row(0, "start", now)]

    def after(motifs: list[bs.Motif]) -> tuple[list[bs.Motif], Tables]:
        new = tangent_tables(motifs, background, model)
        return bs.motifs_of(placed_letters(sequences, new), [t[0] for t in new]), new

    for k in range(1, rounds + 1):
        if not now:
            break
        moves = [(0.0, "place", now)] if trace[-1][1] != "stand" else _tries(now, background, model)[:tries]
        for _, move, motifs in moves:
            new, own = after(motifs)
            if value(new) > trace[-1][4] + 1e-6:
                now, tables = new, own
                trace.append(row(k, move, now))
                break
        else:
            if trace[-1][1] == "stand":
                break
            trace.append(row(k, "stand", now))
    found = sites.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("cluster").cast("int").alias("cluster"), F.col("pos").cast("int").alias("pos"), "reverse") if tables is None else placed(sequences, tables)
    return found, spark.createDataFrame(trace, TRACE)


# populations

HISTORY = "chain int, " + bs.TRACE
STATES = "chain int, step int, state string"


def state_text(state: bs.State, rng: np.random.Generator) -> str:
    """A sampler's state and random generator as JSON; numbers come back exactly."""
    motifs = [{"length": m.length, "theta": m.theta.tolist()} for m in state.motifs]
    return json.dumps({"motifs": motifs, "weights": state.weights.tolist(), "background": state.background.tolist(), "step": state.step, "temperature": state.temperature, "rng": rng.bit_generator.state})


def state_of(text: str) -> tuple[bs.State, np.random.Generator]:
    x = json.loads(text)
    rng = np.random.default_rng()
    rng.bit_generator.state = x["rng"]
    motifs = [bs.Motif(m["length"], theta=np.array(m["theta"])) for m in x["motifs"]]
    return bs.State(motifs, np.array(x["weights"]), np.array(x["background"]), x["step"], x["temperature"]), rng


def population(sequences: DataFrame, model: bs.Model, chains: int, steps: int, folder: str, burnin: int = 0, t0: float = 5.0, seed: int = 0, every: int = 10) -> DataFrame:
    """(chain, step, temperature, clusters, sites, likelihood, posterior): the history of all chains in ``folder`` after ``steps`` further sweeps of each.

    ``folder`` keeps the chains' history and, behind every ``every`` sweeps, their states; a call on a folder that has states goes on from
    the last ones, with the same random numbers as a run that never stopped. Rows of sweeps whose state was not stored any more (the
    driver was lost between) don't count. The burn-in and the seed must stay from call to call.
    """
    spark, sequences = sequences.sparkSession, bs.dealt(sequences)
    everything = bs.letter_totals(sequences)
    states = _states(spark, folder)
    if not states:
        for c in range(chains):
            rng = np.random.default_rng([seed, c])
            states[c] = (bs._next([], everything, model, rng, 0, bs.temperature(0, burnin, t0)), rng)
    if len(states) != chains:
        raise ValueError(f"the folder has {len(states)} chains, not {chains}")
    left = steps
    while left > 0:
        rows, n = [], min(every, left)
        for c, (state, rng) in sorted(states.items()):
            for _ in range(n):
                row, state = bs.sweep(sequences, model, state, everything, seed + c, rng, burnin, t0)
                rows.append((c, *row))
            states[c] = (state, rng)
        # the history first: what has no state behind it is passed over when the folder is read
        spark.createDataFrame(rows, HISTORY).coalesce(1).write.mode("append").parquet(f"{folder}/history")
        stored = [(c, s.step, state_text(s, rng)) for c, (s, rng) in sorted(states.items())]
        spark.createDataFrame(stored, STATES).coalesce(1).write.mode("append").parquet(f"{folder}/states")
        left -= n
    return population_history(spark, folder)


def _exists(spark, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _states(spark, folder: str) -> dict[int, tuple[bs.State, np.random.Generator]]:
    if not _exists(spark, f"{folder}/states/_SUCCESS"):
        return {}
    last = spark.read.schema(STATES).parquet(f"{folder}/states").groupBy("chain").agg(F.max_by("state", "step").alias("state"))
    return {r["chain"]: state_of(r["state"]) for r in last.collect()}  # one row a chain


def population_history(spark, folder: str) -> DataFrame:
    """Rows of sweeps up to each chain's last stored state; a sweep that was run again counts once."""
    upto = spark.read.schema(STATES).parquet(f"{folder}/states").groupBy("chain").agg(F.max("step").alias("upto"))
    rows = spark.read.schema(HISTORY).parquet(f"{folder}/history").join(F.broadcast(upto), "chain").where("step < upto").drop("upto")
    return rows.dropDuplicates(["chain", "step"])
