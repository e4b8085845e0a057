"""Sites of many sequences, drawn or placed side by side, against one sequence at a time."""

from __future__ import annotations

import time

import numpy as np

from cladewise.operators import binding_sites as bs
from cladewise.operators import side_by_side, site_search


def _state(lengths: list[int], seed: int = 1, sharp: float = 1.0, temperature: float = 1.0) -> bs.State:
    rng = np.random.default_rng(seed)
    motifs = [bs.Motif(n, theta=rng.dirichlet([sharp] * 5, n).clip(1e-12)) for n in lengths]
    return bs.State(motifs, np.full(len(lengths), 1 / max(1, len(lengths))), np.full(5, 0.2), 2, temperature)


def _drawn(seqs: list[str], state: bs.State, model: bs.Model) -> list[list[tuple[int, int, bool]]]:
    lined, (row, motif, start, reverse) = bs.draw_all([bs._codes_of(s) for s in seqs], list(range(len(seqs))), state, model, 7)
    out: list[list[tuple[int, int, bool]]] = [[] for _ in seqs]
    for k, *site in zip(lined.order[row].tolist(), start.tolist(), motif.tolist(), reverse.tolist()):
        out[k].append(tuple(site))
    return [sorted(x) for x in out]


def _alone(seqs: list[str], state: bs.State, model: bs.Model) -> list[list[tuple[int, int, bool]]]:
    rngs = (np.random.Generator(np.random.PCG64([7, state.step, k])) for k in range(len(seqs)))
    return [sorted(bs.draw_sites(s, state, model, rng)) for s, rng in zip(seqs, rngs)]


def test_draws_equal_those_of_each_sequence_by_itself():
    rng = np.random.default_rng(5)
    sizes = [1, 2, 3, 5, 33, 64, 400, 3000, *rng.integers(1, 200, 200).tolist()]
    seqs = ["".join(rng.choice(list("GATC-N"), n, p=[0.22] * 4 + [0.06] * 2)) for n in sizes]
    for lengths, rate, temperature in (([4, 6, 6], 0.05, 1.0), ([2, 3], 0.4, 3.0), ([9, 12], 0.1, 1.0), ([], 0.1, 1.0)):
        state, model = _state(lengths, temperature=temperature), bs.Model(rate=rate)
        found = _drawn(seqs, state, model)
        assert found == _alone(seqs, state, model)
        assert any(found) == bool(lengths)


def test_heavy_sites_are_drawn_from_logarithms():
    state = _state([60])
    state.motifs[0].theta = np.eye(5)[np.zeros(60, int)].clip(1e-12)
    state.background = np.array([1e-9, 0.4, 0.3, 0.2, 0.1])
    seqs = ["AT" + "G" * 130 + "CA", "GATTACA", "G" * 59]
    assert _drawn(seqs, state, bs.Model()) == _alone(seqs, state, bs.Model())
    assert len(_drawn(seqs, state, bs.Model())[0]) == 2


def test_letters_equal_a_count_of_each_site():
    rng = np.random.default_rng(6)
    seqs = [rng.integers(0, 6, n) for n in (12, 7, 30)]
    lined, lengths = side_by_side.Lined(seqs), [4, 5]
    sites = [(int(rng.integers(3)), int(k), bool(r)) for k, r in zip(rng.integers(0, 2, 40), rng.integers(0, 2, 40))]
    sites = [(row, k, int(rng.integers(0, lined.size[row] - lengths[k] + 1)), r) for row, k, r in sites]
    counts, sizes = [np.zeros((n + 2 * -(-n // 2), 5), np.int64) for n in lengths], np.zeros(2, np.int64)
    side_by_side.add_letters(lined, tuple(np.array(x) for x in zip(*sites)), lengths, bs.COMPLEMENT, counts, sizes)
    plain = [np.zeros_like(x) for x in counts]
    for row, k, start, reverse in sites:
        own, flank = seqs[lined.order[row]], -(-lengths[k] // 2)
        for j in range(-flank, lengths[k] + flank):
            at = start + (lengths[k] - 1 - j if reverse else j)
            if 0 <= at < len(own) and own[at] < 5:
                plain[k][j + flank, bs.COMPLEMENT[own[at]] if reverse else own[at]] += 1
    assert all((a == b).all() for a, b in zip(counts, plain)) and sizes.sum() == 40


def test_draws_of_many_sequences_take_a_fraction_of_the_time():
    rng = np.random.default_rng(8)
    seqs = ["".join(rng.choice(list("GATC"), 300)) for _ in range(1500)]
    state, model = _state([6, 7, 8, 8]), bs.Model(rate=0.05)
    began = time.process_time()
    found = _drawn(seqs, state, model)
    own = time.process_time() - began
    began = time.process_time()
    assert found[:300] == _alone(seqs[:300], state, model)
    assert own < 0.6 * 5 * (time.process_time() - began)


def _read(spark, seqs: list[str]):
    """A table of sequences, in one part, that counts how often its rows are made."""
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    table = spark.createDataFrame(list(enumerate(seqs)), "doc_id long, seq string").coalesce(1)
    return table.mapInArrow(seen, "doc_id long, seq string"), made


_SEQS = ["GATTACA" * 9, "", "TTATTATTAC" * 5, "ACGT" * 20]


def test_sweeps_make_their_sequences_once(spark):
    table, made = _read(spark, _SEQS)
    assert bs.sample(table, bs.Model(lengths=(4, 5)), 2, seed=1)[0].count() == 2
    assert made.value == len(_SEQS)


def test_populations_make_their_sequences_once_a_call(spark, tmp_path):
    table, made = _read(spark, _SEQS)
    assert site_search.population(table, bs.Model(lengths=(4, 5)), 2, 2, f"file://{tmp_path}/states", seed=1).count() == 4
    assert made.value == len(_SEQS)


def test_searches_make_their_sequences_once(spark):
    table, made = _read(spark, _SEQS)
    sites = spark.createDataFrame([(0, 0, 7, False), (2, 0, 10, False)], bs.SITES)
    _, trace = site_search.optimise(table, sites, [5], bs.Model(lengths=(4, 6)), rounds=3, tries=2)
    assert trace.count() >= 2
    assert made.value == len(_SEQS)


def test_best_sites_of_long_and_short_motifs_equal_one_sequence_at_a_time():
    rng = np.random.default_rng(9)
    seqs = [rng.integers(0, 6, n) for n in (1, 3, 9, 40, 700, *rng.integers(1, 90, 60))]
    tables = [(n, -1.0, np.hstack([rng.normal(0, 1, (n, 5)), np.zeros((n, 1))])) for n in (3, 3, 10)]
    for many, (seq,) in zip(site_search.best_sites(seqs, tables), ([s] for s in seqs)):
        best, taken = [0.0], [None]
        for i in range(1, len(seq) + 1):
            value, site = best[-1], None
            for n in (3, 10):
                ways = [(base + sum((t[::-1][:, bs.COMPLEMENT] if r else t)[j][seq[i - n + j]] for j in range(n)), k, r) for k, (length, base, t) in enumerate(tables) if length == n <= i for r in (False, True)]
                for own, k, r in ways:
                    if own + best[i - n] > value + 1e-12:
                        value, site = own + best[i - n], (i - n, k, r)
            best.append(value)
            taken.append(site)
        found, i = [], len(seq)
        while i > 0:
            if taken[i]:
                found.append(taken[i])
            i = taken[i][0] if taken[i] else i - 1
        assert many == found
