"""Search for the best state, and resumed populations, of the binding-site model."""

import itertools
import tempfile

import numpy as np
import pytest

from cladewise.operators import binding_sites as bs
from cladewise.operators import site_search as search

LETTERS = "GATC"
MODEL = bs.Model(lengths=(5, 8), rate=0.02)


def planted(seed=1, n=60, length=40, motif="GATTACA"):
    rng = np.random.default_rng(seed)
    seqs, sites = [], []
    for k in range(n):
        letters = [LETTERS[i] for i in rng.integers(0, 4, length)]
        if k % 3:
            start, reverse = int(rng.integers(0, length - len(motif))), bool(rng.random() < 0.5)
            own = motif[::-1].translate(str.maketrans("GATC", "CTAG")) if reverse else motif
            letters[start : start + len(motif)] = own
            sites.append((k, 0, start, reverse))
        seqs.append((k, "".join(letters)))
    return seqs, sites


def frames(spark, seqs, sites):
    return spark.createDataFrame(seqs, "doc_id long, seq string"), spark.createDataFrame(sites, bs.SITES)


def test_best_sites_equal_enumeration():
    rng = np.random.default_rng(3)
    tables = [(3, 0.4, np.hstack([rng.normal(size=(3, 5)), np.zeros((3, 1))])), (2, 0.1, np.hstack([rng.normal(size=(2, 5)), np.zeros((2, 1))])), (3, 0.2, np.hstack([rng.normal(size=(3, 5)), np.zeros((3, 1))]))]
    seqs = [rng.integers(0, 6, n) for n in (9, 7, 1, 2, 9, 0)]

    def score(codes, start, k, reverse):
        length, base, table = tables[k]
        own = codes[start : start + length]
        return base + sum(table[length - 1 - j][bs.COMPLEMENT[c]] if reverse else table[j][c] for j, c in enumerate(own))

    def best(codes, start):
        if start >= len(codes):
            return 0.0
        options = [best(codes, start + 1)]
        for k, reverse in itertools.product(range(3), (False, True)):
            if start + tables[k][0] <= len(codes):
                options.append(score(codes, start, k, reverse) + best(codes, start + tables[k][0]))
        return max(options)

    for codes, sites in zip(seqs, search.best_sites(seqs, tables)):
        assert sum(score(codes, *s) for s in sites) == pytest.approx(best(codes, 0))
        ends = sorted((s, s + tables[k][0]) for s, k, _ in sites)
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:])) and all(e <= len(codes) for _, e in ends)


def test_posterior_never_falls_and_the_planted_state_is_kept(spark):
    seqs, sites = planted()
    sequences, given = frames(spark, seqs, sites)
    found, trace = search.optimise(sequences, given, [7], MODEL)
    steps = [r["posterior"] for r in trace.collect()]
    assert all(b >= a for a, b in zip(steps, steps[1:]))
    got = {(r["doc_id"], r["pos"], r["reverse"]) for r in found.collect()}
    want = {(d, p, r) for d, _, p, r in sites}
    assert len(got & want) >= 0.95 * len(want) and len(got) <= 1.3 * len(want)
    # the trace's posterior is that of the sites
    sizes = [m.length for m in bs.motifs_of(search.given_letters(sequences, found, [7]), [7])]
    assert sizes == [7]
    everything = bs.letter_totals(sequences)
    background = (np.array(MODEL.background) + everything) / (sum(MODEL.background) + everything.sum())
    again = bs.posterior_of(bs.motifs_of(search.given_letters(sequences, found, [7]), [7]), everything, background, MODEL)[1]
    assert again == pytest.approx(steps[-1])


def test_shifted_and_divided_motifs_come_together(spark):
    seqs, sites = planted(2)
    # one motif lies a place off, the sites are dealt to two motifs
    off = [(d, d % 2, p + 1, r) if not r and p + 8 <= 40 else (d, d % 2, p - 1, r) for d, _, p, r in sites if r is False or p > 0]
    sequences, given = frames(spark, seqs, off)
    found, trace = search.optimise(sequences, given, [7, 7], MODEL)
    rows = trace.collect()
    assert rows[0]["clusters"] == 2 and rows[-1]["clusters"] == 1
    assert all(b["posterior"] >= a["posterior"] for a, b in zip(rows, rows[1:])) and {"join"} <= {r["move"] for r in rows}
    got = {(r["doc_id"], r["pos"] + by) for r in found.collect() for by in (-1, 0, 1)}  # a motif may take in a place beside it
    assert len(got & {(d, p) for d, _, p, _ in sites}) >= 0.9 * len(sites)


def test_search_without_sites(spark):
    sequences, given = frames(spark, [(1, "GATTACA"), (2, ""), (3, None)], [])
    found, trace = search.optimise(sequences, given, [7], MODEL)
    assert found.count() == 0 and trace.count() == 1


def test_resumed_population_equals_one_run(spark):
    seqs, _ = planted(4, n=12)
    sequences, _ = frames(spark, seqs, [])
    one, two = (tempfile.mkdtemp(prefix="population-") for _ in range(2))
    whole = search.population(sequences, MODEL, 2, 4, one, burnin=2, seed=7, every=4)
    search.population(sequences, MODEL, 2, 2, two, burnin=2, seed=7, every=1)
    # rows without a state behind them, as a lost driver leaves them, don't count, nor twice when their sweep is run again
    whole.where("step = 2").write.mode("append").parquet(f"{two}/history")
    assert search.population_history(spark, two).count() == 4
    parts = search.population(sequences, MODEL, 2, 2, two, burnin=2, seed=7, every=2)
    got = [sorted(map(tuple, x.collect())) for x in (whole, parts)]
    assert len(got[0]) == 8 and got[0] == got[1]
    with pytest.raises(ValueError):
        search.population(sequences, MODEL, 3, 1, two, burnin=2, seed=7)
