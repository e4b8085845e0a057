"""Result and cluster files as round trips, and the sampler of binding sites on planted motifs."""

import random

import pytest
from pyspark.sql import functions as F

from cladewise.operators import binding_sites
from cladewise.sources import clusters, results

TEXT = """[Result]
components =
\t3 4 5
\t2 2
cluster-sizes =
\t7 2
\t-
likelihood =
\t-10.25 -9.00 -8.50
\t-11.00 -7.75
partitions =
\tm1:8:{(0, 3), (1, 4)!}, m2:6:{(2, 0)}
\t-
map_partition = m1:8:{(0, 3)}
"""


def test_history_round_trip(spark, tmp_path):
    (tmp_path / "a.ini").write_text(TEXT)
    texts = results.read_texts(spark, str(tmp_path / "a.ini"))
    history = results.read_history(texts)
    rows = {(r["chain"], r["step"]): r for r in history.collect()}
    assert set(rows) == {(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)}
    assert rows[0, 2]["likelihood"] == -8.5 and rows[1, 1]["components"] == 2.0 and rows[0, 0]["posterior"] is None
    sizes = results.read_cluster_sizes(texts)
    assert [(r["row"], r["sizes"]) for r in sizes.orderBy("row").collect()] == [(0, [7, 2]), (1, [])]
    found = {(r["kind"], r["row"]): r["subsets"] for r in results.read_result_partitions(texts).collect()}
    assert len(found["partitions", 0]) == 2 and found["partitions", 1] == [] and found["map_partition", 0][0]["elements"][0]["pos"] == 3
    assert found["partitions", 0][0]["elements"][1]["reverse"]
    again = str(tmp_path / "again")
    results.write_history(results.history_lines(history.select("chain", "step", "components", "likelihood"), sizes), again)
    back = results.read_texts(spark, again)
    assert sorted(map(tuple, results.read_history(back).drop("file").collect())) == sorted(map(tuple, history.drop("file").collect()))
    (tmp_path / "b.ini").write_text("[Other]\n")
    with pytest.raises(Exception, match="no section"):
        results.read_texts(spark, str(tmp_path / "b.ini")).collect()


def test_cluster_round_trip(spark, tmp_path):
    rows = [(3, [[1.0, 2.0], [0.0, 0.5], [4.0, 4.0], [0.0, 0.0], [0.25, 9.0]], 7, "m1", [(0, 5, False), (2, 1, True)]), (11, [[1.0], [1.0], [1.0], [1.0], [0.0]], 2, "m2", None)]
    schema = "cluster int, counts array<array<double>>, members int, type string, sites array<struct<seq:int,pos:int,reverse:boolean>>"
    clusters.write_clusters(spark.createDataFrame(rows, schema), str(tmp_path / "c"))
    back = {r["cluster"]: r for r in clusters.read_clusters(spark, str(tmp_path / "c")).collect()}
    assert [(k, back[k]["counts"], back[k]["members"], back[k]["type"]) for k in (3, 11)] == [(r[0], r[1], r[2], r[3]) for r in rows]
    assert [tuple(x) for x in back[3]["sites"]] == rows[0][4] and back[11]["sites"] is None
    pwm = spark.range(1).select(clusters.parse_matrix(F.array(F.lit("a: 1 2"), F.lit("T: .5")), "GATC").alias("x")).first()["x"]
    assert pwm == [[], [1.0, 2.0], [0.5], []]
    with pytest.raises(Exception, match="neither letter"):
        spark.range(1).select(clusters.parse_matrix(F.array(F.lit("X: 1"))).alias("x")).collect()


def planted(seed: int = 1, n: int = 80):
    rng, rows = random.Random(seed), []
    for k in range(n):
        s = [rng.choice("GATC") for _ in range(60)]
        at = rng.randrange(50)
        s[at : at + 8] = "GATTCAGA" if k % 2 else "TCTGAATC"  # the same motif on either strand
        rows.append((k, "".join(s), at))
    return rows


def test_sampler_finds_a_planted_motif(spark):
    rows = planted()
    sequences = spark.createDataFrame([(k, s) for k, s, _ in rows], "doc_id long, seq string").repartition(4)
    model = binding_sites.Model(lengths=(8, 8), rate=0.02)
    trace, state = binding_sites.sample(sequences, model, steps=8, burnin=20, t0=2.0, seed=4)
    steps = trace.orderBy("step").collect()
    assert len(steps) == 28 and steps[0]["temperature"] == 2.0 and steps[-1]["temperature"] == 1.0
    assert steps[-1]["posterior"] > steps[0]["posterior"]
    sites = binding_sites.sample_sites(sequences, state, model, 9).collect()
    again = binding_sites.sample_sites(sequences.repartition(2), state, model, 9).collect()
    assert sorted(map(tuple, sites)) == sorted(map(tuple, again))
    near = {k: at for k, _, at in rows}
    assert len({r["doc_id"] for r in sites if abs(r["pos"] - near[r["doc_id"]]) <= 3}) > 60


def test_sites_do_not_overlap_and_counts_are_of_the_sites(spark):
    import numpy as np

    rows = [(k, s) for k, s, _ in planted(2, 30)] + [(100, "NNNN"), (101, ""), (102, None)]
    sequences = spark.createDataFrame(rows, "doc_id long, seq string")
    model = binding_sites.Model(lengths=(5, 7), rate=0.2)
    state = binding_sites._next([], np.zeros(5), model, np.random.default_rng(0), 0, 1.0)
    sites = binding_sites.sample_sites(sequences, state, model, 1).collect()
    text = dict(rows)
    want: dict[tuple[int, int], list[int]] = {}
    ends: dict[int, int] = {}
    for r in sorted(sites, key=lambda r: (r["doc_id"], r["pos"])):
        m, word = state.motifs[r["cluster"]], text[r["doc_id"]][r["pos"] : r["pos"] + state.motifs[r["cluster"]].length]
        assert len(word) == m.length and r["pos"] >= ends.get(r["doc_id"], 0)
        ends[r["doc_id"]] = r["pos"] + m.length
        if r["reverse"]:
            word = word[::-1].translate(str.maketrans("GATC", "CTAG"))
        for j, c in enumerate(word):
            if c != "N":
                want[r["cluster"], j, "GATC".index(c)] = want.get((r["cluster"], j, "GATC".index(c)), 0) + 1
    got = {(r["cluster"], r["offset"], r["letter"]): r["n"] for r in binding_sites.site_letters(sequences, state, model, 1).collect() if r["cluster"] >= 0}
    core = {k: n for k, n in got.items() if 0 <= k[1] < state.motifs[k[0]].length}
    assert sites and core == want


def test_site_placement_is_drawn_from_all_placements():
    """Chances of a short sequence's placements against their enumeration."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    model = binding_sites.Model(lengths=(2, 3), rate=0.3, fresh=2)
    state = binding_sites._next([], np.zeros(5), model, rng, 0, 1.0)
    seq = "GATCA"
    codes = binding_sites._CODE[np.frombuffer(seq.encode(), np.uint8)]
    options = [(s, k, rev, length, float(x[t, s])) for length, x, tags in binding_sites._ratios(codes, state, model) for t, (k, rev) in enumerate(tags) for s in range(x.shape[1])]
    weights = {}
    for n in range(4):
        for pick in itertools.combinations(options, n):
            spans = sorted((p[0], p[0] + p[3]) for p in pick)
            if all(a[1] <= b[0] for a, b in zip(spans, spans[1:])):
                weights[tuple(sorted(p[:3] for p in pick))] = float(np.exp(sum(p[4] for p in pick)))
    total, seen, draws = sum(weights.values()), {}, 20000
    for _ in range(draws):
        key = tuple(sorted(binding_sites.draw_sites(seq, state, model, rng)))
        seen[key] = seen.get(key, 0) + 1
    for key, w in weights.items():
        p = w / total
        assert abs(seen.get(key, 0) / draws - p) < 5 * (p * (1 - p) / draws) ** 0.5 + 1e-3
