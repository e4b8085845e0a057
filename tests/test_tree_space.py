"""Points, means and medians in tree space, and chains over trees."""

import math
import random

import pytest

from cladewise.operators import partitions, tree_means, tree_sampler, trees

NAMES = ["a", "b", "c", "d", "e"]
ONE, TWO = "(((b:1,c:1):3,d:1):4,e:1,a:1);", "(((b:1,d:1):6,c:1):8,e:1,a:1);"
FAR = "(((b:1,e:1):1,c:1):1,d:1,a:1);"


def tree(text):
    return trees.splits_of(trees.parse_newick(text), NAMES)


@pytest.mark.parametrize("first,second", [(ONE, TWO), (TWO, FAR), (ONE, FAR), (ONE, ONE)])
def test_points_divide_the_way(first, second):
    path = trees.geodesic(tree(first), tree(second))
    for share in (0.0, 0.2, 0.5, 0.9, 1.0):
        point = path.point(share)
        assert math.isclose(trees.geodesic(tree(first), point).length(), share * path.length(), abs_tol=1e-9)
        assert math.isclose(trees.geodesic(point, tree(second)).length(), (1 - share) * path.length(), abs_tol=1e-9)


def sample(n):
    rng = random.Random(5)
    return [(k, f"(((b:1,c:{rng.uniform(1, 9):.3f}):{rng.uniform(1, 5):.3f},d:1):{rng.uniform(1, 5):.3f},e:1,a:1);") for k in range(n)]


def test_mean_in_one_topology_is_the_average(spark):
    rows = sample(8)
    got = tree_means.random_walks(spark.createDataFrame([*rows, (99, None)], "tree long, newick string"), NAMES, "mean", 2, 7).toPandas()
    edges = [tree(t)[0] for _, t in rows]
    for w in (0, 1):
        own = got[(got["walk"] == w) & (got["kind"] == "split")]
        assert set(own["mask"]) == set(edges[0])
        for m, d in zip(own["mask"], own["d"]):
            assert math.isclose(d, sum(e[m] for e in edges) / 8, rel_tol=1e-9)


@pytest.mark.parametrize("block", [16, 256])
def test_every_tree_takes_part(spark, monkeypatch, block):
    """Far more trees than passes: the mean of one topology is the average of all, over several levels of merges too."""
    monkeypatch.setattr(tree_means, "BLOCK_TREES", block)
    rows = sample(400)
    got = tree_means.random_walks(spark.createDataFrame(rows, "tree long, newick string"), NAMES, "mean", 2, 3).toPandas()
    edges = [tree(t)[0] for _, t in rows]
    for w in (0, 1):
        own = got[(got["walk"] == w) & (got["kind"] == "split")]
        assert set(own["mask"]) == set(edges[0])
        for m, d in zip(own["mask"], own["d"]):
            assert math.isclose(d, sum(e[m] for e in edges) / 400, rel_tol=1e-9)


def test_blocks_lose_little_against_a_cyclic_walk(spark, monkeypatch):
    monkeypatch.setattr(tree_means, "BLOCK_TREES", 20)
    rng = random.Random(8)
    rows = [(k, t.replace(":1,", f":{rng.uniform(0.5, 2):.3f},")) for k, t in enumerate([ONE] * 60 + [TWO] * 30 + [FAR] * 10)]
    all_trees = [tree(t) for _, t in rows]
    for kind, power, share in (("mean", 2, tree_means.toward_mean), ("median", 1, tree_means.toward_median)):
        loss = lambda place: sum(trees.geodesic(place, t).length() ** power for t in all_trees)  # noqa: B023, E731
        cyclic = tree_means.walk(all_trees, [1.0] * 100, 100 * 100 - 1, share)
        got = tree_means.random_walks(spark.createDataFrame(rows, "tree long, newick string"), NAMES, kind, 1).toPandas()
        split, leaf = got[got["kind"] == "split"], got[got["kind"] == "leaf"].sort_values("mask")
        place = (dict(zip(map(int, split["mask"]), split["d"])), leaf["d"].tolist())
        assert loss(place) < 1.1 * loss(cyclic)


def test_median_of_copies_and_one_far_tree_stays_with_the_copies(spark):
    rows = [(k, ONE) for k in range(9)] + [(9, FAR)]
    got = tree_means.random_walks(spark.createDataFrame(rows, "tree long, newick string"), NAMES, "median", 2, 200).toPandas()
    for w in (0, 1):
        own = got[got["walk"] == w]
        end = (dict(own[own["kind"] == "split"][["mask", "d"]].values), own[own["kind"] == "leaf"]["d"].tolist())
        end = ({int(m): d for m, d in end[0].items()}, end[1])
        assert trees.geodesic(end, tree(ONE)).length() < 0.2


def test_no_trees_give_no_walks(spark):
    assert tree_means.random_walks(spark.createDataFrame([], "tree long, newick string"), NAMES).count() == 0


TAXA = ["x", "y", "z", "o"]
START = "((x:0.3,y:0.4):0.2,z:0.5,o:0.3);"


def patterns(spark):
    return spark.createDataFrame([([0, 0, 1, 2], 3), ([1, 1, 1, 1], 5), ([0, 1, 2, -1], 2)], "codes array<int>, n int")


def test_log_posterior_is_the_sum_over_columns(spark):
    root = trees.parse_newick(START)
    want = tree_sampler.log_prior(root, 2.0, 0.5)
    for r in patterns(spark).collect():
        want += r["n"] * trees.log_marginal(trees.column_polynomial(root, dict(zip(TAXA, r["codes"])), 4), [0.5] * 4)
    (got,) = tree_sampler.log_posteriors(patterns(spark), [root], TAXA, [0.5] * 4, 2.0, 0.5)
    assert math.isclose(got, want, rel_tol=1e-9)


def test_chains_keep_their_leaves_and_report_the_posterior_of_their_tree(spark):
    p = patterns(spark).cache()
    rows = tree_sampler.metropolis_hastings(p, START, TAXA, [0.5] * 4, 8, [1.0, 3.0], share=0.5, seed=3).collect()
    assert len(rows) == 16 and {r["accepted"] for r in rows} == {True, False}
    last = [r for r in rows if r["step"] == 7]
    again = tree_sampler.log_posteriors(p, [trees.parse_newick(r["newick"]) for r in last], TAXA, [0.5] * 4, 1.0, 0.1)
    for r, value in zip(last, again):
        root = trees.parse_newick(r["newick"])
        assert sorted(n.name for n in trees.leaves(root)) == sorted(TAXA) and root.children[-1].name == "o"
        assert math.isclose(r["posterior"], value, rel_tol=1e-3)


def test_partition_estimates_against_all_pairs(spark):
    rng = random.Random(2)
    own = {s: [rng.randrange(s + 2) for _ in range(20)] for s in range(4)}
    own[3] = own[1]
    rows = [(s, i, c) for s, cs in own.items() for i, c in enumerate(cs)]
    d = partitions.pair_distances(spark.createDataFrame(rows, "sample int, item int, cluster int"))
    got = {(r["i"], r["j"]): r["distance"] for r in d.collect()}
    for (i, j), x in got.items():
        apart = sum((own[i][p] == own[i][q]) != (own[j][p] == own[j][q]) for p in range(20) for q in range(p))
        assert math.isclose(x, apart / 190)
    assert len(got) == 6 and got[1, 3] == 0
    best = partitions.estimates(d).where("is_median").collect()
    assert [r["sample"] for r in best] == [min(range(4), key=lambda s: round(sum(x for k, x in got.items() if s in k), 9))]


def random_tree(rng):
    while True:
        names = list(NAMES)
        rng.shuffle(names)
        text = f"(({names[0]}:{rng.random():.4f},{names[1]}:{rng.random():.4f}):{rng.random():.4f},({names[2]}:{rng.random():.4f},{names[3]}:{rng.random():.4f}):{rng.random():.4f}"
        return text + "".join(f",{n}:{rng.random():.4f}" for n in names[4:]) + ");"


def test_median_by_passes_is_as_good_as_a_long_walk(spark):
    rng = random.Random(11)
    near = [random_tree(rng)] * 1
    texts = [random_tree(rng) for _ in range(60)] + near * 10
    rows = [(k, t, float(1 + k % 3)) for k, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "tree long, newick string, weight double").repartition(5)
    own = [(tree(t), w) for _, t, w in rows]
    loss = lambda place: sum(w * trees.geodesic(place, t).length() for t, w in own)
    found, trace = tree_means.geometric_median(table, NAMES)
    got = found.collect()
    place = ({r["mask"]: r["d"] for r in got if r["kind"] == "split"}, [r["d"] for r in sorted((r for r in got if r["kind"] == "leaf"), key=lambda r: r["mask"])])
    walked = tree_means.walk([t for t, _ in own], [w for _, w in own], 4000, tree_means.toward_median)
    assert loss(place) <= 1.002 * loss(walked)
    steps = [r["loss"] for r in trace.orderBy("pass").collect()]
    assert min(steps) < steps[0] and abs(min(steps) - loss(place)) < 1e-6 * steps[0]


def test_median_of_odd_tables(spark):
    none = spark.createDataFrame([(1, None)], "tree long, newick string")
    found, trace = tree_means.geometric_median(none, NAMES)
    assert found.count() == 0 and trace.count() == 0
    text = random_tree(random.Random(1))
    one = tree_means.geometric_median(spark.createDataFrame([(1, text), (2, text), (3, None)], "tree long, newick string"), NAMES)[0]
    edges, _ = trees.splits_of(trees.parse_newick(text), NAMES)
    assert {r["mask"]: round(r["d"], 6) for r in one.where("kind = 'split'").collect()} == {m: round(d, 6) for m, d in edges.items()}
