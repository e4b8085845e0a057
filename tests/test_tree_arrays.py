"""Geodesics side by side equal those of one pair at a time; the tree queries' figures at size are in the README."""

import random

import numpy as np
import pytest

from cladewise.operators import tree_arrays, tree_means, trees

NAMES = [f"x{k}" for k in range(7)]


def random_tree(rng):
    nodes = [trees.Node(rng.random() + 0.1, n) for n in NAMES[1:]]
    while len(nodes) > 2:
        a, b = nodes.pop(rng.randrange(len(nodes))), nodes.pop(rng.randrange(len(nodes)))
        nodes.append(trees.Node(rng.choice([0.0, rng.random() + 0.01, 3 * rng.random() + 0.01]), "", [a, b]))
    return trees.Node(0.0, "", [*nodes, trees.Node(rng.random(), NAMES[0])])


def array(pool):
    masks = sorted({m for e, _ in pool for m in e})
    return masks, np.array([[*(e.get(m, 0.0) for m in masks), *own] for e, own in pool]).T


def same(masks, column, place):
    assert column == pytest.approx([*(place[0].get(m, 0.0) for m in masks), *place[1]], abs=1e-9)


def test_pairs_side_by_side(monkeypatch):
    rng = random.Random(1)
    for k in range(60):
        monkeypatch.setattr(tree_arrays, "MOST_TRIED", 8 if k % 3 else 0)
        pool = [trees.splits_of(random_tree(rng), NAMES) for _ in range(6)]
        masks, every = array(pool)
        i, j = np.divmod(np.arange(36), 6)
        share, space = np.array([rng.random() for _ in i]), tree_arrays.Space(masks)
        lengths, points = space.lengths(every[:, i], every[:, j]), space.between(every[:, i], every[:, j], share)
        from_one = space.between(every[:, :1], every, 0.3)
        for n, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
            way = trees.geodesic(pool[a], pool[b])
            assert lengths[n] == pytest.approx(way.length(), abs=1e-9)
            same(masks, points[:, n], way.point(share[n]))
            if a == 0:
                same(masks, from_one[:, b], way.point(0.3))


@pytest.mark.parametrize("weights", [[1.0] * 15, [1.0 + k % 3 for k in range(15)]])
def test_walks_side_by_side(weights):
    rng = random.Random(2)
    pool = [trees.splits_of(random_tree(rng), NAMES) for _ in range(5)]
    pool = [pool[rng.randrange(5)] for _ in range(15)]
    masks, every = array(pool)
    first, sizes = np.array([0, 4, 5, 12]), np.array([4, 1, 7, 3])
    ends = tree_arrays.mean_walks(tree_arrays.Space(masks), every, np.array(weights), first, sizes, 20)
    for k, (a, n) in enumerate(zip(first.tolist(), sizes.tolist())):
        same(masks, ends[:, k], tree_means.walk(pool[a : a + n], weights[a : a + n], 20 * n - 1, tree_means.toward_mean))


def test_texts_of_one_shape_are_looked_up_once():
    rng, read = random.Random(3), trees.split_reader(NAMES)
    for _ in range(100):
        text = trees.to_newick(random_tree(rng))
        assert read(text) == trees.splits_of(trees.parse_newick(text), NAMES)
    zero = "((x1:1,x2:2):0.0,(x3:1,x4:1):0.5,x5,(x6: 2,x0:1):3);"
    assert read(zero) == trees.splits_of(trees.parse_newick(zero), NAMES)
    with pytest.raises(ValueError):
        read("((x1:1,x2:2;")


def test_blocks_over_several_batches_and_too_many_edges(spark, monkeypatch):
    """A block is walked whole wherever batches end, and trees of many edges go one pair at a time."""
    rng = random.Random(4)
    rows = [(k, trees.to_newick(random_tree(rng))) for k in range(90)]
    table = spark.createDataFrame(rows, "tree long, newick string")
    monkeypatch.setattr(tree_means, "BLOCK_TREES", 30)
    monkeypatch.setattr(tree_means, "SIDE_BY_SIDE", 1)

    def places(got):
        return sorted((r["walk"], r["kind"], r["mask"], round(r["d"], 7)) for r in got.collect())

    whole = places(tree_means.random_walks(table, NAMES, "mean", 2, 3))
    assert len({w for w, *_ in whole}) == 2
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        held = tree_means._walks_side_by_side(3)
        assert places(tree_means.random_walks(table, NAMES, "mean", 2, 3)) == whole
        assert held is not None
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_many_walks_take_arrays(monkeypatch):
    """Walks toward the mean of blocks do not call the plain geodesic for every step."""
    import pyarrow as pa

    rng = random.Random(5)
    pool = [trees.splits_of(random_tree(rng), NAMES) for _ in range(4)] * 50
    rows = pa.table({"walk": [0] * 200, "block": [k // 10 for k in range(200)], "weight": [1.0] * 200, "masks": [list(e) for e, _ in pool], "edges": [list(e.values()) for e, _ in pool], "leaves": [x for _, x in pool]})
    rows = rows.cast(pa.schema([("walk", pa.int32()), ("block", pa.int64()), ("weight", pa.float64()), ("masks", pa.list_(pa.int64())), ("edges", pa.list_(pa.float64())), ("leaves", pa.list_(pa.float64()))]))
    monkeypatch.setattr(tree_means, "HELD", 25)
    plain = list(tree_means._walks_side_by_side(4)(iter(rows.to_batches(max_chunksize=7))))
    assert [b for x in plain for b in x.column("block").to_pylist()] == list(range(20))
    monkeypatch.setattr(tree_means, "walk", lambda *a: pytest.fail("one pair at a time"))
    whole = list(tree_means._walks_side_by_side(4)(iter(rows.to_batches())))
    edges = lambda found: [e for x in found for e in x.column("edges").to_pylist()]
    assert [pytest.approx(e) for e in edges(plain)] == edges(whole)


def test_passes_take_arrays(monkeypatch):
    """A pass to the median measures and pulls all trees of a batch at once, with the distances of single geodesics."""
    import pyarrow as pa

    rng = random.Random(6)
    pool = [trees.splits_of(random_tree(rng), NAMES) for _ in range(5)] * 8
    weights = [1.0 + k % 3 for k in range(40)]
    kinds = [pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
    columns = [weights, [list(e) for e, _ in pool], [list(e.values()) for e, _ in pool], [x for _, x in pool]]
    rows = pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], tree_means.PREPARED_COLUMNS)
    ways = [trees.geodesic(pool[0], t) for t in pool]
    monkeypatch.setattr(tree_means, "geodesic", lambda *a: pytest.fail("one pair at a time"))
    ((place, weight, loss, _),) = tree_means._pulled(rows, pool[0], 0.0)
    assert weight == sum(weights) and loss == pytest.approx(sum(w * g.length() for w, g in zip(weights, ways)))
    assert place[0] == pytest.approx(pool[0][0]) and place[1] == pytest.approx(pool[0][1])


def test_texts_of_one_shape_are_read_together(monkeypatch):
    """Trees are read and packed side by side once, not text by text; odd texts and trees of many edges keep their place."""
    import pyarrow as pa

    rng = random.Random(8)
    texts = [trees.to_newick(random_tree(rng)) for _ in range(3)]
    texts = [t.replace("0.", f"{k % 7}.") for k in range(60) for t in texts]
    one, together = trees.split_reader(NAMES), trees.array_reader(NAMES)
    masks, lengths = together(pa.array(texts))
    found = [({m: d for m, d in zip(masks, x) if d > 0}, x[len(masks) :].tolist()) for x in lengths.T]
    assert found == [({m: d for m, d in sorted(e.items())}, x) for e, x in map(one, texts)]
    assert together(pa.array([texts[0].replace("0.", "1_0.")])) is None and together(pa.array([texts[0].replace(":", ":\t")])) is None
    spaced = together(pa.array([texts[0].replace(":", ": ")]))
    assert found[0] == ({m: d for m, d in zip(spaced[0], spaced[1][:, 0])}, spaced[1][len(spaced[0]) :, 0].tolist())
    weights = np.array([1.0 + k % 3 for k in range(len(texts))])
    own = pa.table([pa.array(weights), *(pa.array(c, k) for c, k in zip(([list(e) for e, _ in found], [list(e.values()) for e, _ in found], [x for _, x in found]), (pa.list_(pa.int64()), *[pa.list_(pa.float64())] * 2)))], tree_means.PREPARED_COLUMNS)
    lengths[-1] = 2.5  # shared by all, not by the second place
    own = own.set_column(3, "leaves", pa.array([x[len(masks) :].tolist() for x in lengths.T]))
    packed = tree_means._packed_row(masks, lengths, weights)
    assert packed.column("shared")[0].as_py()[-1] == 2.5
    apart = tree_means._apart_row(own.combine_chunks().to_batches()[0])
    leaves = found[0][1][:-1]
    for place in (None, (found[0][0], [*leaves, 2.5]), (found[1][0], [*leaves, 1.0])):
        for most in (30, 1):
            monkeypatch.setattr(tree_means.tree_arrays, "MOST_EDGES", most)
            plain = list(tree_means._pulled(own, place, 0.7))
            for rows in (packed, apart):
                got = list(tree_means._pulled_packed(rows, place, 0.7))
                assert len(got) == len(plain)
                for (p, *a), (q, *b) in zip(got, plain):
                    assert p[0] == pytest.approx(q[0]) and p[1] == pytest.approx(q[1]) and a == pytest.approx(b)


def test_median_reads_texts_side_by_side(spark):
    rng = random.Random(9)
    shapes = [trees.to_newick(random_tree(rng)) for _ in range(2)]
    rows = [(k, t.replace("0.", f"{k % 5}.")) for k in range(200) for t in shapes]
    table = spark.createDataFrame(rows, "tree long, newick string")
    packed = tree_means._packed(table, NAMES).collect()
    assert len(packed) <= 4 * spark.sparkContext.defaultParallelism and all(r["apart"] is None for r in packed)
    assert sum(len(r["weights"]) // 8 for r in packed) == 400
