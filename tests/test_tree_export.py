"""Trees from their edges, numbers of leaves, term counts against the published ones, and lengths that a text would round."""

import math
import random

import pytest

from cladewise.functions import signed_log
from cladewise.operators import motifs, tree_sampler, trees
from pyspark.sql import functions as F

NAMES = ["a", "b", "c", "d", "e"]


def test_tree_of_its_own_splits():
    for text in ("(((b:1,c:2):3,d:4):5,e:6,a:7);", "((b:1,c:2):3,(d:4,e:5):6,a:7);", "(b:1,c:2,d:3,e:4,a:5);"):
        edges, lengths = trees.splits_of(trees.parse_newick(text), NAMES)
        again = trees.to_newick(trees.tree_of_splits(edges, lengths, NAMES))
        assert trees.splits_of(trees.parse_newick(again), NAMES) == (edges, lengths)
        assert again.endswith(f",a:{lengths[0]:.6f});")
    with pytest.raises(ValueError):
        trees.tree_of_splits({0b00110: 1.0, 0b01100: 1.0}, [1.0] * 5, NAMES)


def test_newick_of_rows_of_edges(spark):
    rows = [(1, "split", 0b00110, 2.0), (1, "leaf", 1, 0.5), (1, "leaf", 0, 0.25), (2, "leaf", 3, 1.0)]
    got = {r["tree"]: r["newick"] for r in trees.newick_of_splits(spark.createDataFrame(rows, "tree int, kind string, mask long, d double"), NAMES).collect()}
    assert got[1] == "((b:0.500000,c:0.000000):2.000000,d:0.000000,e:0.000000,a:0.250000);"
    assert got[2].startswith("(b:0.000000,c:0.000000,d:1.000000")


def test_edges_of_length_zero_are_left_out():
    assert trees.to_newick(trees.parse_newick("(((b:1,c:2):0,d:4):5,a:7);")) == "((b:1.000000,c:2.000000,d:4.000000):5.000000,a:7.000000);"


def test_leaves_by_name():
    root = trees.parse_newick("((b:1,c:2)x:3,a:7);")
    assert trees.leaf_numbers(root, ["a", "b", "c"]) == {"b": 1, "c": 2, "a": 0}
    assert trees.find(root, "x").d == 3 and trees.find(root, "none") is None
    for other in (["a", "b"], ["a", "b", "c", "d"], ["a", "b", "x"]):
        with pytest.raises(ValueError):
            trees.leaf_numbers(root, other)


def test_term_counts_are_the_published_ones(spark):
    closed = {r["x"]: r["terms"] for r in trees.expected_terms(spark, [1, 2, 3, 5, 10], 1000).collect()}
    for x, want in {1: 1.241, 3: 1.698, 5: 2.328, 9: 4.268, 19: 17.17}.items():
        assert abs(closed[x] - want) < 0.1 * want
    pruned = {r["x"]: r["terms"] for r in trees.expected_terms(spark, [1, 2, 3], 300, prune=True).collect()}
    for x, want in {1: 5.249, 3: 16.42, 5: 40.419}.items():
        assert abs(pruned[x] - want) < 0.05 * want


def test_pruning_gives_the_same_polynomial():
    rng = random.Random(5)
    tree = trees.parse_newick("((x:0.3,y:0.1):0.2,(z:0.5,w:0.2):0.4,v:0.6);")
    for _ in range(5):
        codes, theta = {n: rng.randrange(4) for n in "xyzwv"}, [0.1, 0.2, 0.3, 0.4]
        one, two = trees.column_polynomial(tree, codes, 4), trees.pruned_polynomial(tree, codes, 4)
        assert math.isclose(trees.value_at(one, theta), trees.value_at(two, theta), rel_tol=1e-12)


def test_posterior_density_integrates_to_one():
    poly = trees.column_polynomial(trees.parse_newick("(x:0.3,y:0.1);"), {"x": 0, "y": 1}, 2)
    n = 2000
    total = sum(math.exp(trees.log_posterior_density(poly, [1.5, 2.0], [(k + 0.5) / n, 1 - (k + 0.5) / n])) for k in range(n)) / n
    assert abs(total - 1) < 1e-3


def test_posteriors_see_lengths_below_six_decimals(spark):
    patterns = spark.createDataFrame([([0, 1, 2], 2)], "codes array<int>, n int")
    roots = [trees.parse_newick(f"((x:{d},y:0.1):{d},z:0.2);") for d in (1e-8, 3e-7)]
    got = tree_sampler.log_posteriors(patterns, roots, ["x", "y", "z"], [1.0] * 4, 2.0, 0.1)
    for root, value in zip(roots, got):
        want = 2 * trees.log_marginal(trees.column_polynomial(root, {"x": 0, "y": 1, "z": 2}, 4), [1.0] * 4) + tree_sampler.log_prior(root, 2.0, 0.1)
        assert math.isclose(value, want, rel_tol=1e-12)


def test_signed_logs_of_huge_numbers(spark):
    pairs = [(1, 800.0, -1, 790.0), (-1, 5.0, -1, 6.0), (1, 3.0, -1, 3.0), (0, None, -1, 2.0)]
    rows = spark.createDataFrame([((a, b), (c, d)) for a, b, c, d in pairs], "a struct<sign:int,log:double>, b struct<sign:int,log:double>")
    got = [r[0] for r in rows.select(signed_log.add(F.col("a"), F.col("b"))).collect()]
    assert got[0]["sign"] == 1 and math.isclose(got[0]["log"], 800 + math.log1p(-math.exp(-10)))
    assert got[1]["sign"] == -1 and math.isclose(got[1]["log"], 6 + math.log1p(math.exp(-1)))
    assert tuple(got[2]) == (0, None) and tuple(got[3]) == (-1, 2.0)


def test_valid_starts(spark):
    starts, candidates = [(1, 5), (1, 9), (2, 5)], [(s, p) for s in (1, 2, 3) for p in range(12)]
    table = lambda rows: spark.createDataFrame(rows, "seq long, pos long")
    got = {(r["seq"], r["pos"]): r["valid"] for r in motifs.valid_starts(table(candidates), table(starts), "seq", "pos", 3).collect()}
    assert got == {(s, p): not any(t == s and p < q < p + 3 for t, q in starts) for s, p in candidates}
