"""Codons of whole arrays, and tasks that grow with the table."""

import pyarrow as pa

from cladewise.functions import alphabet
from cladewise.plans import model_queries

TABLE = {a + b + c: alphabet.CODON_ACIDS[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def test_codons_of_an_array():
    texts = ["", "AC", "ATGNNA", None, "ttttaaGGGC", "AÄGATG", "ATG" * 50]
    plain = lambda t: None if t is None else "".join(TABLE.get(t[i : i + 3].upper(), "X") for i in range(0, len(t) - 2, 3))
    for own in (pa.array(texts), pa.array(["x", *texts]).slice(1), pa.array([], pa.string())):
        assert alphabet.translated(own).to_pylist() == [plain(t) for t in own.to_pylist()]


def test_tasks_of_the_cone_queries_grow_with_the_table(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k // 3, k % 3, 1.0 + k) for k in range(300)], "l_orderkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(model_queries, "CONE_ROWS", 5)
    for query, rows in ((model_queries.cone_path_length, 99), (model_queries.cone_path_point, 297), (model_queries.cover_weights, 0)):
        found = query(spark, str(tmp_path))
        assert "hashpartitioning(pair" in (plan := found._jdf.queryExecution().toString()) and ", 60)" in plan
        assert found.count() == rows


def test_chains_read_their_columns_once(spark, monkeypatch):
    """Columns that differ in the letters' names alone are one evaluation, also under unequal prior weights."""
    import pytest

    from cladewise.operators import tree_gradients, tree_sampler, trees

    taxa, alpha = ["x", "y", "z"], [0.3, 0.5, 0.2, 1.0]
    columns = {(0, 1, 1): 3, (2, 0, 0): 1, (3, 2, 2): 2, (1, 1, 1): 5, (-1, 2, 0): 2, (3, -1, 1): 1}
    p = spark.createDataFrame([(list(c), n) for c, n in columns.items()], "codes array<int>, n long")
    assert tree_gradients.alike_columns(p).count() == 4
    root = trees.parse_newick("((x:0.2,y:0.1):0.3,z:0.4);")
    want = sum(n * trees.log_marginal(trees.column_polynomial(root, dict(zip(taxa, c)), 4), alpha) for c, n in columns.items()) + tree_sampler.log_prior(root, 1.0, 0.1)
    assert tree_sampler.log_posteriors(p, [root], taxa, alpha, 1.0, 0.1) == [pytest.approx(want)]
    stored, calls = tree_gradients._stored, []
    monkeypatch.setattr(tree_gradients, "_stored", lambda x: calls.append(1) or stored(x))
    assert tree_sampler.metropolis_hastings(p, "((x:0.2,y:0.1):0.3,z:0.4);", taxa, alpha, 2, [1.0]).count() == 2
    assert calls == [1]


def test_points_are_assigned_in_batches(spark):
    """No function over an array of components, which Spark would interpret point by point."""
    import numpy as np

    from cladewise.operators import dirichlet_process as dp

    points = spark.createDataFrame([(k, k % 2 * 50.0, 0.0) for k in range(20)] + [(99, None, 1.0)], "i long, x double, y double")
    state = dp.State(np.array([0.5, 0.0, 0.5]), np.array([[0.0, 0.0], [25.0, 0.0], [50.0, 0.0]]))
    found = dp.assigned(points, state, dp.Model(), 1)
    assert "transform(" not in found._jdf.queryExecution().toString()
    assert sorted((r["i"], r["cluster"]) for r in found.collect()) == [(k, k % 2 * 2) for k in range(20)]


def test_alike_columns_are_evaluated_once(spark, monkeypatch):
    import itertools

    import pyarrow as pa
    import pytest

    from cladewise.operators import trees

    taxa, text = ["x", "y", "z"], "((x:0.2,y:0.1):0.3,z:0.4);"
    columns = list(itertools.product(range(-1, 3), repeat=3))
    for alpha, most in (([0.5] * 3, 15), ([0.5, 0.2, 0.2], 64)):
        captured = []

        class Table:
            select = lambda self, *a: self
            mapInArrow = lambda self, f, schema: captured.append(f)

        trees.pattern_likelihoods(Table(), text, taxa, alpha)
        calls, plain = [], trees.column_polynomial
        monkeypatch.setattr(trees, "column_polynomial", lambda *a: calls.append(1) or plain(*a))
        (found,) = captured[0](iter([pa.RecordBatch.from_arrays([pa.array([list(c) for c in columns]), pa.array([1] * 64)], ["codes", "n"])]))
        monkeypatch.setattr(trees, "column_polynomial", plain)
        assert len(calls) <= most
        for c, r in zip(columns, found.to_pylist()):
            poly = plain(trees.parse_newick(text), dict(zip(taxa, c)), 3)
            assert r["logml"] == pytest.approx(trees.log_marginal(poly, alpha)) and r["expectation"] == pytest.approx(trees.expectation(poly, alpha)) and r["n_terms"] == len(poly)
