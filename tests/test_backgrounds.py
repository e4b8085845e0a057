"""Fitted background models: gradients against differences, planted pseudocounts, rising probabilities, empty tables and nulls."""

import math

import numpy as np
import pytest

from cladewise.operators import backgrounds as bg

COLUMNS = ["c0", "c1", "c2"]
SCHEMA = "c0 long, c1 long, c2 long"


def drawn(seed, alphas, sizes, depth=30):
    rng = np.random.default_rng(seed)
    return [tuple(map(int, rng.multinomial(depth, rng.dirichlet(a)))) for a, n in zip(alphas, sizes) for _ in range(n)]


def log_posterior(rows, owner, alpha, shape, scale):
    mbeta = lambda x: sum(map(math.lgamma, x)) - math.lgamma(sum(x))
    like = sum(mbeta(np.array(r) + alpha[k]) - mbeta(alpha[k]) for r, k in zip(rows, owner))
    return like + float(((shape - 1) * np.log(alpha) - alpha / scale).sum())


@pytest.mark.parametrize("few", [200_000, 0])
def test_gradient_equals_differences(spark, monkeypatch, few):
    """On the driver, and by one job a gradient."""
    monkeypatch.setattr(bg, "FEW_STATISTICS", few)
    rows = drawn(1, [[2, 2, 2], [9, 1, 1]], [40, 40])
    alpha, w = np.array([[1.0, 1.5, 2.0], [4.0, 0.5, 0.7]]), np.array([0.6, 0.4])
    assigned = bg.assignments(bg.count_patterns(spark.createDataFrame(rows, SCHEMA), COLUMNS), COLUMNS, alpha, w)
    owner = {(r["c0"], r["c1"], r["c2"]): r["component"] for r in assigned.collect()}
    owners = [owner[r] for r in rows]
    score = lambda r, k: log_posterior([r], [k], alpha, 1.0, math.inf) + math.log(w[k])
    assert owners == [max((0, 1), key=lambda k: score(r, k)) for r in rows] and len(set(owners)) == 2
    gradient, sums = bg.pseudocount_gradient(bg.value_statistics(assigned, COLUMNS), alpha.shape, 2.0, 3.0)
    got = gradient(alpha)
    assert sums["n"].tolist() == [owners.count(0), owners.count(1)]
    for k, j in np.ndindex(*alpha.shape):
        up, down = alpha.copy(), alpha.copy()
        up[k, j] += 1e-5
        down[k, j] -= 1e-5
        want = (log_posterior(rows, owners, up, 2.0, 3.0) - log_posterior(rows, owners, down, 2.0, 3.0)) / 2e-5
        assert got[k, j] == pytest.approx(want, rel=1e-5, abs=1e-4)


def test_planted_pseudocounts_are_found(spark):
    planted = np.array([[2.0, 2.0, 2.0], [20.0, 2.0, 1.0]])
    rows = drawn(2, planted, [3000, 3000], depth=60)
    fit, trace = bg.fit_pseudocounts(spark.createDataFrame(rows, SCHEMA), COLUMNS, [[1, 1, 1], [5, 1, 1]], [0.5, 0.5], shape=1.0, scale=100.0)
    alpha = np.zeros((2, 3))
    for r in fit.collect():
        alpha[r["component"], r["coordinate"]] = r["alpha"]
    # hard assignments sharpen both components a little, the shares keep
    assert np.allclose(alpha / alpha.sum(1, keepdims=True), planted / planted.sum(1, keepdims=True), atol=0.05)
    assert np.all(alpha / planted > 0.7) and np.all(alpha / planted < 1.6)
    steps = [r["log_likelihood"] for r in trace.orderBy("round").collect()]
    assert len(steps) > 1 and all(b >= a - 0.1 for a, b in zip(steps, steps[1:]))
    assert trace.orderBy("round").collect()[-1]["changed"] == 0


def test_mixture_rises_until_it_stands(spark):
    rows = drawn(3, [[6, 4, 3], [3, 6, 4], [4, 3, 6]], [300, 200, 100], depth=9) + [(0, 0, 0)] * 5
    alpha, w = [[3.0, 1.0, 1.0], [1.0, 1.0, 1.2], [1.0, 1.05, 1.0]], [0.4, 0.35, 0.25]
    found, trace = bg.fit_mixture(spark.createDataFrame(rows, SCHEMA), COLUMNS, alpha, w)
    got = {r["component"]: r for r in found.collect()}
    steps = trace.orderBy("round").collect()
    assert steps[-1]["changed"] == 0 and len(steps) > 2
    assert all(b["log_likelihood"] >= a["log_likelihood"] - 1e-9 for a, b in zip(steps, steps[1:]))
    assert sum(r["sites"] for r in got.values()) == len(rows)
    # where it stands, the result is that of a plain loop
    table, a, weights = np.array(rows), np.array(alpha), np.array(w)
    totals, owner = a.copy(), None
    while True:
        logs = np.array([[bg.digamma(x) - bg.digamma(t.sum()) for x in t] for t in totals])
        new = (table @ logs.T + np.log(weights)).argmax(1)
        if owner is not None and (new == owner).all():
            break
        owner = new
        totals = a + np.array([table[owner == k].sum(0) for k in range(3)])
    assert [[got[k][c] for c in COLUMNS] for k in range(3)] == (totals - a).tolist()
    three, _ = bg.fit_mixture(spark.createDataFrame(rows, SCHEMA), COLUMNS, alpha, w, rounds=1)
    assert sum(r["sites"] for r in three.collect()) == len(rows)


def test_empty_tables_and_nulls(spark):
    empty = spark.createDataFrame([], SCHEMA)
    fit, trace = bg.fit_pseudocounts(empty, COLUMNS, [[1, 1, 1]], [1.0], shape=3.0, scale=2.0)
    assert all(r["alpha"] == pytest.approx(4.0, abs=0.2) and r["sites"] == 0 for r in fit.collect())
    found, _ = bg.fit_mixture(empty, COLUMNS, [[1, 1, 1], [2, 1, 1]], [0.5, 0.5])
    assert [r["sites"] for r in found.collect()] == [0, 0]
    odd = spark.createDataFrame([(1, None, 2), (1, 0, 2), (1, 0, 2)], SCHEMA)
    found, _ = bg.fit_mixture(odd, COLUMNS, [[1, 1, 1], [2, 1, 1]], [0.5, 0.5])
    assert sum(r["sites"] for r in found.collect()) == 2
