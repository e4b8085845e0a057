"""Divergences by stratified sampling against closed forms and a long plain average."""

import math

import numpy as np
import pytest

from cladewise.operators import divergence as dv
from cladewise.operators import trees
from cladewise.operators.backgrounds import digamma

ALPHA = [1.0, 1.5, 2.0]


def target(key, xi, poly):
    return key, xi, [list(e) for e in poly], list(poly.values()), trees.log_marginal(poly, ALPHA)


def closed(xi, eta):
    """Divergence of one Dirichlet distribution from another."""
    xi, eta = np.array(xi), np.array(eta)
    return dv._dirichlet_log(xi) - dv._dirichlet_log(eta) + float(((xi - eta) * (digamma(xi) - digamma(xi.sum()))).sum())


def test_simplex_is_covered_evenly():
    theta = dv.on_simplex(np.random.default_rng(1).random((200_000, 3)))
    assert np.allclose(theta.sum(1), 1) and np.allclose(theta.mean(0), 0.25, atol=0.002)
    assert np.allclose(theta.var(0), 3 / 80, atol=0.001)


def test_one_term_has_the_closed_form_within_the_error(spark):
    rows = [target(k, xi, {e: 0.3}) for k, (xi, e) in enumerate([([3.0, 2.5, 4.0], (2, 1, 3)), ([2.0, 2.0, 2.0], (1, 0, 0)), ([5.0, 1.5, 2.0], (4, 0, 0))])]
    table = spark.createDataFrame(rows, dv.TARGET)
    got = {r["key"]: r for r in dv.divergences(table, ALPHA, 60_000).collect()}
    plain = {}
    for k, xi, e, _, _ in rows:
        want = closed(xi, np.array(ALPHA) + np.array(e[0]))
        assert abs(got[k]["divergence"] - want) < 4.5 * got[k]["error"] + 1e-12 and got[k]["error"] < 0.01
        t = dv.Target(*rows[k][1:], ALPHA)
        plain[k] = t(np.random.default_rng(k).random((60_000, 2))).std() / math.sqrt(60_000)
        # strata are worth four times as many plain calls at least; where both distributions are the same there is no error
        assert got[k]["error"] < 0.5 * plain[k]
    again = {r["key"]: r["divergence"] for r in dv.divergences(table, ALPHA, 60_000).collect()}
    assert again == {k: r["divergence"] for k, r in got.items()}
    assert dv.divergences(table.limit(0), ALPHA, 1000, 2).count() == 0


def test_mixture_and_best_scale(spark):
    poly = {(3, 0, 1): 0.5, (1, 2, 1): 0.25, (0, 0, 4): 0.1}
    xi = [4.0, 2.0, 4.0]
    table = spark.createDataFrame([target(7, xi, poly)], dv.TARGET)
    r = dv.divergences(table, ALPHA, 80_000).first()
    draws = np.random.default_rng(3).dirichlet(xi, 400_000)
    logs = np.log(draws)
    p = np.log(sum(c * np.exp(logs @ np.array(e)) for e, c in poly.items())) + logs @ (np.array(ALPHA) - 1) + dv._dirichlet_log(np.array(ALPHA)) - trees.log_marginal(poly, ALPHA)
    q = logs @ (np.array(xi) - 1) + dv._dirichlet_log(np.array(xi))
    want, error = (q - p).mean(), (q - p).std() / math.sqrt(len(p))
    assert abs(r["divergence"] - want) < 4.5 * (r["error"] + error)
    far = spark.createDataFrame([target(7, [1.3 * x for x in xi], poly)], dv.TARGET)
    found = dv.scale_search(far, ALPHA, steps=8, calls=10_000, levels=3, first=0.1).first()
    start = dv.divergences(far, ALPHA, 10_000, 3).first()["divergence"]
    assert found["divergence"] < start and found["scale"] < 1.0
    assert found["divergence"] == pytest.approx(dv.divergences(spark.createDataFrame([target(7, [found["scale"] * 1.3 * x for x in xi], poly)], dv.TARGET), ALPHA, 10_000, 3).first()["divergence"], abs=1e-9)


def test_columns_are_dealt_and_take_no_job_a_level(spark):
    """No table is written on the way, columns of few bytes go to all tasks, and they are fitted side by side as one at a time."""
    from cladewise.operators import variational
    from cladewise.plans.likelihood_queries import TAXA, TREE
    from cladewise.plans.likelihood_queries import ALPHA as PRIOR

    rng = np.random.default_rng(4)
    columns = sorted({tuple(int(x) for x in rng.integers(-1, 5, 8)) for _ in range(120)})
    table = spark.createDataFrame([(list(c), 1) for c in columns], "codes array<int>, n long").groupBy("codes").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    fit = variational.pattern_approximations(table, TREE, TAXA, PRIOR)
    assert fit.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    root = trees.parse_newick(TREE)
    for r in fit.collect():
        poly = trees.column_polynomial(root, dict(zip(TAXA, r["codes"])), len(PRIOR))
        assert r["xi"] == pytest.approx(variational.closest_dirichlet(variational.expected_logs(poly, PRIOR)), rel=1e-9)
    rows = [target(k, [3.0, 2.5, 4.0], {(2, 1, 3): 0.3, (1, 1, k): 0.2}) for k in range(40)]
    got = {r["key"]: r["divergence"] for r in dv.divergences(spark.createDataFrame(rows, dv.TARGET), ALPHA, 2000, 3).collect()}
    alone = dv.divergences(spark.createDataFrame(rows[7:8], dv.TARGET), ALPHA, 2000, 3)
    assert "divergence-" not in alone._jdf.queryExecution().toString() and alone.first()["divergence"] == pytest.approx(got[7], rel=1e-12)


def test_halves_have_the_spread_of_plain_standard_deviations():
    rng = np.random.default_rng(5)
    for _ in range(20):
        low, high = np.array([0.0, 0.25, 0.5]), np.array([1.0, 0.5, 1.0])
        u = low + (high - low) * rng.random((50, 3))
        values = np.exp(3 * u[:, int(rng.integers(3))]) * rng.random(50)
        want = (math.inf, 0, 0.5)
        for side in range(3):
            left = u[:, side] < (low[side] + high[side]) / 2
            spread = [float(values[m].std()) ** (2 / 3) for m in (left, ~left)]
            want = min(want, (sum(spread), side, spread[0] / sum(spread)))
        assert dv.best_cut(u, values, low, high) == (want[1], pytest.approx(min(0.9, max(0.1, want[2]))))
    assert dv.best_cut(u, np.zeros(50), low, high) == (0, 0.5)
