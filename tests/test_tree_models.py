"""Gradients against differences, chains and ascents on a small alignment, closest distributions and simulated data."""

import math

import numpy as np

from cladewise.operators import simulation, tree_gradients, tree_sampler, trees, variational

TAXA = ["x", "y", "z", "o"]
START = "((x:0.3,y:0.4):0.2,z:0.5,o:0.3);"
ALPHA = [0.5] * 4


def patterns(spark):
    return spark.createDataFrame([([0, 0, 1, 2], 3), ([1, 1, 1, 1], 5), ([0, 1, 2, -1], 2)], "codes array<int>, n int").cache()


def test_gradient_is_the_limit_of_differences(spark):
    p, root = patterns(spark), trees.parse_newick(START)
    value, slope = tree_gradients.posterior_gradient(p, root, TAXA, ALPHA, 2.0, 0.5)
    assert math.isclose(value, tree_sampler.log_posteriors(p, [root], TAXA, ALPHA, 2.0, 0.5)[0], rel_tol=1e-9)
    rows = p.collect()

    def at():
        return tree_sampler.log_prior(root, 2.0, 0.5) + sum(r["n"] * trees.log_marginal(trees.column_polynomial(root, dict(zip(TAXA, r["codes"])), 4), ALPHA) for r in rows)

    for n, s in zip(tree_sampler.nodes(root), slope):
        n.d += 1e-6
        high = at()
        n.d -= 2e-6
        low = at()
        n.d += 1e-6
        assert math.isclose((high - low) / 2e-6, s, rel_tol=1e-4, abs_tol=1e-5)


def test_zero_lengths_have_gradients():
    value, slope = tree_gradients.column_gradient(trees.parse_newick("((x:0,y:0):0.2,z:0.5);"), {"x": 1, "y": 1, "z": 2}, ALPHA)
    assert math.isfinite(value) and all(map(math.isfinite, slope))


def test_ascent_climbs(spark):
    values = [r["posterior"] for r in tree_gradients.gradient_ascent(patterns(spark), START, TAXA, ALPHA, 8, first=0.01).orderBy("step").collect()]
    assert values == sorted(values) and values[-1] > values[0] + 0.1


def test_small_leaps_are_accepted(spark):
    rows = tree_gradients.hamiltonian(patterns(spark), START, TAXA, ALPHA, 6, leaps=2, size=0.002, keep=0.3).collect()
    assert sum(r["accepted"] for r in rows) >= 5 and len({r["newick"] for r in rows}) >= 5


def test_without_columns_only_the_prior_counts(spark):
    none = patterns(spark).where("n < 0")
    root = trees.parse_newick(START)
    value, slope = tree_gradients.posterior_gradient(none, root, TAXA, ALPHA, 1.0, 0.1)
    assert math.isclose(value, tree_sampler.log_prior(root, 1.0, 0.1)) and np.allclose(slope, -10)


def test_closest_dirichlet():
    for xi in ([0.2, 1.0, 3.0, 40.0], [5.0] * 4):
        logs = [variational.digamma(x) - variational.digamma(sum(xi)) for x in xi]
        assert np.allclose(variational.closest_dirichlet(logs), xi, rtol=1e-4)
    assert math.isclose(variational.digamma(1.0), -0.5772156649015329, rel_tol=1e-10)
    assert math.isclose(variational.trigamma(1.0), math.pi**2 / 6, rel_tol=1e-9)
    one = {(2, 1, 0, 0): 0.7}  # a polynomial of one term is a Dirichlet distribution itself
    assert np.allclose(variational.closest_dirichlet(variational.expected_logs(one, ALPHA)), [2.5, 1.5, 0.5, 0.5], rtol=1e-4)


def test_simulated_columns_follow_the_model(spark):
    tree, alpha = "(x:0.4,y:0.3);", [1.0, 2.0, 1.0]
    columns = [tuple(r["codes"]) for r in simulation.simulate_columns(spark, 4000, tree, ["x", "y"], alpha, 7).collect()]
    root = trees.parse_newick(tree)
    for codes in ((0, 0), (1, 1), (0, 1)):
        p = math.exp(trees.log_marginal(trees.column_polynomial(root, dict(zip("xy", codes)), 3), alpha))
        assert abs(columns.count(codes) / 4000 - p) < 4 * math.sqrt(p * (1 - p) / 4000)
    again = simulation.simulate_columns(spark.newSession(), 10, tree, ["x", "y"], alpha, 7).orderBy("pos").collect()
    assert [tuple(r["codes"]) for r in again] == columns[:10]


def test_mixture_points(spark):
    got = simulation.gaussian_mixture(spark, 6000, [(0.0, 0.0), (10.0, -5.0)], [3.0, 1.0], 0.5, 3).toPandas()
    share = (got["cluster"] == 1).mean()
    assert abs(share - 0.25) < 0.03
    far = got[got["cluster"] == 1]
    assert abs(far["x"].mean() - 10) < 0.1 and abs(far["y"].mean() + 5) < 0.1 and abs(far["x"].std() - 0.5) < 0.05
