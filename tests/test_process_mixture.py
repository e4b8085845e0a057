"""The blocked sampler of a process mixture on planted clusters, and options from INI texts."""

import numpy as np
import pytest

from cladewise.operators import dirichlet_process as dp
from cladewise.operators import simulation
from cladewise.sources import options as opt


def test_planted_clusters_are_found(spark):
    centres = [(0.0, 0.0), (6.0, 1.0), (-4.0, 5.0)]
    points = simulation.gaussian_mixture(spark, 900, centres, [0.5, 0.3, 0.2], 0.5, 4).cache()
    model = dp.Model(alpha=0.5, sigma=((0.25, 0.0), (0.0, 0.25)))
    trace, state = dp.sample(points, model, 25, 2)
    rows = trace.orderBy("step").collect()
    assert rows[-1]["likelihood"] > rows[0]["likelihood"] and rows[-1]["likelihood"] > -2.2 * 900
    got = dp.assigned(points, state, model, 2).join(points.select("i", points["cluster"].alias("true")), "i").toPandas()
    assert len(got) == 900
    for k, centre in enumerate(centres):
        own = got[got["true"] == k]
        main = own["cluster"].mode()[0]
        assert (own["cluster"] == main).mean() > 0.9 and (got[got["cluster"] == main]["true"] == k).mean() > 0.99
        assert np.allclose(state.means[main], centre, atol=0.2)


def test_density_and_empty_tables(spark):
    from pyspark.sql import functions as F

    sigma = ((2.0, 0.5), (0.5, 1.0))
    got = spark.range(1).select(dp.log_density(F.lit(1.0), F.lit(2.0), F.lit(0.0), F.lit(0.5), sigma)).first()[0]
    d = np.array([1.0, 1.5])
    assert np.isclose(got, -0.5 * d @ np.linalg.inv(sigma) @ d - np.log(2 * np.pi) - 0.5 * np.log(np.linalg.det(sigma)))
    none = spark.createDataFrame([(1, None, 2.0)], "i long, x double, y double")
    assert [r["clusters"] for r in dp.sample(none, dp.Model(), 2)[0].collect()] == [0, 0]


def test_components_have_no_bound():
    """Sixty clusters keep their points; the sticks go on behind them until next to nothing is left."""
    state = dp._drawn({k: (10, 10.0 * k, 0.0) for k in range(60)}, dp.Model(alpha=2.0), np.random.default_rng(0), 1)
    assert len(state.weights) > 60 and abs(state.weights.sum() - 1) < 1e-12 and (state.weights[:60] > 0).all()
    assert np.allclose(state.means[:60, 0], range(60), atol=2)


TEXT = """[TFBS-Sampler]
alpha = 1
optimize = yes
samples = 10:20
process-prior = uniform process
background-alpha = 1 1 1 1 5
  2 2 2 2 1
baseline-priors = one two
baseline-weights = 1 3
one = 0.1
  0.1
  0.1
  0.1
  0.2
one_length = 4-16
two = 1 2
  1 2
  1 2
  1 2
  1 2
two_length = 8
"""


def test_options():
    found, baselines = opt.read_options(TEXT)
    assert (found["alpha"], found["optimize"], found["samples"], found["lambda"]) == (1.0, True, (10, 20), 0.01)
    assert found["background-alpha"] == [[1, 1, 1, 1, 5], [2, 2, 2, 2, 1]]
    assert [(x.name, x.lengths, x.weight) for x in baselines] == [("one", (4, 16), 0.25), ("two", (8, 8), 0.75)]
    assert opt.matrix(opt.matrix_text([[1.5, 2], []])) == [[1.5, 2.0], []]


@pytest.mark.parametrize("old,new", [("uniform process", "x"), ("two_length = 8", ""), ("optimize = yes", "optimize = perhaps"), ("1 3", "1"), ("[TFBS-Sampler]", "[x]"), ("10:20", "10")])
def test_wrong_options_are_refused(old, new):
    with pytest.raises(ValueError):
        opt.read_options(TEXT.replace(old, new))
