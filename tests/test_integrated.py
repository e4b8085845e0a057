"""Marginals without a closed form against exact cases, and the histogram of entropies."""

import itertools
import math

import numpy as np

from cladewise.operators import integrated as i


def test_lgamma():
    x = np.array([1e-3, 0.2, 1.0, 2.0, 7.5, 300.0])
    assert np.allclose(i.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)


def test_probabilities_of_all_texts_sum_to_one():
    for evaluate in (i.gamma_prior(3, 5.0, 0.2, 4000, 1), i.entropy_prior(3, 2.0, 5.0, 4000, 1)):
        total = sum(math.exp(evaluate(np.bincount(t, minlength=3).astype(float))) for t in itertools.product(range(3), repeat=4))
        assert math.isclose(total, 1.0, rel_tol=1e-9)
        assert abs(evaluate(np.array([1.0, 0, 0])) - math.log(1 / 3)) < 0.05


def test_narrow_prior_is_a_dirichlet_multinomial():
    evaluate, counts = i.gamma_prior(3, 1e6, 2e-6, 200, 1), np.array([3.0, 1.0, 0.0])
    want = sum(math.lgamma(c + 2) - math.lgamma(2) for c in counts) + math.lgamma(6) - math.lgamma(10)
    assert abs(evaluate(counts) - want) < 1e-2


def test_low_entropies_favour_one_letter():
    low, high = i.entropy_prior(4, 1.0, 20.0, 4000, 1), i.entropy_prior(4, 20.0, 1.0, 4000, 1)
    one, even = np.array([8.0, 0, 0, 0]), np.array([2.0, 2, 2, 2])
    assert low(one) > high(one) + 2 and high(even) > low(even) + 2


def test_marginals_of_rows(spark):
    rows = [(1, 3, 0, 1), (2, 0, 1, 3), (3, 0, 0, 0), (4, None, 1, 2), (1, 3, 0, 1)]
    df = spark.createDataFrame(rows, "id int, a int, b int, c int")
    got = i.marginals(df, ["a", "b", "c"], lambda: i.gamma_prior(3, 5.0, 0.2, 500, 1)).collect()
    by = {r["id"]: r["logml"] for r in got}
    assert len(got) == 5 and by[1] == by[2] and abs(by[3]) < 1e-9 and by[4] is None
    assert math.isclose(by[1], i.gamma_prior(3, 5.0, 0.2, 500, 1)(np.array([0.0, 1.0, 3.0])), rel_tol=1e-9)


def test_histogram_of_entropies(spark):
    rows = i.entropy_histogram(spark, 3, 12_500, 20, 4).collect()
    assert sum(r["n"] for r in rows) == 12_500 and math.isclose(sum(r["pdf"] for r in rows) / 20, 1.0)
    mean = sum((r["bin"] + 0.5) / 20 * r["n"] for r in rows) / 12_500
    assert abs(mean - (1 / 2 + 1 / 3) / math.log(3)) < 0.01  # the mean entropy of even draws is a difference of harmonic numbers
