"""Golden polynomials and marginals, and axioms of tree space."""

import math

import pytest

from cladewise.operators import trees

N = trees.parse_newick


@pytest.mark.parametrize(
    "tree,codes,want,logml",
    [
        ("(n2:1,n3:2);", {"n2": 1, "n3": 2}, {(0, 1, 1, 0): 0.950213}, -3.0468),
        ("(n2:1,n3:2);", {"n2": 1, "n3": 1}, {(0, 2, 0, 0): 0.950213, (0, 1, 0, 0): 0.0497871}, -2.23056),
        ("((n4:1,n5:2):0.5,n3:1);", {"n4": 1, "n5": 1, "n3": 2}, {(0, 1, 1, 0): 0.0386781, (0, 2, 1, 0): 0.860149 + 0.0}, None),
        ("(n2:0.2,n3:0.1,n0:0.3);", {"n2": 1, "n3": 1, "n0": 2}, {(0, 1, 1, 0): 0.192007, (0, 2, 1, 0): 0.0799543}, None),
    ],
)
def test_golden(tree, codes, want, logml):
    poly = trees.column_polynomial(N(tree), codes, 4)
    for e, c in want.items():
        assert math.isclose(poly[e], c, rel_tol=2e-5)
    if logml is not None:
        assert math.isclose(trees.log_marginal(poly, [1.0] * 4), logml, rel_tol=1e-5)


def test_probabilities_of_all_columns_sum_to_one():
    theta = [0.1, 0.2, 0.3, 0.4]
    total = 0.0
    for k in range(64):
        codes = {"x": k % 4, "y": k // 4 % 4, "z": k // 16}
        poly = trees.column_polynomial(N("((x:0.3,y:0.5):0.2,z:0.7);"), codes, 4)
        total += sum(c * math.prod(t**e for t, e in zip(theta, es)) for es, c in poly.items())
    assert math.isclose(total, 1.0, rel_tol=1e-12)


def test_distances():
    names = ["a", "b", "c", "d", "e"]
    one, two = N("(((b:1,c:1):3,d:1):4,e:1,a:1);"), N("(((b:1,d:1):6,c:1):8,e:1,a:1);")
    assert trees.geodesic_length(one, one, names) == 0
    assert math.isclose(trees.geodesic_length(one, two, names), math.hypot(3 + 6, 8 - 4))
    assert math.isclose(trees.geodesic_length(two, one, names), trees.geodesic_length(one, two, names))
    other = N("(((b:1,e:1):1,c:1):1,d:1,a:1);")
    d = lambda x, y: trees.geodesic_length(x, y, names)
    assert d(one, other) <= d(one, two) + d(two, other) + 1e-12
    assert trees.to_newick(N("((x:1,y:2):0.5,z:1);")) == "((x:1.000000,y:2.000000):0.500000,z:1.000000);"
