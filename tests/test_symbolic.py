"""Reduced terms of trees expand to the polynomials that are carried up the tree."""

import random

import pytest

from cladewise.operators import symbolic, trees

TAXA = ["a", "b", "c", "d", "e", "f"]


def random_tree(rng, names):
    parts = [f"{n}:{rng.uniform(0, 2):.3f}" for n in names]
    while len(parts) > 3:
        rng.shuffle(parts)
        x, y = parts.pop(), parts.pop()
        parts.append(f"({x},{y}):{rng.uniform(0, 1.5):.3f}")
    inner = [p for p in parts if p.startswith("(")]
    return "(" + ",".join(inner + [p for p in parts if not p.startswith("(")]) + ");"


def test_known_terms():
    root = trees.parse_newick("((n4:1,n5:2):0.5,n3:1);")
    terms = symbolic.reduced_terms(root, ["n3", "n4", "n5"])
    assert {tuple(sorted(t)): round(x, 6) for t, x in terms.items()} == {(7,): 0.606531, (1, 6): 0.393469}
    # both mutate, or one of them or none does and the letter is the origin's
    assert symbolic.set_factor((1, 1), (0.25, 0.5), 3) == pytest.approx({(0, 2, 0): 0.25 * 0.5 + 0.75 * 0.5 + 0.25 * 0.5, (0, 1, 0): 0.75 * 0.5})
    assert symbolic.set_factor((1, -1), (0.25, 0.5), 3) == pytest.approx({(0, 1, 0): 1.0})


def test_expansions_equal_the_carried_polynomials(spark):
    rng = random.Random(8)
    for n in (2, 3, 4, 5, 6):
        for _ in range(4):
            taxa = TAXA[:n]
            text = random_tree(rng, taxa)
            root = trees.parse_newick(text)
            assert sum(symbolic.reduced_terms(root, taxa).values()) == pytest.approx(1)
            columns = [[rng.randrange(-1, 4) for _ in taxa] for _ in range(6)]
            for codes in columns:
                chance = {x.name: 1 - 2.718281828459045 ** -x.d for x in trees.leaves(root)}
                parts = [symbolic._times(symbolic._product([symbolic.set_factor(tuple(codes[k] for k in range(n) if s >> k & 1), tuple(chance[taxa[k]] for k in range(n) if s >> k & 1), 4) for s in t], (0,) * 4), {(0,) * 4: 1.0}, w) for t, w in symbolic.reduced_terms(root, taxa).items()]
                got, want = symbolic._add(*parts), trees.column_polynomial(root, dict(zip(taxa, codes)), 4)
                assert {e: c for e, c in got.items() if abs(c) > 1e-12} == pytest.approx({e: c for e, c in want.items() if abs(c) > 1e-12})
    table = spark.createDataFrame([(c, 3) for c in columns] + [([-1] * 6, 1)], "codes array<int>, n long")
    rows = symbolic.expanded_columns(table, text, taxa, 4).collect()
    for codes in [*columns, [-1] * 6]:
        got = {tuple(r["exponents"]): r["coefficient"] for r in rows if r["codes"] == codes}
        want = trees.column_polynomial(root, dict(zip(taxa, codes)), 4)
        assert {e: c for e, c in got.items() if abs(c) > 1e-12} == pytest.approx({e: c for e, c in want.items() if abs(c) > 1e-12})
    terms = symbolic.term_table(spark, text, taxa).collect()
    assert sum(r["weight"] for r in terms) == pytest.approx(1) and all(sum(r["sets"]) == 63 for r in terms)
    assert symbolic.expanded_columns(table.limit(0), text, taxa, 4).count() == 0
