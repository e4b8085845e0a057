"""Refinement of partitions against distances that are recomputed pair by pair."""

import itertools
import random

from cladewise.operators import refinement


def pairs_apart(a, b):
    return sum((a[x] == a[y]) != (b[x] == b[y]) for x, y in itertools.combinations(sorted(a), 2))


def test_gains_and_refinement_equal_recomputed_distances(spark):
    rng = random.Random(5)
    items = range(24)
    # the estimate joins some elements that hardly any sample joins
    samples = {s: {i: (1 + i % 3 if i < 15 and rng.random() < 0.8 else 0) for i in items} for s in range(5)}
    estimate = {i: (1 + i % 3 if i < 20 else 0) for i in items}
    table = spark.createDataFrame([(s, i, c) for s, own in samples.items() for i, c in own.items()], "sample long, item long, cluster long")
    frame = spark.createDataFrame(list(estimate.items()), "item long, cluster long")
    total = lambda e: sum(pairs_apart(e, own) for own in samples.values())
    assert refinement.summed_distance(table, frame).first()["distance"] == total(estimate)
    got = {r["item"]: r["gain"] for r in refinement.deletion_gains(table, frame).collect()}
    assert got == {i: total({**estimate, i: 0}) - total(estimate) for i in items if estimate[i]}
    refined, trace = refinement.refine(table, frame)
    after = {r["item"]: r["cluster"] for r in refined.collect()}
    steps = [r["distance"] for r in trace.orderBy("round").collect()]
    assert steps == sorted(steps, reverse=True) and steps[0] == total(estimate) and steps[-1] == total(after) < steps[0]
    assert all(total({**after, i: 0}) >= total(after) for i in items if after[i])
    assert all(after[i] in (0, estimate[i]) for i in items)


def test_nothing_to_refine(spark):
    none = spark.createDataFrame([], "sample long, item long, cluster long")
    refined, trace = refinement.refine(none, none.select("item", "cluster"))
    assert refined.count() == 0 and trace.count() == 1
    same = spark.createDataFrame([(0, i, i % 2) for i in range(6)], "sample long, item long, cluster long")
    refined, _ = refinement.refine(same, same.select("item", "cluster"))
    assert {(r["item"], r["cluster"]) for r in refined.collect()} == {(i, i % 2) for i in range(6)}
