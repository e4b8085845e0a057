"""Running sums, numbers and order statistics against plain Python, and ranges that no fine bin holds."""

import math
import random

from cladewise.operators import alignments, history, ranges, running, splits
from pyspark.sql import functions as F


def test_running_sums_in_groups(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, 1, 2]), rng.randrange(40) if k % 9 else None, rng.randrange(100)) for k in range(500)]
    table = spark.createDataFrame(rows, "k long, g int, a long, v long")
    got = {r["k"]: r["running"] for r in running.running_sum(table, F.col("v"), "a", ["k"], ["g"], buckets=7).collect()}
    for g in (None, 1, 2):
        total = 0
        for k, _, _, v in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
            total += v
            assert got[k] == total
    assert running.numbered(table.where("false"), "n", "a").count() == 0
    numbers = {r["k"]: r["n"] for r in running.numbered(table, "n", "a", ["k"]).collect()}
    assert sorted(numbers.values()) == list(range(1, 501))


def test_ranges_across_the_largest_bins(spark):
    edge = 1 << 29
    targets = spark.createDataFrame([(1, edge - 5, edge + 5), (2, 3 * edge - 1, 5 * edge), (3, 10, 20), (4, edge, edge + 1)], "t long, a long, b long")
    queries = spark.createDataFrame([(1, edge - 1, edge + 1), (2, 0, 15), (3, 4 * edge, 4 * edge + 9)], "q long, x long, y long")
    got = {(r["q"], r["t"]) for r in ranges.bin_range_join(queries, targets, "x", "y", "a", "b").collect()}
    assert got == {(1, 1), (1, 4), (2, 3), (3, 2)}


def test_order_statistic(spark):
    values = [math.sqrt(k * 7919 % 1009) for k in range(300)]
    found = splits.credibility_radius(spark.createDataFrame([(v,) for v in values], "distance double"), 0.95).first()
    assert found["radius"] == sorted(values)[min(math.ceil(300 * 0.95), 299)] and found["n"] == 300


def test_last_samples_of_a_chain(spark):
    rows = [(c, s, float(s), 2 if s < 4 else 1) for c in (None, 0) for s in range(1, 11)]
    kept = history.take_last(spark.createDataFrame(rows, "chain int, step long, posterior double, temperature int"), 3).collect()
    assert sorted((str(r["chain"]), r["step"]) for r in kept) == [(c, s) for c in ("0", "None") for s in (8, 9, 10)]


def test_columns_are_shuffled_within_their_alignment(spark):
    rows = [(a, p, [p + 100 * a]) for a in range(3) for p in range(20)]
    table = spark.createDataFrame(rows, "aln long, pos int, codes array<int>")
    one, two = ([tuple(r) for r in alignments.shuffle_columns(table, s).orderBy("aln", "pos").collect()] for s in (1, 2))
    assert one != two and sorted((a, c) for a, _, c in one) == sorted((a, c) for a, _, c in rows)
    assert [(a, p) for a, p, _ in one] == [(a, p) for a, p, _ in rows]


def test_taxa_of_a_tree_that_lack_a_record(spark):
    records = spark.createDataFrame([(0, "x", "ACGT"), (1, "x", "TTTT"), (2, "other", "AA"), (3, "y", "GG-T")], "rec int, taxon string, seq string")
    taxa = spark.createDataFrame([("x", 0), ("y", 1), ("z", 2)], "taxon string, leaf_id int")
    assert {r["leaf_id"]: r["seq"] for r in alignments.align_to_taxa(records, taxa).collect()} == {0: "ACGT", 1: "GG-T", 2: "NNNN"}
