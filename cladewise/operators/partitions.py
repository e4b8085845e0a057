"""Distances between partitions of the same items, and the partition closest to the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pair_distances(samples: DataFrame) -> DataFrame:
    """(i, j, distance) for i < j: share of the pairs of items that one partition joins and the other parts.

    ``samples`` (sample, item, cluster) has one row per sample and item. The samples' number is the estimate's
    parameter (the last ones of the chains), not the data's size: an item's clusters travel as one array, whose pairs are
    counted before the shuffle.
    """
    own = F.array_sort(F.collect_list(F.struct("sample", "cluster")))
    items = samples.groupBy("item").agg(own.alias("own"))
    pairs = F.flatten(F.transform("own", lambda x: F.transform(F.filter("own", lambda y: y["sample"] > x["sample"]), lambda y: F.struct(x["sample"].alias("i"), y["sample"].alias("j"), x["cluster"].alias("a"), y["cluster"].alias("b")))))
    cells = items.select(F.explode(pairs).alias("p")).groupBy("p.i", "p.j", "p.a", "p.b").agg(F.count("*").cast("double").alias("n"))
    both = cells.groupBy("i", "j").agg(F.sum(F.col("n") * F.col("n")).alias("both"))
    sizes = samples.groupBy("sample", "cluster").agg(F.count("*").cast("double").alias("n"))
    half = sizes.groupBy("sample").agg((F.sum(F.col("n") * F.col("n")) / 2).alias("half"), F.sum("n").alias("items"))
    i, j = (half.select(F.col("sample").alias(s), F.col("half").alias(f"half_{s}"), F.col("items").alias(f"items_{s}")) for s in "ij")
    n = F.greatest("items_i", "items_j")
    distance = (F.col("half_i") + F.col("half_j") - F.col("both")) / F.when(n > 1, n * (n - 1) / 2)
    return both.join(i, "i").join(j, "j").select("i", "j", F.coalesce(distance, F.lit(0.0)).alias("distance"))


def edited(elements: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """A partition's elements (cluster, seq, pos) without those of ``gone`` and with those of ``new``; each element is there once."""
    key = ["cluster", "seq", "pos"]
    return elements.select(*key).join(gone.select(*key), key, "left_anti").unionByName(new.select(*key)).distinct()


def used_sites(one: DataFrame, two: DataFrame) -> DataFrame:
    """(seq, pos) of the sites that either partition uses."""
    return one.select("seq", "pos").unionByName(two.select("seq", "pos")).distinct()


def estimates(distances: DataFrame) -> DataFrame:
    """(sample, mean_loss, median_loss, is_mean, is_median): sums of squared and of plain distances to the others; smallest sample of equal ones."""
    d = distances.select(F.explode(F.array("i", "j")).alias("sample"), "distance")
    loss = d.groupBy("sample").agg(F.round(F.sum(F.col("distance") ** 2), 9).alias("mean_loss"), F.round(F.sum("distance"), 9).alias("median_loss"))
    best = lambda c: F.col("sample") == F.min_by("sample", F.struct(c, "sample")).over(Window.partitionBy())
    return loss.select("*", best("mean_loss").alias("is_mean"), best("median_loss").alias("is_median"))
