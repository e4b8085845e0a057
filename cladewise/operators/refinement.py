"""Refinement of an estimated partition: elements go to the background while that brings it closer to the samples.

The summed distance of an estimate to many sample partitions changes by a closed form when one element leaves its cluster:
the sizes of its cluster and of the background, and, for every sample, the two cells of the contingency table that the
element leaves and enters. So the gains of all elements are one join with the samples' contingency tables, whose size is that of the
clusters. Elements that leave together change each other's gains; a round therefore tries the best ones together,
computes the exact sum, and halves their number until it falls. A round of one element always falls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .saved import Saved

TRACE = "round int, tried long, moved long, distance double"


def _cells(samples: DataFrame, estimate: DataFrame) -> DataFrame:
    """(sample, own, cluster, n): the contingency tables of the estimate (``own``) with each sample."""
    own = estimate.select("item", F.col("cluster").alias("own"))
    return samples.select("sample", "item", "cluster").join(own, "item").groupBy("sample", "own", "cluster").agg(F.count("*").alias("n"))


def summed_distance(samples: DataFrame, estimate: DataFrame) -> DataFrame:
    """One row: ``distance``, the pairs of items that a sample joins and the estimate parts or the other way round, summed over the samples."""
    cells = _cells(samples, estimate)
    both = cells.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("both"))
    half = cells.groupBy("sample", "cluster").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("theirs"))
    mine = cells.groupBy("sample", "own").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("mine"))
    return both.crossJoin(half).crossJoin(mine).select(((F.col("theirs") + F.col("mine")) / 2 - F.col("both")).cast("double").alias("distance"))  # one row each


def deletion_gains(samples: DataFrame, estimate: DataFrame, background: int = 0) -> DataFrame:
    """(item, cluster, gain): by how much the summed distance changes when the item leaves its cluster for the background.

    ``samples`` (sample, item, cluster) and ``estimate`` (item, cluster) have every item once (a sample); items of the background have no gain.
    """
    cells = _cells(samples, estimate)
    sizes = estimate.groupBy("cluster").agg(F.count("*").alias("size"))
    ground = estimate.agg(F.sum((F.col("cluster") == background).cast("long")).alias("ground"))
    there = cells.where(F.col("own") == background).select("sample", F.col("cluster").alias("theirs"), F.col("n").alias("there"))
    here = cells.where(F.col("own") != background).select("sample", "own", F.col("cluster").alias("theirs"), F.col("n").alias("here"))
    met = here.join(there, ["sample", "theirs"], "left")
    # from both sums of squares: (ground - size + 1) for the estimate's pairs, twice (there - here + 1) for the common ones
    met = met.join(sizes.withColumnRenamed("cluster", "own"), "own").crossJoin(ground)  # one row
    change = F.col("ground") - F.col("size") + 1 - 2 * (F.coalesce("there", F.lit(0)) - F.col("here") + 1)
    met = met.select("sample", "own", "theirs", change.alias("change"))
    items = samples.select("sample", "item", F.col("cluster").alias("theirs")).join(estimate.select("item", F.col("cluster").alias("own")).where(F.col("own") != background), "item")
    return items.join(met, ["sample", "own", "theirs"]).groupBy("item", F.col("own").alias("cluster")).agg(F.sum("change").alias("gain"))


def refine(samples: DataFrame, estimate: DataFrame, background: int = 0) -> tuple[DataFrame, DataFrame]:
    """(item, cluster) of the refined estimate, and the trace (round, tried, moved, distance).

    It ends when no single element's leaving lowers the summed distance, which holds for squared and plain losses of it alike. Items that the estimate
    has and no sample, or the other way round, don't count. An empty estimate or table of samples comes back as it is. Rows must
    not repeat. Equal gains go by item.
    """
    spark = samples.sparkSession
    saved = Saved(spark, "refinement")
    samples = saved.save(samples.select("sample", "item", "cluster"))
    now = Saved(spark, "refined")
    estimate = now.save(estimate.select("item", "cluster"))
    distance = summed_distance(samples, estimate).first()["distance"]
    trace, k = [(0, 0, 0, distance)], 0
    while True:
        k += 1
        gains = now.save(deletion_gains(samples, estimate, background).where("gain < 0"))
        tried = most = gains.count()
        if not tried:
            return estimate, spark.createDataFrame(trace, TRACE)
        while True:
            chosen = gains if most == tried else gains.orderBy("gain", "item").limit(most)
            moved = estimate.join(chosen.select("item", F.lit(True).alias("leaves")), "item", "left")
            new = now.save(moved.select("item", F.when(F.col("leaves"), F.lit(background).cast("long")).otherwise(F.col("cluster")).alias("cluster")))
            after = summed_distance(samples, new).first()["distance"]
            if after < distance:
                break
            most //= 2
        estimate, distance = new, after
        trace.append((k, tried, most, distance))
        now.keep_last(2)
