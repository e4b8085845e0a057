"""Operators on sampling histories (chain, step, posterior, temperature) and partitions of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .running import numbered


def thin(history: DataFrame, drop: int, every: int) -> DataFrame:
    """Samples from number ``drop`` on (from 0), every so-many-th counted back from the chain's last."""
    p = F.col("step") - 1
    last = history.groupBy("chain").agg((F.max("step") - 1).alias("last")).withColumnRenamed("chain", "own")
    # one row per chain, whose number is the sampler's parameter
    found = history.join(F.broadcast(last), F.col("chain").eqNullSafe(F.col("own")))
    return found.where((p >= drop) & ((F.col("last") - p) % every == 0)).drop("last", "own")


def take_last(history: DataFrame, n: int) -> DataFrame:
    """The last n samples at temperature 1 or below of every chain."""
    cold = history.where("temperature <= 1").withColumn("__back", -F.col("step"))
    return numbered(cold, "k", "__back", by=["chain"]).where(F.col("k") <= n).drop("k", "__back")


def map_sample(history: DataFrame) -> DataFrame:
    """The step of the largest posterior of each chain, the earliest of equal ones."""
    best = F.max_by("step", F.struct("posterior", -F.col("step")))
    return history.where("temperature <= 1").groupBy("chain").agg(best.alias("step"), F.max("posterior").alias("posterior"))


def deltas(history: DataFrame) -> DataFrame:
    """Change of the posterior from the step before. A chain's steps are numbered without gaps, so that its rows can lie anywhere."""
    before = history.select(F.col("chain").alias("own"), (F.col("step") + 1).alias("next"), F.col("posterior").alias("before"))
    found = history.join(before, F.col("chain").eqNullSafe(F.col("own")) & (F.col("step") == F.col("next")), "left")
    return found.withColumn("delta", F.col("posterior") - F.col("before")).drop("own", "next", "before")


def contingency(labels: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n): items by their clusters in two partitions."""
    return labels.groupBy(a, b).agg(F.count("*").alias("n"))


def partition_distance(table: DataFrame, a: str, b: str) -> DataFrame:
    """Number of pairs of items that one partition joins and the other parts, from the contingency table alone."""
    half = lambda key: table.groupBy(key).agg(F.sum("n").alias("m")).agg((F.sum(F.col("m") * F.col("m")) / 2).alias(f"h{key}"))
    cells = table.agg(F.sum(F.col("n") * F.col("n")).alias("cells"))
    return half(a).join(half(b)).join(cells).select((F.col(f"h{a}") + F.col(f"h{b}") - F.col("cells")).cast("long").alias("distance"))


def running_logsumexp(value: Column, window) -> Column:
    """Log of the running sum of exponentials, safe for large values."""
    most = F.max(value).over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return most + F.log(F.sum(F.exp(value - most)).over(window.rowsBetween(Window.unboundedPreceding, 0)))


def value_lines(history: DataFrame, chains: int, value: str = "posterior") -> DataFrame:
    """(step, line): a table's lines ``x y1 y2 ...`` with the chains' values by step in six decimals; step 0 is the header. Chains are 0 to ``chains`` - 1; steps that not all have are left out."""
    wide = history.groupBy("step").pivot("chain", list(range(chains))).agg(F.max(value))
    names = [str(k) for k in range(chains)]
    line = F.concat_ws(" ", F.col("step").cast("string"), *(F.format_string("%.6f", F.col(f"`{k}`")) for k in names))
    header = history.sparkSession.createDataFrame([(0, " ".join(["x", *(f"y{k + 1}" for k in range(chains))]))], "step int, line string")
    return header.unionByName(wide.where(" AND ".join(f"`{k}` IS NOT NULL" for k in names)).select(F.col("step").cast("int").alias("step"), line.alias("line")))
