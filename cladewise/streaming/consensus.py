"""Split counts of a stream of sampled trees, kept up to date for a consensus at any time.

Trees come as (tree, edges ARRAY<STRUCT<split BIGINT, d DOUBLE>>). The state is one row per distinct
split. Every batch writes the splits it changed under its own number, so that a batch which runs
again after a failure replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: The row that counts the trees themselves; splits are bit masks and never negative.
TREES = -1


def split_totals(trees: DataFrame) -> DataFrame:
    """(split, n, total): in how many trees a split lies and the sum of its lengths; split -1 counts trees."""
    own = F.array(F.struct(F.lit(TREES).cast("long").alias("split"), F.lit(0.0).alias("d")))
    none = F.filter(own, lambda e: F.lit(False))
    rows = trees.select(F.explode(F.concat(own, F.coalesce("edges", none))).alias("e")).select("e.split", "e.d")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.sum("d").alias("total"))


def start(trees: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Begin to keep the totals of a stream under ``path``; ``trigger`` as in ``writeStream.trigger``."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = split_totals(trees).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    return (out.trigger(**trigger) if trigger else out).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """(split, n, total) as of the last batch that changed each split."""
    rows = spark.read.parquet(path)
    return rows.groupBy("split").agg(F.max_by(F.struct("n", "total"), "batch").alias("t")).select("split", "t.n", "t.total")


def majority(totals: DataFrame) -> DataFrame:
    """(split, n, d): splits of more than half of the trees with their mean length."""
    trees = totals.where(F.col("split") == TREES).select(F.col("n").alias("m"))
    kept = totals.where(F.col("split") != TREES).join(F.broadcast(trees)).where(2 * F.col("n") > F.col("m"))
    return kept.select("split", "n", (F.col("total") / F.col("n")).alias("d"))
