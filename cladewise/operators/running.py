"""Running sums and row numbers over a whole table, without one task that holds all rows.

The order's first column is cut at approximate quantiles into buckets; a bucket's rows are summed in their own
task, and behind each row stands the total of the buckets before, one row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 64


def _bucket(rows: DataFrame, first: str, buckets: int) -> Column:
    """The number of cuts below ``first``; nulls are in the first bucket, as in an order with nulls first."""
    cuts = sorted(set(rows.approxQuantile(first, [k / buckets for k in range(1, buckets)], 0.25 / buckets)))
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col(first)))


def running_sum(rows: DataFrame, value: Column, first: str, then: Sequence[str | Column] = (), by: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with ``running``, the sum of ``value`` up to and with each row in the order (first, then), within groups of ``by`` (null is a group).

    ``first`` is numeric. Rows alike in the whole order are summed in any order. An empty table stays empty.
    """
    marked = rows.withColumns({"__bucket": _bucket(rows, first, buckets), "__value": value})
    key = [*by, "__bucket"]
    totals = marked.groupBy(*key).agg(F.sum("__value").alias("__total"))
    earlier = Window.partitionBy(*by, *([] if by else [F.lit(0)])).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most ``buckets`` rows
    before = totals.select(*(F.col(k).alias(f"__b_{k}") for k in key), F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__before"))
    own = Window.partitionBy(*key).orderBy(first, *then).rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumn("__own", F.sum("__value").over(own))
    same = [F.col(k).eqNullSafe(F.col(f"__b_{k}")) for k in key]
    return local.join(before, same).withColumn("running", F.col("__before") + F.col("__own")).select(*(f"`{c}`" for c in rows.columns), "running")


def numbered(rows: DataFrame, name: str, first: str, then: Sequence[str | Column] = (), by: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with their number from 1 as column ``name``."""
    return running_sum(rows, F.lit(1).cast("long"), first, then, by, buckets).withColumnRenamed("running", name)
