"""Helpers shared by the training-data operators: shared scratch tables and small column idioms."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract: space and the control characters tab to carriage return.
WHITE = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset and Spark runs in one process, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cladewise-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a written table through Hadoop's file systems, wherever it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables written to the shared folder to cut lineage.

    ``save`` writes a table and reads it back, so that lost executors cost a reread and never a new
    run of what came before. ``drop`` removes tables that no later step reads; what the returned,
    lazy result still needs goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.count = 0
        atexit.register(self._end)

    def save(self, df: DataFrame) -> DataFrame:
        path, self.count = f"{self.base}/{self.count}", self.count + 1
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        self._held = [*getattr(self, "_held", []), back]
        return back

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            delete(self.spark, self.paths.pop(id(table)))

    def _end(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                delete(self.spark, self.base)
            except Exception:  # the gateway may be gone when the interpreter ends
                return


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


#: A group with more than one in so many rows is large; there are fewer large groups than that.
LARGE_SHARE = 1000


def joined_to_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` with the columns of their group (inner join on ``keys``, which are not null); ``size`` is a group's number of rows.

    The fewer than LARGE_SHARE large groups are broadcast, so that their rows stay where they are; all others are joined by shuffle.
    Both tables are read twice, so they are best saved ones.
    """
    bar = total // LARGE_SHARE
    large = F.broadcast(groups.where(F.col(size) > bar))
    rest = rows.join(large.select(*keys), keys, "left_anti").join(groups.where(F.col(size) <= bar), keys)
    return rows.join(large, keys).unionByName(rest)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
