"""Tables written to the folder that all executors share, to cut the lineage of iterations."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset and Spark runs in one process, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cladewise-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Saved:
    """Numbered tables of one iteration. All go when the application ends; ``keep_last`` removes older ones before."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base, self.paths, self.count = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", [], 0
        atexit.register(self._delete, self.base)

    def save(self, df: DataFrame) -> DataFrame:
        path, self.count = f"{self.base}/{self.count}", self.count + 1
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_last(self, n: int) -> None:
        gone, self.paths = self.paths[:-n], self.paths[-n:]
        for path in gone:
            self._delete(path)

    def _delete(self, path: str) -> None:
        if self.spark.sparkContext._jsc is None:
            return
        try:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the gateway may be gone when the interpreter ends
            return
