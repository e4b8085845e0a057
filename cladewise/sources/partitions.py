"""Text files of partitions as DataFrames, and back.

A line is one partition: ``name:length:{(seq, pos), (seq, pos)!}, name:length:{...}``, or ``-`` if it
is empty; ``!`` marks the reverse strand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SUBSET = r"([^,:{}\s][^:{}]*):([0-9]+):\{([^}]*)\}"
_ELEMENT = r"\(\s*([0-9]+)\s*,\s*([0-9]+)\s*\)(!?)"


def elements_of(text: Column) -> Column:
    """ARRAY<STRUCT<seq, pos, reverse>> of the elements in a text."""

    def element(x: Column) -> Column:
        part = lambda k: F.regexp_extract(x, _ELEMENT, k)
        return F.struct(part(1).cast("int").alias("seq"), part(2).cast("int").alias("pos"), (part(3) == "!").alias("reverse"))

    return F.transform(F.regexp_extract_all(text, F.lit(_ELEMENT), F.lit(0)), element)


def subsets_of(line: Column) -> Column:
    """ARRAY<STRUCT<model, length, elements>> of the subsets in a partition's line."""

    def subset(x: Column) -> Column:
        part = lambda k: F.regexp_extract(x, _SUBSET, k)
        return F.struct(part(1).alias("model"), part(2).cast("int").alias("length"), elements_of(part(3)).alias("elements"))

    return F.transform(F.regexp_extract_all(line, F.lit(_SUBSET), F.lit(0)), subset)


def element_text(e: Column) -> Column:
    return F.concat(F.format_string("(%d, %d)", e["seq"], e["pos"]), F.when(e["reverse"], "!").otherwise(""))


def read_partitions(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, line, subsets) with subsets ARRAY<STRUCT<model, length, elements ARRAY<STRUCT<seq, pos, reverse>>>>.

    Partitions of a file are in order of (``at``, ``line``). Empty partitions have no subsets; blank lines are skipped.
    """
    text = spark.read.text(path).where(F.trim("value") != "")
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("line"),
        subsets_of(F.col("value")).alias("subsets"),
    )


def partition_elements(partitions: DataFrame) -> DataFrame:
    """(file, at, line, cluster, model, length, seq, pos, reverse), one row per element."""
    clusters = partitions.select("file", "at", "line", F.posexplode("subsets").alias("cluster", "s"))
    rows = clusters.select("file", "at", "line", "cluster", "s.model", "s.length", F.explode("s.elements").alias("e"))
    return rows.select("file", "at", "line", "cluster", "model", "length", "e.seq", "e.pos", "e.reverse")


def partition_lines(partitions: DataFrame, *more: str) -> DataFrame:
    """One line of text per partition, as ``value``, behind the columns ``more``."""
    subset = lambda s: F.concat(s["model"], F.lit(":"), s["length"].cast("string"), F.lit(":{"), F.array_join(F.transform(s["elements"], element_text), ", "), F.lit("}"))
    return partitions.select(*more, F.when(F.size("subsets") == 0, "-").otherwise(F.array_join(F.transform("subsets", subset), ", ")).alias("value"))
