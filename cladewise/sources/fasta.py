"""FASTA files and files of site counts as DataFrames, and back.

A file is cut at its headers, so a large file is read by many tasks. Records of one file are in order
of (``at``, ``rec``): the place of the split they were read from, and a growing number within it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.functions.alphabet import wrap

_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
_FIVE = rf"^\s*{_NUMBER}(?:\s+{_NUMBER}){{4}}\s*$"
#: A record that only parts the blocks of a file has a header of nothing but this sign.
_RULE = r"^>+$"


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, rec, header, body); blank lines before the first header are skipped."""
    text = spark.read.text(path, lineSep="\n>")
    value = F.regexp_replace("value", r"^\s*>", "")
    parts = F.split(value, "\n", 2)
    found = text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("rec"),
        F.trim(F.regexp_replace(parts[0], "\r", "")).alias("header"),
        F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("body"),
    )
    return found.where((F.col("header") != "") | F.col("body").rlike(r"\S"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, rec, taxon, contig, desc, seq), one row per record.

    ``desc`` holds the header's parts between ``|``; the first one is ``taxon.contig``, and ``contig``
    is null without a dot. Lines of a sequence are joined without white space.
    """
    r = _records(spark, path).where(~F.col("header").rlike(_RULE))
    desc = F.transform(F.split("header", r"\|"), lambda x: F.trim(x))
    name = F.split(desc[0], r"\.", 2)
    return r.select(
        "file", "at", "rec", name[0].alias("taxon"), F.get(name, F.lit(1)).alias("contig"), desc.alias("desc"), F.regexp_replace("body", r"\s", "").alias("seq")
    )


def fasta_lines(sequences: DataFrame) -> DataFrame:
    """One text per record of (taxon, contig, seq), its sequence wrapped; a null contig is left out."""
    name = F.concat_ws(".", "taxon", "contig")
    return sequences.select(F.concat(F.lit(">"), name, F.lit("\n"), wrap(F.coalesce("seq", F.lit("")))).alias("value"))


def write_fasta(sequences: DataFrame, path: str) -> None:
    fasta_lines(sequences).write.text(path)


def pretty_lines(sequences: DataFrame) -> DataFrame:
    """``taxon (id): sequence`` for each row of (taxon, leaf_id, seq)."""
    return sequences.select(F.format_string("%10s (%2d): %s", F.col("taxon"), F.col("leaf_id"), F.coalesce("seq", F.lit(""))).alias("value"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, rec, pos, counts): five numbers per site, sites parted by ``;``. What isn't five numbers is skipped."""
    sites = F.filter(F.split("body", ";"), lambda s: s.rlike(_FIVE))
    numbers = F.transform(F.split(F.trim(F.regexp_replace("site", r"\s+", " ")), " "), lambda x: x.cast("double"))
    rows = _records(spark, path).select("file", "at", "rec", F.posexplode(sites).alias("pos", "site"))
    return rows.select("file", "at", "rec", "pos", numbers.alias("counts"))


def count_lines(sites: DataFrame, by: str = "rec") -> DataFrame:
    """One text per sequence of (``by``, pos, counts): a header, then a line of five numbers per site.

    A sequence's sites are gathered into its one text, as the format asks.
    """
    line = F.concat(F.array_join(F.transform("counts", lambda x: F.format_string("%10.8f", x)), " "), F.lit(" ;"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    text = F.array_join(F.transform(ordered, lambda s: s["line"]), "\n")
    return sites.groupBy(by).agg(F.concat(F.lit(">\n"), text).alias("value"))
