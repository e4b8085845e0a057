"""BED and MAF files as DataFrames, and MAF back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.operators.ranges import candidate_bins, smallest_bin

_BED = r"^(chr\w+)[ \t]+([0-9]+)[ \t]+([0-9]+)"


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end) of every line that begins with a chromosome and two places; other lines are skipped."""
    lines = spark.read.text(path).where(F.col("value").rlike(_BED))
    part = lambda k: F.regexp_extract("value", _BED, k)
    return lines.select(part(1).alias("chrom"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end"))


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, block, rec, src, start, size, strand, src_size, text), one row per sequence line.

    Blocks are parted by empty lines and are in order of (``at``, ``block``) within a file. Lines other
    than those of sequences are skipped; where a text has ``.`` the first line's letter stands. A
    sequence line without seven fields raises an error.
    """
    blocks = spark.read.text(path, lineSep="\n\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("block"), F.split("value", "\r?\n").alias("lines")
    )
    rows = F.transform(F.filter("lines", lambda x: x.rlike(r"^s\s")), lambda x: F.split(F.trim(x), r"\s+"))
    rows = blocks.where(F.exists("lines", lambda x: x.rlike(r"^a(\s|$)"))).select("file", "at", "block", rows.alias("rows"))
    rows = rows.withColumn("first", F.split(F.get(F.get("rows", F.lit(0)), F.lit(6)), ""))
    r = rows.select("file", "at", "block", "first", F.posexplode("rows").alias("rec", "f"))
    r = r.withColumn("f", F.when(F.size("f") == 7, F.col("f")).otherwise(F.raise_error(F.lit("a sequence line needs seven fields"))))
    whole = F.col("f")[6]
    text = F.when(F.contains(whole, F.lit(".")), F.array_join(F.zip_with(F.split(whole, ""), "first", lambda x, y: F.when(x == ".", y).otherwise(x)), "")).otherwise(whole)
    number = lambda k: F.col("f")[k].cast("long")
    return r.select(
        "file", "at", "block", "rec", F.col("f")[1].alias("src"), number(2).alias("start"), number(3).alias("size"), F.col("f")[4].alias("strand"), number(5).alias("src_size"), text.alias("text")
    )


def maf_lines(rows: DataFrame) -> DataFrame:
    """One text per block of (file, at, block, rec, src, start, size, strand, src_size, text)."""
    line = F.concat_ws(" ", F.lit("s"), "src", "start", "size", "strand", "src_size", "text")
    ordered = F.array_sort(F.collect_list(F.struct("rec", line.alias("line"))))
    block = F.concat(F.lit("a\n"), F.array_join(F.transform(ordered, lambda s: s["line"]), "\n"), F.lit("\n"))
    return rows.groupBy("file", "at", "block").agg(block.alias("value")).select("value")


def write_maf(rows: DataFrame, path: str) -> None:
    maf_lines(rows).write.text(path)


def maf_to_sequences(rows: DataFrame) -> DataFrame:
    """MAF rows as FASTA records (file, at, block, rec, taxon, contig, seq)."""
    name = F.split("src", r"\.", 2)
    return rows.select("file", "at", "block", "rec", name[0].alias("taxon"), F.get(name, F.lit(1)).alias("contig"), F.col("text").alias("seq"))


def sequences_to_maf(records: DataFrame) -> DataFrame:
    """FASTA records (file, at, rec, taxon, contig, seq) as MAF rows, one block per file. Starts are 0, and a source is as long as its letters."""
    letters = F.length(F.regexp_replace("seq", "-", "")).cast("long")
    zero = F.lit(0).cast("long")
    return records.select(
        "file", zero.alias("at"), zero.alias("block"), F.struct("at", "rec").alias("rec"), F.concat_ws(".", "taxon", "contig").alias("src"),
        zero.alias("start"), letters.alias("size"), F.lit("+").alias("strand"), letters.alias("src_size"), F.col("seq").alias("text"),
    )


def reference_rows(rows: DataFrame, species: str) -> DataFrame:
    """(file, at, block, chrom, start, end): where each block lies on the reference species; of several rows of it the first. Blocks without it are left out."""
    name = F.split("src", r"\.", 2)
    own = rows.where(name[0] == species).groupBy("file", "at", "block").agg(F.min_by(F.struct(F.get(name, F.lit(1)).alias("chrom"), "start", "size", "text"), "rec").alias("r"))
    return own.select("file", "at", "block", F.col("r.chrom").alias("chrom"), F.col("r.start").alias("start"), (F.col("r.start") + F.col("r.size")).alias("end"), F.col("r.text").alias("reference"))


def write_index(rows: DataFrame, species: str, path: str) -> None:
    """Places of all blocks on the reference species as a table, by chromosome and in order of bin, so that a lookup reads the row groups it needs."""
    own = reference_rows(rows, species).where("end > start").drop("reference").withColumns({"species": F.lit(species), "bin": smallest_bin(F.col("start"), F.col("end"))})
    own.repartition("chrom", F.floor(F.col("bin") / 64)).sortWithinPartitions("chrom", "bin", "start").write.partitionBy("chrom").parquet(path)


def lookup(spark: SparkSession, path: str, species: str, regions: DataFrame) -> DataFrame:
    """(id, chrom, region_start, region_end, file, at, block) of the blocks that overlap ``regions`` (id, chrom, start, end).

    An index of another species raises an error. Regions of one chromosome after the other are an equi-join on bins.
    """
    index = spark.read.parquet(path)
    same = F.when(F.col("species") == species, F.col("chrom").cast("string")).otherwise(F.raise_error(F.lit(f"not an index of {species}")))
    index = index.select("file", "at", "block", "start", "end", "bin", same.alias("chrom"))
    q = regions.select("id", F.col("chrom").alias("q"), F.col("start").alias("region_start"), F.col("end").alias("region_end"))
    q = q.withColumn("bin", F.explode(candidate_bins(F.col("region_start"), F.col("region_end"))))
    found = index.join(q, ["bin"]).where((F.col("chrom") == F.col("q")) & (F.col("start") < F.col("region_end")) & (F.col("end") > F.col("region_start")))
    return found.select("id", "chrom", "region_start", "region_end", "file", "at", "block")


def trim_to_regions(rows: DataFrame, found: DataFrame, species: str) -> DataFrame:
    """MAF rows of the blocks of ``found`` (see ``lookup``), with ``id``, cut to their regions: as many letters of the reference go at each end as lie outside, and what is aligned with them.

    Starts and sizes of all rows are those of the letters that are left. Gaps of the reference next to a cut stay.
    """
    block = ["file", "at", "block"]
    ref = reference_rows(rows, species).select(*block, F.col("start").alias("first"), F.col("end").alias("last"), "reference")
    whole = found.join(ref, block)
    places = F.filter(F.transform(F.split("reference", ""), lambda c, i: F.when(c != "-", i)), lambda i: i.isNotNull())
    before, behind = F.greatest(F.col("region_start") - F.col("first"), F.lit(0)).cast("int"), F.greatest(F.col("last") - F.col("region_end"), F.lit(0)).cast("int")
    cut = whole.withColumn("places", places).select(
        "id", *block,
        F.when(before > 0, F.element_at("places", F.greatest(before, F.lit(1))) + 1).otherwise(0).alias("left"),
        F.when(behind > 0, F.element_at("places", -F.greatest(behind, F.lit(1)))).otherwise(F.length("reference")).alias("right"),
    )
    letters = lambda x: F.length(F.regexp_replace(x, "-", "")).cast("long")
    met = rows.join(cut, block).withColumns({"gone": F.substring(F.col("text"), F.lit(1), F.col("left")), "text": F.substring(F.col("text"), F.col("left") + 1, F.col("right") - F.col("left"))})
    return met.select("id", *block, "rec", "src", (F.col("start") + letters(F.col("gone"))).alias("start"), letters(F.col("text")).alias("size"), "strand", "src_size", "text")


def clear_names(records: DataFrame, column: str = "src") -> DataFrame:
    """``records`` with sources cut before their first dot, so that contigs of one species share its name."""
    return records.withColumn(column, F.element_at(F.split(F.col(column), r"\."), 1))
