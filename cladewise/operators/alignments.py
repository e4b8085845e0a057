"""Relational operators on sequences (doc_id, seq), sites (doc_id, pos, letter) and alignments (pos, codes)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .running import numbered

GAP = 4


def kmer_tally(sequences: DataFrame, k: int) -> DataFrame:
    """Counts of all k-mers. A text's windows come from one pass over it (a look-ahead that takes no letter)."""
    s = sequences.select(F.explode(windows(F.col("seq"), k)).alias("kmer"))
    return s.groupBy("kmer").agg(F.count("*").alias("n"))


def windows(seq: Column, k: int) -> Column:
    """All strings of k letters in a row, in order of their starts."""
    return F.regexp_extract_all(seq, F.lit(f"(?=(.{{{k}}}))"), F.lit(1))


def letter_tally(sequences: DataFrame, letters: str) -> DataFrame:
    """(letter, n) of each of the letters that occurs; one row per text and letter at most is aggregated."""
    count = lambda c: (F.length("seq") - F.length(F.replace("seq", F.lit(c)))).cast("long")
    sums = sequences.agg(*(F.sum(count(c)).alias(c) for c in letters))
    found = F.explode(F.array(*(F.struct(F.lit(c).alias("letter"), F.col(f"`{c}`").alias("n")) for c in letters)))
    return sums.select(found.alias("x")).select("x.letter", "x.n").where("n > 0")


def profile(sites: DataFrame) -> DataFrame:
    """Counts and frequencies of letters by position."""
    n = sites.groupBy("pos", "letter").agg(F.count("*").alias("n"))
    return n.withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy("pos")))


def patterns(alignment: DataFrame) -> DataFrame:
    """Distinct columns with their number, over all blocks."""
    return alignment.groupBy("codes").agg(F.count("*").alias("n"))


def strip_gaps(alignment: DataFrame, species: int) -> DataFrame:
    """Columns of (aln, pos, codes) where the species has no gap, numbered anew within each alignment."""
    keep = alignment.where(F.element_at("codes", species + 1) != GAP)
    return numbered(keep, "place", "pos", by=["aln"]).select("aln", (F.col("place") - 1).alias("pos"), "codes")


def gap_runs(sequences: DataFrame, least: int) -> DataFrame:
    """Texts with runs of at least ``least`` gaps or missing letters in a row: doc_id, n_runs, n_masked (letters in runs), first_start. No shuffle."""
    found = F.regexp_extract_all("seq", F.lit(f"[-N]{{{least},}}"), F.lit(0))
    first = F.regexp_instr("seq", F.lit(f"[-N]{{{least},}}")) - 1
    rows = sequences.select("doc_id", found.alias("runs"), first.cast("long").alias("first_start")).where(F.size("runs") > 0)
    letters = F.aggregate("runs", F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), letters.alias("n_masked"), "first_start")


def mask_gaps(seq: Column, least: int) -> Column:
    """The sequence with all letters of such runs set to N."""
    parts = F.regexp_extract_all(seq, F.lit("[-N]+|[^-N]+"), F.lit(0))
    masked = F.transform(parts, lambda x: F.when(x.rlike("^[-N]") & (F.length(x) >= least), F.repeat(F.lit("N"), F.length(x))).otherwise(x))
    return F.array_join(masked, "")


def context_counts(sequences: DataFrame, order: int) -> DataFrame:
    """Letters after each context of ``order`` letters; gaps and missing letters break contexts."""
    known = kmer_tally(sequences, order + 1).where(F.col("kmer").rlike("^[ACGT]+$"))
    return known.select(F.substring("kmer", 1, order).alias("context"), F.substring("kmer", order + 1, 1).alias("letter"), "n")


def reference_coordinates(sites: DataFrame) -> DataFrame:
    """``ref_pos``: number of letters other than gaps up to here, from 0."""
    seen = F.sum((F.col("letter") != "-").cast("long")).over(Window.partitionBy("doc_id").orderBy("pos"))
    return sites.withColumn("ref_pos", seen - 1)


def site_slice(alignment: DataFrame, start: int, stop: int) -> DataFrame:
    """Columns of positions start to stop - 1."""
    return alignment.where(F.col("pos").between(start, stop - 1))


def shuffle_columns(alignment: DataFrame, seed: int) -> DataFrame:
    """The same columns of (aln, pos, codes), in each alignment in an order that depends on the seed alone."""
    drawn = alignment.withColumn("__draw", F.xxhash64(F.lit(seed), "aln", "pos"))
    return numbered(drawn, "place", "__draw", ["pos"], by=["aln"]).select("aln", (F.col("place") - 1).alias("pos"), "codes")


def set_cells(alignment: DataFrame, cells: DataFrame) -> DataFrame:
    """The alignment (aln, pos, codes) with the cells (aln, pos, species, code) written over; each once. A species outside a column raises an error."""
    new = cells.groupBy("aln", "pos").agg(F.map_from_entries(F.collect_list(F.struct("species", "code"))).alias("new"), F.min("species").alias("__low"), F.max("species").alias("__high"))
    found = alignment.join(new, ["aln", "pos"], "left")
    written = F.transform("codes", lambda c, k: F.coalesce(F.try_element_at("new", k), c))
    outside = (F.col("__low") < 0) | (F.col("__high") >= F.size("codes"))
    codes = F.when(F.col("new").isNull(), F.col("codes")).when(outside, F.raise_error(F.lit("no such species")).cast("array<int>")).otherwise(written)
    return found.select("aln", "pos", codes.alias("codes"))


def distinct_taxa(records: DataFrame) -> DataFrame:
    """One row: all taxa of (taxon, ...) in order. A tree's taxa are few, whatever the number of records."""
    return records.agg(F.array_sort(F.collect_set("taxon")).alias("taxa"))


def align_to_taxa(sequences: DataFrame, taxa: DataFrame) -> DataFrame:
    """(leaf_id, seq): the first record of each taxon, unknown taxa dropped, absent ones filled with N.

    ``sequences`` (rec, taxon, seq); ``taxa`` (taxon, leaf_id). Sequences of unequal length raise an error.
    """
    first = sequences.groupBy("taxon").agg(F.min_by("seq", "rec").alias("seq"))
    known = first.join(F.broadcast(taxa), "taxon", "right")
    span = known.agg(F.struct(F.min(F.length("seq")).alias("a"), F.max(F.length("seq")).alias("b")).alias("span"))
    checked = known.join(F.broadcast(span))
    bad = F.when(F.col("span.a") != F.col("span.b"), F.raise_error(F.lit("sequences have unequal lengths"))).otherwise(F.col("span.b"))
    return checked.select("leaf_id", F.coalesce("seq", F.expr("repeat('N', span.b)")).alias("seq"), bad.cast("int").alias("n"))


def on_taxa(records: DataFrame, taxa: Sequence[str], last: bool = False) -> DataFrame:
    """(aln, taxon, seq): every alignment of ``records`` (aln, taxon, rec, seq) on the given taxa.

    The record of the smallest ``rec`` of a taxon stays (``last``: of the largest), unknown taxa go, and missing ones are N over the longest sequence.
    """
    choose = F.max_by if last else F.min_by
    first = records.where(F.col("taxon").isin(*taxa)).groupBy("aln", "taxon").agg(choose("seq", "rec").alias("seq"))
    whole = first.groupBy("aln").agg(F.map_from_entries(F.collect_list(F.struct("taxon", "seq"))).alias("own"), F.max(F.length("seq")).alias("n"))
    whole = whole.withColumn("taxon", F.explode(F.array(*map(F.lit, taxa))))
    return whole.select("aln", "taxon", F.coalesce(F.try_element_at("own", F.col("taxon")), F.expr("repeat('N', n)")).alias("seq"))


def append(first: DataFrame, second: DataFrame) -> DataFrame:
    """The columns (aln, pos, codes) of each alignment and then those of another of the same name on the same taxa."""
    behind = first.groupBy("aln").agg((F.max("pos") + 1).alias("behind"))
    moved = second.select("aln", "pos", "codes").join(behind, "aln", "left").select("aln", (F.col("pos") + F.coalesce("behind", F.lit(0))).alias("pos"), "codes")
    return first.select("aln", "pos", "codes").unionByName(moved)
