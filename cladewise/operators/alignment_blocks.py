"""Alignment blocks of files without separators: a block ends where one of its taxa comes again, or at a header that is a rule.

Where the next block starts depends on where this one did, which looks sequential. But the end of a block that starts at s is the first place from s on
that is the next one of the same taxon as some place from s on: a minimum over a suffix, known for every s at once. The starts are those places that
are reached from the file's first one, found by doubling the steps taken, in as many rounds as the number of blocks has binary digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .running import numbered
from .saved import Saved

#: Records that one task orders.
BUCKET = 100_000
_RULE = r"^>+$"


def _suffix_least(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` (file, pos, ...) with the least ``value`` at or behind each place of its file."""
    marked = rows.withColumn("__bucket", F.floor(F.col("pos") / BUCKET))
    least = marked.groupBy("file", "__bucket").agg(F.min(value).alias("__least"))
    behind = Window.partitionBy("file").orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    later = least.select("file", "__bucket", F.min("__least").over(behind).alias("__later"))
    own = Window.partitionBy("file", "__bucket").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("__own", F.min(value).over(own)).join(later, ["file", "__bucket"]).withColumn(name, F.least("__own", "__later")).drop("__bucket", "__own", "__later")


def blocks_of(records: DataFrame, header: Column | None = None, keep_repeated: bool = True) -> DataFrame:
    """``records`` (file, at, rec, taxon, ...) with their place ``pos`` from 0 and the number ``block`` from 0 within their file.

    ``header`` marks rules: such rows end a block and belong to none. ``keep_repeated``: the record that ends a block starts the next one; otherwise it
    is left out, as readers do that look at it only to see the end. Records without a taxon end nothing. Files are apart; an empty table stays empty.
    """
    saved = Saved(records.sparkSession, "blocks")
    rule = F.coalesce(header.rlike(_RULE), F.lit(False)) if header is not None else F.lit(False)
    rows = numbered(records.withColumn("__rule", rule), "pos", "at", ["rec"], ["file"]).withColumn("pos", F.col("pos") - 1)
    rows = saved.save(rows)
    places = rows.select("file", "pos", "taxon", "__rule")
    again = F.lead("pos").over(Window.partitionBy("file", "taxon").orderBy("pos"))
    ends = places.where("NOT __rule AND taxon IS NOT NULL").select("file", "pos", again.alias("end"))
    # a place's own rule ends the block before it; every place counts as a start, so the end of a block is looked up where it starts
    ends = ends.unionByName(places.where("__rule OR taxon IS NULL").select("file", "pos", F.when(F.col("__rule"), F.col("pos")).alias("end")))
    ends = _suffix_least(ends, "end", "stop")
    first = F.when(F.lit(keep_repeated), F.col("stop")).otherwise(F.col("stop") + 1)
    rules = places.where("__rule").select("file", F.col("pos").alias("stop"), F.lit(True).alias("at_rule"))
    jump = ends.select("file", "pos", "stop").join(rules, ["file", "stop"], "left")
    jump = saved.save(jump.select("file", "pos", "stop", F.when(F.col("at_rule"), F.col("stop") + 1).otherwise(first).alias("to")).where("stop IS NOT NULL"))
    starts = saved.save(rows.groupBy("file").agg(F.min("pos").alias("pos")))
    steps = jump.select("file", "pos", "to")
    while True:
        reached = starts.join(steps, ["file", "pos"]).select("file", F.col("to").alias("pos"))
        new = saved.save(starts.unionByName(reached).distinct())
        if new.count() == starts.count():
            break
        starts = new
        over = steps.select("file", F.col("pos").alias("to"), F.col("to").alias("top"))
        steps = saved.save(steps.join(over, ["file", "to"]).select("file", "pos", F.col("top").alias("to")))
    # a start counts as a block if it holds a record; its number is that of the starts before it
    inside = starts.join(jump.select("file", "pos", "stop"), ["file", "pos"], "left")
    marks = rows.join(inside.select("file", "pos", F.lit(1).alias("__start")), ["file", "pos"], "left").withColumn("__start", F.coalesce("__start", F.lit(0)))
    marks = marks.where("NOT __rule")
    if not keep_repeated:  # the ends of reached blocks that are no rules
        gone = inside.where("stop IS NOT NULL").select("file", F.col("stop").alias("pos"))
        marks = marks.join(gone, ["file", "pos"], "left_anti")
    # a start may itself be a rule or have been left out: the next record takes its place, so blocks are numbered by the starts at or before a record
    filled = _prefix_count(marks.select("file", "pos"), starts, saved)
    return marks.drop("__start", "__rule").join(filled, ["file", "pos"])


def _prefix_count(places: DataFrame, starts: DataFrame, saved: Saved) -> DataFrame:
    """(file, pos, block): for each place the number of starts up to it, empty blocks not counted."""
    both = places.withColumn("s", F.lit(0)).unionByName(starts.withColumn("s", F.lit(1)))
    marked = both.withColumn("__bucket", F.floor(F.col("pos") / BUCKET))
    totals = marked.groupBy("file", "__bucket").agg(F.sum("s").alias("t"))
    before = Window.partitionBy("file").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    earlier = totals.select("file", "__bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("earlier"))
    own = Window.partitionBy("file", "__bucket").orderBy("pos", F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    counted = marked.withColumn("n", F.sum("s").over(own)).join(earlier, ["file", "__bucket"]).where("s = 0").select("file", "pos", (F.col("n") + F.col("earlier")).alias("n"))
    counted = saved.save(counted)
    held = counted.select("file", "n").distinct()
    number = numbered(held, "block", "n", by=["file"])
    return counted.join(number, ["file", "n"]).select("file", "pos", (F.col("block") - 1).alias("block"))
