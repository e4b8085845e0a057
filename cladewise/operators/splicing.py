"""Spliced extraction: the parts of alignment blocks over the exons of a target, joined in silico."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import bin_range_join

#: Nucleotide letters and their complements.
LETTERS, COMPLEMENTS = "ACGTRYKMBVDHacgtrykmbvdh", "TGCAYRMKVBHDtgcayrmkvbhd"


def _refuse(wrong: Column, why: str, value: Column) -> Column:
    return F.when(wrong, F.raise_error(F.lit(why))).otherwise(value)


def _blocks(maf: DataFrame, target: str) -> DataFrame:
    """(start, stop, strand, ends, width, rows) of every block with the target; ``ends`` are the places behind its letters."""
    own = F.collect_list(F.when(F.col("src") == target, F.struct("start", "size", "strand", "text")))
    found = maf.groupBy("file", "at", "block").agg(own.alias("own"), F.collect_list(F.struct("src", "text")).alias("rows")).where(F.size("own") > 0)
    found = found.select(F.col("own")[0].alias("own"), _refuse(F.size(F.array_distinct("rows.src")) < F.size("rows"), "a block has a source twice", F.col("rows")).alias("rows"))
    places = F.transform(F.split("own.text", ""), lambda c, i: F.when(~c.isin("-", ""), i + 1))
    found = found.withColumn("ends", F.filter(places, lambda e: e.isNotNull()))
    ends = _refuse(F.size("ends") != F.col("own.size"), "a target's size is not the number of its letters", F.col("ends"))
    return found.select("own.start", (F.col("own.start") + F.col("own.size")).alias("stop"), "own.strand", ends.alias("ends"), F.length("own.text").alias("width"), "rows")


def _pieces(exons: DataFrame, blocks: DataFrame) -> DataFrame:
    """(splice, part, pieces): what blocks have of every exon, with the gaps before each and behind the last."""
    pairs = bin_range_join(exons, blocks, "from", "to", "start", "stop")
    low, high = F.greatest("from", "start"), F.least("to", "stop")
    first, last = (low - F.col("start")).cast("int"), (high - F.col("start")).cast("int")
    pairs = pairs.select(
        "splice", "part", "from", "to", low.alias("low"), high.alias("high"), "strand", "rows",
        F.when(first > 0, F.get("ends", first - 1)).otherwise(0).alias("c0"),
        F.when(high < F.col("stop"), F.get("ends", last - 1)).otherwise(F.col("width")).alias("c1"),
    )
    order = Window.partitionBy("splice", "part").orderBy("low", "high")
    before = F.col("low") - F.coalesce(F.lag("high").over(order), F.col("from"))
    after = F.when(F.lead("low").over(order).isNull(), F.col("to") - F.col("high")).otherwise(0)
    width = F.col("c1") - F.col("c0")
    cut = F.transform("rows", lambda r: F.struct(r["src"].alias("src"), F.substr(r["text"], F.col("c0") + 1, width).alias("text")))
    cut = pairs.select("splice", "part", "low", "strand", before.alias("before"), after.cast("int").alias("after"), width.alias("width"), cut.alias("rows"))
    before = _refuse(F.col("before") < 0, "blocks of the target overlap", F.col("before")).cast("int")
    piece = F.struct("low", before.alias("before"), "after", "width", "strand", "rows")
    return cut.groupBy("splice", "part").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))


def splice(maf: DataFrame, exons: DataFrame, target: str, strand: str = "+") -> DataFrame:
    """(splice, src, seq): the alignment of every splice over its exons (splice, part, from, to).

    ``maf`` has (file, at, block, src, start, size, strand, text). Exons are half-open ranges of the
    target, taken in order of ``part``, which is unique within a splice. Where no block covers the target
    it gets ``N`` and other sources ``-``; sources that a block lacks get ``-``. Columns between two
    letters of the target belong to the second, those behind a block's last letter to that letter. If the
    target's blocks are on the other strand than ``strand``, the result is the reverse complement.
    A splice without any block has only the target, as filler; empty exons and rows with a null give nothing.
    Errors: mixed strands of the target in one splice, blocks that overlap inside an exon, a source
    twice in a block, and sizes that disagree with the letters.
    """
    if strand not in ("+", "-"):
        raise ValueError("strand must be + or -")
    exons = exons.select("splice", "part", F.col("from").cast("long").alias("from"), F.col("to").cast("long").alias("to")).dropna().where(F.col("from") < F.col("to"))
    maf = maf.select("file", "at", "block", "src", "start", "size", "strand", "text").dropna()
    parts = exons.join(_pieces(exons, _blocks(maf, target)), ["splice", "part"], "left")
    part = F.struct("part", (F.col("to") - F.col("from")).cast("int").alias("size"), "pieces")
    whole = parts.groupBy("splice").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    pieces = F.flatten(F.filter(F.col("parts.pieces"), lambda x: x.isNotNull()))
    strands = F.array_distinct(F.transform(pieces, lambda x: x["strand"]))
    sources = F.array_union(F.array(F.lit(target)), F.flatten(F.transform(pieces, lambda x: x["rows"]["src"])))
    whole = whole.select("splice", "parts", _refuse(F.size(strands) > 1, "the target's strands are mixed", F.get(strands, F.lit(0))).alias("strand"), F.explode(sources).alias("src"))
    src, filler = F.col("src"), F.when(F.col("src") == target, "N").otherwise("-")

    def piece_text(x: Column) -> Column:
        own = F.get(F.filter(x["rows"], lambda r: r["src"] == src), F.lit(0))["text"]
        return F.concat(F.repeat(filler, x["before"]), F.coalesce(own, F.repeat(F.lit("-"), x["width"])), F.repeat(filler, x["after"]))

    texts = F.transform("parts", lambda p: F.coalesce(F.array_join(F.transform(p["pieces"], piece_text), ""), F.repeat(filler, p["size"])))
    seq = F.array_join(texts, "")
    turned = F.reverse(F.translate(seq, LETTERS, COMPLEMENTS))
    return whole.select("splice", "src", F.when(F.col("strand") != strand, turned).otherwise(seq).alias("seq"))
