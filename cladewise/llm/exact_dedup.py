"""Operator 2, exact deduplication by deterministic block naming.

A normalised text is cut into blocks of ``BLOCK`` code points. The distinct blocks of the corpus are
sorted and get integer names; adjacent pairs of names are sorted and named in turn, level by level,
until each document has one name. Two documents have the same (level, name) if and only if their
normalised texts are the same: names stand for whole blocks, never for hashes of them. A pair of
64-bit hashes only brings each block to its name, and is checked to be free of collisions first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, joined_to_groups, text_or_empty

BLOCK = 2048
#: Blocks are sorted by so many first code points, and among those that begin alike by their hashes.
SORTED = 64
#: Runs of white space that are not one plain space already.
UNEVEN_WHITE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: str | Column = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), UNEVEN_WHITE, " ")


def _blocks(text: Column, size: int) -> Column:
    found = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(found)


def _keys(block: Column, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), block).alias("h1"), F.xxhash64(F.lit(seed + 1), block, F.lit(seed)).alias("h2")]


def _named(scratch: Scratch, distinct: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """Names for distinct rows: their places, from 0, in the order of ``by`` over all rows, whatever the partitions."""
    placed = scratch.save(distinct.sort(*by).select(*keep, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    before, total = [], 0
    for r in placed.groupBy("part").count().orderBy("part").collect():  # one row per partition of the sort
        before.append((r["part"], total))
        total += r["count"]
    offsets = placed.sparkSession.createDataFrame(before, "part int, before long")
    return placed.join(F.broadcast(offsets), "part").select(*keep, (F.col("before") + F.col("place")).alias("name"))


def dedup_report(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Of equal texts the row with the smallest doc_id stays (nulls last);
    of rows that repeat one doc_id and text, exactly one stays. An empty table gives no rows.
    Columns beyond doc_id and text are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    texts = docs.select(docs["doc_id"].alias("doc_id"), normalised(docs["text"]).alias("text"))
    seed = 7
    while True:
        blocks = texts.select(F.explode(_blocks(F.col("text"), block)).alias("b")).select(*_keys(F.col("b"), seed), "b").distinct()
        found = scratch.save(blocks.select(F.substring("b", 1, SORTED).alias("start"), "h1", "h2"))
        if found.groupBy("h1", "h2").count().where("count > 1").limit(1).isEmpty():
            break
        scratch.drop(found)
        seed += 2
    names = _named(scratch, found, ["start", "h1", "h2"], ["h1", "h2"])
    rows = scratch.save(
        texts.select(
            F.monotonically_increasing_id().alias("uid"),
            "doc_id",
            F.sha2(F.col("text"), 256).alias("text_sha256"),
            F.transform(_blocks(F.col("text"), block), lambda b: F.struct(*_keys(b, seed))).alias("keys"),
        )
    )
    level, most = 0, rows.agg(F.max(F.size("keys"))).first()[0] or 1
    at = rows.select("uid", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "k"))
    at = at.select("uid", "n", "pos", "k.h1", "k.h2").join(names, ["h1", "h2"]).select("uid", "n", "pos", "name")
    whole = []
    while True:
        at = scratch.save(at)
        whole.append(at.where("n = 1").select("uid", F.lit(level).alias("level"), "name"))
        if most <= 1:
            break
        level, most = level + 1, (most + 1) // 2
        even, half = F.col("pos") % 2 == 0, F.floor(F.col("pos") / 2).cast("int").alias("pos")
        pairs = scratch.save(
            at.where("n > 1")
            .groupBy("uid", ((F.col("n") + 1) / 2).cast("int").alias("n"), half)
            .agg(F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"))
        )
        names = _named(scratch, pairs.select("a", "b").distinct(), ["a", "b"], ["a", "b"])
        at = pairs.join(names, ["a", "b"]).select("uid", "n", "pos", "name")
    named = whole[0]
    for more in whole[1:]:
        named = named.unionByName(more)
    rows = scratch.save(rows.drop("keys").join(named, "uid"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    groups = scratch.save(rows.groupBy("level", "name").agg(first.alias("first"), F.count("*").alias("group_size")))
    return joined_to_groups(rows, groups, ["level", "name"], "group_size", rows.count()).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("first.uid")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` without the copies, all columns as they were.

    Rows that repeat a doc_id and its text are also reduced to one; only where such rows exist
    does that take another shuffle of the texts.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup-kept")
    report = scratch.save(dedup_report(docs, block))
    keep = report.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    repeated = not report.groupBy("doc_id", "text_sha256").count().where("count > 1").limit(1).isEmpty()
    sha = F.sha2(normalised(docs["text"]), 256)
    if repeated:
        docs = docs.withColumn("__sha_own", sha).dropDuplicates(["doc_id", "__sha_own"])
        return docs.join(keep, docs["doc_id"].eqNullSafe(keep["__id"]) & (docs["__sha_own"] == keep["__sha"]), "left_semi").drop("__sha_own")
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["__id"]) & (sha == keep["__sha"]), "left_semi")


REPORT_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
       row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256 FROM t
"""
