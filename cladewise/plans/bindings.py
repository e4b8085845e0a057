"""Views of the driver's tables as sequences, counts, splits, histories and trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cladewise.operators import running

#: Event types in order of name, which number the coordinates of a count vector.
EVENT_TYPES = 5


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sequences(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, seq): the nucleotide letters of each document."""
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGTN-]", "").alias("seq"))


SEQ = "seqs AS (SELECT doc_id, regexp_replace(upper(coalesce(text, '')), '[^ACGTN-]', '', 'g') AS seq FROM documents)"


def sites(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, pos, letter), positions from 0."""
    s = sequences(spark, folder).where(F.length("seq") > 0)
    return s.select("doc_id", F.posexplode(F.split("seq", "")).alias("pos", "letter"))


SITES = SEQ + ", sites AS (SELECT doc_id, i - 1 AS pos, seq[i] AS letter FROM (SELECT doc_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM seqs))"


def counts(spark: SparkSession, folder: str, by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Count vectors c0..c4 of the event types in order of name."""
    e = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    # one row per event type; a type beyond the coordinates at hand is an error, not dropped
    kinds = e.where("event_type IS NOT NULL").select("event_type").distinct().select("event_type", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("event_type")) - 1).alias("k"))
    checked = F.when(F.col("k") < EVENT_TYPES, F.col("k")).otherwise(F.raise_error(F.lit(f"more than {EVENT_TYPES} event types")).cast("int"))
    e = e.join(F.broadcast(kinds.select("event_type", checked.alias("k"))), "event_type")
    return e.groupBy(*by).agg(*[F.sum((F.col("k") == k).cast("long")).alias(f"c{k}") for k in range(EVENT_TYPES)])


def count_columns() -> list[Column]:
    return [F.col(f"c{k}") for k in range(EVENT_TYPES)]


def counts_sql(by: str = "user_id") -> str:
    sums = ", ".join(f"CAST(sum(CASE WHEN k = {k} THEN 1 ELSE 0 END) AS BIGINT) AS c{k}" for k in range(EVENT_TYPES))
    return (
        "kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS k FROM (SELECT DISTINCT event_type FROM events)), "
        f"counts AS (SELECT {by}, {sums} FROM (SELECT *, CAST(ts AS DATE) AS day FROM events) JOIN kinds USING (event_type) GROUP BY {by})"
    )


def splits(spark: SparkSession, folder: str) -> DataFrame:
    """(tree, split, d, w): edge lengths of tree samples, one row per tree and split."""
    x = table(spark, folder, "lineitem")
    return x.groupBy(F.col("l_orderkey").alias("tree"), F.col("l_suppkey").alias("split")).agg(F.sum("l_quantity").alias("d"), F.max(1 - F.col("l_discount")).alias("w"))


SPLITS = "splits AS (SELECT l_orderkey AS tree, l_suppkey AS split, sum(l_quantity) AS d, max(1 - l_discount) AS w FROM lineitem GROUP BY ALL)"


def history(spark: SparkSession, folder: str) -> DataFrame:
    """(chain, step, posterior, temperature): four chains of samples in order of time."""
    e = table(spark, folder, "events").withColumn("chain", F.col("user_id") % 4)
    e = e.select("chain", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", F.col("value").alias("posterior"))
    e = running.numbered(e, "step", "at", ["event_id"], by=["chain"])
    return e.select("chain", "step", "event_id", "posterior").withColumn("temperature", 1 + (F.col("step") <= 100).cast("int"))


HISTORY = (
    "history AS (SELECT *, 1 + CAST(step <= 100 AS INT) AS temperature FROM (SELECT user_id % 4 AS chain, "
    "row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS step, event_id, value AS posterior FROM events))"
)


#: Species of an alignment block.
SPECIES = 8


def alignment_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """(aln, pos, codes): every embedding, as blocks of eight species; block ``aln`` has ids 8 aln to 8 aln + 7.

    Species that an incomplete block lacks, and places behind a shorter embedding's end, are missing (-1). Embeddings
    without an id have no block.
    """
    e = table(spark, folder, "embeddings").where("vec_id IS NOT NULL")
    aln = F.floor(F.col("vec_id") / SPECIES).cast("long").alias("aln")
    cells = e.select(aln, F.pmod("vec_id", F.lit(SPECIES)).cast("int").alias("species"), F.posexplode("embedding").alias("pos", "x"))
    code = F.pmod(F.floor(F.col("x").cast("double") * 10), F.lit(5)).cast("int")
    codes = [F.coalesce(F.max(F.when(F.col("species") == k, code)), F.lit(-1)) for k in range(SPECIES)]
    return cells.groupBy("aln", "pos").agg(F.array(*codes).alias("codes"))


#: ``cells`` (aln, species, pos, code) and ``blocks`` (aln, pos, codes), as ``alignment_blocks``.
CELLS = (
    f"cells AS (SELECT vec_id // {SPECIES} AS aln, vec_id % {SPECIES} AS species, i - 1 AS pos, CAST(((floor(CAST(embedding[i] AS DOUBLE) * 10) % 5) + 5) % 5 AS INT) AS code "
    "FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE vec_id IS NOT NULL)), "
    f"blocks AS (SELECT aln, pos, [{', '.join(f'coalesce(max(CASE WHEN species = {k} THEN code END), -1)' for k in range(SPECIES))}] AS codes FROM cells GROUP BY aln, pos)"
)
