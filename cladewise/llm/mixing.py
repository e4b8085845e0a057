"""Operator 9, mixing sources: iterative proportional fitting of token weights, then calibrated sampling.

All of it is DataFrame work. Topics are clusters of hashed word counts, learnt from all documents by a few
rounds of sums per cluster. The cells (source, language, topic) are sums over all documents; raking
alternates window sums over one marginal at a time on that table of cells, until all marginals are met.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WHITE, Scratch, let, text_or_empty

DIMS = ("source", "lang", "topic")
#: Cells that are raked in one task and broadcast to the documents; a table of more is raked and joined by shuffles.
SMALL_CELLS = 50_000
#: Raking ends when no marginal is further from its target than this share of it, or after so many sweeps; a job makes SWEEPS_A_JOB of them.
TOLERANCE, MOST_SWEEPS, SWEEPS_A_JOB = 1e-9, 120, 6
#: Topics, rounds that move their centres, and the letters from which on a word counts for its text's topic.
TOPICS, ROUNDS, LEAST_LETTERS = 6, 3, 5
#: A text's word counts are projected on so many random directions, counted in lanes of so many bits, three to a number.
DIRECTIONS, LANE = 6, 21
#: Without given targets, a marginal's shares are its present ones to this power, made to sum to 1.
TEMPER = 0.9
SEED = 17


def n_tokens(text: str | Column = "text") -> Column:
    words = F.filter(F.split(text_or_empty(text), WHITE), lambda w: w != "")
    return F.size(words).cast("long")


def projections(text: str | Column = "text") -> Column:
    """``DIRECTIONS`` sums over the text's longer words, each of which counts 1 or -1 in a direction by a bit of its hash; divided by the root of their number.

    The sums are kept as counts of ones in lanes of two numbers. All are 0 in a text without such words.
    """
    words = F.filter(F.split(F.lower(text_or_empty(text)), WHITE), lambda w: F.length(w) >= LEAST_LETTERS)
    ones = sum(1 << (LANE * k) for k in range(3))
    zero = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))

    def add(s: Column, w: Column) -> Column:
        h = F.xxhash64(w)
        return F.struct((s["a"] + h.bitwiseAND(F.lit(ones))).alias("a"), (s["b"] + F.shiftright(h, 1).bitwiseAND(F.lit(ones))).alias("b"))

    def spread(words: Column) -> Column:
        n = F.size(words)

        def values(s: Column) -> Column:
            counts = [F.shiftright(s[x], LANE * k).bitwiseAND(F.lit((1 << LANE) - 1)) for x in "ab" for k in range(3)]
            return F.array(*((2 * c - n) / F.sqrt(F.greatest(n, F.lit(1))) for c in counts))

        return let(F.aggregate(words, zero, add), values)

    return let(words, spread)


def nearest(vector: Column, centres: list[list[float]]) -> Column:
    """The number of the centre of the largest product with the vector, the first of equal ones."""
    products = [sum((F.element_at(vector, j + 1) * x for j, x in enumerate(c)), F.lit(0.0)) for c in centres]
    best = F.greatest(*products)
    out = F.lit(len(centres) - 1)
    for k in range(len(centres) - 2, -1, -1):
        out = F.when(products[k] == best, k).otherwise(out)
    return out


def topic_centres(vectors: DataFrame) -> list[list[float]]:
    """Unit vectors of the topics of a saved table of ``vector``: from the axes on, each moves to the direction of its documents' sum. A few numbers per topic reach the driver."""
    centres = [[float(j == k) for j in range(DIRECTIONS)] for k in range(TOPICS)]
    for _ in range(ROUNDS):
        sums = vectors.groupBy(nearest(F.col("vector"), centres).alias("k")).agg(*(F.sum(F.element_at("vector", j + 1)).alias(f"x{j}") for j in range(DIRECTIONS)))
        for r in sums.collect():
            size = sum(r[f"x{j}"] ** 2 for j in range(DIRECTIONS)) ** 0.5
            if size > 0:
                # rounded, so that the order in which a sum was made doesn't matter
                centres[r["k"]] = [round(r[f"x{j}"] / size, 6) for j in range(DIRECTIONS)]
    return centres


def topic(vector: Column, centres: list[list[float]]) -> Column:
    return F.concat(F.lit("topic"), nearest(vector, centres).cast("string"))


def cells(docs: DataFrame) -> DataFrame:
    """Tokens and documents of each cell; a null source, language or topic is a category of its own."""
    return docs.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))


def rake(table: DataFrame, scratch: Scratch, targets: Mapping[str, Mapping[str, float]] | None = None, one_task: bool = True) -> tuple[DataFrame, float]:
    """``table`` of cells with ``weight`` (target tokens per present token, from raking) and ``probability`` (weight over the largest weight); and the largest gap left.

    A gap is the distance of a marginal's tokens from its target, as a share of the target. Targets that no weights can meet (cells
    that lack) leave one after ``MOST_SWEEPS`` sweeps. Cells without tokens get weight 1 and probability 1. Empty tables stay empty.
    """
    targets = targets or {}
    total = F.broadcast(table.agg(F.sum("tokens").cast("double").alias("__total")))
    table = table.withColumn("tokens", F.col("tokens").cast("double")).join(total)
    for dim in DIMS:
        table = table.withColumn(f"__present_{dim}", F.sum("tokens").over(Window.partitionBy(dim)))
    for dim in DIMS:
        given, present = targets.get(dim), F.col(f"__present_{dim}")
        if given:
            scale = float(sum(given.values()))
            pairs = F.create_map(*[F.lit(v) for k, x in given.items() for v in (str(k), float(x) / scale)])
            share = F.coalesce(F.element_at(pairs, F.col(dim).cast("string")), F.lit(0.0))
        else:
            table = table.withColumn("__share", F.when(present > 0, F.pow(present / F.col("__total"), TEMPER)).otherwise(F.lit(0.0)))
            part = F.when(present > 0, F.col("tokens") / present).otherwise(F.lit(0.0))
            sums = table.agg(F.sum(F.col("__share") * part).alias("__sum"))
            table = table.join(F.broadcast(sums))
            share = F.when(F.col("__sum") > 0, F.col("__share") / F.col("__sum")).otherwise(F.lit(0.0))
        table = table.withColumn(f"__target_{dim}", share * F.col("__total")).drop("__share", "__sum")
    table = table.withColumn("__w", F.col("tokens"))
    now = lambda dim: F.sum("__w").over(Window.partitionBy(dim))
    sweeps, gap = 0, 1.0
    while gap > TOLERANCE and sweeps < MOST_SWEEPS:
        table = table.coalesce(1) if one_task else table
        for _ in range(SWEEPS_A_JOB):
            for dim in DIMS:
                table = table.withColumn("__now", now(dim)).withColumn("__w", F.when(F.col("__now") > 0, F.col("__w") * F.col(f"__target_{dim}") / F.col("__now")).otherwise(F.lit(0.0)))
        table = scratch.save(table.drop("__now"))
        off = [F.when(F.col(f"__target_{d}") > 0, F.abs(now(d) / F.col(f"__target_{d}") - 1)).otherwise(F.lit(0.0)) for d in DIMS]
        gap = table.select(F.greatest(*off).alias("gap")).agg(F.max("gap")).first()[0] or 0.0
        sweeps += SWEEPS_A_JOB
    ratio = F.when(F.col("tokens") > 0, F.col("__w") / F.col("tokens"))
    table = table.withColumn("__ratio", ratio)
    table = table.join(F.broadcast(table.agg(F.max("__ratio").alias("__most"))))
    table = table.select(
        *DIMS,
        F.col("tokens").cast("long").alias("tokens"),
        "n_docs",
        F.coalesce("__ratio", F.lit(1.0)).alias("weight"),
        F.when(F.col("tokens") > 0, F.when(F.col("__most") > 0, F.col("__ratio") / F.col("__most")).otherwise(F.lit(0.0))).otherwise(F.lit(1.0)).alias("probability"),
    )
    return table, gap


def draw(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _calibrated(docs: DataFrame, scratch: Scratch, targets) -> tuple[DataFrame, bool, float]:
    """``small`` only chooses how the same numbers are come by: raked in one task and broadcast, or by shuffles."""
    table = scratch.save(cells(docs))
    small = table.count() <= SMALL_CELLS
    raked, gap = rake(table, scratch, targets, small)
    return scratch.save(raked), small, gap


def _joined(docs: DataFrame, table: DataFrame, small: bool, take: list[str]) -> DataFrame:
    names = {d: f"__cell_{d}" for d in DIMS}
    side = table.select(*(F.col(d).alias(n) for d, n in names.items()), *take)
    same = [F.col(f"__own_{d}").eqNullSafe(F.col(n)) for d, n in names.items()]
    return docs.join(F.broadcast(side) if small else side, same, "left").drop(*names.values())


def _measured(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*more, "source", "lang", projections(docs["text"]).alias("vector"), n_tokens(docs["text"]).alias("n_tokens"))


def mix_report(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, lang, topic, n_tokens, weight, probability, gap, selected.

    ``targets``: for each of source, lang, topic a mapping of category to share; without one, shares
    are tempered. A document is selected if its own draw lies below its cell's probability, so
    selected tokens meet the raked marginals in expectation, but for ``gap`` (see ``rake``). Null texts have no tokens and a
    null source or language is a category; rows that repeat are drawn alike; an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.save(_measured(docs, "doc_id"))
    rows = rows.withColumn("topic", topic(F.col("vector"), topic_centres(rows))).select("doc_id", *DIMS, "n_tokens")
    table, small, gap = _calibrated(rows, scratch, targets)
    own = rows.select("*", *(F.col(d).alias(f"__own_{d}") for d in DIMS))
    out = _joined(own, table, small, ["weight", "probability"]).drop(*(f"__own_{d}" for d in DIMS))
    return out.withColumns({"gap": F.lit(gap), "selected": draw(F.col("doc_id"), seed) < F.col("probability")})


def mix_documents(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, seed: int = SEED) -> DataFrame:
    """The sampled documents with all their columns, as ``mix_report`` selects them (see there for nulls, repeated rows and empty tables)."""
    scratch = Scratch(docs.sparkSession, "mixing")
    narrow = scratch.save(_measured(docs))
    centres = topic_centres(narrow)
    table, small, _ = _calibrated(narrow.withColumn("topic", topic(F.col("vector"), centres)), scratch, targets)
    columns = docs.columns
    own = docs.select("*", docs["source"].alias("__own_source"), docs["lang"].alias("__own_lang"), let(projections(docs["text"]), lambda v: topic(v, centres)).alias("__own_topic"))
    out = _joined(own, table.withColumnRenamed("probability", "__p"), small, ["__p"])
    return out.where(draw(F.col("doc_id"), seed) < F.col("__p")).select(*(F.col(f"`{c}`") for c in columns))
