"""Motifs: counts, frequencies, position weights, scans and shifted comparisons."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .alignments import windows

LETTERS = "GATC"


def posterior_mean(counts: Sequence[Column], alpha: Sequence[float]) -> list[Column]:
    total = sum(alpha)
    n = counts[0]
    for c in counts[1:]:
        n = n + c
    return [(c + a) / (n + total) for c, a in zip(counts, alpha)]


def pwm_from_counts(counts: Sequence[Sequence[float]], pseudo: float, background: float = 0.25) -> list[list[float]]:
    """Log2 ratios of smoothed frequencies to the background, by position and letter, rounded to 6 digits."""
    return [[round(math.log2((c + pseudo) / (sum(row) + 4 * pseudo) / background), 6) for c in row] for row in counts]


def pwm_scan(sequences: DataFrame, pwm: Sequence[Sequence[float]]) -> DataFrame:
    """(doc_id, pos, score) of every window of plain letters; positions from 1. No shuffle."""
    found = sequences.select("doc_id", F.posexplode(windows(F.col("seq"), len(pwm))).alias("k", "w")).where(~F.col("w").rlike("[-N]"))
    return found.select("doc_id", (F.col("k") + 1).alias("pos"), _score(F.col("w"), pwm).alias("score"))


def _score(word: Column, pwm: Sequence[Sequence[float]]) -> Column:
    score = F.lit(0.0)
    for j, row in enumerate(pwm):
        letter = F.substring(word, j + 1, 1)
        term = F.lit(row[3])
        for x in (2, 1, 0):
            term = F.when(letter == LETTERS[x], row[x]).otherwise(term)
        score = score + term
    return score


def pwm_best(sequences: DataFrame, pwm: Sequence[Sequence[float]], most: int, digits: int = 6) -> DataFrame:
    """(doc_id, pos, score) of each sequence's best windows, of equal rounded scores the earlier ones. A sequence is one row, so nothing is shuffled."""
    found = F.filter(F.transform(windows(F.col("seq"), len(pwm)), lambda w, i: F.struct(w.alias("w"), (i + 1).cast("long").alias("pos"))), lambda x: ~x["w"].rlike("[-N]"))
    scored = F.transform(found, lambda x: F.struct((-(F.round(_score(x["w"], pwm), digits) + F.lit(0.0))).alias("loss"), x["pos"].alias("pos")))
    best = sequences.select("doc_id", F.explode(F.slice(F.array_sort(scored), 1, most)).alias("x"))
    return best.select("doc_id", "x.pos", (-F.col("x.loss") + F.lit(0.0)).alias("score"))


def pwm_sql(pwm: Sequence[Sequence[float]], word: str) -> str:
    return " + ".join("CASE substr({}, {}, 1) {} END".format(word, j + 1, " ".join(f"WHEN '{c}' THEN {row[x]!r}::DOUBLE" for x, c in enumerate(LETTERS))) for j, row in enumerate(pwm))


def shifted_kl(columns: DataFrame, pairs: DataFrame, shifts: Sequence[int], background: float = 0.2) -> DataFrame:
    """Mean column divergence of motif ``first`` from motif ``second`` moved by each shift; columns without a partner meet the background.

    ``columns`` (motif, pos, p0..p4), ``pairs`` (first, second).
    """
    names = [c for c in columns.columns if c.startswith("p") and c != "pos"]
    todo = pairs.withColumn("shift", F.explode(F.array(*map(F.lit, shifts))))
    key = ["first", "second", "shift", "pos"]
    one = todo.join(columns, todo["first"] == columns["motif"]).select(*key, *(F.col(n).alias(f"a{n}") for n in names))
    two = todo.join(columns, todo["second"] == columns["motif"]).select("first", "second", "shift", (F.col("pos") + F.col("shift")).alias("pos"), *(F.col(n).alias(f"b{n}") for n in names))
    term = F.lit(0.0)
    for n in names:
        p, q = F.coalesce(f"a{n}", F.lit(background)), F.coalesce(f"b{n}", F.lit(background))
        term = term + p * F.log2(p / q)
    return one.join(two, key, "full").groupBy("first", "second", "shift").agg(F.avg(term).alias("kl"))


def free_room(starts: DataFrame, by: str, pos: str, most: int) -> DataFrame:
    """``starts`` with ``free``: places from a start to the next one of its sequence, ``most`` at the most (no next one: ``most``)."""
    after = F.lead(pos).over(Window.partitionBy(by).orderBy(pos))
    return starts.withColumn("free", F.least(F.coalesce(after - F.col(pos), F.lit(most)), F.lit(most)).cast("long"))


def valid_starts(candidates: DataFrame, starts: DataFrame, by: str, pos: str, length: int) -> DataFrame:
    """``candidates`` with ``valid``: whether no start lies within ``length`` places from them on, but for one at their own place."""
    both = candidates.select(by, pos, F.lit(0).alias("__kind")).unionByName(starts.select(by, pos, F.lit(1).alias("__kind")))
    # at one place a start comes before the candidate, so that the next start is one behind it
    ahead = Window.partitionBy(by).orderBy(pos, F.desc("__kind")).rowsBetween(1, Window.unboundedFollowing)
    next_ = F.first(F.when(F.col("__kind") == 1, F.col(pos)), ignorenulls=True).over(ahead)
    return both.withColumn("valid", F.coalesce(next_ >= F.col(pos) + length, F.lit(True))).where("__kind = 0").select(by, pos, "valid")


def average_counts(counts: DataFrame) -> DataFrame:
    """(cluster, average): letters, gaps apart, for each offset of (cluster, offset, c0..c4) on average."""
    return counts.groupBy("cluster").agg(F.avg(F.col("c0") + F.col("c1") + F.col("c2") + F.col("c3")).alias("average"))


def motif_counts(elements: DataFrame, sites: DataFrame, length: int) -> DataFrame:
    """Count vectors of each cluster's positions, summed over its elements; elements on the reverse strand read complements backwards.

    ``elements`` (cluster, seq, pos, reverse), ``sites`` (seq, pos, c0..c4) in the order G A T C gap.
    """
    spread = elements.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn("at", F.col("pos") + F.when(F.col("reverse"), length - 1 - F.col("offset")).otherwise(F.col("offset")))
    met = spread.drop("pos").join(sites.withColumnRenamed("pos", "at"), ["seq", "at"])
    swap = {0: 3, 1: 2, 2: 1, 3: 0, 4: 4}
    sums = [F.sum(F.when(F.col("reverse"), F.col(f"c{swap[k]}")).otherwise(F.col(f"c{k}"))).alias(f"c{k}") for k in range(5)]
    return met.groupBy("cluster", "offset").agg(*sums)


def site_kinds(sites: DataFrame, elements: DataFrame, length: int) -> DataFrame:
    """``sites`` (seq, pos) with ``is_start``, whether an element (seq, pos) starts there, and ``is_background``, whether none covers the place."""
    starts = elements.select("seq", "pos").distinct()
    covered = starts.select("seq", F.explode(F.sequence("pos", F.col("pos") + (length - 1))).alias("pos"), F.col("pos").alias("first"))
    covered = covered.groupBy("seq", "pos").agg(F.max((F.col("pos") == F.col("first")).cast("int")).alias("__start"))
    found = sites.join(covered, ["seq", "pos"], "left")
    return found.withColumns({"is_start": F.coalesce("__start", F.lit(0)) == 1, "is_background": F.col("__start").isNull()}).drop("__start")
