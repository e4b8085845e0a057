"""Genomic ranges: hierarchical bins, and joins of ranges by bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the public binning scheme: first bin of each level from the finest, with its shift.
LEVELS = ((585, 17), (73, 20), (9, 23), (1, 26), (0, 29))
#: The bin of ranges that no other one holds; it is a candidate of every query.
WHOLE = -1


def smallest_bin(start: Column, stop: Column) -> Column:
    """The smallest bin that holds [start, stop) whole; WHOLE for a range across a border of the largest bins."""
    out = F.when(start.isNotNull() & stop.isNotNull(), F.lit(WHOLE).cast("long"))
    for offset, shift in reversed(LEVELS):
        a, b = F.shiftright(start, shift), F.shiftright(stop - 1, shift)
        out = F.when(a == b, a + offset).otherwise(out)
    return out


def bin_sql(start: str, stop: str) -> str:
    cases = " ".join(f"WHEN ({start} >> {s}) = (({stop} - 1) >> {s}) THEN ({start} >> {s}) + {o}" for o, s in LEVELS)
    return f"CASE {cases} WHEN {start} IS NOT NULL AND {stop} IS NOT NULL THEN {WHOLE} END"


def candidate_bins(start: Column, stop: Column) -> Column:
    """All bins whose ranges may overlap [start, stop)."""
    return F.concat(F.array(F.lit(WHOLE).cast("long")), *(F.sequence(F.shiftright(start, s) + o, F.shiftright(stop - 1, s) + o) for o, s in LEVELS))


def bin_range_join(queries: DataFrame, targets: DataFrame, qs: str, qe: str, start: str, stop: str) -> DataFrame:
    """Pairs of overlapping half-open ranges: an equi-join on bins and a residual filter.

    A target lies in one bin, so no pair is found twice.
    """
    q = queries.withColumn("__bin", F.explode(candidate_bins(F.col(qs), F.col(qe))))
    t = targets.withColumn("__bin", smallest_bin(F.col(start), F.col(stop)))
    return q.join(t, "__bin").where((F.col(start) < F.col(qe)) & (F.col(stop) > F.col(qs))).drop("__bin")
