"""A tree's likelihood as terms over sets of leaves, before any letter is seen, and their expansion for the columns of an alignment.

Inner branches mutate or not. Leaves that stay joined to one origin by branches which don't are a set; a term is a set of such sets with the
probability of its branches. The terms depend on the tree alone and number at most two to the power of its inner branches, so they go to every task. A set's factor depends
on its leaves' letters: each leaf has its own branch, and those that don't mutate there share the origin's letter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .trees import Node, Poly, _add, _times, leaves, parse_newick

Term = frozenset[int]
TERMS = "term int, weight double, sets array<long>"
EXPANDED = "codes array<int>, n long, exponents array<int>, coefficient double"


def reduced_terms(root: Node, taxa: list[str]) -> dict[Term, float]:
    """Probability of each way to part the leaves into sets; a set is a mask of places in ``taxa``."""
    place = {t: 1 << k for k, t in enumerate(taxa)}

    def below(n: Node) -> dict[tuple[Term, int], float]:
        """By complete sets and the leaves that are still joined to ``n``."""
        if not n.children:
            return {(frozenset(), place[n.name]): 1.0}
        out: dict[tuple[Term, int], float] = {(frozenset(), 0): 1.0}
        for c in n.children:
            grown: dict[tuple[Term, int], float] = {}
            for (done, joined), x in out.items():
                for (more, also), y in cut(c).items():
                    key = (done | more, joined | also)
                    grown[key] = grown.get(key, 0.0) + x * y
            out = grown
        return out

    def cut(n: Node) -> dict[tuple[Term, int], float]:
        """``below``, behind the branch to the parent; a leaf's own branch belongs to its set's factor."""
        own = below(n)
        if not n.children:
            return own
        p, out = -math.expm1(-n.d), {}
        for (done, joined), x in own.items():
            for key, share in (((done, joined), 1 - p), ((done | {joined} if joined else done, 0), p)):
                if share:
                    out[key] = out.get(key, 0.0) + x * share
        return out

    found: dict[Term, float] = {}
    for (done, joined), x in below(root).items():
        term = done | {joined} if joined else done
        found[term] = found.get(term, 0.0) + x
    return found


def set_factor(letters: tuple[int, ...], mutated: tuple[float, ...], alphabet: int) -> Poly:
    """The factor of one set whose leaves have these letters (-1: missing) and these chances of a mutation on their own branches."""
    zero = (0,) * alphabet
    unit = [tuple(int(i == k) for i in range(alphabet)) for k in range(alphabet)]
    known = [(x, p) for x, p in zip(letters, mutated) if x >= 0]
    alone = lambda own: _product([{unit[x]: p} for x, p in own], zero)
    out = [alone(known)]
    for k in sorted({x for x, _ in known}):
        same, rest = [(x, p) for x, p in known if x == k], [(x, p) for x, p in known if x != k]
        kept = _add(_product([{unit[k]: p, zero: 1 - p} for _, p in same], zero), _times(alone(same), {zero: 1.0}, -1.0))
        out.append(_times(_times(kept, alone(rest), 1.0), {unit[k]: 1.0}, 1.0))
    return _add(*out)


def _product(factors: list[Poly], zero: tuple[int, ...]) -> Poly:
    out: Poly = {zero: 1.0}
    for f in factors:
        out = _times(out, f, 1.0)
    return out


def term_table(spark: SparkSession, newick: str, taxa: list[str]) -> DataFrame:
    """(term, weight, sets): the reduced terms as rows, likeliest first."""
    terms = sorted(reduced_terms(parse_newick(newick), taxa).items(), key=lambda x: (-x[1], sorted(x[0])))
    return spark.createDataFrame([(k, w, sorted(s)) for k, (s, w) in enumerate(terms)], TERMS)


def expanded_columns(patterns: DataFrame, newick: str, taxa: list[str], alphabet: int) -> DataFrame:
    """(codes, n, exponents, coefficient): the polynomial of each distinct column (codes, n), one row a term of it, expanded from the reduced terms.

    A set's factor is remembered by its leaves' letters. A column without known letters has the constant 1; an empty table gives no rows.
    """

    def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = parse_newick(newick)
        terms = reduced_terms(root, taxa)
        chance = {x.name: -math.expm1(-x.d) for x in leaves(root)}
        members = {s: [k for k in range(len(taxa)) if s >> k & 1] for term in terms for s in term}
        zero = (0,) * alphabet

        @lru_cache(maxsize=100_000)
        def factor(s: int, letters: tuple[int, ...]) -> Poly:
            return set_factor(letters, tuple(chance[taxa[k]] for k in members[s]), alphabet)

        for batch in batches:
            rows = []
            for codes, n in zip(*(c.to_pylist() for c in batch.columns)):
                parts = [_times(_product([factor(s, tuple(codes[k] for k in members[s])) for s in term], zero), {zero: 1.0}, w) for term, w in terms.items()]
                rows += [(codes, n, list(e), c) for e, c in _add(*parts).items()]
            kinds = [pa.list_(pa.int32()), pa.int64(), pa.list_(pa.int32()), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["codes", "n", "exponents", "coefficient"])

    return patterns.select("codes", F.col("n").cast("long").alias("n")).mapInArrow(expanded, EXPANDED)
