"""Operator 5, quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, let, text_or_empty

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Very common words of the four languages of the corpus.
STOP_WORDS = tuple(
    "the of and to in a is that it on for was be with as this by at are an from not or "
    "le la les de des et un une du en que qui pour dans est sur au pas avec par "
    "der die das und den von zu mit ist ein eine im für nicht sich auf dem "
    "el los las y se por con para su lo como del es".split()
)


@dataclass(frozen=True)
class Rule:
    """100 * measure must lie within [low, high] * base; documents under ``from_words`` words are exempt."""

    measure: str
    base: str
    low: int | None = None
    high: int | None = None
    from_words: int = 0


RULES = (
    Rule("word_chars", "n_words", 200, 1400),
    Rule("n_symbols", "n_words", None, 10),
    Rule("n_exclaims", "n_words", None, 50),
    Rule("n_stop_words", "n_words", 1, None, 100),
    Rule("n_dup_lines", "n_lines", None, 50, 20),
    Rule("n_bullet_lines", "n_lines", None, 90, 20),
    Rule("n_ellipsis_lines", "n_lines", None, 30, 20),
)


def _long(value: Column) -> Column:
    return value.cast("long")


def _repeated(words: Column) -> Column:
    """Words inside windows of five words that occur twice or more, the first occurrence included."""

    def covered(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(
            by_hash,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda p, i: F.coalesce(F.get(s, i - 1)["h"] == p["h"], F.lit(False))
                        | F.coalesce(F.get(s, i + 1)["h"] == p["h"], F.lit(False)),
                    ),
                    lambda p: p["i"],
                )
            ),
        )
        steps = let(starts, lambda d: F.transform(d, lambda v, i: F.least(F.lit(WINDOW), F.coalesce(F.get(d, i + 1) - v, F.lit(WINDOW)))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)),
        lambda i: F.xxhash64(*(F.element_at(words, i + k) for k in range(WINDOW))),
    )
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(
        let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    )


def _measures(text: Column) -> Column:
    """All counts of one text as a struct."""
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda ws, keep: F.size(F.filter(ws, keep))
    length = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    stop = F.array(*map(F.lit, STOP_WORDS))
    return let(
        F.struct(words.alias("w"), lines.alias("l")),
        lambda t: F.struct(
            _long(F.size(t["w"])).alias("n_words"),
            _long(F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))).alias("word_chars"),
            _long(length(SYMBOLS)).alias("n_symbols"),
            _long(F.size(t["l"]) - F.size(F.array_distinct(t["l"]))).alias("n_dup_lines"),
            _long(_repeated(t["w"])).alias("n_repeat_words"),
            _long(F.size(t["l"])).alias("n_lines"),
            _long(length("!")).alias("n_exclaims"),
            _long(count(t["w"], lambda w: F.array_contains(stop, F.lower(w)))).alias("n_stop_words"),
            _long(count(t["l"], lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).alias("n_bullet_lines"),
            _long(count(t["l"], lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).alias("n_ellipsis_lines"),
        ),
    )


def compile_rules(rules: tuple[Rule, ...], of) -> Column:
    """The table of thresholds as one boolean column over the measures."""
    verdict = F.lit(True)
    for rule in rules:
        value, base = of(rule.measure) * 100, of(rule.base)
        if rule.low is not None:
            verdict &= (of("n_words") < rule.from_words) | (value >= base * rule.low)
        if rule.high is not None:
            verdict &= (of("n_words") < rule.from_words) | (value <= base * rule.high)
    return verdict


def quality_columns(text: str | Column = "text", rules: tuple[Rule, ...] = RULES) -> Column:
    """Measures, ``base_failed`` and ``kept`` of one text, as a struct column.

    A null text counts as empty and fails; texts of any length are read whole; equal rows get equal
    results. Windows of five words are compared by 64-bit hashes inside one text.
    """
    return let(
        _measures(text_or_empty(text)),
        lambda m: let(
            (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"]),
            lambda failed: F.struct(
                *(m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                failed.alias("base_failed"),
                (~failed & compile_rules(rules, lambda c: m[c])).alias("kept"),
            ),
        ),
    )


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, the base counts, ``base_failed`` and ``kept``. No shuffle; rows stay as many as they came."""
    return docs.select("doc_id", quality_columns(docs["text"], rules).alias("q")).select("doc_id", "q.*")


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with all their columns, whatever their names are."""
    return docs.where(quality_columns(docs["text"], rules)["kept"])


def _sql_list(words) -> str:
    return "(" + ",".join(f"'{w}'" for w in words) + ")"


def _sql_rules() -> str:
    parts = []
    for r in RULES:
        for bound, op in ((r.low, ">="), (r.high, "<=")):
            if bound is not None:
                parts.append(f"(n_words < {r.from_words} OR 100 * {r.measure} {op} {bound} * {r.base})")
    return " AND ".join(parts)


#: The same report for DuckDB.
REPORT_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT rid, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
d AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt
      FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n FROM d GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
             len(l) AS n_lines, length(text) - length(replace(text, '!', '')) AS n_exclaims,
             len(list_filter(w, lambda x: lower(x) IN {_sql_list(STOP_WORDS)})) AS n_stop_words,
             len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{{2022}}]'))) AS n_bullet_lines,
             len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines
      FROM t JOIN w USING (rid) LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_sql_rules()} AS kept FROM b
"""
