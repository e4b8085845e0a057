"""Columns whose names clash with those of the operators, tables of nulls and repeated rows."""

import public_tokenizers
import pytest

from cladewise.llm import bpe, exact_dedup, language_model, mixing, ngram_join, quality, sharding, suffix_dedup
from pyspark.sql import functions as F

NAMES = ["bucket", "skey", "kept", "n", "component_id", "keep_id", "shard", "slot", "size", "weight", "probability", "topic", "n_tokens", "tokens", "rows", "q", "level", "first"]
SENTENCE = "the quick brown fox and a lazy dog of the old farm walk to the river that is near"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", SENTENCE, SENTENCE + "  ", SENTENCE + " now", "x y", "\t\n", "other words that have nothing in common with the first line of this table at all"]
    rows = [(k, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "web", None) for k, t in enumerate(texts)]
    rows += [rows[2], (None, SENTENCE, None, None, 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *(F.lit("clash").alias(c) for c in NAMES))


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(None,) * 5] * 3, "doc_id long, text string, lang string, source string, n_chars long")


STAGES = {"quality": quality.quality_filter, "copies": exact_dedup.drop_copies, "near": ngram_join.keep_one_of_each, "mixing": mixing.mix_documents}


@pytest.mark.parametrize("name", STAGES)
def test_filters_keep_columns_and_whole_rows(odd, name):
    out = STAGES[name](odd)
    assert out.columns == odd.columns
    before = [tuple(r) for r in odd.collect()]
    for r in out.collect():
        assert tuple(r) in before and r["kept"] == r["topic"] == "clash"


@pytest.mark.parametrize("name", STAGES)
def test_filters_take_tables_of_nulls(nulls, name):
    assert STAGES[name](nulls).count() <= 3


def test_reports_have_a_row_for_every_row(odd, nulls):
    path = public_tokenizers.path("word_bpe_49k.json")
    reports = [
        quality.quality_report, exact_dedup.dedup_report, ngram_join.jaccard_components, suffix_dedup.remove_repeats,
        mixing.mix_report, lambda d: bpe.bpe_digests(d, path), lambda d: language_model.score_documents(d, rounds=1),
    ]
    for report in reports:
        for docs, n in ((odd, 11), (nulls, 3)):
            assert report(docs).count() == n


def test_copies_go_and_other_texts_stay(odd):
    kept = [r["text"] for r in exact_dedup.drop_copies(odd).collect()]
    assert sorted(t for t in kept if t and t.startswith("the")) == [SENTENCE, SENTENCE + "  ", SENTENCE + " now"]


def test_sharding_takes_clashing_columns(odd):
    placed, _ = sharding.reshard(odd, F.lit(0), 1, 4)
    rows = placed.collect()
    assert len(rows) == 11 and {r["shard"] for r in rows} <= set(range(4))
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_rewritten_files_hold_every_row_once(spark, odd, tmp_path):
    """Repeated rows, nulls and clashing columns come back from the files as they were; an unchanged shard keeps its files."""
    path = str(tmp_path / "files")
    back, changed = sharding.rewrite_affected(odd, F.lit(0), 1, 4, path)
    assert changed == [0, 1, 2, 3]
    files = spark.read.parquet(path)
    whole = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert whole(files.select("row.*").collect()) == whole(odd.collect())
    rows = back.collect()
    assert len(rows) == 11
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert sorted((r["shard"], r["slot"]) for r in files.collect()) == sorted((r["shard"], r["slot"]) for r in rows)
    kept, changed = sharding.rewrite_affected(odd, F.lit(0), 1, 1, str(tmp_path / "none"))
    assert changed == [] and kept.count() == 11
    assert sharding.rewrite_affected(odd.limit(0), F.lit(0), 1, 4)[0].count() == 0


def test_only_affected_shards_change(spark, tmp_path):
    """Two of four shards even out; the files of the others stay byte for byte, and together they hold every row once."""
    from pathlib import Path

    rows = [(k, "x" * (99 if k % 4 == 0 else 19 if k % 4 == 3 else 59), None, "web", k) for k in range(80)] + [(0, "x" * 99, None, "web", 0)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    root, new = str(tmp_path / "root"), str(tmp_path / "new")
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("slot"), (F.col("doc_id") % 4).cast("int").alias("old_shard"), (F.col("doc_id") % 4).cast("int").alias("shard"))
    held.write.partitionBy("shard").parquet(root)
    sizes = [sum(len(r[1]) + 1 for r in rows if r[0] % 4 == s) for s in range(4)]
    total = sum(sizes)
    want = [total - sizes[1] - sizes[2] - sizes[3] - 600, sizes[1], sizes[2], sizes[3] + 600]
    before = {p: p.read_bytes() for s in (1, 2) for p in Path(root, f"shard={s}").glob("*.parquet")}
    back, changed = sharding.rewrite_affected(docs, F.col("doc_id") % 4, 4, 4, new, want)
    assert changed == [0, 3] and back.count() == len(rows)
    found = {r["shard"]: r["size"] for r in back.groupBy("shard").agg(F.sum("size").alias("size")).collect()}
    assert all(abs(found[s] - want[s]) <= 100 for s in range(4))
    sharding.swap_shards(spark, root, new, changed)
    sharding.swap_shards(spark, root, new, changed)
    assert {p: p.read_bytes() for p in before} == before
    after = spark.read.parquet(root)
    whole = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert whole(after.select("row.*").collect()) == whole(docs.collect())


def test_sharding_moves_no_more_than_the_best_of_all_plans():
    """Against every way to deal whole units of bytes from two old shards to three new ones."""
    import itertools

    for supply, capacity in (([5, 4], [3, 3, 3]), ([7, 0], [1, 2, 4]), ([2, 6], [4, 4, 0])):
        flows = sharding.min_cost_flow(supply, capacity)
        best = min(
            sum(x for (i, j), x in zip(itertools.product(range(2), range(3)), f) if i != j)
            for f in itertools.product(*[range(max(supply) + 1)] * 6)
            if [sum(f[:3]), sum(f[3:])] == supply and [f[j] + f[3 + j] for j in range(3)] == capacity
        )
        assert sum(x for (i, j), x in flows.items() if i != j) == best
        assert [sum(x for (i, _), x in flows.items() if i == k) for k in range(2)] == supply


def test_html_takes_odd_pages(spark):
    """Very long and deeply nested pages in time, repeated rows, an empty table and columns with clashing names."""
    import time

    from cladewise.llm import html_text

    began = time.time()
    assert html_text.main_text("<div>" * 100_000 + "word") == "word"
    assert html_text.main_text("<svg>" * 20_000) == ""
    html_text.main_text("<b><div>" * 20_000 + "</b>" * 20_000 + '<a ">' * 20_000)
    assert time.time() - began < 20  # seconds; a second on an idle machine
    page = "<body><p>" + "the one of and to in " * 10 + "</p></body>"
    table = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, "x" * 100_000)], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "n_chars")})
    rows = html_text.extract_pages(table).collect()
    assert len(rows) == 3 and sorted(r["n_chars"] for r in rows)[0] == sorted(r["n_chars"] for r in rows)[1] and max(r["n_chars"] for r in rows) == 100_000
    assert html_text.extract_pages(table.where("false")).count() == 0


def test_html_without_an_article_gives_the_same_text():
    from cladewise.llm import html_text

    body = "<h1>A heading</h1><p>" + "this is the story of a man and his dog in the town " * 3 + "</p><p>Short.</p><p>" + "and then it was the end of all that they had to say " * 3 + "</p>"
    around = '<nav><a href="/">Home</a></nav><div class="ad">Buy now and save a lot of the money.</div>{}<div class="comments">I like the text of this a lot and so do all of my friends in the town.</div><footer>the end</footer>'
    with_mark, without = (html_text.main_text("<html><body>" + around.format(f"<{t}>{body}</{t}>") + "</body></html>") for t in ("article", "div"))
    assert with_mark == without and with_mark.startswith("A heading this") and with_mark.endswith("say") and " Short. " in with_mark


def naive_labels(blocks):
    """The two passes as their docstrings say, with a search over all blocks for each open one."""
    from cladewise.llm import html_text as h

    label, everyone = [h._decide(b, h.STOPS) for b in blocks], range(len(blocks))
    size = lambda own: sum(len(blocks[k].text) for k in own)
    plain = [k for k in everyone if not blocks[k].hints and label[k] != h.BAD]
    hinted = [k for k in everyone if blocks[k].hints and label[k] == h.GOOD]
    decided_plain = [k for k in plain if label[k] == h.GOOD or blocks[k].main and not blocks[k].heading]
    if decided_plain or size(plain) >= size(hinted):
        label = [h.BAD if blocks[k].hints else label[k] for k in everyone]
    inside = [k for k in everyone if blocks[k].main and label[k] != h.BAD]
    marked = any(label[k] == h.GOOD for k in inside) or bool(inside) and size(inside) >= size(k for k in everyone if label[k] == h.GOOD)
    if marked:
        text = any(label[k] == h.GOOD for k in inside)
        label = [h.BAD if not blocks[k].main else label[k] if text else label[k] or h.GOOD for k in everyone]
    else:
        held = {c: size(k for k in everyone if blocks[k].container == c and label[k] != h.BAD) for c in {b.container for b in blocks}}
        label = [h.OPEN if label[k] == h.GOOD and held[blocks[k].container] < h.SMALL * max(held.values()) else label[k] for k in everyone]
        if h.GOOD not in label:
            label = [h.GOOD if label[k] == h.OPEN and 3 * held[blocks[k].container] >= max(held.values()) else label[k] for k in everyone]
    out = []
    for k in everyone:
        before = max((j for j in range(k) if label[j]), default=-1)
        after = min((j for j in range(k + 1, len(blocks)) if label[j]), default=len(blocks))
        ends = {j: label[j] if 0 <= j < len(blocks) else None if marked else h.BAD for j in (before, after)}
        met = [x for x in ends.values() if x is not None]
        near = {x: min((abs(j - k) for j in ends if ends[j] == x), default=None) for x in (h.GOOD, h.BAD)}
        if label[k]:
            out.append(label[k])
        elif all(x == h.GOOD for x in met):
            out.append(h.GOOD)
        elif blocks[k].heading and ends[after] is not None:
            out.append(ends[after])
        elif near[h.GOOD] is None:
            out.append(h.BAD)
        elif marked:
            same = any(ends[j] == h.GOOD and blocks[j].container == blocks[k].container for j in ends)
            out.append(h.GOOD if near[h.GOOD] <= near[h.BAD] or same or near[h.GOOD] + h.APART < near[h.BAD] else h.BAD)
        else:
            same = any(ends[j] == h.GOOD and blocks[j].container == blocks[k].container for j in ends)
            out.append(h.GOOD if same or near[h.GOOD] + h.APART < near[h.BAD] else h.BAD)
    return out


def test_html_labels_against_the_plain_rules():
    import random

    from cladewise.llm import html_text as h

    rng = random.Random(6)
    for _ in range(600):
        blocks, container, kinds = [], 0, rng.choice([(0, 0.4), (0.2, 0.4), (0, 0)])
        for _ in range(rng.randrange(12)):
            words = [rng.choice(["the", "of", "and", "house", "tree", "river"]) for _ in range(rng.choice([1, 3, 14, 30]))]
            text = " ".join(words)
            container += rng.random() < 0.4
            blocks.append(h.Block(text, rng.random() < kinds[1], rng.random() < 0.2, rng.choice([0, 0, len(text)]), container, int(rng.random() < kinds[0])))
        want = naive_labels(blocks)
        assert [b.label for b in h.classify(blocks)] == want


def test_chat_takes_long_texts_and_clashing_columns(spark):
    from cladewise.llm import chat

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    long_text = "some words <|im_end|> and \\<| more of them " * 5000
    table = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", long_text)], "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("ids", "mask", "n_turns")})
    row = chat.conversation_digests(chat.format_turns(table, path), path).first()
    assert (row["n_turns"], row["loss_chars"]) == (2, len(long_text))
