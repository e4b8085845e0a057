"""The training-data operators against brute force on a small fixture of nulls, ties, copies and long texts."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cladewise.llm import bpe, chat, exact_dedup, html_text, language_model, mixing, ngram_join, quality, sharding, suffix_dedup
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, key long, uid long"


def texts():
    rng = random.Random(3)
    words = ["the", "of", "and", "La", "maison", "est", "grande", "Haus", "über", "tree", "node", "alpha", "beta", "γάμμα"]
    long_text = " ".join(rng.choice(words) + str(rng.randrange(300)) for _ in range(3000))
    out = [None, "", " \n\t ", "one two", "a b c d", "same  text\nhere now", "same text here now", "x" * 700, "ab " * 400, long_text, long_text]
    for k in range(12):
        base = [rng.choice(words) + str(rng.randrange(50)) for _ in range(120)]
        out.append(" ".join(base))
        for _ in range(3):
            near = list(base)
            near[rng.randrange(120)] = f"w{rng.randrange(1000)}"
            out.append(" ".join(near))
        out.append(long_text[k * 50 : k * 50 + 300] + f" tail {k}")
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 0 else "en", f"s{i % 3 if i % 2 else 0}", i, "n", 1, 2) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(frame):
    return {r["doc_id"]: r.asDict() for r in frame.collect()}


def sql(docs, text):
    con = duckdb.connect()
    documents = docs.select("doc_id", "text").toPandas()
    con.register("documents", documents)
    return {r[0]: r for r in con.sql(text).fetchall()}


def test_exact_dedup(docs, empty):
    want = sql(docs, f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({exact_dedup.REPORT_SQL})")
    got = {r["doc_id"]: tuple(r) for r in exact_dedup.dedup_report(docs, block=64).collect()}
    assert got == want
    assert exact_dedup.dedup_report(empty).count() == 0
    again = docs.unionByName(docs.where("doc_id < 20"))
    assert exact_dedup.drop_copies(again).select("doc_id").distinct().count() == exact_dedup.drop_copies(again).count() == sum(r[3] for r in want.values())


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b", None, None, None, None, None, None), (5, "a b", None, None, None, None, None, None), (5, "a b", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = exact_dedup.dedup_report(df).collect()
    found = collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got)
    assert found == collections.Counter([(None, 5, 3, False), (5, 5, 3, True), (5, 5, 3, False), (None, None, 1, True)])
    assert sum(r["kept"] for r in got) == 2
    for report in (quality.quality_report, ngram_join.jaccard_components, suffix_dedup.remove_repeats, language_model.score_documents, mixing.mix_report):
        assert report(df).count() == 4


def test_quality(docs, empty):
    want = sql(docs, quality.REPORT_SQL)
    got = {r["doc_id"]: tuple(r) for r in quality.quality_report(docs).collect()}
    assert got == want
    assert quality.quality_filter(docs).columns == docs.columns
    assert quality.quality_report(empty).count() == 0


def test_ngram_join(docs, empty):
    want = sql(docs, ngram_join.REPORT_SQL)
    got = {r["doc_id"]: tuple(r) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == want
    assert ngram_join.jaccard_components(empty).count() == 0
    assert ngram_join.keep_one_of_each(docs).count() == sum(r[0] == r[2] for r in want.values())


def test_ngram_join_of_large_tiles_and_hot_shingles(spark, docs, monkeypatch):
    """Every tile in blocks of two, one partner named at a time, and frequent shingles beside the counting shuffle."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 2)
    monkeypatch.setattr(ngram_join, "NAMED", 1)
    monkeypatch.setattr(ngram_join, "EARLY_ROUNDS", 1)
    monkeypatch.setattr(ngram_join, "PAIR_DOCS", 0)
    rng = random.Random(8)
    shared = [f"s{k}" for k in range(30)]
    rows = []
    for k in range(60):  # most words are everybody's, so that the first shingles are too; some pairs link and some don't
        own = list(shared)
        for _ in range(rng.choice([0, 1, 1, 2])):
            own[rng.randrange(30)] = f"v{rng.randrange(6)}"
        rows.append((1000 + k, " ".join(own[: rng.randrange(22, 31)])))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    want = sql(both, ngram_join.REPORT_SQL)
    for least, seen in ((3, 2), (10_000, 8)):
        assert {r["doc_id"]: tuple(r) for r in ngram_join.jaccard_components(both, hot_least=least, seen=seen).collect()} == want


def test_one_of_each_component_stays(spark):
    base = " ".join(f"w{k}" for k in range(40))
    rows = [(3, base), (5, base + " tail"), (5, "an unrelated text of some more words than five"), (None, base + " end"), (None, "words of its own that no other row of the table has"), (7, base), (7, base), (9, None), (9, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r["doc_id"], r["text"]) for r in ngram_join.keep_one_of_each(table).collect()), key=repr)
    assert kept == sorted([rows[0], rows[2], rows[4], rows[7], rows[8]], key=repr)
    twice = table.where("doc_id = 7")
    assert ngram_join.keep_one_of_each(twice).count() == 1


def test_suffix_dedup(docs, empty):
    data = {r["doc_id"]: (r["text"] or "").encode() for r in docs.select("doc_id", "text").collect()}
    seen = collections.Counter(t[i : i + 200] for t in data.values() for i in range(len(t) - 199))
    got = by_id(suffix_dedup.remove_repeats(docs))
    for d, t in data.items():
        covered = [False] * len(t)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                covered[i : i + 200] = [True] * 200
        spans = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        sha = hashlib.sha256(bytes(b for b, c in zip(t, covered) if not c)).hexdigest()
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["n_spans"], got[d]["kept_sha256"]) == (len(t), sum(covered), spans, sha)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_blind_trie_sorts():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(300)]
    assert [strings[k] for k in suffix_dedup.BlindTrie(strings).ordered()] == sorted(strings)


def test_bpe(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    extra = docs.sparkSession.createDataFrame([(1000, "<|endoftext|>Don't STOP <|startoftext|> 123 é\u0301 ΑΣ <|x"), (1001, None)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    got = by_id(bpe.bpe_digests(rows, path))
    for r in rows.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        back = tok.decode(ids, skip_special_tokens=False).encode()
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest())
    long_word = docs.sparkSession.createDataFrame([(1, "ab" * 30_000), (1, "ab" * 30_000)], "doc_id long, text string").withColumn("ids", F.lit(1))
    ids = tok.encode("ab" * 30_000, add_special_tokens=False).ids
    assert {r["n_tokens"] for r in bpe.bpe_digests(long_word, path).collect()} == {len(ids)}
    assert bpe.bpe_digests(long_word.where("false"), path).count() == 0
    round_trip = bpe.decode_documents(bpe.encode_documents(extra, path), path).where("doc_id = 1001").first()
    assert round_trip["text"] == ""


def test_chat(spark):
    rows = [(1, 1, "assistant", "<|im_end|> <\\| \\<|x"), (1, 0, "user", None), (2, 0, None, "hi"), (2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (None, 3, "user<|im_sep|>", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_turns(df, path), path).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256("user\n\nassistant\n<|im_end|> <\\| \\<|x\n".encode()).hexdigest()
    assert (got[1]["loss_chars"], got[1]["n_turns"]) == (len(rows[0][3]), 2)
    assert got[2]["loss_sha256"] == hashlib.sha256(b"samesame").hexdigest()
    assert got[None]["turns_sha256"] == hashlib.sha256(b"user<|im_sep|>\n\n").hexdigest()
    assert chat.conversation_digests(chat.format_turns(df.where("false"), path), path).count() == 0
    for text in ("<|", "<\\|", "<\\\\|", "a<|b|>"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_html(spark):
    page = "<html><nav>menu</nav><script>'</p>'</script><article><h1>T&amp;t</h1><p>One  <b>two</b>three<p>Short.<div class='comments'>bad</div></article><footer>f</footer>"
    assert html_text.main_text(page) == "T&t One twothree Short."
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    assert [(r["page_id"], r["n_chars"]) for r in html_text.extract_pages(df).orderBy("page_id").collect()] == [(1, 23), (2, 0), (3, 0)]


def test_sharding(docs, empty):
    placed, plan = sharding.reshard(docs, F.col("doc_id") % 3, 3, 4)
    rows = placed.collect()
    assert len(rows) == docs.count()
    sizes = collections.defaultdict(int)
    slots = collections.defaultdict(list)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)
    supply = collections.Counter()
    for r in rows:
        supply[r["old_shard"]] += r["size"]
    share = sharding.equal_capacities(sum(supply.values()), 4)
    stays = sum(min(supply[k], share[k]) for k in range(3))
    assert plan.moved == sum(supply.values()) - stays  # no plan can move less
    assert sharding.reshard(empty, F.lit(0), 1, 4)[0].count() == 0


def test_mixing(docs, empty):
    rows = mixing.mix_report(docs).collect()
    cells = collections.defaultdict(float)
    for r in rows:
        cells[r["source"], r["lang"], r["topic"]] += r["n_tokens"]
    total = sum(cells.values())
    w, targets = dict(cells), []
    for d in range(3):
        present = collections.defaultdict(float)
        for k, v in cells.items():
            present[k[d]] += v
        share = {k: (v / total) ** mixing.TEMPER for k, v in present.items() if v}
        targets.append({k: v / sum(share.values()) * total for k, v in share.items()})
    for _ in range(2000):
        for d in range(3):
            now = collections.defaultdict(float)
            for k, v in w.items():
                now[k[d]] += v
            w = {k: v * targets[d][k[d]] / now[k[d]] if now[k[d]] else 0.0 for k, v in w.items()}
    most = max(w[k] / cells[k] for k in cells if cells[k])
    for r in rows:
        k = r["source"], r["lang"], r["topic"]
        want = w[k] / cells[k] / most if cells[k] else 1.0
        assert math.isclose(r["probability"], want, rel_tol=1e-6, abs_tol=1e-12) and r["gap"] <= mixing.TOLERANCE
    kept = {r["doc_id"] for r in rows if r["selected"]}
    assert {r["doc_id"] for r in mixing.mix_documents(docs).collect()} == kept
    assert mixing.mix_report(empty).count() == 0


def test_mixing_by_shuffles_gives_the_same(docs, monkeypatch):
    rows = {r["doc_id"]: round(r["probability"], 9) for r in mixing.mix_report(docs).collect()}
    monkeypatch.setattr(mixing, "SMALL_CELLS", 0)
    assert {r["doc_id"]: round(r["probability"], 9) for r in mixing.mix_report(docs).collect()} == rows


def test_topics_part_vocabularies(spark):
    """Two vocabularies with some words in common: no topic holds documents of both."""
    rng = random.Random(4)
    words = [[f"alpha{k}word" for k in range(12)], [f"omega{k}term" for k in range(12)]]
    rows = [(k, " ".join(rng.choice(words[k % 2]) if rng.random() < 0.9 else "common" for _ in range(400)), "en", "web") for k in range(40)]
    found = {r["doc_id"]: r["topic"] for r in mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not {found[k] for k in range(0, 40, 2)} & {found[k] for k in range(1, 40, 2)}


def test_language_model(docs, empty):
    got = by_id(language_model.score_documents(docs, rounds=2))
    words = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")) + [None] for r in docs.select("doc_id", "text").collect()}
    c = collections.Counter()
    for d, w in words.items():
        if zlib.crc32(str(d).encode()) % 7 != 2:
            c.update(w)
    n, v = sum(c.values()), len(c)
    for d, w in words.items():
        g = got[d]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(g["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert g["score"] < 0
    assert language_model.score_documents(empty).count() == 0


def test_language_model_learns_from_every_training_document(spark):
    """Words that only documents outside one eighth of the hash hold are frequent, and the network knows their order."""
    eighth = F.pmod(F.xxhash64(F.lit(3), F.col("id")), F.lit(8)) == 0
    text = F.when(eighth, F.repeat(F.lit("red green blue "), 30)).otherwise(F.repeat(F.lit("zig zag zog zug "), 30))
    got = language_model.score_documents(spark.range(600).select(F.col("id").alias("doc_id"), text.alias("text"))).where("held_out")
    rows = got.join(spark.range(600).select(F.col("id").alias("doc_id"), eighth.alias("eighth")), "doc_id").collect()
    own = [r for r in rows if not r["eighth"]]
    assert own and all(r["score"] > r["base_score"] for r in own)
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_gradients_match_differences():
    import numpy as np

    rng = np.random.default_rng(0)
    p = {k: rng.normal(0, 0.3, s) for k, s in language_model.SHAPES.items()}
    given, target = rng.integers(0, language_model.INPUTS, (4, 3)), rng.integers(0, language_model.INPUTS, (4, 3))
    h = rng.normal(0, 0.3, (3, language_model.HIDDEN))
    g, _, loss = language_model.gradients(p, given, target, h)
    for k in ("wh", "wx", "emb", "wc", "wi", "b"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        moved = {x: v.copy() for x, v in p.items()}
        moved[k][at] += 1e-4
        assert abs((language_model.gradients(moved, given, target, h)[2] - loss) / 1e-4 - g[k][at]) < 2e-3


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    base = docs.where(F.col("doc_id").isin([r["doc_id"] for r in quality.quality_report(docs).where("kept").collect()]))
    base = base.where(F.col("doc_id").isin([r[0] for r in sql(base, exact_dedup.REPORT_SQL).values() if r[3]]))
    base = base.where(F.col("doc_id").isin([r[0] for r in sql(base, ngram_join.REPORT_SQL).values() if r[0] == r[2]]))
    assert got == {r["doc_id"] for r in mixing.mix_report(base).where("selected").collect()}


def test_rounds_take_only_the_named_sets_along(spark, monkeypatch):
    """Few pairs of a round do not move the shingles of all sets; many do, once."""
    from cladewise.llm import ngram_join
    from cladewise.llm.common import Scratch

    rows = [(k, 4, bytes(8 * 4)) for k in range(100)]
    sets = spark.createDataFrame(rows, "skey long, n long, shared binary")
    few = spark.createDataFrame([(1, 5), (1, 7), (5, 9)], "a long, b long")
    scratch = Scratch(spark, "needed-test")
    assert sorted(r["skey"] for r in ngram_join._needed(few, sets, scratch).collect()) == [1, 5, 7, 9]
    many = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long")
    assert ngram_join._needed(many, sets, scratch) is sets
    # rounds over large tiles: the sets that are compared are those of the round's pairs, and no link is lost
    rng, shared, docs = random.Random(8), [f"s{k}" for k in range(30)], []
    for d in range(30):
        own = list(shared)
        for _ in range(rng.choice([0, 1, 1, 2])):
            own[rng.randrange(30)] = f"v{rng.randrange(6)}"
        docs.append((d, " ".join(own[: rng.randrange(22, 31)])))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(map(tuple, ngram_join.jaccard_components(table).collect()))
    verified, taken = ngram_join._verified, []
    rounds = ngram_join._joined_by_rounds

    def noted(pairs, own, limit):
        taken.append((pairs.count(), own.count()))
        return verified(pairs, own, limit)

    def noting(*args):
        monkeypatch.setattr(ngram_join, "_verified", noted)
        try:
            return rounds(*args)
        finally:
            monkeypatch.setattr(ngram_join, "_verified", verified)

    monkeypatch.setattr(ngram_join, "NEEDED_SHARE", 0)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 2)
    monkeypatch.setattr(ngram_join, "NAMED", 1)
    monkeypatch.setattr(ngram_join, "EARLY_ROUNDS", 1)
    monkeypatch.setattr(ngram_join, "PAIR_DOCS", 0)
    monkeypatch.setattr(ngram_join, "_joined_by_rounds", noting)
    assert sorted(map(tuple, ngram_join.jaccard_components(table).collect())) == want
    assert taken and all(own <= 2 * pairs for pairs, own in taken)


def test_hot_shingles_leave_the_order_of_others_alone():
    """Sets that share the same shingles take the same ones first, wherever hot shingles lie among their rows."""
    import numpy as np
    import pyarrow as pa

    values = np.arange(1, 9, dtype=np.uint64) << np.uint64(16)
    keys, sizes = np.arange(100, 140, dtype=np.uint64), np.full(40, 8, np.uint32)
    doc, sent = np.repeat(np.arange(40), 8), np.tile(values, 40)
    cold = [(0, False, *r[1:]) for r in ngram_join._pack(np.zeros(320, np.int32), doc, keys, sizes, [sent.view(np.uint8).reshape(-1, 8)[:, 2:]])]
    few = np.arange(0, 40, 3)
    hot = [(0, True, *r[1:]) for r in ngram_join._pack(np.zeros(len(few), np.int32), few, keys, sizes, [np.full(len(few), 99, np.uint64)])]
    names = ["bucket", "hot", "keys", "sizes", "counts", "values"]
    back = ngram_join._shared(1)((pa.scalar(0),), pa.table({c: [r[k] for r in cold + hot] for k, c in enumerate(names)}))
    # the rows of the hot shingle may come first
    back = ngram_join._candidates(75)(back.take(list(range(len(back)))[::-1]))
    assert len(back) == 40
    assert {tuple(p[:1]) for p in back["prefix"].to_pylist()} == {(int(values[0]),)}


def test_ngram_join_moves_whole_only_sets_that_may_link(spark, monkeypatch):
    """Texts of their own leave after the part of their shingles; with any filter and part the links are those of SQL."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    alone = [[word() for _ in range(200)] for _ in range(60)]
    near = []
    for _ in range(6):
        base = ["the", "same", "six", "words", "start", "all"] + [word() for _ in range(rng.choice([3, 8, 40, 150]))]
        for _ in range(4):
            own = list(base)
            own[rng.randrange(6, len(own))] = word()
            near.append(own)
    table = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate([*alone, *near, *near[:5]])], "doc_id long, text string")
    want = {k: tuple(r) for k, r in sql(table, ngram_join.REPORT_SQL).items()}
    assert any(r[0] != r[2] for r in want.values())
    buckets, passed = ngram_join._shingle_buckets, []

    def noted(docs, size, count, hot, bits):
        out = buckets(docs, size, count, hot, bits)
        keys = [k for r in out.select("hot", "keys").collect() if not r["hot"] for k in (r["keys"][i : i + 8] for i in range(0, len(r["keys"]), 8))]
        passed.append(len(set(keys)))
        return out

    monkeypatch.setattr(ngram_join, "_shingle_buckets", noted)
    got = lambda **more: {r["doc_id"]: tuple(r) for r in ngram_join.jaccard_components(table, **more).collect()}
    assert got() == want
    assert passed[0] <= len(near) + 6, "most texts without a partner go no further"
    monkeypatch.setattr(ngram_join, "PART_BUCKET", 50)
    monkeypatch.setattr(ngram_join, "WHOLE_BUCKET", 50)
    assert got(hot_least=3, seen=1) == want
    monkeypatch.setattr(ngram_join, "MOST_BITS", 0)
    monkeypatch.setattr(ngram_join, "PART_SHARE", 1.0)
    assert got() == want
