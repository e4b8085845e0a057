"""Token alignment, MinHash near-duplicates and spelling variants against brute force, on nulls, ties, repeated rows, odd and long texts."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cladewise.llm import minhash, ngram_join, spelling, token_alignment

SCHEMA = "doc_id long, text string, word string, n long, unit string"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "w", 1, "u") for i, t in enumerate(texts)], SCHEMA)


def odd_texts(n=250):
    rng = random.Random(4)
    parts = ["a", "the", "The", "é", "日本", "\n", " ", "  ", "\t", "▁", "<|endoftext|>", "<0x41>", "'s", "12", " ", " ", "\x1c", "!", "...", "🙂", "\r\n", "ﬁ", "\x85", "\0", "word", " and", "\nNext"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(n)]
    return [None, "", " ", "\n", "a", "a ", " a", "word\nNext line. More", "x" * 500, "ab " * 3000, "the word, the word", "the word, the word", *out]


def plain_alignment(texts):
    """Ids by the libraries; groups from the positions where both sides' tokens end."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    code = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}
    rows = []
    for text in texts:
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw = [[bytes(code[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids[1])]]
        if not text or any(b"".join(r) != (" " + text).encode() for r in raw):
            rows.append(([], [], []))
            continue
        ends = [np.cumsum([len(x) for x in r]).tolist() for r in raw]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        rows.append((*ids, [(ends[0].index(c) + 1, ends[1].index(c) + 1) for c in cuts]))
    counts = collections.Counter((a[x - 1], b[y - 1]) for a, b, cuts in rows for x, y in cuts)
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for a, b, cuts in rows:
        links, i, j, shown = [(a[x - 1], b[y - 1]) for x, y in cuts], 0, 0, []
        for x, y in cuts:
            shown.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        digest = hashlib.sha256(";".join(shown).encode()).hexdigest() if cuts else ""
        out.append((len(a), len(b), len(cuts), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out, rows


def test_token_alignment(spark):
    texts = odd_texts()
    want, rows = plain_alignment(texts)
    got = {r["doc_id"]: tuple(r)[1:] for r in token_alignment.alignment_report(frame(spark, texts), A, B).collect()}
    assert got == dict(enumerate(want))
    assert sum(w[0] > 0 for w in want) > 80 and sum(w[0] == 0 for w in want) > 80
    tokens = {r["doc_id"]: r for r in token_alignment.aligned_tokens(frame(spark, texts), A, B).collect()}
    for k, (a, b, cuts) in enumerate(rows):
        r = tokens[k]
        assert (r["a_ids"], r["b_ids"], list(zip(r["a_ends"], r["b_ends"]))) == (a, b, cuts)
    assert token_alignment.alignment_report(frame(spark, []), A, B).count() == 0


def test_units_are_forgotten_without_a_trace(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "REMEMBERED", 5)
    monkeypatch.setattr(token_alignment, "TOGETHER", 3)
    both, texts = token_alignment.Aligner(A, B), [t for t in odd_texts() if t]
    whole = token_alignment.Aligner(A, B)
    whole.apart = False  # every text is one unit
    for k in range(0, len(texts), 7):
        part = texts[k : k + 7]
        shown = [[b";".join(u[3] for u in units) if units else None for units in x.align(part)] for x in (both, whole)]
        assert shown[0] == shown[1]


def test_transducer_flips_sides():
    t = token_alignment.Transducer(([b"ab", b"c", b"abc"], [b"a", b"bc", b"abca", b"b"]))
    assert t.groups([0, 1], [0, 1]) == ([2], [2])
    assert t.groups([2, 0, 1], [2, 1]) == ([3], [2])
    assert t.groups([0], [0, 3]) == ([1], [2])
    assert t.groups([0], [0]) is None and t.groups([0], [1]) is None and t.groups([0], [0, 3, 0]) is None
    assert t.groups([], []) == ([], [])


def near_texts():
    rng = random.Random(6)
    out = [None, "", " \n", "one two", "One  TWO", "a b c d e", "a b c d e", "x" * 700]
    for k in range(10):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 30, 90, 200]))]
        out.append(" ".join(base))
        for changes in (1, 1, 2, 3, 5):
            near = list(base)
            for _ in range(changes):
                near[rng.randrange(len(near))] = f"v{rng.randrange(1000)}"
            out.append(" ".join(near))
    chain = [f"c{k}" for k in range(120)]
    out += [" ".join(chain[3 * k : 3 * k + 80]) for k in range(12)]  # each links with its neighbours alone
    shared = [f"s{k}" for k in range(40)]
    out += [" ".join(shared[: rng.randrange(28, 41)] + [f"u{rng.randrange(6)}" for _ in range(rng.randrange(4))]) for _ in range(60)]
    return out


def components_by_sql(texts):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    return {r[0]: tuple(r) for r in con.sql(minhash.REPORT_SQL).fetchall()}


@pytest.mark.parametrize("blocks", [1024, 2])
def test_minhash(spark, monkeypatch, blocks):
    """In whole tiles, and in blocks of two documents."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", blocks)
    texts = near_texts()
    want = components_by_sql(texts)
    got = {r["doc_id"]: tuple(r) for r in minhash.near_duplicates(frame(spark, texts)).collect()}
    assert got == want
    assert len({r[2] for r in want.values()}) < len(texts) - 40


def test_minhash_of_odd_rows(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(None, base), (4, base), (4, base), (2, base + " tail"), (None, "words of its own that no other row has at all"), (None, None), (7, "")]
    got = collections.Counter(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == collections.Counter([(None, 56, 2, False), (4, 56, 2, False), (4, 56, 2, False), (2, 57, 2, True), (None, 7, None, True), (None, 0, None, True), (7, 0, 7, True)])


def test_posterior_bounds():
    """The closed form equals the integral of the posterior, and true pairs are hardly ever given up."""
    grid = (np.arange(200_000) + 0.5) / 200_000
    t = 0.85 + 0.15 / 256
    for n in (24, 72, 216):
        m = minhash.least_matches(0.85, n)
        for k, kept in ((m, True), (m - 1, False)):
            density = np.exp(k * np.log(grid) + (n - k) * np.log1p(-grid))
            assert (density[grid >= t].sum() / density.sum() >= minhash.MISS) == kept
    rng = np.random.default_rng(1)
    bars = minhash._bars(85, minhash.MISS)
    one = rng.integers(0, 256, minhash.HASHES).astype(np.uint8)
    true, false = (np.where(rng.random((20_000, minhash.HASHES)) < s, one, one + 1 + rng.integers(0, 255, (20_000, minhash.HASHES))).astype(np.uint8) for s in (0.85, 0.4))
    assert len(minhash.survivors(one, true, bars)[0]) == 20_000
    assert len(minhash.survivors(one, false, bars)[0]) == 0


def test_minima_estimate_similarity():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    both = np.concatenate([np.sort(x[:2000]), np.sort(x[500:]), np.zeros(0, np.uint64)])
    least = minhash.minima(both, np.array([0, 2000, 4500, 4500]))
    assert abs((least[0] == least[1]).mean() - 1500 / 3000) < 0.12
    assert (least[2] == 0xFFFFFFFF).all() and minhash.band_keys(least).shape == (3, minhash.BANDS)


def plain_variants(docs):
    counts = collections.Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, {}
    for w, n in words.items():
        close = [v for v in words if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
        out[w] = (n, len(close), form[w], words[best] if form[w] else None)
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] += (root,)
    return out


def spelled(seed=9, n=120):
    rng = random.Random(seed)
    bases = ["maison", "häuser", "colour", "ÉCOLE", "aaaaab", "abcdefghij", "Straße", "running", "naïveté", "q×q÷qq"]
    docs = [(0, None), (1, ""), (2, "a bb ccc dddd 12345 !!"), (None, "maison maison häuser")]
    for k in range(n):
        words = []
        for _ in range(rng.randrange(1, 40)):
            w = rng.choice(bases[: 2 + rng.randrange(9)])
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                i, c = rng.randrange(len(w)), rng.choice("aeéx")
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]]) or "a"
            words.append(w)
        docs.append((10 + k, rng.choice([" ", ", ", "\n"]).join(words)))
    return docs + docs[-2:]  # rows repeat


@pytest.mark.parametrize("most_bits", [1 << 30, 1 << 16])
def test_spelling(spark, monkeypatch, most_bits):
    """With the usual filter, and with one that passes many strings that are no words."""
    monkeypatch.setattr(spelling, "MOST_BITS", most_bits)
    docs = spelled()
    want = plain_variants(docs)
    got = {r["word"]: tuple(r)[1:] for r in spelling.variant_groups(spark.createDataFrame([(*d, "w", 1, "u") for d in docs], SCHEMA)).collect()}
    assert got == want and len(want) > 60 and sum(w[2] is not None for w in want.values()) > 30
    assert max(len(str(w[4])) for w in want.values()) > 5
    assert spelling.variant_groups(frame(spark, [])).count() == 0


def test_neighbourhood_is_whole_and_distinct():
    word, alphabet = "aabca", np.array([ord(c) for c in "abcé"], np.uint8)
    codes = np.frombuffer(word.encode("latin-1"), np.uint8)[None]
    want = {word[:i] + word[i + 1 :] for i in range(5)} | {word[:i] + chr(c) + word[i + 1 :] for i in range(5) for c in alphabet} | {word[:i] + chr(c) + word[i:] for i in range(6) for c in alphabet}
    want.discard(word)
    own = lambda w: int(spelling.hashes(np.frombuffer(w.encode("latin-1"), np.uint8)[None])[0])
    got = [int(x) for _, h, distinct, _ in spelling.edited(codes, alphabet) for x in h[distinct]]
    assert len(got) == len(set(got)) and set(got) == set(map(own, want))
