"""Scores of the language model against a forward pass written out token by token."""

import collections
import math
import random
import re
import zlib

import numpy as np

from cladewise.llm import language_model as lm
from cladewise.llm.vectors import slices
import pyarrow as pa


def id_of(word):
    return int(lm.word_ids(next(slices(pa.array([word]))))[0][0])


def plain_score(words, model, counts):
    """Log10 probability of the words and the end: a class, then a word in it; rare words have their count's share of their class."""
    p = {k: v.astype(float) for k, v in model.params.items()}
    number = dict(zip(model.head.tolist(), model.place.tolist()))
    rare = collections.defaultdict(float)
    for w, c in counts.items():
        if id_of(w) not in number:
            rare[int(lm._tail_class(np.array([id_of(w)], np.uint64))[0])] += c + 1
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    n, state, before, total = lm.HIDDEN, [0.0] * lm.HIDDEN, lm.END, 0.0
    for w in [*words, None]:
        tail = None if w is None else int(lm._tail_class(np.array([id_of(w)], np.uint64))[0])
        token = lm.END if w is None else number.get(id_of(w), lm.HEAD + tail)
        a = p["emb"][before] @ p["wx"] + p["b"]
        u = np.array(state) @ p["wh"]
        r, z = ([sigmoid(a[k * n + j] + u[k * n + j]) for j in range(n)] for k in (0, 1))
        new = [math.tanh(a[2 * n + j] + r[j] * u[2 * n + j]) for j in range(n)]
        state = [(1 - z[j]) * new[j] + z[j] * state[j] for j in range(n)]
        own = lambda weights, bias, at: (x := np.array(state) @ weights.T + bias)[at] - np.log(np.exp(x).sum())
        cls = token // lm.PER_CLASS if token < lm.HEAD else lm.HEAD_CLASSES + tail
        total += own(p["wc"], p["bc"], cls)
        if token < lm.HEAD:
            first = cls * lm.PER_CLASS
            total += own(p["wi"][first : first + lm.PER_CLASS], p["bi"][first : first + lm.PER_CLASS], token - first)
        else:
            total += math.log(counts.get(w, 0) + 1) - math.log(rare[tail] + 1)
        before = token
    return total / math.log(10)


def test_score_is_that_of_a_plain_forward_pass(spark, monkeypatch):
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(2500)]
    weights = [1 / (k + 3) for k in range(2500)]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 400))) for _ in range(80)] + ["", " ", None, "never seen before at all", "W1 W2\nw3"]
    kept = []
    scored = lm._scored
    monkeypatch.setattr(lm, "_scored", lambda docs, model, *rest: kept.append(model) or scored(docs, model, *rest))
    rows = lm.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    counts = collections.Counter(w for k, own in enumerate(words) if zlib.crc32(str(k).encode()) % 7 != 2 for w in own)
    assert len(counts) > lm.HEAD + 200
    for r in rows:
        want = plain_score(words[r["doc_id"]], kept[0], counts)
        assert abs(r["score"] - want) < 1e-5 * max(1.0, abs(want)), (r["doc_id"], r["score"], want)


def test_gradients_equal_differences_of_the_loss_for_words_of_few_classes():
    """Classes without rows, with one and with many; texts end inside the window."""
    rng = np.random.default_rng(4)
    p = {k: rng.normal(0, 0.3, s) for k, s in lm.SHAPES.items()}
    given = rng.choice([lm.END, 1, 40, 41, lm.HEAD - 1, lm.HEAD, lm.INPUTS - 1], (4, 6))
    target, h0 = np.roll(given, -1, 0), rng.normal(0, 0.3, (6, lm.HIDDEN))
    g, _, loss = lm.gradients(p, given, target, h0)
    for name, at in (("wc", (3, 2)), ("bc", (0,)), ("wi", (40, 5)), ("wi", (200, 1)), ("bi", (lm.HEAD - 1,)), ("bi", (41,)), ("wh", (1, 30)), ("emb", (lm.END, 2))):
        ends = []
        for by in (1e-5, -1e-5):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += by
            ends.append(lm.gradients(q, given, target, h0)[2])
        assert abs((ends[0] - ends[1]) / 2e-5 - g[name][at]) < 1e-7
    h = rng.normal(0, 0.5, (24, lm.HIDDEN))
    x = h @ p["wi"].T + p["bi"]
    plain = h @ p["wc"].T + p["bc"]
    plain = plain[np.arange(24), lm._classes_of(target.ravel())] - np.log(np.exp(plain).sum(1))
    for k, t in enumerate(target.ravel().tolist()):
        if t < lm.HEAD:
            own = x[k, t // lm.PER_CLASS * lm.PER_CLASS :][: lm.PER_CLASS]
            plain[k] += own[t % lm.PER_CLASS] - np.log(np.exp(own).sum())
    assert np.allclose(lm.log_probabilities(p, h, target.ravel()), plain, atol=1e-9)
