import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import maxent
from factloom.llm.common import KeyTable
from factloom.llm.maxent import Model, Vocabulary, score_texts

from .helpers import documents, frame, lower


def base(rows, held):
    tokens = [[*lower((r[1] or "").encode()).split(), None] for r in rows]
    c = Counter(t for x, h in zip(tokens, held, strict=True) if not h for t in x)
    total, distinct = sum(c.values()), len(c)
    return [(len(x), sum(c[t] > 0 for t in x), sum(math.log10((c[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in x)) for x in tokens], total


@pytest.mark.parametrize("head", [1 << 20, 20])
def test_base_scores(spark, monkeypatch, head):
    monkeypatch.setattr(maxent.vocabulary, "__defaults__", (head, 1 << 15))
    rows = [(i, *r[1:]) for i, r in enumerate(documents())]
    held = [i % 5 == 0 for i in range(len(rows))]
    got = {x["doc_id"]: x for x in score_texts(frame(spark, rows), F.col("doc_id") % 5 == 0).collect()}
    want, total = base(rows, held)
    for i, (n, known, score) in enumerate(want):
        x = got[i]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (held[i], n, known, total)
        assert x["base_score"] == pytest.approx(score) and math.isfinite(x["score"]) and x["score"] <= 0


def test_model_beats_counts_on_held_out_text(spark):
    r = random.Random(1)
    a, b = ([f"{p}{i}" for i in range(40)] for p in "ab")
    rows = []
    for i in range(400):
        words, own = [], (a, b)[i % 2]
        while len(words) < 40:
            w = r.choice(own)
            words += [w, own[(own.index(w) + 1) % 40]]
        rows.append((i, " ".join(words), None, None, 0, None, None, None))
    got = [x for x in score_texts(frame(spark, rows), F.col("doc_id") >= 350).collect() if x["held_out"]]
    assert sum(x["score"] for x in got) > sum(x["base_score"] for x in got) + 5 * len(got)


def test_probabilities_sum_to_one():
    r = np.random.default_rng(0)
    counts = np.sort(r.integers(1, 50, 30))[::-1]
    vocab = Vocabulary(int(counts.sum()) + 40, 30 + 25, KeyTable(np.arange(1, 31).astype(np.uint64), counts), 30, 0)
    m = Model(vocab, np.arange(30) % 4, 4)
    m.u = r.normal(size=m.u.shape).astype(np.float32)
    m.v = r.normal(size=m.v.shape)
    m.normalize()
    p1, p2 = np.array([3]), np.array([30])
    x = m.class_logits(m.features(p1, p2))[0]
    p = np.exp(x) / np.exp(x).sum()
    w = np.arange(30)
    inside = np.exp(m.inside + m.v[m.slot(np.full(30, 3), w)] - m.log_z[3][m.word_class[:-1]])
    rest = (40 + 25 * 0.1 + 0.1) / 10**m.rest_base  # 25 known rare words with 40 tokens, and one unseen
    assert (p[m.word_class[:-1]] * inside).sum() + p[4] * rest == pytest.approx(1, abs=1e-4)


def test_no_training_text_and_no_rows(spark):
    rows = documents()[:5]
    got = score_texts(frame(spark, rows), F.lit(True)).collect()
    assert len(got) == 5 and all(x["n_known"] == 0 and x["train_tokens"] == 0 and x["score"] == x["base_score"] for x in got)
    assert score_texts(frame(spark, []), F.lit(False)).count() == 0


def test_words_beyond_the_lexicon_and_the_frequent_contexts_have_features(spark, monkeypatch):
    r = random.Random(4)
    monkeypatch.setattr(maxent.vocabulary, "__defaults__", (1 << 20, 40))
    monkeypatch.setattr(maxent, "BUCKET_WORDS", 1)
    common, rare = [f"c{i}" for i in range(39)], [f"r{i}" for i in range(300)]
    rows = []
    for i in range(400):
        words = [w for _ in range(20) for k in [r.randrange(150)] for w in (r.choice(common), rare[2 * k], rare[2 * k + 1])]
        rows.append((i, " ".join(words), None, None, 0, None, None, None))
    got = [x for x in score_texts(frame(spark, rows), F.col("doc_id") >= 350).collect() if x["held_out"]]
    # each word 2k + 1 beyond the lexicon follows 2k only
    assert sum(x["score"] for x in got) > sum(x["base_score"] for x in got) + 20 * len(got)


def test_probabilities_of_buckets_sum_to_one():
    r = np.random.default_rng(0)
    counts = np.sort(r.integers(1, 50, 30))[::-1]
    sizes = np.array([[40, 0, 25], [25, 0, 9]], float)
    vocab = Vocabulary(int(counts.sum()) + 65, 30 + 34, KeyTable(np.arange(1, 31).astype(np.uint64), counts), 30, 0)
    m = Model(vocab, np.arange(30) % 4, 4, sizes)
    m.u, m.v = r.normal(size=m.u.shape).astype(np.float32), r.normal(size=m.v.shape)
    m.normalize()
    w, p1 = np.arange(33), np.array([30])
    x = m.class_logits(m.features(p1, np.array([31])))[0]
    p = np.exp(x) / np.exp(x).sum()
    assert (m.context(np.arange(256)) == np.arange(256)).all() and len({*m.context(np.arange(256, 1256)).tolist()}) > 200
    g = m.context(np.full(33, 31))
    inside = np.exp(m.within + m.v[m.slot(g, w)] - m.log_z[g, m.word_class])
    share = np.append(np.ones(30), (sizes[0] + 0.1 * sizes[1] + 0.1) / 10**m.rest_base)
    assert (p[m.word_class] * inside * share).sum() == pytest.approx(1, abs=1e-4)
