import math
import random
from collections import Counter

import numpy as np
import pytest

from factloom.llm.linear import BITS, Rows
from factloom.llm.quality import quality
from factloom.llm.toxicity import GRADES, loss_and_slope, observed, toxicity

from .helpers import documents, frame, prose


def base(text):
    b = (text or "").encode()
    w = b.split()
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice, covered = Counter(three), set()
    for i, t in enumerate(three):
        if twice[t] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in b.split(b"\n") if x.split()]
    chars = sum(len(x.decode(errors="ignore")) for x in w)
    return len(w), chars, sum(c in b"#*$%&|<>" for c in b), len(lines) - len(set(lines)), len(covered)


def labelled(spark, kind, n=160, seed=4):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = prose(r, 80, words).split()
        if bad and kind == "quality":
            text = [x.upper() + "!!" for x in text]
        if bad and kind == "toxic":
            for _ in range(2 + i % 7):
                text[r.randrange(80)] = r.choice(["awful", "vile", "nasty"])
        rows.append((i, " ".join(text), "en", "s", 0, "", 1, ""))
        labels.append((i, int(not bad) if kind == "quality" else 1, int(bad)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_counts_and_base_rules(spark):
    rows = [(i, *x[1:]) for i, x in enumerate(documents())] + [(900, "a b\na b\n \n\nc\na b", None, None, 0, None, None, None), (901, "x y z " * 40, None, None, 0, None, None, None)]
    got = {x["doc_id"]: x for x in quality(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        want, x = base(text), got[i]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == want
        assert x["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and x["kept"] == (not x["base_failed"])


def test_quality_held_out(spark):
    docs, labels, rows = labelled(spark, "quality")
    got = {x["doc_id"]: x for x in quality(docs, labels.where("doc_id < 100")).collect()}
    assert all(got[i]["kept"] == (i % 4 != 0) for i in range(100, 160))
    assert quality(docs.where("false"), labels).count() == 0


def test_toxicity_held_out(spark):
    docs, labels, rows = labelled(spark, "toxic")
    got = {x["doc_id"]: x for x in toxicity(docs, labels.where("doc_id < 120")).collect()}
    assert sum(got[i]["toxic"] == (i % 4 == 0) for i in range(120, 160)) >= 39
    assert all(0 <= x["severity"] <= GRADES for x in got.values())
    many, few = (sum(got[i]["severity"] for i in range(0, 160, 4) if 2 + i % 7 == k) for k in (8, 2))
    assert many > few
    odd = toxicity(frame(spark, documents()), labels.where("doc_id < 120")).collect()
    assert len(odd) == len(documents()) and not any(x["toxic"] for x in odd if x["doc_id"] is None and x["severity"] < 0.1)


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_keeps_everything(spark, label):
    docs, labels, _ = labelled(spark, "quality", 20)
    one = labels.selectExpr("doc_id", f"{label} as quality", f"{label} as toxic")
    assert quality(docs, one).where("not kept and not base_failed").count() == 0
    assert toxicity(docs, one).where("toxic").count() == 0


def test_copies_of_a_document_leave_room_for_the_other_labels(spark):
    from factloom.llm.linear import fitted

    docs = spark.createDataFrame([(1, "one")] * 60 + [(1, "uno")] * 60 + [(i, f"text {i}") for i in range(2, 6)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(1, 6)], "doc_id long, quality int, text string")
    n = lambda off: len(off) - 1
    y, sizes = fitted(docs, labels, "quality", 5, lambda data, off: [(np.arange(n(off)), np.arange(n(off)) * 0)], lambda y, rows: (y, rows.sizes))
    assert sorted(y) == [0, 0, 1, 1, 1] and list(sizes) == [1] * 5
    assert fitted(docs, labels.where("false"), "quality", 5, None, None) is None


def sample(n=40, seed=3):
    r = np.random.default_rng(seed)
    sizes = r.integers(0, 9, n)
    sizes[:2] = 0
    return Rows(sizes, np.concatenate([np.sort(r.choice(50, k, replace=False)) for k in sizes]).astype(int), r.random(sizes.sum()))


def test_sparse_products():
    rows, r = sample(), np.random.default_rng(1)
    dense = np.zeros((rows.n, 1 << BITS))
    dense[rows.row, rows.slot] = rows.value
    w, g = r.normal(size=1 << BITS), r.normal(size=rows.n)
    assert np.allclose(rows.dot(w), dense @ w) and np.allclose(rows.back(g), g @ dense)
    mask = g > 0
    assert np.allclose(rows.take(mask).dot(w), dense[mask] @ w)


@pytest.mark.parametrize("top", [1, GRADES])
def test_ordinal_likelihood_and_slope(top):
    rows, r = sample(), np.random.default_rng(2)
    labels = r.integers(0, top + 1, rows.n)
    low, high = observed(labels)
    weight = r.random(rows.n)
    p = np.concatenate([r.normal(size=1 << BITS), [0.3], r.normal(size=GRADES - 1)])
    loss, slope = loss_and_slope(p, rows, (low, high), weight, 0.01)
    # the same, grade by grade
    theta = [p[1 << BITS]]
    for step in p[(1 << BITS) + 1 :]:
        theta.append(theta[-1] + math.exp(step))
    x, total = rows.dot(p[: 1 << BITS]), 0.005 * (p[: 1 << BITS] ** 2).sum()
    for i in range(rows.n):
        at_most = [1 / (1 + math.exp(-(t - x[i]))) for t in theta] + [1.0]
        each = [at_most[0]] + [b - a for a, b in zip(at_most, at_most[1:])]
        total -= weight[i] * math.log(sum(each[k] for k in range(GRADES + 1) if (k == labels[i] if top > 1 or labels[i] == 0 else k > 0)))
    assert math.isclose(loss, total, rel_tol=1e-9)
    for j in [*map(int, rows.slot[:12]), 1 << BITS, (1 << BITS) + 1, (1 << BITS) + 2]:
        d = np.zeros(len(p))
        d[j] = 1e-5
        ends = [loss_and_slope(p + e, rows, (low, high), weight, 0.01)[0] for e in (d, -d)]
        assert math.isclose(slope[j], (ends[0] - ends[1]) / 2e-5, rel_tol=1e-4, abs_tol=1e-6)


def test_graded_labels_are_predicted_in_order(spark):
    r = random.Random(7)
    rows, labels = [], []
    for i in range(200):
        grade, text = i % 4, [f"w{r.randrange(40)}" for _ in range(30)]
        for k in range(grade * 3):
            text[k * 3] = f"vile{k}"
        rows.append((i, " ".join(text)))
        labels.append((i, 1, grade))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x for x in toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where("doc_id < 120")).collect()}
    assert sum(got[i]["grade"] == i % 4 for i in range(120, 200)) >= 70
    means = [np.mean([got[i]["severity"] for i in range(120, 200) if i % 4 == g]) for g in range(4)]
    assert means == sorted(means)
