import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from factloom.llm.language import Trees, grow, identify

from .helpers import bytes_and_offsets, frame


def plain_bits(train, text, order):
    """The same code, symbol by symbol."""
    counts = defaultdict(Counter)
    for t in train:
        for i, c in enumerate(t):
            for n in range(order + 1):
                if i >= n:
                    counts[t[i - n : i]][c] += 1
    bits = 0.0
    for i, c in enumerate(text):
        for n in range(min(order, i), -1, -1):
            seen = counts.get(text[i - n : i])
            if seen is None:
                continue
            total = sum(seen.values()) + len(seen)
            if c in seen:
                bits -= math.log2(seen[c] / total)
                break
            bits -= math.log2(len(seen) / total)
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("order", [0, 2, 4])
def test_bits_are_those_of_the_plain_code(order):
    r = random.Random(order)
    texts = [["".join(r.choice(a) for _ in range(r.randint(1, 60))).encode() for _ in range(5)] for a in ("abcd ", "abxyé ")]
    t = Trees(["a", "b"], texts, order)
    asked = ["abab x", "", "é", "zzzz", "a", texts[0][0].decode(), texts[1][2].decode() + "qq"]
    got = t.bits(*bytes_and_offsets(asked))
    for row, text in zip(got, asked, strict=True):
        for bits, own in zip(row, texts, strict=True):
            assert bits == pytest.approx(plain_bits(own, text.encode(), order), rel=1e-4, abs=1e-3)


def prose(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


def test_held_out_accuracy_and_edge_cases(spark):
    r = random.Random(3)
    vocab = {g: ["".join(r.choice(a) for _ in range(r.randint(2, 6))) for _ in range(50)] for g, a in (("en", "theorsin"), ("de", "erichuäß"))}
    rows = [(i, prose(r, vocab[g], 30), g, None, 0, None, None, None) for i, g in enumerate(["en", "de"] * 30)]
    trees = grow(frame(spark, rows[:40]))
    odd = [(100, None, "en"), (101, "", "en"), (102, "12 34!", "de"), (103, "Ж", None), (100, None, "en")]
    asked = frame(spark, [*rows[40:], *((i, t, g, None, 0, "k", 1, "d") for i, t, g in odd)])
    got = identify(asked, trees).collect()
    assert len(got) == 25
    by_id = {x["doc_id"]: x for x in got}
    assert all(by_id[i]["lang_pred"] == g and 0.5 < by_id[i]["score"] <= 1 for i, _, g, *_ in rows[40:])
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (100, 101, 102)) and by_id[103]["lang_pred"] in ("de", "en")


def test_nothing_learned(spark):
    trees = grow(frame(spark, [(1, "x", None, None, 0, None, None, None)]))
    assert [x["lang_pred"] for x in identify(frame(spark, [(1, "abc", None, None, 0, None, None, None)]), trees).collect()] == ["und"]
    assert identify(frame(spark, []), trees).count() == 0
    assert np.isfinite(Trees(["a"], [[b""]]).bits(*bytes_and_offsets(["abc"]))).all()


def test_languages_of_long_documents_only_and_many_languages(spark):
    r = random.Random(5)
    vocab = {f"l{g:02}": ["".join(chr(0x4E00 + 20 * g + r.randrange(20)) for _ in range(3)) for _ in range(20)] for g in range(70)}
    rows = [(i, prose(r, vocab[g], 400 if g == "l07" else 20), g, None, 0, None, None, None) for i, g in enumerate(2 * sorted(vocab))]
    trees = grow(frame(spark, rows), 3, 3000)
    assert trees.langs == sorted(vocab) and all(len(t[1].encode()) > 3000 for t in rows if t[2] == "l07")
    asked = frame(spark, [(i, prose(r, vocab[g], 10), g, None, 0, None, None, None) for i, g in enumerate(sorted(vocab))])
    assert {x["lang"]: x["lang_pred"] for x in identify(asked, trees, ("lang",)).collect()} == {g: g for g in vocab}
