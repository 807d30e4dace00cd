import hashlib
from collections import Counter

from factloom.llm.repeats import without_repeats

from .helpers import documents, frame


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def check(spark, rows):
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    got = without_repeats(frame(spark, rows)).collect()
    found = {r["doc_id"]: (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got}
    assert len(got) == len(rows)
    assert found == dict(enumerate(brute([r[1] for r in rows], 200)))


def test_against_brute_force(spark):
    check(spark, documents())
    check(spark, documents(9))


def test_periods_and_edges(spark):
    x = "".join(chr(97 + i * i % 26) for i in range(500))
    texts = ["a" * 199, "a" * 200, "a" * 201, "a" * 450, x[:300] + "1" + x[300:], x, "é" * 150, "z" + "é" * 150, x[100:299], x[100:300], "abc" * 200 + x[:250]]
    check(spark, [(0, t, None, None, None, None, None, None) for t in texts])


def test_empty_table(spark):
    assert without_repeats(frame(spark, [])).count() == 0
