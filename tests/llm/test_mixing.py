import collections

import pytest

from factloom.llm.mixing import mix_sources, training_stream

from .helpers import documents, frame


def targets(sizes):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(out.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return out


def test_targets_and_takes(spark):
    rows = documents()
    got = mix_sources(frame(spark, rows), keep=("source",)).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    want, taken = targets(dict(sizes)), collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] <= 2 * r["size"] and r["taken"] == sum(t["words"] for t in r["takes"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["taken"], r["position"])
    assert sorted(map(str, map(key, got))) == sorted(map(str, map(key, mix_sources(frame(spark, rows, parts=7), keep=("source",)).collect())))


def test_stream_is_in_order_and_cut_at_the_target(spark):
    rows = documents()
    got = training_stream(frame(spark, rows), keep=("source",)).collect()
    at = [r["position"] for r in got]
    assert at == sorted(at) and all(0 <= x < 1 for x in at)
    assert all(len((r["text"] or "").encode().split()) == r["words"] > 0 for r in got)


def test_no_rows_and_no_words(spark):
    assert mix_sources(frame(spark, [])).count() == 0
    got = mix_sources(frame(spark, [(1, None, None, None, None, None, None, None), (2, "", None, "s", None, None, None, None)])).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in got] == [(0, 0, 0.0)] * 2
