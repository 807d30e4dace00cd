import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import similarity as S
from factloom.llm.components import components
from factloom.llm.similarity import prefix_length, similarity_groups, verify

from .helpers import documents, frame, groups, prose, shingles


def check(spark, rows):
    got = similarity_groups(frame(spark, [(i, *r[1:]) for i, r in enumerate(rows)])).collect()
    sets = [shingles(r[1]) for r in rows]
    first = groups(sets)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s), f) for i, (s, f) in enumerate(zip(sets, first, strict=True))}
    assert len(got) == len(rows)


def test_against_all_pairs(spark):
    check(spark, documents())


def test_chains_and_shared_passages(spark, monkeypatch):
    r = random.Random(5)
    words = prose(r, 60).split()
    rows = []
    for i in range(40):  # each text a few words further on: neighbours are linked, the ends are not
        rows.append((0, " ".join(words[i // 4 :] + [f"n{j}" for j in range(i // 4)]), "en", "a", 1, "", 1, ""))
    line = prose(r, 30)
    rows += [(0, f"{line} {prose(r, 3)}", "en", "a", 1, "", 1, "") for _ in range(12)]
    monkeypatch.setattr(S, "HOT", 3)
    monkeypatch.setattr(S, "EFFORT", 0)
    for rounds in (0, 2):
        monkeypatch.setattr(S, "STAR_ROUNDS", rounds)
        check(spark, rows)


def test_pairs_of_frequent_sets_are_dealt_out(spark, monkeypatch):
    r = random.Random(8)
    base = prose(r, 120)
    rows = [(0, base, "en", "a", 1, "", 1, "")] + [(0, f"{base} {prose(r, r.randint(1, 60))}", "en", "a", 1, "", 1, "") for _ in range(60)]
    rows += [(0, prose(r, 40), "en", "a", 1, "", 1, "") for _ in range(10)]
    for dealt in (2, 7):
        monkeypatch.setattr(S, "DEALT", dealt)
        check(spark, rows)


def test_null_ids_and_clashing_columns(spark):
    rows = [(None, "a b c d e f", *[None] * 6), (5, "a b c d e f", *[None] * 6), (None, "g", *[None] * 6), (9, None, *[None] * 6)]
    got = sorted((r["component_id"] is None, r["component_id"] or 0, r["n_shingles"]) for r in similarity_groups(frame(spark, rows)).collect())
    assert got == [(False, 5, 2), (False, 5, 2), (False, 9, 0), (True, 0, 1)]


def test_empty_table(spark):
    assert similarity_groups(frame(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 90), min_size=1), st.sets(st.integers(0, 90), min_size=1))
def test_verify_and_prefix(a, b):
    x, y = np.array(sorted(a), np.uint64), np.array(sorted(b), np.uint64)
    linked = 100 * len(a & b) >= 75 * len(a | b)
    assert verify(x, y) == linked
    if linked:
        need = min(S.SHARED, -(-75 * len(a) // 100), -(-75 * len(b) // 100))
        assert len(set(sorted(a)[: prefix_length(len(a))]) & set(sorted(b)[: prefix_length(len(b))])) >= need


def test_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(30)] + [(100 + r.randrange(20), 100 + r.randrange(20)) for _ in range(12)] + [(7, 7)]
    up = {n: n for e in links for n in e}
    for _ in up:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    got = {x["node"]: x["comp"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    alone = {a for a, b in links if a == b}
    for a in got:
        for b in got:
            assert (got[a] == got[b]) == (up[a] == up[b])
    assert set(up) - set(got) <= alone | {a for a, b in links if all(x == y for x, y in links if a in (x, y))}
