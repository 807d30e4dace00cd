import hashlib
import random
import zlib

import pytest

from factloom.llm.trie import ending, placed_turns, prefix_trie

TURNS = "conv_id long, turn long, role string, text string, depth long, n string"


def plain(rows):
    convs = {}
    name = lambda r: (r[2] or "", r[3] or "")
    key = lambda r: hashlib.md5(f"{len(name(r)[0].encode())}:{name(r)[0]}{name(r)[1]}".encode()).digest()
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, key(r))):
        convs.setdefault(r[0], []).append(name(r))
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(convs.get(c - c % 20, [])[:h] + own[h:])
    members = {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members.setdefault(built[c][:d], []).append(c)
    below = {}
    for p in members:
        if p:
            below.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode().split()) if p else 0
        leaves[p] = sum(leaves[q] for q in below[p]) if p in below else 1
        saved[p] = own + sum(saved[q] for q in below.get(p, []))
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if len(built[c]) == len(p)).encode()).hexdigest()
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(below.get(p, [])), leaves[p], saved[p], ends(p)) for p, m in members.items()), key=repr)


def conversations(seed, n=120, deep=9):
    r = random.Random(seed)
    said = ["hello", "how are you", "fine \t thanks", "ünï ço", "", None, "x" * 50]
    rows = []
    for c in r.sample(range(20 * n // 10), n):
        turns = [(r.choice(["user", "bot", None]), r.choice(said[: r.randint(1, 7)])) for _ in range(r.randint(1, deep))]
        rows += [(c, i if r.random() < 0.95 else None, *t, 1, "") for i, t in enumerate(turns)]
    rows += [(7, 0, "a", "b", 1, ""), (7, 0, "a", "b", 1, ""), (None, 0, "a", "b", 1, ""), (2**40 + 3, 0, "user", "hello", 1, "")]
    r.shuffle(rows)
    return rows


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("block", [2, 1024])
def test_against_a_plain_trie(spark, block):
    rows = conversations(block)
    assert got(prefix_trie(spark.createDataFrame(rows, TURNS).repartition(5), block)) == plain(rows)


def test_copies_of_a_long_conversation_and_a_very_long_one(spark):
    r = random.Random(4)
    turns = [("user", f"turn {r.random()}") for _ in range(70)]
    rows = [(20 * c, i, *t, 0, "") for c in range(1, 30) for i, t in enumerate(turns[: 60 + c % 3])]  # heads are their own
    rows += [(1, i, "user", f"word {i}", 0, "") for i in range(3000)]
    assert got(prefix_trie(spark.createDataFrame(rows, TURNS).repartition(7), 16)) == plain(rows)


def test_no_conversations_and_one_without_turns(spark):
    assert prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 1, "a", "b", 1, "")], TURNS)).count() == 0
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    rows = [(c, 0, "user", "hello there", 1, "")]
    assert got(prefix_trie(spark.createDataFrame(rows, TURNS))) == plain(rows) and len(plain(rows)) == 1


def test_one_conversation_is_numbered_over_many_tasks(spark):
    rows = [(5, i // 3, "u", "same" if i % 2 else str(i), 0, "") for i in range(4000)] + [(c, 0, "u", "t", 0, "") for c in range(9)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are put together again
    try:
        placed = placed_turns(spark.createDataFrame(rows, TURNS).repartition(6))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert placed.select("conv", "at").distinct().count() == len(rows)
    assert placed.where("conv = 5").agg({"at": "max"}).first()[0] == 4000
    assert placed._from.where("conv = 5").select("part").distinct().count() > 1


def test_many_ends_are_hashed_in_order(spark):
    ids = random.Random(1).sample(range(-500, 40_000), 9000)
    ends = spark.createDataFrame([(0, 1, c) for c in ids] + [(3, 1, 3)], "first long, depth long, conv long").repartition(4)
    want = {(0, 1): hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), (3, 1): hashlib.sha256(b"3").hexdigest()}
    assert {(r[0], r[1]): r[2] for r in ending(ends, 6).collect()} == want
