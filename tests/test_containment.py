import random

import pytest

from factloom.operators.containment import holders

TEXT, PASSAGE = "doc_id long, text string", "item_id long, passage string"


def world(seed, least):
    r = random.Random(seed)
    words = lambda n: " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(n))
    items = [words(r.randint(12, 40)) for _ in range(60)]
    items = [x for x in items if len(x.encode()) >= least] + [items[0]]  # one twice
    texts = [words(r.randint(0, 60)) for _ in range(80)]
    for i in range(60):
        k = r.randrange(len(texts))
        texts[k] = texts[k][: len(texts[k]) // 2] + r.choice(items) + texts[k][len(texts[k]) // 2 :]
    texts += [items[1], items[1][1:], items[2][:-1], "", None, words(400_000) + items[3] + "x", *texts[:3]]
    return list(enumerate(texts)), list(enumerate(items))


@pytest.mark.parametrize(("least", "names"), [(16, 1 << 20), (40, 3), (70, 1 << 20)])
def test_against_every_pair(spark, least, names):
    texts, items = world(least, least)
    items += [(900, None), (901, "")] + ([(902, "é a"), (903, "b")] if least == 16 else [])
    got = holders(spark.createDataFrame(texts, TEXT).repartition(3), spark.createDataFrame(items, PASSAGE), names=names).collect()
    want = sorted((i, j) for i, t in texts for j, p in items if t and p and p in t)
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == want


def test_nothing_to_look_for(spark):
    texts = spark.createDataFrame([(1, "a"), (2, None)], TEXT)
    assert holders(texts, spark.createDataFrame([], PASSAGE)).count() == 0
    assert holders(texts.where("doc_id > 2"), spark.createDataFrame([(1, "x" * 99)], PASSAGE)).count() == 0
    assert [r["doc_id"] for r in holders(texts, spark.createDataFrame([(1, "a")], PASSAGE)).collect()] == [1]
