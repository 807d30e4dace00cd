import random
import re

import numpy as np
import pytest

from factloom.operators import retrieval
from factloom.operators.numbering import running_sum


def plain(facts, links, articles, splitter, k):
    out = {}
    for q, fact in facts.items():
        whole = " ".join(articles[a] for _, a in sorted(links[q]) if a in articles)
        parts = re.split(r"(?<=[.!?])\s+", whole) if splitter == "sentence" else whole.split("\n\n")
        parts = [p.strip() for p in parts if p.strip()]
        encode = retrieval.hashed_words()
        v = encode([fact, *parts])
        unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        scores = (unit[1:] @ unit[0]).round(9)
        out[q] = [parts[i] for i in sorted(range(len(parts)), key=lambda i: (-scores[i], i))[:k]]
    return out


@pytest.mark.parametrize("splitter", ["sentence", "paragraph"])
def test_linked_articles_are_as_one_text(spark, splitter):
    r = random.Random(3)
    piece = lambda: "".join(r.choice(["fox", "red", " ", "  ", ". ", "! ", ".", "\n\n", "\n", "sky"]) for _ in range(r.randint(0, 9)))
    articles = {f"a{i}": piece() for i in range(60)}
    articles |= {"e": "", "w": " \n ", "p": "\n\n", "s": "one. Two"}
    facts = {f"q{i}": r.choice(["red fox", "sky", "Two red"]) for i in range(40)}
    links = {q: [(i, r.choice([*articles, "gone"])) for i in range(r.randint(0, 7))] for q in facts}
    rows = [(q, i, a) for q, x in links.items() for i, a in x]
    for k in (3, 1000):
        got = retrieval.retrieve_linked(spark.createDataFrame(list(facts.items()), "id string, text string"), spark.createDataFrame(rows, "id string, place int, article string"), spark.createDataFrame(list(articles.items()), "article string, text string"), None, splitter, k).collect()
        want = plain(facts, links, articles, splitter, k)
        assert {x["id"]: sorted(x["contexts"]) for x in got} == {q: sorted(w) for q, w in want.items()} if k == 1000 else all(len(x["contexts"]) == len(want[x["id"]]) for x in got)


def test_an_item_in_every_article(spark):
    texts = spark.range(3000).selectExpr("cast(id as string) article", "concat('the fox ', id, ' ran. And no end') text")
    links = texts.selectExpr("'q' id", "cast(article as int) place", "article")
    got = retrieval.retrieve_linked(spark.createDataFrame([("q", "the fox 7 ran")], "id string, text string"), links, texts, k=2).first()["contexts"]
    assert got[0] == "And no end the fox 7 ran." and len(got) == 2


def test_each_fragment_is_encoded_once(spark, tmp_path):
    mark = str(tmp_path / "seen")

    def encode(texts):
        with open(mark, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return np.ones((len(texts), 2))

    articles = spark.createDataFrame([(str(i), "Same. Other. Same.") for i in range(30)], "article string, text string").repartition(4)
    retrieval.retrieve_linked(spark.createDataFrame([("q", "fact")], "id string, text string"), articles.selectExpr("'q' id", "cast(article as int) place", "article"), articles, encode).collect()
    assert sorted(open(mark).read().split()) == ["Other.", "Same.", "fact"]


def test_running_sum(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 v").repartition(5)
    total, want = 0, {}
    for i in range(1000):
        total += i % 3
        want[i] = total
    assert {r["id"]: r["sum"] for r in running_sum(df, ["id"], "v").collect()} == want
    assert running_sum(df.where("id < 0"), ["id"], "v").count() == 0


@pytest.mark.parametrize("size", [7, 2048])
def test_nearest_vectors_against_all_pairs(spark, size):
    g = np.random.default_rng(2)
    v = g.normal(size=(150, 5)).round(1)
    v[20:60] = v[3]  # many ties
    rows = [(i, v[i].tolist()) for i in range(150)] + [(200, [1.0, 2.0]), (201, None), (202, []), (None, v[0].tolist())]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)
    got = retrieval.nearest_vectors(df, df.where("id % 20 = 0").selectExpr("id query", "vector"), 6, size).collect()
    exact = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for q in range(0, 150, 20):
        want = sorted(((-exact(v[q], v[i]), i) for i in range(150) if i != q))[:6]
        assert [(r["id"], r["score"]) for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == [(i, -s) for s, i in want]
    assert {r["query"] for r in got} == set(range(0, 150, 20))
