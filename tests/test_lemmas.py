import pyarrow as pa
from pyspark.sql import functions as F

from factloom.functions import lemmas


def test_a_batch_becomes_strings_slice_by_slice(spark):
    """Whatever the size of a batch, Python has the words of SLICE lists; null lists and empty ones stay in their places."""
    rows = [(i, None if i % 7 == 0 else [f"W{i}"] * (i % 3)) for i in range(2 * lemmas.SLICE + 5)]
    df = spark.createDataFrame(rows, "id long, words array<string>").coalesce(1)
    tagged = lemmas.lemmatize_with("xx", [lambda lang: lambda words: [f"{w}_{lang}" for w in words]])

    def missing(lang):
        raise LookupError(lang)

    plain = lemmas.lemmatize_with("xx", [missing])
    got = {r["id"]: (r["a"], r["b"]) for r in df.select("id", tagged(F.col("words")).alias("a"), plain(F.col("words")).alias("b")).collect()}
    assert got == {i: (w and [f"{x}_xx" for x in w], w and [x.lower() for x in w]) if w is not None else (None, None) for i, w in rows}


def test_different_words_are_looked_at_once(spark, monkeypatch):
    """A lemmatizer of single words is asked for each word of many lists once; nulls, empty lists and places stay, in a slice as well."""
    asked = []
    call = lemmas.by_word(lambda w: asked.append(w) or w.upper())
    rows = pa.array([["x"], ["a", "b", "a"], None, [], ["b", "c"], ["a"] * 50, ["c", None]], pa.list_(pa.string()))
    assert lemmas._lemmas_by_word(rows.slice(1, 5), call).to_pylist() == [["A", "B", "A"], None, [], ["B", "C"], ["A"] * 50]
    assert asked == ["a", "b", "c"]
    monkeypatch.setattr(lemmas, "WORDS", 3)
    parts = list(lemmas._slices(rows))
    assert [x for p in parts for x in p.to_pylist()] == rows.to_pylist() and [len(p) for p in parts] == [1, 3, 1, 1, 1]
    df = spark.createDataFrame([(i, None if i % 5 == 0 else ["B", "A"] * (i % 4)) for i in range(40)], "id long, w array<string>").coalesce(1)
    got = df.select("w", lemmas.lemmatize_with("xx", [lambda lang: lemmas.by_word(lambda w: w + lang)])(F.col("w")).alias("x")).collect()
    assert all(r["x"] == (r["w"] if r["w"] is None else [w + "xx" for w in r["w"]]) for r in got) and len(got) == 40
