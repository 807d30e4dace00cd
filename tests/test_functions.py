import pytest
from pyspark.sql import functions as F

from factloom.functions import answers, months, text, vectors
from factloom.functions.lemmas import for_coverage, for_keywords, lemmatize_with


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<string>' if isinstance(v, list) and (not v or isinstance(v[0], str)) else 'array<double>'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Ёлка й Й ё café", "Елка й И ё cafe"), ("за́мок", "замок"), ("й", "й"), ("A.\n\n== H ==\nBody", "A.\n\nH Body"),
        ("=== S ===\nX", "= S =\nX"), (" x y ", "x y"), ("Łódź ø", "Łodz ø"), ("", ""), (None, None),
    ],
)
def test_normalize_text(spark, given, want):
    assert one(spark, text.normalize_text("t"), t=given) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://en.wikipedia.org/wiki/Caf%C3%A9_A+B", ("en", "Café_A+B")), ("https://simple.wikipedia.org/wiki/X", (None, None)),
        ("https://en.m.wikipedia.org/wiki/X", (None, None)), ("https://de.wikipedia.org/wiki/100%_x", ("de", "100%_x")),
    ],
)
def test_article_key(spark, url, want):
    lang, title = text.article_key(F.col("u"))
    assert tuple(one(spark, F.struct(lang.alias("a"), title.alias("b")), u=url)) == want


def test_titles(spark):
    assert one(spark, text.spoken_title("u"), u="https://x/wiki/A_B%20c/wiki/D") == "A B c"
    assert one(spark, text.title_of("u"), u="https://x/other") is None


def test_words_and_fragments(spark):
    assert one(spark, text.words("t"), t="The tower, the ÉTÉ a_b 12") == ["12", "a_b", "the", "tower", "été"]
    assert one(spark, text.fragments("t", "paragraph"), t="a\n\n \n\n b \n\nc") == ["a", "b", "c"]
    assert one(spark, text.fragments("t", "sentence"), t="One. Two!  Three? four") == ["One.", "Two!", "Three?", "four"]
    assert one(spark, text.abstract("t"), t="a\nb\n\nc") == "a\nb"
    with pytest.raises(ValueError, match="splitter"):
        text.fragments("t", "line")


@pytest.mark.parametrize(
    ("note", "want"),
    [("2024-05-03", "03 Mai 2024"), ("le 3 MAI 2024", "03 Mai 2024"), ("2024-13-01 3 mai 2024", None), ("3 août 2020", "03 Août 2020"), ("x", None), (None, None)],
)
def test_french_section_date(spark, note, want):
    assert one(spark, months.french_section_date(F.col("n")), n=note) == want


@pytest.mark.parametrize(("section", "want"), [(" 2025", ("2025", "Janvier")), ("03 mai 2024", ("2024", "Mai")), ("abc", (None, None))])
def test_french_year_month(spark, section, want):
    y, m = months.french_year_month(F.col("s"))
    assert tuple(one(spark, F.struct(y.alias("y"), m.alias("m")), s=section)) == want


@pytest.mark.parametrize(("title", "want"), [(None, "2024"), ("3 de Março", "3 de Março de 2024"), ("3 de Março de 2019", "3 de Março de 2019"), ("None", "2024")])
def test_portuguese_section(spark, title, want):
    assert one(spark, months.portuguese_section(F.col("t"), F.lit("2024")), t=title) == want


@pytest.mark.parametrize(("section", "want"), [("março e janeiro", "Janeiro"), ("2024", "Janeiro"), ("3 de Março", "Março"), ("Maior", "Janeiro")])
def test_portuguese_month(spark, section, want):
    assert one(spark, months.portuguese_month(F.col("s")), s=section) == want


def test_fact_month(spark):
    for name, want in (("März", "2024-03"), ("august", "2024-08"), ("Май", "2024-05"), ("nonsense", None)):
        assert one(spark, months.fact_month(F.lit("2024"), F.col("m")), m=name) == want


REPLIES = [
    ('```json\n{"answer":"yes","reasoning":"r","x":{"y":1}}\n```', True), ('ok {"answer":"yes","reasoning":"r"} bye', True),
    ('{"answer":"yes","reasoning":"a {b} c"}', False), ('{"answer":null,"reasoning":"r"}', True), ('{"answer":"yes"}', False), ("plain text", False),
]


@pytest.mark.parametrize(("reply", "ok"), REPLIES)
def test_replies_in_columns_and_in_python(spark, reply, ok):
    assert one(spark, answers.accepted(answers.candidate("r")), r=reply) is ok
    assert (answers.read_reply(reply) is not None) is ok


def test_last_resort():
    assert answers.read_last_resort('{"answer":"yes","reasoning":"a {b} c"}')["answer"] == "yes"
    assert answers.read_last_resort("plain") is None
    assert answers.read_last_resort('{"x":1}') is None


def test_vectors(spark):
    assert one(spark, vectors.cosine("a", "b"), a=[3.0, 4.0], b=[4.0, 3.0]) == pytest.approx(0.96)
    assert one(spark, vectors.unit("a"), a=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, vectors.unit("a"), a=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, vectors.ratio(F.lit(1), F.lit(0))) == 0.0
    got = spark.sql("select array(array(1.0d, 2.0d), array(3.0d, 4.0d), array(9.0d, 9.0d)) v, array(1, 1, 0) m").select(vectors.mean_pool("v", "m")).first()[0]
    assert got == [2.0, 3.0]


def test_lemmas(spark):
    assert one(spark, for_keywords(F.col("w")), w=["big", "x", "12", "a1", "été"]) == ["big", "12", "été"]
    assert one(spark, for_coverage(F.col("w")), w=["Big", "12", "x"]) == ["big", "x"]
    plural = lambda lang: lambda words: [w.rstrip("s") for w in words]

    def unknown(lang):
        raise LookupError(lang)

    assert one(spark, lemmatize_with("en", [unknown, plural])(F.col("w")), w=["cats", "dog"]) == ["cat", "dog"]
    assert one(spark, lemmatize_with("xx", [unknown])(F.col("w")), w=["Cats"]) == ["cats"]
