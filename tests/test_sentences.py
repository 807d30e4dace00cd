import random

import pytest

from factloom.functions.sentences import Boundaries, _pairs, abbreviation_scores, learn_boundaries, token_counts, tokens
from factloom.functions.text import fragments

#: Per language: words, abbreviations with what may follow, and words that begin sentences.
LANGS = {
    "en": ("tower bridge river stands house long near built old stone", [("Dr.", "Smith"), ("Mr.", "Brown"), ("approx.", "ten"), ("e.g.", "bridges")], ["The", "It", "They"]),
    "de": ("turm brücke fluss steht haus lang nahe gebaut alt stein", [("z.B.", "Häuser"), ("Nr.", "sieben"), ("Prof.", "Meier"), ("ca.", "zehn")], ["Der", "Es", "Sie"]),
    "fr": ("tour pont fleuve maison longue près bâtie vieille pierre grande", [("M.", "Dupont"), ("p.ex.", "Lyon"), ("env.", "dix"), ("St.", "Jean")], ["La", "Il", "Elle"]),
    "pt": ("torre ponte rio casa longa perto velha pedra grande cidade", [("Sr.", "Silva"), ("Dra.", "Costa"), ("aprox.", "dez"), ("Av.", "Brasil")], ["A", "Ele", "Ela"]),
    "ru": ("башня мост река стоит дом длинный рядом старый камень город", [("т.е.", "Москва"), ("г.", "Тула"), ("ул.", "Мира"), ("им.", "Пушкина")], ["Он", "Это", "Они"]),
}


def sentence(r, lang, short=None):
    words, pairs, starts = LANGS[lang]
    inner = [r.choice(words.split()) for _ in range(r.randint(4, 9))]
    if short is None and r.random() < 0.4:
        short = r.choice(pairs)
    if short:
        inner[2:2] = list(short)
    return " ".join([r.choice(starts), *inner]) + r.choice([".", ".", ".", "!", "?"])


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(1)
    rows = [(lang, " ".join(sentence(r, lang) for _ in range(12))) for lang in LANGS for _ in range(60)]
    r.shuffle(rows)
    return learn_boundaries(spark.createDataFrame([*rows, (None, None), ("en", ""), (None, "x. y.")], "lang string, text string").repartition(4))


@pytest.mark.parametrize("lang", LANGS)
def test_abbreviations_of_five_languages_are_kept_whole(model, lang):
    r = random.Random(2)
    for _ in range(40):
        said = [sentence(r, lang, short) for short in LANGS[lang][1]] + [sentence(r, lang) for _ in range(3)]
        r.shuffle(said)
        assert model.sentences(" ".join(said), lang) == said


def test_the_pattern_would_cut_them(spark, model):
    text = "The tower near Dr. Smith stands. It is old."
    df = spark.createDataFrame([(text, "en"), (None, "en"), (text, None)], "text string, lang string")
    assert len(df.select(fragments("text")).first()[0]) == 3
    got = [r[0] for r in df.select(model.split("text", "lang")).collect()]
    assert got[0] == ["The tower near Dr. Smith stands.", "It is old."] and got[1] == [] and len(got[2]) == 3  # nothing was learned of no language
    assert df.select(fragments("text", model)).first()[0] == got[0]


def test_numbers_letters_and_closing_marks():
    m = Boundaries(frozenset([("de", "z.b")]), frozenset([("de", "es")]), frozenset([("de", "0", "mai")]))
    assert m.sentences("Am 3. Mai kam J. S. Bach z.B. Es ist 5. Das (so!) war „alt.“ gut", "de") == ["Am 3. Mai kam J. S. Bach z.B.", "Es ist 5.", "Das (so!)", "war „alt.“", "gut"]
    assert m.sentences("", "de") == [] and m.sentences("   ", "de") == [] and m.sentences("a", None) == ["a"]
    long = "wort " * 100_000 + "ende."
    assert m.sentences(long + " Neu.", "de") == [long, "Neu."]


def test_counts_of_tokens(spark):
    df = spark.createDataFrame([("en", "Dr. Smith, 12. (etc.) end.")], "lang string, text string")
    got = sorted((r["word"], r["period"], r["next"]) for r in tokens(df).collect())
    assert got == [("0", True, "etc"), ("dr", True, "smith"), ("end", True, None), ("etc", True, "end"), ("smith", False, "12")]
    assert abbreviation_scores(tokens(df.limit(0))).count() == 0


def test_counts_of_different_tokens_are_those_of_all(spark):
    df = spark.createDataFrame([("en", "Dr. Smith, dr. SMITH 12. 7 (etc.) -- end."), (None, "x. y"), ("en", None)], "lang string, text string")
    want = tokens(df).groupBy("lang", "word", "period").count().collect()
    got = token_counts(df).groupBy("lang", "word", "period").agg({"k": "sum"}).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert sorted(map(tuple, abbreviation_scores(token_counts(df)).collect())) == sorted(map(tuple, abbreviation_scores(tokens(df)).collect()))


def test_only_pairs_behind_an_abbreviation_are_told_apart(spark):
    df = spark.createDataFrame([("en", "Dr. Smith end. Smith a. b -- c word Smith, 3. May")], "lang string, text string")
    got = sorted((r["word"] or "", r["word"] is None, r["next"], r["k"]) for r in _pairs(df, [("en", "dr")], "lang", "text").collect())
    assert got == [("", False, "smith", 1), ("", True, "", 1), ("", True, "3", 1), ("", True, "a", 1), ("", True, "end", 1), ("", True, "smith", 1), ("", True, "word", 1), ("0", False, "may", 1), ("a", False, "b", 1), ("dr", False, "smith", 1)]
