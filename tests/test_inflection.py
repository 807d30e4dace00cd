import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from factloom.functions.inflection import EDGE, ENDING, Lemmas, edits, ending_counts, learn_lemmas, learned_rules, rules
from factloom.functions.lemmas import for_coverage, lemmatize_with

PAIR = "lang string, form string, lemma string"


def toy(seed, n, alphabet="abdegiklmnoprtuv"):
    """An inflected language: stems with a thematic ending, cases by declension, a few irregular forms."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        stem, kind = "".join(r.choice(alphabet) for _ in range(r.randint(3, 7))), r.choice(["a", "o", "ik"])
        ends = {"a": ["a", "y", "oj", "ami"], "o": ["o", "u", "om", "ax"], "ik": ["ik", "ika", "ikov", "ikami"]}[kind]
        out += [(stem + e, stem + kind) for e in ends]
    return out


def plain(pairs):
    """The rule of each ending by counting, and the lemma by the longest ending that has one."""
    votes = defaultdict(Counter)
    for form, lemma in set(pairs):
        p = 0
        while p < min(len(form), len(lemma)) and form[p] == lemma[p]:
            p += 1
        for i in range(min(len(form), ENDING) + 1):
            votes[form[len(form) - i :]][len(form) - p, lemma[p:]] += 1
        votes["^" + form][len(form) - p, lemma[p:]] += 1
    best = {}
    for ending, c in votes.items():
        (cut, put), n = min(c.items(), key=lambda x: (-x[1], x[0]))
        if ending.startswith("^") or n >= 2 and n >= sum(c.values()) * 0.5 and cut <= len(ending):
            best[ending] = cut, put

    def lemma(word):
        for ending in ["^" + word, *(word[len(word) - i :] for i in range(min(len(word), ENDING), -1, -1))]:
            if ending in best and (best[ending][0] < len(word) or ending[:1] == "^"):
                return word[: len(word) - best[ending][0]] + best[ending][1]
        return word

    return lemma


def test_held_out_forms_and_a_plain_version(spark):
    pairs, held = toy(1, 400), toy(2, 200)
    model = learn_lemmas(spark.createDataFrame([("xx", *p) for p in [*pairs, *pairs[:50]]], PAIR).repartition(5))
    want = plain(pairs)
    words = [f for f, _ in [*pairs, *held]] + ["a", "zzz", "y", "q"]
    assert [model.lemma(w, "xx") for w in words] == [want(w) for w in words]
    assert sum(model.lemma(f, "xx") == lemma for f, lemma in held) > 0.85 * len(held)
    assert sum(f == lemma for f, lemma in held) == 0.25 * len(held)  # by the word itself


def test_ladder_of_language_script_and_identity(spark):
    rows = [("ru", f, lemma) for f, lemma in toy(3, 150, "абвгдежзиклмн")] + [("en", f, lemma) for f, lemma in [("towers", "tower"), ("rivers", "river"), ("bridges", "bridge"), ("mice", "mouse")]]
    rows += [(None, None, None), ("en", "", "x"), ("en", "went", "go")]
    model = learn_lemmas(spark.createDataFrame(rows, PAIR))
    assert [model.lemma(w, "en") for w in ("Houses", "mice", "went", "s")] == ["house", "mouse", "go", "s"]
    assert model.lemma("клавami", "uk") == model.lemma("клавami", "ru") == "клавa"  # by its script
    assert model.lemma("streets", "fr") == "street" and model.lemma("λόγους", "el") == "λόγους" and model.lemma("", "ru") == ""
    df = spark.createDataFrame([(["Houses", "mice"],), (None,), ([],)], "w array<string>")
    assert [r[0] for r in df.select(lemmatize_with("en", [model.factory()])("w")).collect()] == [["house", "mouse"], None, []]
    assert df.select(for_coverage(lemmatize_with("en", [Lemmas().factory(), model.factory()])("w"))).first()[0] == ["house", "mouse"]


def test_no_pairs(spark):
    none = spark.createDataFrame([], PAIR)
    assert learn_lemmas(none).lemma("Words", "en") == "words" and rules(ending_counts(edits(none))).count() == 0


def test_pairs_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    pairs = spark.createDataFrame([("xx", *p) for p in toy(4, 50)], PAIR).withColumn("form", counted("form"))
    form, lemma = toy(4, 50)[0]
    assert learn_lemmas(pairs).lemma(form, "xx") == lemma and seen.value == 200


def test_rules_of_whole_forms_without_counting_them(spark):
    pairs = [("xx", *p) for p in toy(5, 200)] + [("yy", *p) for p in toy(6, 100)] + [("xx", "went", "go"), ("xx", "saw", "see"), ("xx", "saw", "saw"), ("xx", "s", "x"), ("yy", "ss", "")]
    edited = edits(spark.createDataFrame(pairs, PAIR))
    got, want = (sorted(map(tuple, df.collect())) for df in (learned_rules(edited), rules(ending_counts(edited))))
    assert got == want and any(r[1].startswith(EDGE) for r in got)
    assert ("xx", "^saw", 0, "", 1) in got and ("xx", "^went", 4, "go", 1) in got
