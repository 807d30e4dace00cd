import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import lemmas
from factloom.operators import context, dataset, metrics, retrieval, verdict
from factloom.operators.numbering import number_rows
from factloom.plans.runs import Evaluation, build, judge
from factloom.sources import articles, files
from factloom.streaming import incremental

FACTS = "idx long, text string, fact_date string, links array<string>, relevant_links array<string>"


def test_registry_numbers_first_mentions_and_goes_on(spark):
    facts = spark.createDataFrame([(0, "x", None, ["u/a", "u/b", ""], []), (1, "y", None, ["u/b", "u/c"], ["u/c"])], FACTS)
    got = {r["url"]: r["cid"] for r in dataset.url_registry(dataset.mentions(facts)).collect()}
    assert got == {"u/a": "c-0", "u/b": "c-1", "u/c": "c-2"}
    known = spark.createDataFrame([("c-7", ("u/b",))], "id string, metadata struct<url:string>")
    got = {r["url"]: r["cid"] for r in dataset.url_registry(dataset.mentions(facts), known).collect()}
    assert got == {"u/b": "c-7", "u/a": "c-8", "u/c": "c-9"}


def test_keywords_and_query_entries(spark):
    facts = spark.createDataFrame([(0, "The tower", "2024-05", ["https://en.wikipedia.org/wiki/Big_Ben", "https://en.wikipedia.org/wiki/Tower"], ["https://en.wikipedia.org/wiki/Big_Ben"]), (1, "z", None, [], [])], FACTS)
    got = {r["id"]: r for r in dataset.query_entries(facts, dataset.url_registry(dataset.mentions(facts))).collect()}
    assert got["q-0"]["keywords"] == ["ben", "big"] and got["q-0"]["linked_articles"] == ["c-0", "c-1"] and got["q-0"]["relevant_articles"] == ["c-0"]
    assert got["q-1"]["keywords"] == [] and got["q-1"]["linked_articles"] == []
    assert dataset.known_titles(dataset.mentions(facts), dataset.url_registry(dataset.mentions(facts))).count() == 3


def test_number_rows_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    got = number_rows(df, ["x"]).collect()
    assert all(r["n"] == r["x"] for r in got) and len(got) == 1000


def test_files_round_trip(spark, tmp_path):
    raw = {"2024": {"Mai": [{"section": "s", "text": "t", "links": ["u"]}, {"section": None, "text": "v"}]}, "2023": {}}
    (tmp_path / "facts.json").write_text(json.dumps(raw, indent=2))
    facts = files.scan_facts(spark, str(tmp_path / "facts.json"))
    got = facts.orderBy("item").collect()
    assert [(r["year"], r["month"], r["item"], r["text"], r["links"]) for r in got] == [("2024", "Mai", 0, "t", ["u"]), ("2024", "Mai", 1, "v", [])]
    assert [len(r["months"]["Mai"]) for r in files.nest_facts(facts).collect()] == [2]
    assert [r["fact_date"] for r in dataset.dated_facts(facts).collect()] == ["2024-05"] * 2
    (tmp_path / "corpus.jsonl").write_text('{"id":"c-1","text":"old"}\nbroken\n{"id":"c-1","text":"new","abstract":"n","metadata":{"url":"u"}}\n')
    assert [(r["id"], r["text"]) for r in files.scan_corpus(spark, str(tmp_path / "corpus.jsonl")).collect()] == [("c-1", "new")]
    (tmp_path / "queries.jsonl").write_text('{"id":"q-0","text":"x","linked articles":["c-1"]}\n')
    q = files.scan_queries(spark, str(tmp_path / "queries.jsonl")).first()
    assert q["linked_articles"] == ["c-1"] and q["keywords"] == []
    assert files.scan_corpus(spark, str(tmp_path / "none")).count() == 0
    files.append_lines(files.original_names(files.scan_queries(spark, str(tmp_path / "queries.jsonl"))), str(tmp_path / "out"))
    assert files.scan_queries(spark, str(tmp_path / "out")).first()["linked_articles"] == ["c-1"]
    files.write_facts(facts.withColumn("lang", F.lit("de")), str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2


def test_context_keeps_order_and_repeats(spark):
    rows = spark.createDataFrame([("q", ["c-2", "c-9", "c-0", "c-2"]), ("r", [])], "id string, linked_articles array<string>")
    corpus = spark.createDataFrame([("c-0", "A", "tA"), ("c-2", "B", "tB")], "id string, abstract string, text string")
    got = {r["id"]: r["contexts"] for r in context.abstracts_of(rows, corpus, "linked").collect()}
    assert got == {"q": ["B", "A", "B"], "r": []}
    assert [r["missing"] for r in context.missing_ids(rows, "linked_articles", corpus).collect()] == ["c-9"]
    with pytest.raises(ValueError, match="mode"):
        context.abstracts_of(rows, corpus, "other")


def test_messages(spark):
    df = spark.createDataFrame([("F", ["a", "b"])], "f string, c array<string>")
    system, user = df.select(context.messages("f", "c", "relevant", allow_idk=False, no_think=True)).first()[0]
    assert system["content"].startswith(context._WITH_ABSTRACTS + "Answer with 'yes' if true, 'no' if false\nRespond strictly")
    assert "'answer': one of 'yes', 'no'\n" in system["content"] and "idk" not in system["content"]
    assert user["content"].endswith('FACT:\n"F"\n\nRELEVANT ABSTRACTS:\n\na\n\nb/no_think')
    assert "one of 'yes', 'no', 'idk'" in df.select(context.messages("f", None, "fact", allow_idk=True)).first()[0][0]["content"]


def test_metrics(spark):
    answers = ["yes", "yes", "no", "idk", None, "Yes"]
    queries = spark.createDataFrame([(str(i),) for i in range(6)], "id string")
    done = spark.createDataFrame([(str(i), a, None if a is None else 0.5) for i, a in enumerate(answers)] + [("stale", "yes", 1.0)], "id string, answer string, coverage double")
    r = metrics.evaluate(queries, done, "m").first()
    assert (r["accuracy"], r["recall (without idk)"], r["idk_ratio"]) == pytest.approx((2 / 6, 2 / 3, 1 / 6))
    assert r["stats"] == {"yes": 2, "no": 1, "idk": 1, "null": 1, "Yes": 1} and r["mean_coverage"] == pytest.approx(3.5 / 6)
    none = metrics.evaluate(queries, done.where("answer = 'idk'"), "m").first()
    assert none["recall (without idk)"] == 0.0


@pytest.mark.parametrize(("keys", "said", "want"), [(["Big Ben", "tower"], "The tower is big", 2 / 3), ([], "x", None), (["123"], "x", 0.0), (["x"], "", 0.0), (["x"], None, 0.0)])
def test_coverage(spark, keys, said, want):
    df = spark.createDataFrame([(keys, said)], "k array<string>, r string")
    assert df.select(verdict.coverage("k", "r")).first()[0] == (want if want is None else pytest.approx(want))


def test_ask_retries_corrects_and_gives_up():
    said = []

    def chat(messages):
        said.append(len(messages))
        if len(said) == 1:
            raise OSError("no line")
        return "no" if len(said) == 2 else '{"answer":"yes","reasoning":"r"}'

    assert verdict.ask(chat, [{}], 3, 0)[0::3] == ("yes", 3) and said == [1, 1, 2]
    assert verdict.ask(lambda m: "no", [{}], 2, 0) == (None, None, "no", 2, True)
    assert verdict.ask(lambda m: '{"answer":"yes","reasoning":"a {b} c"}', [{}], 2, 0)[0] == "yes"


def test_evaluation_end_to_end(spark):
    facts = spark.createDataFrame([("2024", "May", 0, "s", "Big tower stands", ["https://en.wikipedia.org/wiki/Tower"], ["https://en.wikipedia.org/wiki/Tower"])], "year string, month string, item int, " + files.FACT)
    texts = articles.with_abstract(articles.local_articles(spark.createDataFrame([("https://en.wikipedia.org/wiki/Tower",)], "url string"), spark.createDataFrame([("en", "Tower", "A tower. Tall.\n\nMore tower text")], "lang string, title string, text string")))
    corpus, queries = build(facts, texts.drop("abstract"))
    assert corpus.first()["abstract"] == "A tower. Tall."
    assert articles.fetched_articles(spark.createDataFrame([("https://en.wikipedia.org/wiki/Tower",), ("x",)], "url string"), lambda g, t: f"{g}:{t}").orderBy("url").collect()[0]["text"] == "en:Tower"
    chat = lambda m: json.dumps({"answer": "yes" if "tower" in m[-1]["content"] else "no", "reasoning": "tower"})
    for options in (Evaluation(mode="linked"), Evaluation(mode="relevant", use_fragments=True, top_k=1), Evaluation(mode="fact")):
        r = judge(queries, corpus, chat, options).first()
        assert r["answer"] == "yes" and not r["failed"]
    r = judge(queries, corpus, lambda m: "", Evaluation(pause=0.0)).first()
    assert (r["answer"], r["failed"], r["attempts"], r["coverage"]) == (None, True, verdict.ATTEMPTS, None)


def test_retrieval_ranks_by_likeness(spark):
    q = spark.createDataFrame([("a", "red fox", "The red fox. A blue whale. red sky."), ("b", "x", "")], "id string, text string, article_text string")
    got = {r["id"]: r["contexts"] for r in retrieval.retrieve(q, k=2).collect()}
    assert got["a"] == ["The red fox.", "red sky."]
    assert got["b"] == []
    import numpy as np

    states, mask = np.arange(12.0).reshape(1, 3, 4), np.array([[1, 1, 0]])
    assert (retrieval.token_mean(states, mask) == [[2, 3, 4, 5]]).all() and (retrieval.first_token(states, mask) == [[0, 1, 2, 3]]).all()
    assert np.linalg.norm(retrieval.pooled(lambda t: (np.ones((len(t), 2, 3)), np.ones((len(t), 2))), "cls")(["a", "b"])[0]) == pytest.approx(1)


def test_resume(spark, tmp_path):
    path, calls = str(tmp_path / "p"), []
    queries = spark.createDataFrame([("q-0", "a"), ("q-1", "b"), ("q-2", "c")], "id string, text string")

    def judge_all(bad):
        def run(q):
            calls.append(sorted(r["id"] for r in q.collect()))
            failed = F.col("id").isin(bad)
            return q.select("id", F.when(~failed, "yes").alias("answer"), F.lit("r").alias("reasoning"), F.lit(1.0).alias("coverage"), failed.alias("failed"))

        return run

    incremental.resume(queries.where("id <> 'q-2'"), path, judge_all(["q-1"]))
    assert incremental.resume(queries, path, judge_all([])).count() == 3
    assert calls == [["q-0", "q-1"], ["q-2"]]
    got = {r["id"]: r["answer"] for r in incremental.resume(queries, path, judge_all([]), retry_failed=True).collect()}
    assert calls[-1] == ["q-1"] and got == dict.fromkeys(("q-0", "q-1", "q-2"), "yes")


def test_follow_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"id":"q-0"}\n{"id":"q-1"}\n')
    done = lambda q: q.select("id", F.lit("yes").alias("answer"), F.lit(None).cast("string").alias("reasoning"), F.lit(None).cast("double").alias("coverage"), F.lit(False).alias("failed"))
    for k in (2, 3):
        incremental.follow(spark, str(tmp_path / "in"), "id string", str(tmp_path / "p"), str(tmp_path / "c"), done)
        assert files.scan_predictions(spark, str(tmp_path / "p")).count() == k
        (tmp_path / "in" / "2.json").write_text('{"id":"q-1"}\n{"id":"q-2"}\n')


@pytest.mark.parametrize(("url", "want"), [("a%20b", "a b"), ("100%", "100%"), ("%zz%C3%A9", "%zzé"), ("a+b%2B", "a+b+"), ("%", "%"), ("%4", "%4")])
def test_percent_decoding_escape_by_escape(spark, url, want):
    from factloom.functions.text import percent_decode

    assert spark.createDataFrame([(url,)], "u string").select(percent_decode("u")).first()[0] == want


def test_a_cluster_has_to_name_its_folder():
    from types import SimpleNamespace

    from factloom.sources.storage import shared_folder

    class Nothing:
        def get(self, key, default=None):
            return default

    def on(master, folder=None):
        return SimpleNamespace(conf=Nothing(), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: folder, setCheckpointDir=lambda path: None))

    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(on(master))
    assert shared_folder(on("yarn", "hdfs://h/x/")) == "hdfs://h/x" and shared_folder(on("local[2]")).startswith("file://")


def test_predictions_without_a_readable_file(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "part-0.parquet").write_bytes(b"no parquet at all")
    assert files.scan_predictions(spark, str(tmp_path / "p")).count() == 0


def offline(messages):
    return '{"answer": "yes", "reasoning": "big tower"}' if "A B" in messages[1]["content"] else "?"


def test_command_line_from_pages_to_a_report(spark, tmp_path, capsys):
    from factloom.__main__ import main

    from .test_html import EN, INDEX

    at = lambda name: str(tmp_path / name)
    spark.createDataFrame([("en", "https://en.wikipedia.org/wiki/I", INDEX["en"][0])], "lang string, url string, html string").write.parquet(at("archives"))
    spark.createDataFrame([("https://en.wikipedia.org/wiki/M1", EN)], "url string, html string").write.parquet(at("pages"))
    spark.createDataFrame([("en", "A_B", "Big.\n\nMore")], "lang string, title string, text string").write.parquet(at("articles"))
    main(["scrape", "--archives", at("archives"), "--pages", at("pages"), "--output", at("facts")], spark)
    assert capsys.readouterr().out == "facts: 2\n"
    words = ["build", "--facts", at("facts/lang=en"), "--articles", at("articles"), "--corpus", at("corpus"), "--queries", at("queries")]
    for _ in range(2):  # the second run finds all done
        main(words, spark)
    assert sorted((r["id"], r["abstract"]) for r in files.scan_corpus(spark, at("corpus")).collect()) == [("c-0", "Big."), ("c-1", "")]
    assert sorted(r["id"] for r in files.scan_queries(spark, at("queries")).collect()) == ["q-0", "q-1"]
    with pytest.raises(SystemExit):
        main([*words, "--corpus-only", "--queries-only"], spark)
    capsys.readouterr()
    main(["evaluate", "--queries", at("queries"), "--corpus", at("corpus"), "--output", at("run"), "--chat", "tests.test_dataset:offline", "--model", "m", "--pause", "0"], spark)
    said = capsys.readouterr().out.splitlines()
    assert said[:4] == ["model: m", "accuracy: 0.5000", "recall (without idk): 1.0000", "idk_ratio: 0.0000"] and said[5] == "answers: null: 1, yes: 1"
    assert "skipped" not in capsys.readouterr().err
    (tmp_path / "more.json").write_text(json.dumps({"2024": {"April": [{"section": "s", "text": "earlier", "links": []}], "May": [{"section": "s", "text": "... that A B met C ?", "links": []}]}}))
    (tmp_path / "queries" / "more.jsonl").write_text("no JSON\n")
    spark.createDataFrame([("en", "earlier", "early"), ("en", "towers", "tower")], "lang string, form string, lemma string").write.parquet(at("pairs"))
    try:
        main(["build", "--facts", at("more.json"), "--corpus", at("corpus"), "--queries", at("queries"), "--lemmas", at("pairs"), "--queries-only"], spark)
    finally:
        lemmas._factories.clear()
    assert "skipped 1 lines that are no JSON" in capsys.readouterr().err
    assert {r["id"]: r["text"] for r in files.scan_queries(spark, at("queries")).collect()}["q-2"] == "earlier"
