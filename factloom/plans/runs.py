"""The three programs end to end: pages to facts, facts to a data set, data set to an evaluation."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sentences import learn_boundaries
from ..functions.months import french_year_month, portuguese_month
from ..operators.calls import CHUNK, WIDTH, results
from ..operators.context import abstracts_of, messages
from ..operators.dataset import corpus_entries, dated_facts, known_urls, mentions, new_queries, query_entries, url_registry
from ..operators.retrieval import Encoder, retrieve_linked
from ..operators.metrics import evaluate
from ..operators.verdict import ATTEMPTS, PAUSE, SAMPLING, VERDICT, Chat, coverage, kept_verdicts, verdicts
from ..sources.fetch import fetched_pages
from ..sources.files import append_failures, append_outputs, append_predictions, nest_months, scan_predictions, write_results
from ..sources.html import parse_facts, parse_index
from ..sources.storage import children, delete, qualified, stored
from ..streaming.incremental import latest, remaining


@dataclass(frozen=True)
class Evaluation:
    """Parameters of an evaluation."""

    model: str = "offline"
    lang: str = "en"
    mode: str = "fact"
    allow_idk: bool = False
    use_fragments: bool = False
    splitter: str = "sentence"
    top_k: int = 5
    attempts: int = ATTEMPTS
    pause: float = PAUSE
    retry_failed: bool = False
    no_think: bool = False
    temperature: float = SAMPLING["temperature"]
    top_p: float = SAMPLING["top_p"]
    timeout: float = float(SAMPLING["timeout"])
    max_threads: int = WIDTH
    rate: float = 0.0
    chunk: int = CHUNK

    @property
    def sampling(self) -> dict:
        return {"temperature": self.temperature, "top_p": self.top_p, "timeout": self.timeout}


def scrape(archives: DataFrame, pages: DataFrame) -> DataFrame:
    """archives (lang, url, html) and pages (url, html) -> facts (lang, year, month, item, section, text, links, relevant_links).

    Months of month pages come from the index; of Portuguese and French pages from the sections. Pages that don't exist have no facts;
    French sections without a date are left out here (quarantine() has them).
    """
    facts = _facts(archives, pages)
    return facts.where("year is not null")


def online(archives: DataFrame, folder: str, **options) -> tuple[DataFrame, DataFrame]:
    """archives (lang, url) -> archives (lang, url, html) and pages (url, status, html, error) as the network has them: the archives first, then
    every page they list as existing. ``folder`` keeps the lists of URLs; options are those of the data source."""
    found = archives.select("lang", "url").join(fetched_pages(archives.select("url"), f"{folder}/archives", **options).select("url", "status", "html", "error"), "url")
    index = parse_index(found).where("exists")
    return found, fetched_pages(index.select("url"), f"{folder}/pages", **options)


def _facts(archives: DataFrame, pages: DataFrame) -> DataFrame:
    index = parse_index(archives).where("exists")
    listed = index.join(pages.select("url", "html"), "url")
    facts = parse_facts(listed).join(index.select("lang", "url", "month"), ["lang", "url"])
    lang = F.col("lang")
    french_year, french_month = french_year_month(F.col("section"))
    year = F.when(lang == "fr", french_year).otherwise(F.col("year"))
    month = F.when(lang == "fr", french_month).when(lang == "pt", portuguese_month(F.col("section"))).otherwise(F.col("month"))
    return facts.select("lang", year.alias("year"), month.alias("month"), F.col("pos").alias("item"), "section", "text", "links", F.coalesce("relevant_links", F.expr("cast(array() as array<string>)")).alias("relevant_links"))


def quarantine(archives: DataFrame, pages: DataFrame) -> DataFrame:
    return _facts(archives, pages).where("year is null")


def nested(archives: DataFrame, facts: DataFrame) -> DataFrame:
    """(lang, year, months) of the nested export. Months of the index that have no page, or no fact on it, stay with an empty list; a
    Portuguese year without a page stays without months, a French one goes."""
    index = parse_index(archives)
    fact = F.struct("item", "section", "text", "links", "relevant_links")
    found = facts.groupBy("lang", "year", "month").agg(F.sort_array(F.collect_list(fact)).alias("facts"))
    listed = index.where("month is not null").select("lang", "year", "month").distinct()
    none = F.expr(f"cast(array() as {found.schema['facts'].dataType.simpleString()})")
    months = nest_months(listed.join(found, ["lang", "year", "month"], "full").withColumn("facts", F.coalesce("facts", none)), ["lang", "year"])
    bare = index.where("lang = 'pt'").select("lang", "year").distinct().join(months, ["lang", "year"], "left_anti")
    return months.unionByName(bare.withColumn("months", F.expr(f"cast(map() as {months.schema['months'].dataType.simpleString()})")))


def count_facts(facts: DataFrame) -> DataFrame:
    """Number of facts in all."""
    return facts.agg(F.count(F.lit(1)).alias("facts"))


def build(facts: DataFrame, articles: DataFrame, known: DataFrame | None = None, lang: str = "en", asked: DataFrame | None = None, only: str | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """facts (year, month, item, ...) and articles (url, text) -> new corpus rows and queries; None for the part that ``only`` ("corpus",
    "queries") leaves out. ``known`` and ``asked`` are the corpus and the queries of an earlier run: what they have isn't made again."""
    dated = dated_facts(facts)
    registry = url_registry(mentions(dated), known)
    fresh = registry if known is None else registry.join(known.select(F.col("id").alias("cid")), "cid", "left_anti")
    corpus = None if only == "queries" else corpus_entries(fresh, articles)
    if only == "corpus":
        return corpus, None
    queries = query_entries(dated, known_urls(known) if only == "queries" and known is not None else registry, lang)
    return corpus, queries if asked is None else new_queries(queries, asked, lang)


def asked_about(queries: DataFrame, corpus: DataFrame | None, options: Evaluation, encoder: Encoder | None = None) -> DataFrame:
    """Queries with the messages that ask about them."""
    if options.use_fragments and options.mode == "relevant":
        links = queries.select("id", F.posexplode("relevant_articles").alias("place", "article"))
        texts = corpus.select(F.col("id").alias("article"), "text")
        splitter = learn_boundaries(texts.withColumn("lang", F.lit(options.lang))) if options.splitter == "learned" else options.splitter
        found = retrieve_linked(queries, links, texts, encoder, splitter, options.top_k, lang=options.lang)
        asked = queries.join(found, "id")
    else:
        asked = abstracts_of(queries, corpus, options.mode)
    return asked.withColumn("messages", messages("text", "contexts", options.mode, options.allow_idk, options.no_think))


def _covered(judged: DataFrame, options: Evaluation) -> DataFrame:
    return judged.withColumn("coverage", F.when(~F.col("failed"), coverage("keywords", "reasoning", options.lang)))


def judge(queries: DataFrame, corpus: DataFrame, chat: Chat, options: Evaluation, encoder: Encoder | None = None) -> DataFrame:
    """Predictions of the queries: context, messages, verdict, coverage. Store the result before reading it twice."""
    asked = asked_about(queries, corpus, options, encoder)
    return _covered(verdicts(asked, chat, options.attempts, options.pause, options.sampling, options.max_threads, options.rate or None), options)


def _settle(spark: SparkSession, folder: str, run: str, options: Evaluation) -> None:
    """Add what the finished chunks of a run hold to the logs, each once however often this is begun, and delete the run."""
    path = f"{folder}/judged/{run}"
    judged = _covered(results(spark, path, VERDICT), options)
    append_outputs(judged, f"{folder}/outputs", run)
    append_failures(judged, f"{folder}/failures", run)
    append_predictions(judged, f"{folder}/predictions", run)
    delete(spark, path)


def run_evaluation(queries: DataFrame, corpus: DataFrame, chat: Chat, options: Evaluation, folder: str, encoder: Encoder | None = None) -> DataFrame:
    """Judge what remains, add predictions, outputs and failures to ``folder``, and write and return the results over all queries.

    Verdicts are kept chunk by chunk. What an earlier run was broken off with is taken over first: at most one chunk a task is asked again."""
    spark, path, began = queries.sparkSession, f"{folder}/predictions", time.time()
    for run in children(spark, f"{folder}/judged"):
        _settle(spark, folder, run, options)
    todo = remaining(queries, scan_predictions(spark, path), options.retry_failed)
    run, asked = f"run-{uuid.uuid4().hex}", asked_about(todo, corpus, options, encoder)
    kept_verdicts(asked, chat, qualified(spark, f"{folder}/judged/{run}"), options.attempts, options.pause, options.sampling, options.max_threads, options.rate or None, options.chunk)
    _settle(spark, folder, run, options)
    found = stored(evaluate(queries, latest(scan_predictions(spark, path)), options.model).withColumn("seconds", F.lit(time.time() - began)), "results")
    write_results(found.drop("seconds"), f"{folder}/results")
    return found


def report(results: DataFrame) -> str:
    """The results in lines for the console, metrics to four decimals."""
    r = results.first().asDict()
    lines = [f"{name}: {r[name]:.4f}" for name in ("accuracy", "recall (without idk)", "idk_ratio", "mean_coverage")]
    stats = ", ".join(f"{k}: {v}" for k, v in sorted(r["stats"].items()))
    return "\n".join([f"model: {r['model']}", *lines, f"answers: {stats}", f"seconds: {r['seconds']:.1f}"])
