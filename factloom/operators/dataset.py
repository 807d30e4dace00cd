"""From facts to a corpus with stable ids and to queries with keywords."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lemmas import for_keywords, lemmatize_with
from ..functions.months import fact_month, month_number
from ..functions.text import abstract, percent_decode, spoken_title, words
from .numbering import number_rows


def dated_facts(facts: DataFrame) -> DataFrame:
    """Facts with ``fact_date`` and ``idx``, their number in the order of year, month and item."""
    dated = facts.withColumn("fact_date", fact_month(F.col("year"), F.col("month")))
    return number_rows(dated, ["year", month_number(F.col("month")), "month", "item"], "idx")


def mentions(facts: DataFrame) -> DataFrame:
    """(idx, pos, url, relevant): every link of every fact, all links before the relevant ones; empty URLs are left out. URLs are decoded."""
    links = F.transform("links", lambda u: F.struct(u.alias("url"), F.lit(False).alias("relevant")))
    relevant = F.transform("relevant_links", lambda u: F.struct(u.alias("url"), F.lit(True).alias("relevant")))
    rows = facts.select("idx", F.posexplode(F.concat(links, relevant)).alias("pos", "x"))
    return rows.select("idx", "pos", percent_decode(F.col("x.url")).alias("url"), "x.relevant").where("url <> ''")


def next_id(corpus: DataFrame) -> int:
    """One more than the largest number of an id ``c-N``, 0 without any."""
    top = corpus.agg(F.max(F.split_part("id", F.lit("-"), F.lit(2)).try_cast("long"))).first()[0]
    return 0 if top is None else top + 1


def url_registry(mentioned: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(url, cid): ids of known URLs kept, new URLs numbered in the order of their first mention, from the next free number on."""
    first = mentioned.groupBy("url").agg(F.min(F.struct("idx", "pos")).alias("first"))
    start = 0
    if known is not None:
        start = next_id(known)
        known = known_urls(known)
        first = first.join(known, "url", "left_anti")
    new = number_rows(first.select("url", F.col("first.idx").alias("i"), F.col("first.pos").alias("p")), ["i", "p"], "n")
    new = new.select("url", F.concat(F.lit("c-"), (F.col("n") + start).cast("string")).alias("cid"))
    return new if known is None else known.unionByName(new)


def known_urls(known: DataFrame) -> DataFrame:
    """(url, cid) of a corpus at hand."""
    return known.select(percent_decode(F.col("metadata.url")).alias("url"), F.col("id").alias("cid")).dropDuplicates(["url"])


def corpus_entries(registry: DataFrame, articles: DataFrame) -> DataFrame:
    """Corpus rows; every URL has one, whatever its text."""
    rows = registry.join(articles, "url", "left").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select(F.col("cid").alias("id"), "text", abstract("text").alias("abstract"), F.struct(percent_decode(F.col("url")).alias("url")).alias("metadata"))


def keywords(title_words: Column, fact_words: Column, lemmatize: Callable[[Column], Column]) -> Column:
    """Lemmas of the titles' words that are not lemmas of the fact's, in code-point order. Words are sorted before they are lemmatized."""
    return F.sort_array(F.array_distinct(F.array_except(for_keywords(lemmatize(title_words)), for_keywords(lemmatize(fact_words)))))


def query_entries(facts: DataFrame, registry: DataFrame, lang: str = "en") -> DataFrame:
    """Queries ``q-N``: ids of linked and relevant articles in the order of the links, keywords, date. Links without an id are left out."""
    found = mentions(facts).join(registry, "url")
    of = lambda relevant: F.transform(F.sort_array(F.collect_list(F.when(F.col("relevant") == relevant, F.struct("pos", "cid")))), lambda x: x["cid"])
    titles = F.collect_set(F.coalesce(spoken_title("url"), F.lit("")))
    lists = found.groupBy("idx").agg(of(False).alias("linked_articles"), of(True).alias("relevant_articles"), titles.alias("titles"))
    rows = facts.select("idx", "text", "fact_date").join(lists, "idx", "left")
    none = F.expr("cast(array() as array<string>)")
    title_words = F.sort_array(F.array_distinct(F.flatten(F.transform(F.coalesce("titles", none), words))))
    return rows.select(
        F.concat(F.lit("q-"), F.col("idx").cast("string")).alias("id"), "text",
        F.coalesce("linked_articles", none).alias("linked_articles"), F.coalesce("relevant_articles", none).alias("relevant_articles"),
        keywords(title_words, words("text"), lemmatize_with(lang)).alias("keywords"), F.struct("fact_date").alias("metadata"),
        F.sha2(F.concat_ws("|", F.lit(lang), "text"), 256).alias("content_key"),
    )


def new_queries(queries: DataFrame, known: DataFrame, lang: str = "en") -> DataFrame:
    """Queries whose fact has none yet, told by language and text, so that facts added in between don't shift what is done; numbered on from
    the largest known id."""
    done = known.select(F.sha2(F.concat_ws("|", F.lit(lang), "text"), 256).alias("content_key")).distinct()
    start = known.agg(F.max(F.split_part("id", F.lit("-"), F.lit(2)).try_cast("long"))).first()[0]
    place = F.split_part("id", F.lit("-"), F.lit(2)).cast("long")
    fresh = number_rows(queries.join(done, "content_key", "left_anti"), [place], "_n")
    return fresh.withColumn("id", F.concat(F.lit("q-"), (F.col("_n") + (0 if start is None else start + 1)).cast("string"))).drop("_n")


def unprocessed(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def known_titles(mentioned: DataFrame, registry: DataFrame) -> DataFrame:
    """Titles of the mentioned URLs that have an id."""
    return mentioned.join(registry, "url", "left_semi").select("idx", spoken_title("url").alias("title"))
