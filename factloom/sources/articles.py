"""Article texts by URL: a pluggable step. The default is a join with texts at hand; a fetcher calls out from the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import abstract, article_key, normalize_text

#: (language, title) -> plain text of the article, or None.
Fetcher = Callable[[str, str], str | None]


def local_articles(urls: DataFrame, articles: DataFrame) -> DataFrame:
    """urls (url) and articles (lang, title, text) -> (url, text); other URLs and missing articles have the text ''."""
    lang, title = article_key(F.col("url"))
    keyed = urls.withColumn("lang", lang).withColumn("title", title)
    found = keyed.join(articles.dropDuplicates(["lang", "title"]), ["lang", "title"], "left")
    return found.select("url", F.coalesce(normalize_text("text"), F.lit("")).alias("text"))


def fetched_articles(urls: DataFrame, fetch: Fetcher) -> DataFrame:
    """The same by calls, one for each distinct URL; store the result before using it twice."""
    lang, title = article_key(F.col("url"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [(fetch(g, t) or "") if g is not None and t is not None else "" for g, t in zip(b["lang"], b["title"], strict=True)]
            yield pd.DataFrame({"url": b["url"], "text": text})

    got = urls.dropDuplicates(["url"]).select("url", lang.alias("lang"), title.alias("title")).mapInPandas(run, "url string, text string")
    return got.select("url", normalize_text("text").alias("text"))


def with_abstract(articles: DataFrame) -> DataFrame:
    return articles.withColumn("abstract", abstract("text"))
