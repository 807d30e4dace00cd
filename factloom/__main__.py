"""The three programs on the command line: python -m factloom scrape | build | evaluate."""

from __future__ import annotations

import argparse
import importlib
import sys
from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.inflection import learn_lemmas
from .functions.lemmas import register_lemmatizer
from .plans import runs
from .sources import fetch, files
from .sources.storage import scratch
from .sources.articles import fetched_articles, local_articles


def named(spec: str):
    """What ``module:name`` names."""
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def options() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="factloom")
    programs = top.add_subparsers(dest="program", required=True)
    p = programs.add_parser("scrape", help="archive pages and fact pages to facts")
    for name, what in (("archives", "Parquet with lang, url, html"), ("output", "folder of the nested export")):
        p.add_argument(f"--{name}", required=True, help=what)
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--pages", help="Parquet with url, html")
    source.add_argument("--fetch", help="folder for lists of URLs: archives and pages are asked for over the network")
    p.add_argument("--wait", type=float, default=fetch.PAUSE, help="seconds between two requests to a host")
    p = programs.add_parser("build", help="facts to a corpus and queries")
    p.add_argument("--facts", required=True, help="nested export")
    p.add_argument("--articles", help="Parquet with lang, title, text")
    p.add_argument("--fetch", help="folder for lists of URLs: articles are asked for over the network, instead of --articles")
    p.add_argument("--endpoint", default="https://{lang}.wikipedia.org/w/api.php")
    p.add_argument("--fetcher", help="module:function of (language, title), instead of --articles")
    p.add_argument("--corpus", required=True)
    p.add_argument("--queries", required=True)
    p.add_argument("--lang", default="en")
    p.add_argument("--lemmas", help="Parquet with lang, form, lemma: pairs that lemmas are learned from")
    only = p.add_mutually_exclusive_group()
    only.add_argument("--corpus-only", dest="only", action="store_const", const="corpus")
    only.add_argument("--queries-only", dest="only", action="store_const", const="queries")
    p = programs.add_parser("evaluate", help="queries and a corpus to predictions and results")
    for name in ("queries", "corpus", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--chat", required=True, help="module:function from messages to a reply")
    p.add_argument("--lemmas", help="Parquet with lang, form, lemma: pairs that lemmas are learned from")
    p.add_argument("--encoder", help="module:function from texts to vectors")
    for f in fields(runs.Evaluation):
        flag = f"--{f.name.replace('_', '-')}"
        if isinstance(f.default, bool):
            p.add_argument(flag, action="store_true")
        else:
            p.add_argument(flag, type=type(f.default), default=f.default)
    return top


def _warn(spark: SparkSession, *paths: tuple[str, str]) -> None:
    for path, schema in paths:
        if said := files.skipped(spark, path, schema):
            print(said, file=sys.stderr)


def main(words: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = options().parse_args(words)
    spark = spark or SparkSession.builder.appName(f"factloom {a.program}").getOrCreate()
    with scratch(spark):
        run(a, spark)


def run(a: argparse.Namespace, spark: SparkSession) -> None:
    if getattr(a, "lemmas", None):
        register_lemmatizer(learn_lemmas(spark.read.parquet(a.lemmas)).factory())
    if a.program == "scrape":
        archives = spark.read.parquet(a.archives)
        archives, pages = runs.online(archives, a.fetch, pause=a.wait) if a.fetch else (archives, spark.read.parquet(a.pages))
        for r in pages.where("html is null").take(20) if a.fetch else []:
            print(f"{r['url']}: no page, {r['error']}", file=sys.stderr)
        facts = runs.scrape(archives, pages)
        files.write_nested(runs.nested(archives, facts), a.output)
        print(f"facts: {runs.count_facts(facts).first()[0]}")
    elif a.program == "build":
        _warn(spark, (a.corpus, files.CORPUS), (a.queries, files.QUERIES))
        known, asked = files.scan_corpus(spark, a.corpus), files.scan_queries(spark, a.queries)
        facts = files.scan_facts(spark, a.facts)
        urls = runs.mentions(runs.dated_facts(facts)).select("url").distinct()
        urls = urls.join(runs.known_urls(known), "url", "left_anti")
        if a.fetcher:
            texts = fetched_articles(urls, named(a.fetcher))
        elif a.fetch:
            texts = fetch.online_articles(urls, a.fetch, a.endpoint).drop("error")
        else:
            texts = local_articles(urls, spark.read.parquet(a.articles)) if a.articles else urls.withColumn("text", F.lit(""))
        corpus, queries = runs.build(facts, texts, known, a.lang, asked, a.only)
        if queries is not None:  # before the corpus they refer to is added to
            files.append_lines(files.original_names(queries.drop("content_key")), a.queries)
        if corpus is not None:
            files.append_lines(corpus, a.corpus)
    else:
        chosen = runs.Evaluation(**{f.name: getattr(a, f.name) for f in fields(runs.Evaluation)})
        _warn(spark, (a.corpus, files.CORPUS), (a.queries, files.QUERIES))
        for r in files.unreadable_files(spark, f"{a.output}/predictions").take(20):
            print(f"{r['file']}: left out, {r['reason']}", file=sys.stderr)
        queries, corpus = files.scan_queries(spark, a.queries), files.scan_corpus(spark, a.corpus)
        print(runs.report(runs.run_evaluation(queries, corpus, named(a.chat), chosen, a.output, named(a.encoder)() if a.encoder else None)))


if __name__ == "__main__":
    main()
