"""Pages over the network: a data source that Spark reads in batches or as a stream, one task for each share of the hosts."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.text import article_key, normalize_text
from . import log
from .storage import qualified, stored

PAGE = "url string, host string, status int, html string, error string, attempts int"
#: URLs of a task, about; seconds between two requests to a host, attempts, seconds to wait for a reply.
SHARE, PAUSE, ATTEMPTS, TIMEOUT = 2000, 1.0, 3, 30.0
#: Statuses that may go away, and the query for an article's plain text.
PASSING = frozenset((408, 425, 429, 500, 502, 503, 504))
EXTRACT = {"action": "query", "prop": "extracts", "explaintext": "1", "format": "json"}


def host_of(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/?#]+)", 1))


def add_urls(urls: DataFrame, folder: str, share: int = SHARE, token: str | None = None) -> int:
    """Add the distinct URLs of ``urls`` (url) to the log in ``folder`` as one append; its number. Nulls are left out.

    All URLs of a host are in one file, since a host is asked by one task only; hosts are spread over files of about ``share`` URLs, and in a
    file every host has its first URL before any has its second, so that pauses between requests to one are spent on the others.
    """
    rows = urls.where("url is not null").select("url").distinct().withColumn("host", host_of("url"))
    rows = rows.withColumn("turn", F.row_number().over(W.partitionBy("host").orderBy("url")))
    rows = stored(rows, "urls")
    files = max(1, -(-rows.count() // share))
    return log.append(rows.repartition(files, "host").sortWithinPartitions("turn", "host").select("url", "host"), folder, "parquet", token)


@dataclass(frozen=True)
class Asker:
    """One request at a time: a pause for each host, more attempts where the trouble may pass."""

    pause: float = PAUSE
    attempts: int = ATTEMPTS
    timeout: float = TIMEOUT
    agent: str = "factloom"

    def once(self, url: str) -> tuple[int | None, str | None, str | None, float]:
        """(status, text, error, seconds the host wants to be left alone)."""
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": self.agent}), timeout=self.timeout) as reply:
                return reply.status, reply.read().decode(reply.headers.get_content_charset() or "utf-8", "replace"), None, 0.0
        except urllib.error.HTTPError as e:
            after = e.headers.get("Retry-After", "") if e.headers else ""
            return e.code, None, f"{e.code} {e.reason}", float(after) if after.isdigit() else 0.0
        except (OSError, ValueError, LookupError) as e:  # no connection, no URL, no such charset
            return None, None, f"{type(e).__name__}: {e}", 0.0

    def pages(self, rows: Iterator[tuple[str, str]]) -> Iterator[tuple]:
        """(url, host) -> rows of PAGE, in order; every URL gives one, whatever became of it."""
        free: dict[str, float] = {}  # host -> when it may be asked again
        for url, host in rows:
            for n in range(1, self.attempts + 1):
                time.sleep(max(0.0, free.get(host, 0.0) - time.monotonic()))
                status, text, error, wait = self.once(url)
                free[host] = time.monotonic() + max(self.pause, wait)
                if error is None or status is not None and status not in PASSING or isinstance(error, str) and error.startswith(("ValueError", "InvalidURL")):
                    break
                free[host] += self.pause * (2 ** (n - 1) - 1)
            yield url, host, status, text, error, n


@dataclass
class _File(InputPartition):
    path: str


class _Reading:
    """What the two readers share: files of the log, and what a task does with one."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.asker = Asker(float(options.get("pause", PAUSE)), int(options.get("attempts", ATTEMPTS)), float(options.get("timeout", TIMEOUT)), options.get("agent", "factloom"))

    def entries(self) -> dict[int, str]:
        fs, top = pyarrow.fs.FileSystem.from_uri(self.folder)
        found = fs.get_file_info(pyarrow.fs.FileSelector(f"{top}/_log", allow_not_found=True))
        out = {}
        for f in found:
            if f.base_name.isdigit():
                with fs.open_input_stream(f.path) as s:
                    out[int(f.base_name)] = json.loads(s.read())["name"]
        return out

    def files(self, after: int, upto: int) -> list[_File]:
        fs, top = pyarrow.fs.FileSystem.from_uri(self.folder)
        names = [name for n, name in sorted(self.entries().items()) if after < n <= upto]
        found = [f.path for name in names for f in fs.get_file_info(pyarrow.fs.FileSelector(f"{top}/append={name}")) if f.base_name.endswith(".parquet")]
        return [_File(p) for p in found]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.folder)
        names = [x.split()[0] for x in PAGE.split(", ")]
        kinds = [pa.int32() if x.endswith(" int") else pa.string() for x in PAGE.split(", ")]
        with fs.open_input_file(partition.path) as f:
            rows = ((u, h) for b in pq.ParquetFile(f).iter_batches(256) for u, h in zip(b.column("url").to_pylist(), b.column("host").to_pylist(), strict=True))
            held, weight = [], 0
            for row in self.asker.pages(rows):
                held.append(row)
                weight += len(row[3] or "") + 100
                if weight > 1 << 22:  # a batch of about four megabytes
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                    held, weight = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


class _Batch(_Reading, DataSourceReader):
    def partitions(self):
        return self.files(0, max(self.entries(), default=0)) or [_File("")]

    def read(self, partition):
        return super().read(partition) if partition.path else iter(())


class _Stream(_Reading, DataSourceStreamReader):
    """Offsets are numbers of appends: each micro-batch asks for the URLs that were added since the last one."""

    def initialOffset(self):
        return {"number": 0}

    def latestOffset(self):
        return {"number": max(self.entries(), default=0)}

    def partitions(self, start, end):
        return self.files(start["number"], end["number"])

    def commit(self, end):
        pass


class PageSource(DataSource):
    """``spark.read.format("factloom_pages").option("path", folder)``, or readStream: the pages of the URLs in the log at ``folder`` (PAGE).

    Every URL gives a row: a page with its status and html, or the status or error that is left after all attempts. Options: pause (seconds
    between two requests to a host), attempts, timeout, agent. Each reading asks anew: store the result before it is used twice.
    """

    @classmethod
    def name(cls):
        return "factloom_pages"

    def schema(self):
        return PAGE

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def fetched_pages(urls: DataFrame, folder: str, **options) -> DataFrame:
    """urls (url) -> stored pages (PAGE), each URL asked for once; ``folder`` keeps the list of URLs."""
    spark = urls.sparkSession
    folder = qualified(spark, folder)
    add_urls(urls, folder)
    return stored(_source(spark.read, folder, options).load(), "pages")


def _source(reader, folder: str, options: dict):
    reader._spark.dataSource.register(PageSource)
    reader = reader.format(PageSource.name()).option("path", folder)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader


def follow_pages(spark: SparkSession, folder: str, **options) -> DataFrame:
    """A stream of the pages of URLs that are added to the log in ``folder``."""
    return _source(spark.readStream, qualified(spark, folder), options).load()


def extract_url(lang: Column, title: Column, endpoint: str = "https://{lang}.wikipedia.org/w/api.php") -> Column:
    """Where the plain text of an article is to be had."""
    before, _, after = endpoint.partition("{lang}")
    where = F.concat(F.lit(before), lang, F.lit(after)) if "{lang}" in endpoint else F.lit(endpoint)
    return F.concat(where, F.lit("?" + urllib.parse.urlencode(EXTRACT) + "&titles="), F.url_encode(title))


def online_articles(urls: DataFrame, folder: str, endpoint: str = "https://{lang}.wikipedia.org/w/api.php", **options) -> DataFrame:
    """urls (url) -> (url, text, error): the extract of the first page of each reply; '' for other URLs, missing articles and failures."""
    lang, title = article_key(F.col("url"))
    keyed = stored(urls.select("url").distinct().withColumn("api", extract_url(lang, title, endpoint)), "article-urls")
    got = fetched_pages(keyed.select(F.col("api").alias("url")), folder, **options)
    reply = F.from_json("html", "struct<query:struct<pages:map<string,struct<extract:string>>>>")
    texts = got.select(F.col("url").alias("api"), F.get(F.map_values(reply["query"]["pages"]), F.lit(0))["extract"].alias("text"), "error")
    return keyed.join(texts, "api", "left").select("url", F.coalesce(normalize_text("text"), F.lit("")).alias("text"), "error")
