"""Ids of URLs over micro-batches: each new URL gets the next number once, and a batch that is run again finds the ids it gave."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from ..sources import log
from ..sources.storage import stored

REGISTRY = "url string, cid string"


def registered(spark: SparkSession, path: str) -> DataFrame:
    """(url, cid) of all URLs that have an id."""
    return log.read(spark, path, REGISTRY, "parquet").select("url", "cid")


def register_urls(mentions: DataFrame, path: str, token: str) -> DataFrame:
    """mentions (idx, pos, url), a batch that is called ``token`` -> (url, cid) of the URLs that are new with it, added to the registry at ``path``.

    The registry is an append log. Its last entry says which number is free, so a batch reserves the range behind it by being the next append:
    of two that are made at once one comes too late, and is made again behind the other. A batch that is there already is not added again; its
    ids are read. New URLs are numbered in the order of their first mention. Null and empty URLs have no id.
    """
    spark = mentions.sparkSession
    first = mentions.where("url <> ''").groupBy("url").agg(F.min(F.struct("idx", "pos")).alias("at"))
    first = stored(first.select("url", F.col("at.idx").alias("idx"), F.col("at.pos").alias("pos")), "mentioned")
    while True:
        known = log.entries(spark, path)
        done = next((e for e in known.values() if e.get("token") == token), None)
        if done is not None:
            return spark.read.schema(REGISTRY).parquet(f"{path}/append={done['name']}")
        last = max(known, default=0)
        free = known[last]["note"]["free"] if known else 0
        new = first.join(log.read(spark, path, REGISTRY, "parquet", last).select("url"), "url", "left_anti") if known else first
        numbered = stored(number_rows(new, ["idx", "pos", "url"], "n").select("url", F.concat(F.lit("c-"), (F.col("n") + free).cast("string")).alias("cid")), "new-urls")
        if log.append_after(numbered, path, last, "parquet", token, {"free": free + numbered.count()}):
            return numbered


def follow_urls(mentions: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, name: str = "urls") -> None:
    """The same for a stream of mentions, batch by batch, until what is there now is done. ``then`` gets the new URLs of each batch with their
    ids and the batch's number; after a failure it gets the same ones again."""

    def one(batch: DataFrame, number: int) -> None:
        new = register_urls(batch, path, f"{name}-{number}")
        if then is not None:
            then(new, number)

    mentions.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(one).start().awaitTermination()
