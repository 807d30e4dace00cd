"""Connected components by contraction: every node hooks onto its smallest neighbour until no link is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, store


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node, comp) of every linked node; equal comp means connected. Each round is written to the shared folder, and
    deleted once the next one is there: only the labels stay."""
    links = store(links.where("a <> b").select("a", "b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = store(both.groupBy(F.col("a").alias("old")).agg(F.least("old", F.min("b")).alias("new")), "hooks")
        if labels is None:
            labels = hook.select(F.col("old").alias("node"), F.col("new").alias("comp"))
            labels._stored, done = hook._stored, None
        else:
            moved, before = labels.join(hook, labels["comp"] == hook["old"], "left"), labels
            labels = store(moved.select("node", F.coalesce("new", "comp").alias("comp")), "labels")
            discard(before)
            done = hook
        h1, h2 = hook.toDF("a", "ra"), hook.toDF("b", "rb")
        left = links.join(h1, "a").join(h2, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        links, before = store(left.distinct(), "links"), links
        discard(before, done)
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    discard(links)
    return labels
