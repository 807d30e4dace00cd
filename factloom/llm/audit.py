"""Filter interaction audit: what each filter removes at each place of every order, from counts of failure masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, store, table

WORD = "[^\\x20\\x09-\\x0D]+"
#: The five filters, by letter: E, copies of another document, is decided over the whole table.
LETTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 50, 65, 5
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
REPORT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def own_failures(text: Column) -> dict[str, Column]:
    """Whether a text fails A to D: too few words, too few distinct ones, too many capitals, a symbol."""
    words = F.regexp_count(text, F.lit(WORD))
    distinct = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))))
    return {
        "A": words < MIN_WORDS,
        "B": distinct * 100 < words * DISTINCT_PERCENT,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * CAPITALS_PERCENT,
        "D": text.rlike("[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row for each document: id, part, mask (bit i: fails the i-th letter), good, toxic.

    Null text is the empty text, a null part the empty string. Copies (E) are documents of whose text, told apart by its SHA-256, a smaller id
    has one too; a null id is neither smaller nor larger than any. Equal rows count one by one and are no copies of each other. Of several
    labels of an id one that says 1 decides; a document without a label is neither good nor toxic. No documents give no rows; other columns,
    whatever their names, are not read. Only ids, digests and bits are shuffled; texts that occur once take no part in the second join.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = sum((F.when(fails, F.lit(1 << i)).otherwise(0) for i, fails in enumerate(own_failures(F.col("text")).values())), F.lit(0))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    slim = slim.select("id", "part", bits.alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(flag("quality"), flag("toxic"))
    said = store(said.where("quality or toxic"), "said")  # a table, so that rows without an id can be split in the join
    slim = store(slim, "masks")  # texts are read once
    firsts = slim.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    firsts = store(firsts.select("digest", "first"), "firsts")  # a table, so that the copies of one text can be split in the join
    known = F.col("id").isNotNull()
    out = slim.join(firsts, "digest", "left").select("id", "part", (F.col("mask") + F.when(known & (F.col("id") > F.col("first")), 1 << LETTERS.index("E")).otherwise(0)).alias("mask"))
    out = out.join(said, "id", "left")
    out = out.select("id", "part", "mask", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    out._from = slim, firsts, said
    return out


def cells(masks: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): counts of the documents with each mask, at most 32 rows a part. A hot part is summed before it is shuffled."""
    one = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0)).alias(c)
    return masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), one("good"), one("toxic"))


def single_swaps(n: int) -> Iterator[tuple[tuple[int, ...], int | None]]:
    """All orders of n things, each made from the one before by swapping two neighbours, with the place of that swap (None at first).

    The largest movable thing, one that looks at a smaller neighbour, moves; all larger ones turn round."""
    order, looks = list(range(n)), [-1] * n
    yield tuple(order), None
    while True:
        at = {x: i for i, x in enumerate(order)}
        movable = [x for x in order if 0 <= at[x] + looks[x] < n and order[at[x] + looks[x]] < x]
        if not movable:
            return
        x = max(movable)
        i = min(at[x], at[x] + looks[x])
        order[i], order[i + 1] = order[i + 1], order[i]
        for y in range(x + 1, n):
            looks[y] = -looks[y]
        yield tuple(order), i


def walk(counts: np.ndarray) -> tuple[list[str], dict[str, np.ndarray]]:
    """counts (parts, 3, 32): documents, good and toxic ones by mask -> the orders, and for each number an array (parts, orders, steps).

    The walk goes from order to order by single swaps. What stands before the two swapped steps and what is left after them is the same as
    before, so only these two are counted anew, each from the cells that fail its filter and none of those ahead of it. Shapley sums add up
    what each filter removes in the order the walk has come to.
    """
    parts, n = len(counts), len(LETTERS)
    masks = np.arange(1 << n)
    failing = np.stack([counts[:, 0, (masks >> f) & 1 == 1].sum(1) for f in range(n)], 1)
    only = np.stack([counts[:, 0, 1 << f] for f in range(n)], 1)
    removed, kept = np.zeros((parts, 3, n), np.int64), np.zeros((parts, n), np.int64)  # by step
    shapley = np.zeros((parts, n), np.int64)
    names, out = [], {c: [] for c in COUNTS[:-1]}
    for order, swapped in single_swaps(n):
        for step in range(n) if swapped is None else (swapped, swapped + 1):
            ahead = sum(1 << f for f in order[:step])
            here = (masks & ahead == 0) & ((masks >> order[step]) & 1 == 1)
            removed[:, :, step] = counts[:, :, here].sum(2)
            kept[:, step] = counts[:, 0, masks & (ahead | 1 << order[step]) == 0].sum(1)
        at = list(order)
        shapley[:, at] += removed[:, 0]
        names.append("".join(LETTERS[f] for f in order))
        for c, x in zip(out, (kept, removed[:, 0], failing[:, at] - removed[:, 0], only[:, at], removed[:, 1], removed[:, 2]), strict=True):
            out[c].append(x.copy())
    stacked = {c: np.stack(x, 1) for c, x in out.items()}
    where = np.array([[LETTERS.index(x) for x in name] for name in names])
    return names, stacked | {"shapley": shapley[:, where]}


def report(counted: DataFrame) -> DataFrame:
    """cells() -> a row for each part, order and step. A part has at most 32 cells, which meet in one row; parts are walked in batches."""
    rows = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for low in range(0, len(b), 64):
                some = b.iloc[low : low + 64]
                counts = np.zeros((len(some), 3, 1 << len(LETTERS)), np.int64)
                for i, x in enumerate(some["cells"]):
                    for c in x:
                        counts[i, :, c["mask"]] += (c["n"], c["good"], c["toxic"])
                names, found = walk(counts)
                steps = np.arange(1, len(LETTERS) + 1)
                each = len(names) * len(steps)
                yield pd.DataFrame(
                    {"part": np.repeat(some["part"].to_numpy(), each), "filter_order": np.tile(np.repeat(names, len(steps)), len(some)), "step": np.tile(steps, len(some) * len(names)).astype(np.int32)}
                    | {c: x.reshape(-1) for c, x in found.items()}
                )

    return rows.mapInPandas(run, REPORT)


def audit_filters(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """The audit of the five filters: failure_masks(), cells() and report(). No documents give no rows.

    Cells are stored, so that the table of masks can go: the report reads at most 32 rows a part."""
    masks = failure_masks(docs, labels, **columns)
    counted = store(cells(masks), "cells")
    discard(*masks._from)
    return report(counted)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
      + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
      + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d LEFT JOIN l USING (doc_id)
), c AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask
), b AS (SELECT unnest(range(5))::INT AS i), o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM b a, b b, b c, b d, b e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (
  SELECT list_aggregate(list_transform(o, lambda x: substr('ABCDE', x + 1, 1)), 'string_agg', '') AS filter_order, step::INT AS step, o[step] AS f,
    coalesce(list_sum(list_transform(o[1:step - 1], lambda x: 1 << x)), 0)::BIGINT AS ahead FROM o, range(1, 6) r(step)
), r AS (
  SELECT part, filter_order, step, f, sum(n) FILTER (mask & ahead = 0 AND (mask >> f) & 1 = 0) AS kept, sum(n) FILTER (mask & ahead = 0 AND (mask >> f) & 1 = 1) AS removed,
    sum(n) FILTER (mask & ahead <> 0 AND (mask >> f) & 1 = 1) AS redundant, sum(n) FILTER (mask = 1 << f) AS unique_fails,
    sum(good) FILTER (mask & ahead = 0 AND (mask >> f) & 1 = 1) AS good_lost, sum(toxic) FILTER (mask & ahead = 0 AND (mask >> f) & 1 = 1) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r
"""
