"""Conversation prefix trie: which conversations share their beginnings, built depth by depth, and rolled up from the leaves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, store, table

WORD = "[^\\x20\\x09-\\x0D]+"
#: Turns of a conversation that are in one row; a longer one is fetched block by block while it shares its beginning.
BLOCK = 1024
#: Of how many bits of the ids the digits are joined in one row before they are hashed one after the other: at most 4096 ids.
ID_BITS = 12
#: Rebuilding: conversations of one family of ids begin with up to SHARED - 1 turns of its first.
FAMILY, SHARED = 20, 4
NOBODY = hashlib.sha256(b"").hexdigest()
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def placed_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> stored (conv, at, key, words): place in the conversation, 128-bit name of (role, text), words of the text.

    Turns are range-sorted by (conversation, turn with null first, name), so a conversation of any length is dealt over tasks; each task numbers
    its rows, and what a conversation has in the tasks before (one row for each task at most) is added. Equal rows keep apart.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    slim = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), named.alias("key"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    order = ["conv", F.col("turn").asc_nulls_first(), "key"]
    # the last column only parts rows that are equal, of which one may be very frequent
    placed = slim.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order, "salt").sortWithinPartitions(*order).drop("turn", "salt")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, seen = None, 0
        for b in batches:
            conv = b.column("conv").to_numpy()
            if not len(conv):
                continue
            new = np.ones(len(conv), bool)
            new[1:] = conv[1:] != conv[:-1]
            new[0] = conv[0] != before
            first = np.maximum.accumulate(np.where(new, np.arange(len(conv)), -1))
            at = np.arange(len(conv)) - first
            at[first < 0] += seen - 1
            before, seen = conv[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=[*b.schema.names, "at"])

    numbered = store(placed.mapInArrow(number, "conv long, key binary, words int, at long").withColumn("part", F.spark_partition_id()), "turns")
    spans = numbered.groupBy("conv", "part").agg((F.max("at") + 1).alias("n"))
    earlier = spans.select("conv", "part", (F.sum("n").over(W.partitionBy("conv").orderBy("part")) - F.col("n")).alias("earlier")).where("earlier > 0")
    # a task's first conversation only can have rows in the tasks before: as many rows as tasks at most
    out = numbered.join(F.broadcast(earlier), ["conv", "part"], "left").select("conv", (F.col("at") + F.coalesce("earlier", F.lit(0))).alias("at"), "key", "words")
    out._from = numbered
    return out


def shared_turns(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % SHARED


def rebuilt(turns: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """placed_turns() -> the conversations (conv, len, next, entries) and their own turns in blocks (conv, block, entries).

    A conversation has the first h turns of its family's first, then its own turns after its first h. Its row has the head and block 0; an
    entry is (key, words). A block has at most ``block`` turns, a head three, a family 20 conversations.
    """
    family, h = F.col("conv") - F.col("conv") % FAMILY, shared_turns(F.col("conv"))
    entry = F.struct("at", F.struct("key", "words").alias("entry"))
    listed = lambda: F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["entry"])
    own = turns.where(F.col("at") >= h).withColumn("block", F.floor((F.col("at") - h) / block))
    blocks = store(own.groupBy("conv", "block").agg(listed().alias("entries")), "blocks")
    heads = turns.where((F.col("conv") % FAMILY == 0) & (F.col("at") < SHARED - 1)).groupBy(F.col("conv").alias("family")).agg(listed().alias("head"))
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).select("conv", "n", family.alias("family"), h.cast("int").alias("h"))
    nothing = F.expr("cast(array() as array<struct<key:binary,words:int>>)")
    first = blocks.where("block = 0").select("conv", F.col("entries").alias("own"))
    rows = convs.join(heads, "family", "left").join(first, "conv", "left")
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", nothing), F.lit(1), F.col("h"))).otherwise(nothing)
    rows = rows.select("conv", (F.size(head) + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"), F.concat(head, F.coalesce("own", nothing)).alias("entries"))
    return rows.select("conv", "len", F.lit(1).cast("long").alias("next"), "entries"), blocks


def _common(a: Column, b: Column) -> Column:
    """Number of entries that two lists share from their start; the smallest and the largest of a group share what all of it shares."""
    same = F.zip_with(F.slice(a, F.lit(1), F.least(F.size(a), F.size(b))), F.slice(b, F.lit(1), F.least(F.size(a), F.size(b))), lambda x, y: x["key"] == y["key"])
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.size(same)).cast("int")


def level(live: DataFrame) -> DataFrame:
    """Groups of live conversations by (node, next turn): the least conversation, their number, and ``run``, the words of the turns that all
    of them go through from here, the next one included. Where nobody else is left, that is the whole rest (``len`` is its end)."""
    groups = live.groupBy("first", "depth", F.get("entries", F.lit(0))["key"].alias("key")).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.min("entries").alias("lo"), F.max("entries").alias("hi"), F.max("len").alias("len"))
    shared = F.slice("lo", F.lit(1), _common(F.col("lo"), F.col("hi")))
    return groups.select("first", "depth", "key", "conv", "n", "len", F.when(F.col("n") > 1, F.transform(shared, lambda x: x["words"])).alias("run"))


def further(live: DataFrame, groups: DataFrame) -> DataFrame:
    """The conversations that share their next node, moved behind the turns of its run. The join can be split where a group is large: its other
    side has one row for each group."""
    on = groups.where("n > 1").select("first", "depth", "key", F.col("conv").alias("to"), F.size("run").alias("k"))
    here = live.withColumn("key", F.get("entries", F.lit(0))["key"])
    moved = here.join(on, ["first", "depth", "key"])
    return moved.select("conv", "len", "next", F.col("to").alias("first"), (F.col("depth") + F.col("k")).alias("depth"), F.slice("entries", F.col("k") + 1, F.size("entries")).alias("entries"))


def refilled(live: DataFrame, blocks: DataFrame) -> DataFrame:
    """``live`` with the next block for those at the end of one; written only if there are any."""
    lacking = "size(entries) = 0 and depth < len"
    if live.where(lacking).isEmpty():
        return live
    more = live.where(lacking).drop("entries").join(blocks.withColumnRenamed("block", "next"), ["conv", "next"])
    more = more.select("conv", "len", (F.col("next") + 1).alias("next"), "first", "depth", "entries")
    out = store(live.where(f"not ({lacking})").unionByName(more), "live")
    discard(live)
    return out


def ending(ends: DataFrame, id_bits: int = ID_BITS) -> DataFrame:
    """(first, depth, conv) -> (first, depth, ends_sha256) over the ids in ascending order. Digits of neighbouring ids are joined in parallel,
    at most 2 ** ``id_bits`` ids in a row; a node's rows then pass the hash in order, one at a time."""
    joined = ends.groupBy("first", "depth", F.shiftright("conv", id_bits).alias("place")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("digits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []
        for b in batches:
            for first, depth, digits in zip(b.column("first").to_pylist(), b.column("depth").to_pylist(), b.column("digits").to_pylist(), strict=True):
                if (first, depth) != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (first, depth), hashlib.sha256(digits.encode())
                else:
                    state.update(b"," + digits.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["first", "depth", "ends_sha256"])
                done = []
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], names=["first", "depth", "ends_sha256"])

    return joined.repartition("first", "depth").sortWithinPartitions("first", "depth", "place").select("first", "depth", "digits").mapInArrow(run, "first long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, block: int = BLOCK, rebuild=rebuilt) -> DataFrame:
    """(conv_id, turn, role, text) -> a row for each node of the trie of the (rebuilt) conversations: NODE, as long but for the hash.

    Level by level, live conversations are grouped by (node, next turn). A group also goes through the turns that all its members share after
    that one, found from its least and its largest rest, so a level costs two joins where conversations part, and a conversation alone leaves
    at once with its whole rest; there are as many levels as partings on one path. Back from the last level, each joins what its children add
    up to. A node is named by its least conversation and its depth.

    Null turns come first, equal turns are ordered by their contents; null role and text are empty; rows without a conv_id take no part; equal
    rows are turns of their own. Other columns, whatever their names, are not read. No conversations give no rows.
    """
    spark = turns.sparkSession
    placed = placed_turns(turns)
    convs, blocks = rebuild(placed, block)
    convs = store(convs, "convs")
    discard(placed._from)
    total = convs.agg(F.min("conv"), F.count(F.lit(1))).first()
    if not total[1]:
        discard(convs, blocks)
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    root = (F.lit(total[0]).cast("long"), F.lit(0).cast("long"))
    live = convs.withColumns({"first": root[0], "depth": root[1]})
    gone = live.where("len = 0").select("first", "depth", "conv")
    levels, reached = [], [convs]
    while True:
        going = live.where("depth < len")
        groups = store(level(going), "level")
        if groups.isEmpty():
            discard(groups)
            break
        levels.append(groups)
        live = refilled(store(further(going, groups), "live"), blocks)
        reached.append(live)
        gone = gone.unionByName(live.where("depth = len").select("first", "depth", "conv"))
    ends = store(ending(gone), "ends")
    discard(*reached, blocks)

    out, below = [], None  # below: (first, depth) of a parent -> sums over its children
    for groups in reversed(levels):
        shared = groups.where("n > 1").withColumns({"top": F.col("depth"), "depth": F.col("depth") + F.size("run"), "parent": F.col("first"), "first": F.col("conv")})
        if below is not None:
            shared = shared.join(below, ["first", "depth"], "left")
        else:
            shared = shared.withColumns({c: F.lit(None).cast("long") for c in ("children", "leaves", "saved")})
        own = (F.col("n") - 1) * F.aggregate("run", F.lit(0).cast("long"), lambda s, x: s + x)
        rolled = shared.select("parent", "top", "first", "depth", "n", "run", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("below"), (own + F.coalesce("saved", F.lit(0))).alias("saved"))
        rolled = store(rolled, "rolled")
        alone = groups.where("n = 1").select(F.col("first").alias("parent"), F.col("depth").alias("top"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        sums = rolled.select("parent", "top", "leaves", "saved").unionByName(alone).groupBy(F.col("parent").alias("first"), F.col("top").alias("depth"))
        below = store(sums.agg(F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "below")
        out += [_of_runs(rolled, ends), _of_one(groups.where("n = 1"))]
    top = below if below is not None else spark.createDataFrame([], "first long, depth long, children long, leaves long, saved long")
    start = spark.range(1).select(root[0].alias("first"), root[1].alias("depth")).join(top, ["first", "depth"], "left").join(ends, ["first", "depth"], "left")
    none = F.lit(0).cast("long")
    rows = start.select(F.col("first").alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total[1]).cast("long").alias("n_convs"), F.coalesce("children", none).alias("n_children"), F.coalesce("leaves", none + 1).alias("n_leaves"), F.coalesce("saved", none).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256"))
    for part in out:
        rows = rows.unionByName(part)
    return rows


def _of_runs(rolled: DataFrame, ends: DataFrame) -> DataFrame:
    """A row for each turn of each run; all but its last node have one child and no end."""
    size = F.size("run")
    rows = rolled.join(ends, ["first", "depth"], "left").select("*", F.posexplode("run").alias("i", "_"))
    last = F.col("i") == size - 1
    rest = F.aggregate(F.slice("run", F.col("i") + 1, size), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select(
        F.col("first").alias("conv_id"), (F.col("top") + F.col("i") + 1).alias("depth"), F.when(F.col("i") == 0, F.col("parent")).otherwise(F.col("first")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("children")).otherwise(F.lit(1).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"),
        ((F.col("n") - 1) * rest + F.col("below")).alias("saved_tokens"), F.when(last, F.coalesce("ends_sha256", F.lit(NOBODY))).otherwise(F.lit(NOBODY)).alias("ends_sha256"),
    )


def _of_one(alone: DataFrame) -> DataFrame:
    """A row for each turn that a conversation goes through alone; a long rest is dealt out in stretches first."""
    stretch = F.explode(F.sequence(F.col("depth") + 1, F.col("len"), F.lit(BLOCK).cast("long"))).alias("low")
    rows = alone.select("conv", "first", F.col("depth").alias("top"), "len", stretch).repartition("conv", "low")
    rows = rows.select("conv", "first", "top", "len", F.explode(F.sequence("low", F.least(F.col("len"), F.col("low") + BLOCK - 1))).alias("depth"))
    last, one = F.col("depth") == F.col("len"), F.lit(1).cast("long")
    return rows.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("top") + 1, F.col("first")).otherwise(F.col("conv")).alias("parent_conv_id"),
        one.alias("n_convs"), F.when(last, one - 1).otherwise(one).alias("n_children"), one.alias("n_leaves"), (one - 1).alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(F.lit(NOBODY)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, turn
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT c, words, k, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) - 1 AS p FROM t
), s AS (
  SELECT DISTINCT c, c::VARCHAR AS id FROM t
), h AS (
  SELECT c, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(8 * length(id)), lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr(id, (i // 8 + 1)::BIGINT, 1))::BIGINT ELSE 0::BIGINT END)),
    lambda a, b: xor(xor(a, b) >> 1, 3988292384::BIGINT * (xor(a, b) & 1))), 4294967295::BIGINT) % 4 AS h FROM s
), b AS (
  SELECT h.c, 0 AS part, p, words, k FROM h JOIN o ON o.c = h.c - h.c % 20 AND p < h UNION ALL SELECT h.c, 1, p, words, k FROM h JOIN o ON o.c = h.c AND p >= h
), r AS (
  SELECT c, words, k, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d FROM b
), x AS (
  SELECT c, d, words, md5(string_agg(k, '') OVER (PARTITION BY c ORDER BY d)) AS node FROM r UNION ALL SELECT c, 0, 0, '' FROM s
), n AS (
  SELECT d, node, min(c) AS f, count(*) AS n, any_value(words) AS w FROM x GROUP BY d, node
), q AS (
  SELECT n.f, n.d, n.n, n.w, u.f AS parent FROM n LEFT JOIN x ON x.c = n.f AND x.d = n.d - 1 LEFT JOIN n u ON u.d = x.d AND u.node = x.node
), k AS (
  SELECT parent AS f, d - 1 AS d, count(*) AS children FROM q WHERE d > 0 GROUP BY ALL
), m AS (
  SELECT u.f, u.d, count(*) FILTER (k.children IS NULL) AS leaves, sum((q.n - 1) * q.w) AS saved
  FROM q LEFT JOIN k ON k.f = q.f AND k.d = q.d JOIN x ON x.c = q.f AND x.d <= q.d JOIN n u ON u.d = x.d AND u.node = x.node GROUP BY ALL
), e AS (
  SELECT n.f, n.d, sha256(string_agg(l.c::VARCHAR, ',' ORDER BY l.c)) AS ends
  FROM (SELECT c, max(d) AS d FROM x GROUP BY c) l JOIN x ON x.c = l.c AND x.d = l.d JOIN n ON n.d = x.d AND n.node = x.node GROUP BY ALL
)
SELECT q.f AS conv_id, q.d::BIGINT AS depth, q.parent AS parent_conv_id, q.n::BIGINT AS n_convs, coalesce(children, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM q LEFT JOIN k ON k.f = q.f AND k.d = q.d JOIN m ON m.f = q.f AND m.d = q.d LEFT JOIN e ON e.f = q.f AND e.d = q.d
"""
