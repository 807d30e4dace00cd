"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import store, table

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3, 1, 2)
#: Change of a source's weight from start to end of training: w(t) = w * (1 + slope * (2t - 1)).
SLOPES = (0.5, 0.0, -0.5)
SHARE, REPEATS = 1.5, 2
#: A (source, bucket) holds about so many rows; the cumulative demand is summed bucket by bucket.
ROWS_A_BUCKET = 20_000


def _pick(values: tuple, rank: Column) -> Column:
    out = F.lit(float(values[0]))
    for i, v in enumerate(values[1:], 1):
        out = F.when((rank - 1) % len(values) == i, F.lit(float(v))).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source_key, source_size) -> target words and slope of each source.

    Targets divide ``share`` of all sizes by weight; the water level is the first at which a source stays below ``repeats`` times its size,
    which is where resharing the excess by weight ends. One row per source passes through one task: a dimension table, not documents.
    """
    by_name = W.orderBy(F.col("source_key.missing"), F.col("source_key.name"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("rank"))
    s = sizes.withColumn("rank", F.row_number().over(by_name))
    s = s.withColumn("weight", _pick(weights, F.col("rank"))).withColumn("slope", _pick(slopes, F.col("rank"))).withColumn("cap", F.col("source_size") * F.lit(repeats))
    everything = W.partitionBy()
    s = (
        s.withColumn("cap_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.lit(share) * F.col("total") - F.col("cap_before")) / F.col("weight_left"))
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"])
    )
    return s.select("source_key", "source_size", "slope", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, slopes: tuple = SLOPES, share: float = SHARE, repeats: int = REPEATS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document with its share of the mix and its place in training; in_order() range-sorts the rows by position.

    Each source's documents form a stream in the order of md5(id), repeated up to ``repeats`` times and cut where the target ends; the document
    at the cut is taken in part: its first words. The weight schedule integrated over training time gives the demand t -> target * (t(1-g) + g*t*t); inverted, it
    turns a cumulative word count into a training position in [0, 1). Columns: doc_id, size, source_size, target, taken, position (of the first
    take, null if nothing is taken), takes (position and words of each), and ``keep``.

    Null text counts 0 words, null ids sort as the empty string, a null source is one source and comes last. Equal rows get equal columns
    but for the words taken at the cut. No documents give no rows. Other columns, whatever their names, are not read.
    """
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.struct(F.col(source_col).isNull().alias("missing"), F.coalesce(source_col, F.lit("")).alias("name")).alias("source_key"),
        F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("draw"),
        F.xxhash64(text_col).alias("tie"),
        *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)),
    )
    if not keep:  # narrow rows are written once; wide ones (whole texts) are rather counted again
        slim = store(slim, "mix")
    totals = slim.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    most = totals.agg(F.max("n")).first()[0] or 0
    digits = 2
    while 16**digits * ROWS_A_BUCKET < most and digits < 6:
        digits += 1
    slim = slim.withColumn("bucket", F.substring("draw", 1, digits))
    offsets = (
        slim.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
        .withColumn("bucket_start", F.sum("bucket_size").over(W.partitionBy("source_key").orderBy("bucket")) - F.col("bucket_size"))
        .drop("bucket_size")
    )
    targets = source_targets(totals.drop("n"), weights, slopes, share, repeats)
    at = W.partitionBy("source_key", "bucket").orderBy("draw", "size", "tie").rowsBetween(W.unboundedPreceding, 0)
    placed = slim.join(offsets.join(targets, "source_key"), ["source_key", "bucket"]).withColumn("start", F.col("bucket_start") + F.sum("size").over(at) - F.col("size"))

    def words_in(epoch: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - F.col("start") - F.col("source_size") * epoch))

    def position(epoch: int) -> Column:
        u, g = (F.col("start") + F.col("source_size") * epoch) / F.col("target"), F.col("slope")
        return F.when(g == 0, u).otherwise((F.sqrt((1 - g) * (1 - g) + 4 * g * u) - (1 - g)) / (2 * g))

    takes = [F.when(words_in(e) > 0, F.struct(position(e).alias("position"), words_in(e).cast("long").alias("words"))) for e in range(repeats)]
    out = placed.withColumn("takes", F.array_compact(F.array(*takes)))
    total = sum((words_in(e) for e in range(repeats)), F.lit(0)).cast("long")
    return out.select(
        "doc_id", "size", "source_size", "target", total.alias("taken"), F.get("takes", F.lit(0))["position"].alias("position"), "takes", "draw", "tie", *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)),
    )


def in_order(mixed: DataFrame) -> DataFrame:
    """Rows of mix_sources() range-sorted by training position; what is not taken comes first."""
    return mixed.repartitionByRange("position", "draw", "tie").sortWithinPartitions("position", "draw", "tie").drop("draw", "tie")


def training_stream(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = (), **options) -> DataFrame:
    """The mix itself: a row for each take (position, words, doc_id, text, ``keep``), range-sorted by position. A part is the text's first words.

    Documents without a word, null texts among them, are never taken. Rows of equal id and size follow the hash of their texts; only rows that
    are equal throughout can stand in for each other. No documents give no rows."""
    mixed = mix_sources(docs, text_col=text_col, keep=(text_col, *keep), **options)
    rows = mixed.select("doc_id", "size", "draw", "tie", text_col, *keep, F.explode("takes").alias("take"))
    part = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(f"([\\x20\\x09-\\x0D]*{WORD})"), F.lit(1)), F.lit(1), F.col("take.words").cast("int")), "")
    text = F.when(F.col("take.words") < F.col("size"), part).otherwise(F.col(text_col))
    rows = rows.select(F.col("take.position").alias("position"), F.col("take.words").alias("words"), "doc_id", text.alias(text_col), *keep, "draw", "tie")
    return in_order(rows)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = in_order(mix_sources(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS draw FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), w AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
    CASE (rank - 1) % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS g, source_size * 2 AS cap FROM s
), c AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cap_before,
    sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left, sum(source_size) OVER ()::BIGINT AS total FROM w
), l AS (
  SELECT *, (1.5::DOUBLE * total - cap_before) / weight_left AS lvl FROM c
), t AS (
  SELECT source, source_size, g, least(cap::DOUBLE, coalesce((SELECT arg_min(lvl, (cap / weight, rank)) FROM l WHERE lvl * weight <= cap) * weight, cap::DOUBLE)) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.g,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, greatest(0, least(size, floor(target)::BIGINT - start)) AS first, greatest(0, least(size, floor(target)::BIGINT - start - source_size)) AS again FROM p
)
SELECT doc_id, size, source_size, target, (first + again)::BIGINT AS taken,
  round(CASE WHEN first > 0 THEN CASE WHEN g = 0 THEN start / target ELSE (sqrt((1 - g) * (1 - g) + 4 * g * (start / target)) - (1 - g)) / (2 * g) END END, 6) AS position
FROM k
"""
