"""Metrics of an evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import ratio


def answer_metrics(answer: Column | str = "answer") -> list[Column]:
    """Aggregates over all queries, failures (null) included: n, tp, fn, accuracy, recall without idk, idk ratio."""
    answer = F.col(answer) if isinstance(answer, str) else answer
    yes, no, idk = (F.count_if(answer == x) for x in ("yes", "no", "idk"))
    n = F.count(F.lit(1))
    return [n.alias("n"), yes.alias("tp"), no.alias("fn"), ratio(yes, n).alias("accuracy"), ratio(yes, yes + no).alias("recall_without_idk"), ratio(idk, n).alias("idk_ratio")]


def histogram(predictions: DataFrame, answer: str = "answer") -> DataFrame:
    """Counts of each answer; failures are the null group."""
    return predictions.groupBy(answer).agg(F.count(F.lit(1)).alias("count"))


def evaluate(queries: DataFrame, predictions: DataFrame, model: str) -> DataFrame:
    """One row: model, accuracy, recall (without idk), idk_ratio over the queries; mean_coverage over all predictions; stats."""
    joined = queries.select("id").join(predictions.select("id", "answer"), "id", "left")
    scores = joined.agg(*answer_metrics())
    cover = predictions.agg(F.coalesce(F.avg("coverage"), F.lit(0.0)).alias("mean_coverage"))
    # map keys are never null: failures are counted under 'null'
    stats = histogram(joined).agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("answer", F.lit("null")), "count"))).alias("stats"))
    one = scores.crossJoin(cover).crossJoin(stats)  # three rows of one
    return one.select(F.lit(model).alias("model"), "accuracy", F.col("recall_without_idk").alias("recall (without idk)"), "idk_ratio", "mean_coverage", "stats")
