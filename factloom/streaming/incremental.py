"""Resumable runs: what is done is never done again, in batches or as a stream of new files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dataset import unprocessed
from ..sources.files import append_predictions, scan_predictions


def remaining(queries: DataFrame, predictions: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Queries without a prediction; a failed one counts as done unless it is to be tried again."""
    done = predictions.where(~F.coalesce("failed", F.lit(False))) if retry_failed else predictions
    return unprocessed(queries, done)


def resume(queries: DataFrame, path: str, judge: Callable[[DataFrame], DataFrame], retry_failed: bool = False) -> DataFrame:
    """Judge what remains, append it to the predictions at ``path``, and return all of them: the latest of each query."""
    spark = queries.sparkSession
    todo = remaining(queries.dropDuplicates(["id"]), scan_predictions(spark, path), retry_failed)
    append_predictions(judge(todo), path)
    return latest(scan_predictions(spark, path))


def latest(predictions: DataFrame) -> DataFrame:
    """One prediction for each query; of one judged again after a failure the row that didn't fail holds."""
    best = F.min_by(F.struct("answer", "reasoning", "coverage", "failed"), F.coalesce("failed", F.lit(False)))
    return predictions.groupBy("id").agg(best.alias("x")).select("id", "x.*")


def follow(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, judge: Callable[[DataFrame], DataFrame]) -> None:
    """The same for new JSON files in a folder: all that are there now, then stop. A batch that is run again adds nothing twice."""

    def one(batch: DataFrame, _: int) -> None:
        todo = remaining(batch.dropDuplicates(["id"]), scan_predictions(batch.sparkSession, path))
        append_predictions(judge(todo), path)

    spark.readStream.schema(schema).json(source).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(one).start().awaitTermination()
