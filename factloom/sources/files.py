"""Scans and sinks: facts, corpus, queries, predictions, outputs, failures, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.months import month_number
from . import log
from .nested import RANGE_BYTES, piece_texts, pieces
from .storage import exists, qualified

FACT = "section string, text string, links array<string>, relevant_links array<string>"
FACTS_JSON = f"map<string, map<string, array<struct<{FACT.replace(' string', ':string').replace(' array', ':array')}>>>>"
CORPUS = "id string, text string, abstract string, metadata struct<url:string>"
QUERIES = "id string, text string, `linked articles` array<string>, `relevant articles` array<string>, keywords array<string>, metadata struct<fact_date:string>"
PREDICTIONS = "id string, answer string, reasoning string, coverage double, failed boolean"


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a log, a folder or a file with their ``_place``; what can't be read or has no id is skipped (broken_lines() has it)."""
    fields = T._parse_datatype_string(schema)
    with_bad = T.StructType([*fields.fields, T.StructField("_bad", T.StringType())])
    lines = log.read(spark, path, with_bad, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    return lines.where(F.col("_bad").isNull() & F.col("id").isNotNull()).drop("_bad")


def _judged_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every line that isn't empty with its place, and the reason why it is skipped, null for a good one."""
    lines = log.read(spark, path, "value string", "text")
    parsed = F.from_json("value", T._parse_datatype_string(schema + ", _bad string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    reason = F.when(F.col("x._bad").isNotNull() | F.col("x").isNull(), "no JSON").when(F.col("x.id").isNull(), "no id")
    return lines.withColumn("x", parsed).select("value", "_place", F.when(F.trim("value") != "", reason).alias("reason"))


def broken_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line, reason, value) of the lines that scans skip. Lines are counted from 1: those of the parts of a file that are read before
    this one, which is a row for each part, and the rows of this one."""
    rows = _judged_lines(spark, path, schema).select("_place.file", "_place.block", "_place.row", "reason", "value")
    parts = rows.groupBy("file", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("block")) - F.col("n")
    parts = parts.select("file", "block", "first", before.alias("before"))
    bad = rows.where("reason is not null").join(parts, ["file", "block"])
    return bad.select("file", (F.col("before") + F.col("row") - F.col("first") + 1).alias("line"), "reason", "value")


def line_counts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row: good lines, lines that are no JSON, lines without an id."""
    reason = F.col("reason")
    return _judged_lines(spark, path, schema).where("trim(value) <> ''").agg(F.count_if(reason.isNull()).alias("good"), F.count_if(reason == "no JSON").alias("no_json"), F.count_if(reason == "no id").alias("no_id"))


def skipped(spark: SparkSession, path: str, schema: str) -> str | None:
    """A warning with counts if a scan of the path skips lines."""
    r = line_counts(spark, path, schema).first()
    return f"{path}: skipped {r['no_json']} lines that are no JSON and {r['no_id']} without an id, kept {r['good']}" if r["no_json"] or r["no_id"] else None


def scan_corpus(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """The corpus, of each id the row that was written last."""
    rows = read_lines(spark, path, CORPUS) if form == "json" else log.read(spark, path, CORPUS, form)
    return log.latest(rows.select("id", "text", "abstract", "metadata", "_place"))


def scan_queries(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Queries, with empty lists where a column is missing; of each id the row that was written last."""
    rows = read_lines(spark, path, QUERIES) if form == "json" else log.read(spark, path, QUERIES, form)
    none = F.expr("cast(array() as array<string>)")
    lists = {"linked_articles": "linked articles", "relevant_articles": "relevant articles", "keywords": "keywords"}
    return log.latest(rows.select("id", "text", *(F.coalesce(F.col(f"`{old}`"), none).alias(new) for new, old in lists.items()), "metadata", "_place"))


def scan_facts(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The nested export {year: {month: [fact]}} -> (year, month, item, fact columns); items keep their order within a month.

    Files up to ``range_bytes`` are read whole; a larger one is read by several tasks, piece by piece, through a file system of pyarrow's:
    no task holds more of it than ``range_bytes`` and a fact."""
    large = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") > range_bytes).select("path", F.col("length").alias("bytes"))
    large = [tuple(r) for r in large.collect()]  # a row for each large file
    text = spark.read.text(path, wholetext=True).withColumn("first", F.lit(0).cast("long"))
    if large:
        files = spark.createDataFrame([(qualified(spark, p), n) for p, n in large], "path string, bytes long")
        text = text.where(F.col("_metadata.file_size") <= range_bytes).select("value", "first").unionByName(piece_texts(pieces(files, range_bytes)))
    years = text.select("first", F.explode(F.from_json("value", FACTS_JSON)).alias("year", "months"))
    items = years.select("year", "first", F.explode("months").alias("month", "facts")).select("year", "month", "first", F.posexplode("facts").alias("item", "fact"))
    none = F.expr("cast(array() as array<string>)")
    return items.select("year", "month", (F.col("first") + F.col("item")).cast("int").alias("item"), "fact.section", "fact.text", F.coalesce("fact.links", none).alias("links"), F.coalesce("fact.relevant_links", none).alias("relevant_links"))


def nest_facts(facts: DataFrame) -> DataFrame:
    """([lang,] year, month, item, fact columns) -> one row per year with its months in the order of the calendar, each a list in order."""
    by = [c for c in ("lang", "year") if c in facts.columns]
    fact = F.struct("item", "section", "text", "links", "relevant_links")
    months = facts.groupBy(*by, "month").agg(F.sort_array(F.collect_list(fact)).alias("facts"))
    return nest_months(months, by)


def nest_months(months: DataFrame, by: list[str]) -> DataFrame:
    """A row per month, with its list of facts -> one per year with a map of its months; months come in the order of the calendar."""
    entry = F.struct(month_number(F.col("month")).alias("number"), "month", "facts")
    ordered = F.transform(F.sort_array(F.collect_list(entry)), lambda x: F.struct(x["month"], x["facts"]))
    return months.groupBy(*by).agg(F.map_from_entries(ordered).alias("months"))


def write_nested(nested: DataFrame, path: str) -> None:
    """The nested export, a JSON object {year: {month: [fact]}} in a file for each year, below its language if there is one."""
    fact = lambda f: F.struct(f["section"].alias("section"), f["text"].alias("text"), f["links"].alias("links"), f["relevant_links"].alias("relevant_links"))
    months = F.transform_values("months", lambda _, facts: F.transform(facts, fact))
    folders = [c for c in ("lang",) if c in nested.columns]
    rows = nested.select(*folders, F.to_json(F.create_map("year", months), {"ignoreNullFields": "false"}).alias("value"))
    rows.write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy(*folders).text(path)


def write_years(facts: DataFrame, path: str) -> None:
    """(year, month, item, fact columns) -> the nested export as nest_facts() and write_nested() make it, a file for each year, for years of any
    size: a fact is a line, and who writes a year has its lines in order and one at a time. Facts are read twice."""
    months = facts.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n")).withColumn("number", month_number(F.col("month")))
    found = months.orderBy("year", "number", "month").collect()  # a row for each month
    if any(r["year"] is None or r["month"] is None for r in found):
        raise ValueError("a fact without year or month")
    years = {y: i for i, y in enumerate(dict.fromkeys(r["year"] for r in found))}
    ends = [(i == 0 or found[i - 1]["year"] != r["year"], i + 1 == len(found) or found[i + 1]["year"] != r["year"]) for i, r in enumerate(found)]
    rows = [(r["year"], r["month"], r["n"], years[r["year"]], i, *ends[i]) for i, r in enumerate(found)]
    months = facts.sparkSession.createDataFrame(rows, "year string, month string, n long, _file int, _month int, _opens boolean, _closes boolean")

    place = F.row_number().over(W.partitionBy("year", "month").orderBy("item", "section", "text", "links", "relevant_links"))
    placed = facts.select("year", "month", place.alias("_place"), F.to_json(F.struct("section", "text", "links", "relevant_links"), {"ignoreNullFields": "false"}).alias("_fact"))
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    before = F.when(F.col("_place") == 1, F.concat(F.when(F.col("_opens"), F.concat(F.lit("{"), quoted("year"), F.lit(":{"))).otherwise(""), quoted("month"), F.lit(":["))).otherwise("")
    after = F.when(F.col("_place") < F.col("n"), ",").when(F.col("_closes"), "]}}").otherwise("],")
    lines = placed.join(F.broadcast(months), ["year", "month"]).select("_file", "_month", "_place", F.concat(before, "_fact", after).alias("value"))
    lines.repartitionById(max(1, len(years)), "_file").sortWithinPartitions("_file", "_month", "_place").select("value").write.mode("overwrite").text(path)


def write_facts(facts: DataFrame, path: str) -> None:
    facts.write.mode("overwrite").partitionBy("lang", "year").parquet(path)


def append_lines(df: DataFrame, path: str, token: str | None = None) -> int:
    """JSON lines added to a log as one append, see log.append()."""
    return log.append(df, path, "json", token)


def original_names(queries: DataFrame) -> DataFrame:
    """Queries with the names, with spaces, of the published files."""
    return queries.withColumnsRenamed({"linked_articles": "linked articles", "relevant_articles": "relevant articles"})


def scan_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions so far; no folder means none, and a file that can't be read is left out (unreadable_files() has it)."""
    return log.read(spark, path, PREDICTIONS, "parquet", ignoreCorruptFiles="true").drop("_place")


def append_predictions(predictions: DataFrame, path: str, token: str | None = None) -> int:
    return log.append(predictions.select(*(f.name for f in T._parse_datatype_string(PREDICTIONS))), path, "parquet", token)


def unreadable_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, reason) of the Parquet files below ``path`` that scans leave out, so that what they held is judged, and paid for, once more.
    Tasks read each file's last bytes only."""
    if not exists(spark, path):
        return spark.createDataFrame([], "file string, reason string")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")

    def run(batches):
        import pandas as pd
        import pyarrow.fs
        import pyarrow.parquet as pq

        for b in batches:
            out = []
            for file, size in zip(b["path"], b["length"], strict=True):
                try:
                    fs, local = pyarrow.fs.FileSystem.from_uri(file)
                    with fs.open_input_file(local) as f:
                        pq.ParquetFile(f)
                except Exception as e:  # whatever is wrong with the file is its reason
                    out.append((file, f"{type(e).__name__} at {size} bytes"))
            yield pd.DataFrame(out, columns=["file", "reason"])

    return found.mapInPandas(run, "file string, reason string")


def append_outputs(predictions: DataFrame, path: str, token: str | None = None) -> int:
    """Prompt, answer, reasoning and the whole reply of each fact with a usable one."""
    return append_lines(predictions.where("not failed").select("prompt", F.col("answer").alias("prediction"), "reasoning", F.col("raw").alias("output")), path, token)


def append_failures(predictions: DataFrame, path: str, token: str | None = None) -> int:
    """The facts without a usable reply, with the reason."""
    return append_lines(predictions.where("failed").select("id", F.col("text").alias("fact"), F.lit("Unable to parse JSON").alias("error")), path, token)


def write_results(metrics: DataFrame, path: str) -> None:
    """One row of results as one JSON object in one file."""
    metrics.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)
