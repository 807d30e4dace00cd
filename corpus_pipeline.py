"""From raw documents to packed training sequences: quality, near duplicates, repeated passages, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import store, table, whole_texts
from factloom.llm.mixing import training_stream
from factloom.llm.packing import pack
from factloom.llm.pretokens import tokenizer_path
from factloom.llm.quality import quality
from factloom.llm.repeats import without_repeats
from factloom.llm.similarity import similarity_groups

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the classifier go: null, empty and short texts among them. Equal rows share their fate, null ids are
    judged by their texts, labels of no document count for nothing, an empty table stays empty, and without labels the base rules decide alone."""
    return quality(docs, table(spark, sf_dir, "labels"), keep=COLUMNS).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id stays (null ids last; of equal rows one). Rows without a word stay.
    Texts of any length are compared whole, other columns are carried along, an empty table stays empty."""
    whole_texts(spark)
    docs = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64("text"))
    groups = similarity_groups(docs, row_id="text_hash").select("component", "doc_id", F.col("row_id").alias("text_hash"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash")).alias("x")
    stay = groups.where("component is not null").groupBy("component").agg(first).select(F.col("x.doc_id").alias("stay_id"), F.col("x.text_hash").alias("stay_hash"))
    empty = groups.where("component is null").select(F.col("doc_id").alias("stay_id"), F.col("text_hash").alias("stay_hash"))
    stay = stay.unionByName(empty).distinct()
    kept = docs.join(stay, docs["doc_id"].eqNullSafe(stay["stay_id"]) & (docs["text_hash"] == stay["stay_hash"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text_hash"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur more than once are cut from every text; characters that a cut breaks go too, and so do texts without a word left.
    A text of 200 bytes or more in several rows repeats itself and goes whole; null and empty texts, where nothing is cut, stay; an empty table stays empty."""
    whole_texts(spark)
    out = without_repeats(docs, keep=COLUMNS)
    # a cut between the bytes of a character leaves invalid bytes
    text = F.translate(F.make_valid_utf8(F.col("kept").cast("string")), "�", "")
    cut = F.size("spans") > 0
    out = out.withColumn("rest", F.when(cut, text).otherwise(F.col("text"))).where(~cut | F.col("rest").rlike("[^\\x20\\x09-\\x0D]"))
    return out.select("doc_id", F.col("rest").alias("text"), "lang", "source", F.when(cut, F.char_length("rest").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as their sources' targets want them, in the order of training. Texts
    without a word (null, empty) are never taken, a null source is one source, equal rows are taken one by one, an empty table stays empty."""
    whole_texts(spark)
    stream = training_stream(docs, keep=("lang", "source"))
    return stream.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of 2048. A null or empty text is its end id alone, a text of any length is cut into pieces, equal
    rows and null ids are packed one by one, an empty table stays empty."""
    whole_texts(spark)
    return pack(docs, tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("packing", packed_sequences),
]
#: Trained models and token ids are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store(docs, f"stage{i}")
    return docs
