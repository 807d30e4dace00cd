"""Fragments nearest to a fact."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fragments, strip
from ..functions.vectors import cosine, dot
from ..sources.storage import stored
from .numbering import number_rows, running_sum

#: Texts -> one vector for each; made once for each worker.
Encoder = Callable[[list[str]], np.ndarray]


def hashed_words(dim: int = 256) -> Encoder:
    """The offline encoder: counts of words, hashed."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                out[i, zlib.crc32(w.encode()) % dim] += 1
        return out

    return encode


def token_mean(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the token vectors under the mask: (texts, tokens, dim) and (texts, tokens) -> (texts, dim)."""
    return (states * mask[..., None]).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)[:, None]


def first_token(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return states[:, 0]


POOLING = {"mean": token_mean, "cls": first_token}


def pooled(model: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], pooling: str = "mean", batch: int = 32) -> Encoder:
    """An encoder from a model that gives token vectors and a mask, batch by batch; vectors are scaled to length 1."""
    pool = POOLING[pooling]

    def encode(texts: list[str]) -> np.ndarray:
        parts = [pool(*model(texts[i : i + batch])) for i in range(0, len(texts), batch)]
        out = np.concatenate(parts) if parts else np.zeros((0, 1))
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def embedded(df: DataFrame, text: str, encoder: Encoder, to: str = "vector") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{to: list(np.asarray(encoder([t or "" for t in b[text]]), float))})

    from pyspark.sql.types import ArrayType, DoubleType, StructType

    return df.mapInPandas(run, StructType([*df.schema.fields]).add(to, ArrayType(DoubleType())))


def top_by_group(scored: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group with their ``rank``; ties go to the smaller ``tie``. Only k rows a group and task are shuffled."""
    order = W.partitionBy(group).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def encoded(texts: DataFrame, text: str, encoder: Encoder) -> DataFrame:
    """(name, vector) of the distinct values of a text column, each encoded once and stored; ``name`` is the text's SHA-256."""
    rows = texts.select(F.col(text).alias("_text")).groupBy(F.sha2("_text", 256).alias("name")).agg(F.first("_text").alias("_text"))
    return stored(embedded(rows, "_text", encoder).drop("_text"), "vectors")


def _nearest(scored: DataFrame, key: str, place: list[str], k: int) -> DataFrame:
    best = top_by_group(scored.select(key, F.struct(*place).alias("place"), "fragment", "score"), key, "score", "place", k)
    return best.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "fragment"))), lambda x: x["fragment"]).alias("contexts"))


def _packed(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Rows of up to ``size`` vectors of one length: keys and vectors as bytes of whole matrices. Vectors that are null or empty are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def full(dim: int) -> pa.RecordBatch:
            keys, vectors = held.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.array(keys, np.int64).tobytes()]), pa.array([np.array(vectors, np.float64).tobytes()])], names=["dim", "keys", "vectors"])

        for b in batches:
            for k, v in zip(b.column(key).to_pylist(), b.column(vector).to_pylist(), strict=True):
                if k is not None and v:
                    keys, vectors = held.setdefault(len(v), ([], []))
                    keys.append(k)
                    vectors.append(v)
                    if len(keys) >= size:
                        yield full(len(v))
        for dim in list(held):
            yield full(dim)

    return rows.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector)).mapInArrow(run, "dim int, keys binary, vectors binary")


def nearest_vectors(rows: DataFrame, asked: DataFrame, k: int, size: int = 2048) -> DataFrame:
    """rows (id, vector) and asked (query, vector) -> (query, id, score, rank): the k rows of the largest inner product with each query, itself
    (the row of its number) left out; ties go to the smaller id.

    Both sides are packed into matrices of ``size`` vectors. Every query block meets every block of rows, wherever Spark brings them together,
    and gives the best k of each query, with all that rounding could confuse with them; only these are scored exactly and merged by query.
    """
    left = _packed(rows, "id", "vector", size)
    right = _packed(asked, "query", "vector", size).toDF("query_dim", "queries", "query_vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, keys, vectors, query_dim, queries, query_vectors in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if dim != query_dim:
                    continue
                ids, names = np.frombuffer(keys, np.int64), np.frombuffer(queries, np.int64)
                v, q = np.frombuffer(vectors).reshape(-1, dim), np.frombuffer(query_vectors).reshape(-1, dim)
                scores = q @ v.T
                scores[names[:, None] == ids[None, :]] = -np.inf
                least = np.partition(scores, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(names), -np.inf)
                slack = 1e-9 * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max()
                at_q, at_v = np.nonzero((scores >= (least - slack)[:, None]) & (names[:, None] != ids[None, :]))
                arrays = [pa.array(names[at_q]), pa.array(ids[at_v]), pa.array(list(q[at_q]), pa.list_(pa.float64())), pa.array(list(v[at_v]), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["query", "id", "qv", "v"])

    # not a join by length: all vectors have the same, and would meet in one task
    near = left.crossJoin(right).mapInArrow(run, "query long, id long, qv array<double>, v array<double>")
    return top_by_group(near.select("query", "id", dot("qv", "v").alias("score")), "query", "score", "id", k)


def retrieve(queries: DataFrame, encoder: Encoder | None = None, splitter: str = "sentence", k: int = 5, key: str = "id") -> DataFrame:
    """queries (key, text, article_text) -> (key, contexts): the k fragments of each query's own text nearest to it, best first."""
    links = queries.select(key, F.lit(0).alias("place"), F.col(key).alias("article"))
    return retrieve_linked(queries.select(key, "text"), links, queries.select(F.col(key).alias("article"), F.col("article_text").alias("text")), encoder, splitter, k, key)


def retrieve_linked(queries: DataFrame, links: DataFrame, articles: DataFrame, encoder: Encoder | None = None, splitter="sentence", k: int = 5, key: str = "id", lang: str = "en") -> DataFrame:
    """queries (key, text), links (key, place, article) and articles (article, text) -> (key, contexts): of the fragments of a query's articles,
    taken as one text in the order of their places, the k nearest to it, best first; ties go to the earlier fragment.

    Articles are split one by one, and each distinct fragment is encoded once; no query's articles are put together. Only where one article's
    text ends within a fragment is that piece joined with the beginning of the query's next article, or of several if they have no end of a
    fragment at all. Each task keeps k fragments of a query, and these are merged by query. Articles that are not there are left out.
    """
    encoder = encoder or hashed_words()
    text = F.coalesce(F.col("text"), F.lit(""))
    # learned boundaries end with each article
    open_end = F.lit(False) if not isinstance(splitter, str) else text.rlike(r"(^|[^.!?\s])\s*$") if splitter == "sentence" else ~text.rlike(r"\n\n$")
    white = text.rlike(r"^\s*$")
    split = articles.select("article", fragments(text, splitter, lang).alias("parts"), open_end.alias("open"), F.regexp_extract(text, r"^\s*", 0).alias("lead"), F.when(white, "").otherwise(F.regexp_extract(text, r"\s*$", 0)).alias("tail"))
    # an article without a fragment is an empty one, through which an open end goes on
    split = stored(split.withColumn("parts", F.when(F.size("parts") == 0, F.array(F.lit(""))).otherwise(F.col("parts"))), "fragments")
    ends = split.select("article", "open", "lead", "tail", F.size("parts").alias("n"), F.get("parts", F.lit(0)).alias("first"), F.element_at("parts", -1).alias("final"))

    # which articles of a query run into the next one: only their ends are looked at
    pairs = number_rows(links.join(ends.select("article", "open", "n"), "article"), [key, "place"], "at")
    before = pairs.select((F.col("at") + 1).alias("at"), F.col(key).alias("key_before"), F.col("open").alias("open_before"))
    pairs = pairs.join(before, "at", "left").withColumn("follows", F.coalesce((F.col("key_before") == F.col(key)) & F.col("open_before"), F.lit(False)))
    pairs = stored(pairs.select(key, "article", "at", "n", "open", "follows"), "pairs")
    starts = F.when(F.col("n") == 1, F.array(F.struct(F.lit(0).alias("half"), (~F.col("follows")).alias("new")))).otherwise(F.array(F.struct(F.lit(0).alias("half"), (~F.col("follows")).alias("new")), F.struct(F.lit(1).alias("half"), F.lit(True).alias("new"))))
    pieces = pairs.select(key, "article", "at", F.explode(starts).alias("x")).select(key, "article", "at", "x.half", F.col("x.new").cast("long").alias("new"))
    chained = running_sum(pieces, ["at", "half"], "new", "chain")
    chained = stored(chained.join(chained.groupBy("chain").agg(F.count(F.lit(1)).alias("links")).where("links > 1"), "chain"), "chains")
    # the first article of a chain gives its last piece, the others their first
    whole = F.when(F.col("n") == 1, F.concat("lead", "first", "tail")).when(F.col("half") == 0, F.concat("lead", "first")).otherwise(F.concat("final", "tail"))
    joined = chained.join(ends, "article").groupBy(key, "chain").agg(F.sort_array(F.collect_list(F.struct("at", "half", whole.alias("t")))).alias("x"))
    first = F.get("x", F.lit(0))
    at_first = joined.select(key, first["at"].alias("at"), strip(F.array_join(F.transform("x", lambda p: p["t"]), " ")).alias("fragment"), first["half"].alias("half")).where("fragment <> ''")
    merged = stored(at_first.join(pairs.select("at", "n"), "at").select(key, "at", F.when(F.col("half") == 0, 0).otherwise(F.col("n") - 1).alias("pos"), "fragment"), "merged")

    taken = chained.groupBy("at").agg(F.max(F.col("half") == 0).alias("first_taken"), F.max(F.col("half") == 1).alias("last_taken"))
    parts = split.select("article", F.posexplode("parts").alias("pos", "fragment")).where("fragment <> ''").withColumn("name", F.sha2("fragment", 256))
    vectors = encoded(parts.select("fragment").unionByName(merged.select("fragment")), "fragment", encoder)
    facts = embedded(queries.select(key, "text"), "text", encoder, "fact_vector").drop("text")
    inner = pairs.join(taken, "at", "left").join(parts, "article").where(~(F.coalesce("first_taken", F.lit(False)) & (F.col("pos") == 0)) & ~(F.coalesce("last_taken", F.lit(False)) & (F.col("pos") == F.col("n") - 1)))
    rows = inner.select(key, "at", "pos", "fragment", "name").unionByName(merged.withColumn("name", F.sha2("fragment", 256)))
    scored = rows.join(vectors, "name").join(facts, key).withColumn("score", cosine("vector", "fact_vector"))
    found = queries.select(key).join(_nearest(scored, key, ["at", "pos"], k), key, "left")
    return found.select(key, F.coalesce("contexts", F.expr("cast(array() as array<string>)")).alias("contexts"))
