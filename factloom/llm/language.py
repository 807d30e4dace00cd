"""Language identification by prediction by partial matching: frozen byte context trees for each language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import KeyTable, byte_view, frugal, pieces, table

#: Longest context in bytes.
ORDER = 4
#: The trees of a language are grown from so many whole documents at most, those of at most so many bytes first.
SAMPLE_DOCS, SAMPLE_BYTES = 400, 8000


def _windows(data: np.ndarray, off: np.ndarray, n: int) -> np.ndarray:
    """For each byte, the n bytes that end with it and their number as one key; bytes before the row's start are absent."""
    d = data.astype(np.uint64)
    key = d.copy()
    for k in range(1, n):
        key[k:] |= d[:-k] << np.uint64(8 * k)
    key |= np.uint64(n) << np.uint64(56)
    return key


class Trees:
    """Context trees of all languages, as one hashed table of byte strings of up to ORDER + 1 bytes.

    A string's entry has, for each language, the exact code length in bits of its last byte after the bytes before it under escape
    method C: the byte's share in the longest context that has it, times the escape probabilities of the longer contexts that exist
    and don't. Where a string is in no tree, each language pays the escape of that context, if it has it, and the next shorter
    string is looked up; below the empty context every byte is equally likely.
    """

    def __init__(self, langs: list[str], texts: list[list[bytes]], order: int = ORDER):
        self.langs, self.order = langs, order
        counts: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
        for own in texts:
            data = np.frombuffer(b"".join(own), np.uint8)
            off = np.concatenate([[0], np.cumsum([len(t) for t in own])]).astype(np.int64)
            levels = {}
            for n in range(1, order + 2):
                key, keep = _windows(data, off, n), np.ones(len(data), bool)
                for k in range(n - 1):
                    at = off[:-1] + k
                    keep[at[at < off[1:]]] = False
                levels[n] = np.unique(key[keep], return_counts=True)
            counts.append(levels)
        L = len(langs)
        keys, cost, ctx_keys, escape = [], [], [], []
        lower_keys, lower_cost = np.zeros(0, np.uint64), np.zeros((0, L))
        for n in range(1, order + 2):
            strings = np.unique(np.concatenate([np.zeros(0, np.uint64), *(c[n][0] for c in counts)]))
            body = (strings & ~(np.uint64(0xFF) << np.uint64(56))) >> np.uint64(8) | np.uint64(n - 1) << np.uint64(56)
            contexts = np.unique(body)
            ctx_of = np.searchsorted(contexts, body)
            esc, c = np.zeros((len(contexts), L)), np.zeros((len(strings), L))
            if n == 1:
                below = np.full((len(strings), L), 8.0)
            else:
                keep = np.uint64(256 ** (n - 1) - 1)
                below = lower_cost[np.searchsorted(lower_keys, (strings & keep) | np.uint64(n - 1) << np.uint64(56))]
            for i, levels in enumerate(counts):
                k, m = levels[n]
                count = np.zeros(len(strings))
                count[np.searchsorted(strings, k)] = m
                total = np.bincount(ctx_of, weights=count, minlength=len(contexts))
                kinds = np.bincount(ctx_of, weights=count > 0, minlength=len(contexts))
                there = total > 0
                esc[there, i] = -np.log2(kinds[there] / (total + kinds)[there])
                seen = count > 0
                c[:, i] = esc[ctx_of, i] + below[:, i]
                c[seen, i] = -np.log2(count[seen] / (total + kinds)[ctx_of][seen])
            keys.append(strings)
            cost.append(c)
            ctx_keys.append(contexts)
            escape.append(esc)
            lower_keys, lower_cost = strings, c
        self.size = 1 << max(12, int(np.ceil(np.log2(4 * max(1, sum(map(len, keys)))))))
        self.strings = KeyTable(np.concatenate(keys), np.concatenate(cost).astype(np.float32), self.size)
        self.contexts = KeyTable(np.concatenate(ctx_keys), np.concatenate(escape).astype(np.float32), self.size)

    def bits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length in bits of each row under each language."""
        rows, L = len(off) - 1, len(self.langs)
        if not len(data):
            return np.zeros((rows, L))
        key = _windows(data, off, self.order + 1)
        first = np.arange(len(data)) - np.repeat(off[:-1], np.diff(off))  # bytes before each byte in its row
        out = np.zeros((len(data) + 1, L), np.float32)
        for n in range(self.order + 1, 0, -1):
            at = np.flatnonzero(first >= n - 1) if n == self.order + 1 else np.concatenate([left, np.flatnonzero(first == n - 1)])
            mask = np.uint64(256**n - 1)
            k = (key[at] & mask) | np.uint64(n) << np.uint64(56)
            slot = self.strings.find(k)
            hit = slot >= 0
            out[at[hit]] += self.strings.values[slot[hit]]
            left, k = at[~hit], k[~hit]
            ctx = (k & ~(np.uint64(0xFF) << np.uint64(56))) >> np.uint64(8) | np.uint64(n - 1) << np.uint64(56)
            slot = self.contexts.find(ctx)
            hit = slot >= 0
            out[left[hit]] += self.contexts.values[slot[hit]]
            if n == 1:
                out[left] += 8.0
        sums = np.concatenate([np.zeros((1, L)), np.cumsum(out[:-1], axis=0, dtype=np.float64)])
        return sums[off[1:]] - sums[off[:-1]]


def grow(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Trees:
    """Trees from the first documents of each language in a fixed pseudo-random order; docs: doc_id, text, lang. Every language that has a
    text is learned. Documents of more than ``sample_bytes`` come after all shorter ones of their language, whole, until the sample has
    ``sample_docs`` documents or as many bytes as those may have."""
    known = docs.select("lang", "doc_id", "text", F.octet_length("text").alias("size")).where(F.col("lang").isNotNull() & (F.col("size") > 0))
    known = known.withColumn("long", F.col("size") > sample_bytes)
    langs = {r["lang"]: (r["short"], r["long"]) for r in known.groupBy("lang").agg(F.count_if(~F.col("long")).alias("short"), F.count_if("long").alias("long")).collect()}
    # four times the sample is drawn by a threshold on the hash, so that no task keeps a sample of its own
    top = [(g, long, 4e9 * sample_docs / n) for g, (short, many) in langs.items() for long, n in ((False, short), (True, many)) if n and not (long and short >= sample_docs)]
    top = F.broadcast(docs.sparkSession.createDataFrame(top, "lang string, long boolean, top double"))
    got = known.withColumn("draw", F.pmod(F.xxhash64("doc_id", "text"), F.lit(10**9))).join(top, ["lang", "long"]).where(F.col("draw") < F.col("top"))
    order = W.partitionBy("lang").orderBy("long", "draw", "text")
    got = got.withColumn("n", F.row_number().over(order)).withColumn("before", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size"))
    got = got.where((F.col("n") <= sample_docs) & (F.col("before") < sample_docs * sample_bytes))
    got = got.select("lang", "draw", "text").toArrow().sort_by([("draw", "ascending"), ("text", "ascending")]).to_pylist()
    texts: dict[str, list[bytes]] = {g: [] for g in sorted(langs)}
    for r in got:
        texts[r["lang"]].append(r["text"].encode())
    return Trees(list(texts), list(texts.values()))


def identify(docs: DataFrame, trees: Trees, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred and score: the language with the shortest code of the whole text, and its posterior probability
    if all are equally likely before. Ties go to the first language by code point. `und` with score 0 if text is null or has no letter,
    or if no language was learned. Equal texts get equal results; no documents give no rows.
    """
    schema = docs.select(*keep).schema
    fields = ", ".join(f"kept_{i} {f.dataType.simpleString()}" for i, f in enumerate(schema))
    names = [f"kept_{i}" for i in range(len(keep))]
    spread = docs.sparkSession.sparkContext.broadcast(trees)

    @frugal
    def run(batches):
        trees = spread.value
        for b in pieces(batches, "text", 1 << 20):
            data, off = byte_view(b.column("text"))
            letters = pc.fill_null(pc.match_substring_regex(b.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if trees.langs:
                bits = trees.bits(data, off)
                best = bits.argmin(axis=1)
                gap = bits - bits.min(axis=1, keepdims=True)
                score = 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)
                pred = np.array(trees.langs, object)[best]
            else:
                letters = np.zeros(b.num_rows, bool)
                score, pred = np.zeros(b.num_rows), np.full(b.num_rows, "und", object)
            cols = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.where(letters, pred, "und"), pa.string()), pa.array(np.where(letters, score, 0.0))], names=[*names, "lang_pred", "score"])

    given = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]
    out = docs.select(*given, F.col("text")).mapInArrow(run, f"{fields}, lang_pred string, score double")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), "lang_pred", "score")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    trees = grow(docs.where(~fold))
    out = identify(docs.select("doc_id", "text"), trees)
    return out.select("doc_id", fold.alias("held_out"), "lang_pred", "score")
