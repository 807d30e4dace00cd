"""Removal of long strings that occur more than once, by fingerprints of growing length over thinned positions, in place of a suffix array.

Prefix doubling has one row for each byte and makes ranks from ranks. Measured on sf0.01 it shuffles 107 times its input, so it does not fit the
limits (README); here the positions are thinned first, without losing any, and each round hashes the text itself: of the 64-byte strings within a
200-byte window the one with the smallest hash is the window's anchor, so equal windows have equal anchors at equal offsets. The rounds then
rank ever longer strings. A rank is a 64-bit name computed from the names of two parts at a growing offset; Spark sorts and groups the ranks
by shuffle, and positions with a rank of their own drop out:

    round 1   64 bytes at each anchor
    round 2   137 bytes that 64 neighbouring windows have in common, and the 263 bytes they cover together
    round 3   193 bytes that 8 neighbouring windows have in common, and the 207 bytes they cover together
    round 4   200 bytes at each window that is left

A block of windows is settled as soon as what they have in common is unique (none repeats) or what they cover repeats (all repeat). Settled
blocks go on for one more round only as witnesses, one for each distinct string, where an unsettled block has the same string in common.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, byte_view, discard, frugal, mix, pieces, powers, prefix_hash, span_hash, store, table
from .sketch import BITS, present, spread

LENGTH, GRAM = 200, 64
#: Windows to a block in rounds 2, 3 and 4.
BLOCKS = (64, 8, 1)


def rank(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The name of each string: that of the pair of its halves."""
    middle = (start + end) >> 1
    return mix(span_hash(prefix, start, middle) * np.uint64(0x9E3779B97F4A7C15) + span_hash(prefix, middle, end))


def anchors(data: np.ndarray, off: np.ndarray, prefix: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Row, place, first and last window start, and rank of each anchor; no window crosses a row."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    g = mix((prefix[gram:] - prefix[:-gram]) * powers(n + 1)[1][: n - gram + 1])
    m = (g >> np.uint64(32) << np.uint64(32)) | np.arange(len(g), dtype=np.uint64)
    width, w = length - gram + 1, 1
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    if width > w:
        m = np.minimum(m[: len(m) - (width - w)], m[width - w :])
    at = np.repeat(np.arange(len(off) - 1), np.diff(off))
    start = np.flatnonzero(at[: n - length + 1] == at[length - 1 :])
    if not len(start):
        return anchors(data[:0], off[:1], prefix)
    a = (m[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    last = np.concatenate([new[1:], [len(a)]]) - 1
    return at[start[new]], a[new], start[new], start[last], mix(g[a[new]])


def _batch(cols: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(cols)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.xxhash64(text).alias("d"), text.alias("text"))


def _second(text: Column | str) -> Column:
    """A second name of a text, so that texts are told apart by 128 bits where one of them goes."""
    return F.xxhash64(F.lit(1), text)


def _fresh(batches, limit: int = 1 << 20):
    """Each text once in this task."""
    seen: set[int] = set()
    for b in pieces(batches, "text", limit):
        ids = b.column("d").to_pylist()
        keep = []
        for i in ids:
            keep.append(i not in seen)
            seen.add(i)
        if any(keep):
            yield b.filter(pa.array(keep))


def _candidates(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(d, ranks) of the texts with repeated anchors."""

    @frugal
    def run(batches):
        for b in _fresh(batches):
            data, off = byte_view(b.column("text"))
            row, _, _, _, key = anchors(data, off, prefix_hash(data), length, gram)
            # a rank that a text has again and again is one row
            order = np.lexsort((key, row))
            key, row = key[order], row[order]
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])) if len(key) else np.zeros(0, int)
            again = np.diff(np.append(first, len(key))) > 1
            yield _batch({"rank": key[first].view(np.int64), "d": b.column("d").to_numpy()[row[first]], "again": again})

    rows = texts.where(F.octet_length("text") >= length).mapInArrow(run, "rank long, d long, again boolean")
    ranks = rows.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.bool_or("again").alias("again")).where("n > 1 or again").select("rank")
    return store(rows.join(ranks, "rank", "left_semi").groupBy("d").agg(F.collect_set("rank").alias("ranks")), "anchors")


def _kept_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts that may be in ``wanted``, dealt out by their names."""
    held = texts.sparkSession.sparkContext.broadcast(present(wanted, "d"))

    @frugal
    def run(batches):
        for b in _fresh(batches, 8 << 20):
            ids = b.column("d").to_numpy(zero_copy_only=False).view(np.uint64)
            keep = held.value[(spread(ids) >> np.uint64(64 - BITS)).astype(np.int64)] > 0
            if keep.any():
                yield b.filter(pa.array(keep))

    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.mapInArrow(run, "d long, text string").repartition(n, "d")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values, np.repeat(np.arange(len(column)), np.asarray(column.value_lengths().fill_null(0)))


def _ranked(texts: DataFrame, todo: DataFrame, block: int, length: int, gram: int, first: bool) -> DataFrame:
    """(common, whole, d, place, low, high, own): for blocks of windows at offsets low..high before an anchor, the rank of what they have in
    common and of what they cover together. ``todo`` has the ranks of anchors (first round) or coarser blocks; own is false for witnesses."""

    @frugal
    def run(batches):
        for b in pieces(batches, "text", 1 << 20):
            data, off = byte_view(b.column("text"))
            prefix = prefix_hash(data)
            if first:
                row, place, start, last, key = anchors(data, off, prefix, length, gram)
                want, want_row = _flat(b.column("ranks"))
                salt = np.uint64(0xD6E8FEB86659FD93)
                hit = np.isin(key + row.astype(np.uint64) * salt, want.view(np.uint64) + want_row.astype(np.uint64) * salt)
                row, place, low, high = row[hit], place[hit], (place - last)[hit], (place - start)[hit]
                own = np.ones(len(row), bool)
            else:
                place, row = _flat(b.column("place"))
                place = place + off[row]
                low, high = (_flat(b.column(c))[0].astype(np.int64) for c in ("low", "high"))
                own = _flat(b.column("own"))[0].astype(bool)
            if not len(row):
                continue
            k0 = low // block
            many = high // block - k0 + 1
            of = np.repeat(np.arange(len(row)), many)
            k = k0[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            row, place, low, high, own = row[of], place[of], np.maximum(low[of], k * block), np.minimum(high[of], k * block + block - 1), own[of]
            tag = k.astype(np.uint64) * np.uint64(1024) + np.uint64(block)
            common = mix(rank(prefix, place - k * block, place - k * block - block + 1 + length) + tag)
            whole = rank(prefix, place - high, place - low + length)
            d, rel = b.column("d").to_numpy(zero_copy_only=False)[row], place - off[row]
            yield _batch({"common": common.view(np.int64), "whole": whole.view(np.int64), "d": d, "place": rel.astype(np.int32), "low": low.astype(np.int32), "high": high.astype(np.int32), "own": own})

    return texts.join(todo, "d").mapInArrow(run, "common long, whole long, d long, place int, low int, high int, own boolean")


def _settle(rows: DataFrame, last: bool) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """The blocks whose windows all repeat, the blocks (with witnesses) that the next round splits, by text, and the tables behind both."""
    # both sides of the join are tables, so that Spark can split the rows of a frequent rank
    ranked = store(rows, "ranked")
    groups = store(ranked.groupBy("common").agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("least"), F.max("whole").alias("most")).where("n > 1").select("common", (F.col("least") != F.col("most")).alias("mixed")), "groups")
    rows = store(ranked.join(groups, "common"), "blocks")
    discard(ranked, groups)
    all_ = rows.where("not mixed")
    if last:
        return all_, None, [rows]
    mixed = rows.where("mixed")
    twice = store(mixed.groupBy("whole").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("whole", F.lit(True).alias("whole_repeats")), "twice")
    mixed = store(mixed.join(twice, "whole", "left").withColumn("whole_repeats", F.coalesce("whole_repeats", F.lit(False))), "blocks")
    open_ = mixed.where("own and not whole_repeats")
    block = F.struct("d", "place", "low", "high").alias("x")
    # one witness for each distinct string first: a frequent rank is reduced before its rows are gathered
    near = mixed.where("whole_repeats or not own").groupBy("common", "whole").agg(F.min(block).alias("x"))
    witnesses = near.join(open_.select("common").distinct(), "common", "left_semi").select("x.*", F.lit(False).alias("own"))
    todo = open_.select("d", "place", "low", "high", "own").unionByName(witnesses)
    todo = todo.groupBy("d").agg(F.collect_list(F.struct("place", "low", "high", "own")).alias("x")).select("d", "x.place", "x.low", "x.high", "x.own")
    return all_.unionByName(mixed.where("whole_repeats").drop("whole_repeats")), todo, [rows, mixed, twice]


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text_col: str = "text") -> DataFrame:
    """(d, d2, spans, kept): for each text (named by two hashes) with strings of ``length`` bytes that also start elsewhere, the maximal stretches
    of bytes they cover (start, end) and the bytes that are left.

    Texts that occur in several rows are looked at once; they repeat as a whole, which the caller sees from the rows. Null text is empty.
    """
    texts = _texts(docs, text_col)
    todo = _candidates(texts, length, gram)
    with bucketed(_kept_texts(texts, todo), "d", "repeat_texts") as held:
        settled, behind = [], [todo]
        for i, block in enumerate(BLOCKS):
            done, todo, tables = _settle(_ranked(held, todo, block, length, gram, i == 0), block == 1)
            settled.append(done.select("d", "place", "low", "high"))
            behind += tables
            discard()
        out = _removed(held, settled, length)
    discard(*behind)
    return out


def _removed(held: DataFrame, settled: list[DataFrame], length: int) -> DataFrame:
    spans = settled[0]
    for s in settled[1:]:
        spans = spans.unionByName(s)
    spans = spans.groupBy("d").agg(F.collect_list(F.struct((F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + length).alias("end"))).alias("x"))

    @frugal
    def run(batches):
        for b in pieces(batches, "text"):
            data, off = byte_view(b.column("text"))
            start, row = _flat(b.column("start"))
            end, _ = _flat(b.column("end"))
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, start + off[row], 1)
            np.add.at(change, end + off[row], -1)
            gone = np.cumsum(change[:-1]) > 0
            kept, all_spans = [], []
            for i in range(b.num_rows):
                g = gone[off[i] : off[i + 1]]
                kept.append(data[off[i] : off[i + 1]][~g].tobytes())
                edge = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]])))
                all_spans.append([{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
            yield pa.RecordBatch.from_arrays([b.column("d"), b.column("d2"), pa.array(all_spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["d", "d2", "spans", "kept"])

    rows = held.join(spans, "d").select("d", _second("text").alias("d2"), "text", "x.start", "x.end")
    return store(rows.mapInArrow(run, "d long, d2 long, spans array<struct<start:long,end:long>>, kept binary").dropDuplicates(["d"]), "repeats")


def without_repeats(docs: DataFrame, length: int = LENGTH, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), lean: bool = False) -> DataFrame:
    """The columns ``keep`` of every row with n_bytes, spans (array of start, end) and kept (binary): its UTF-8 bytes without each byte
    covered by a string of ``length`` bytes that also starts anywhere else in the input, the same document included.

    ``lean`` leaves kept null where nothing is removed. Null and empty text: no bytes, no spans. A text of at least ``length`` bytes in
    several rows is removed from all of them. No documents give no rows. Other columns are not read.
    """
    spans = repeated_spans(docs, length, text_col=text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)), F.xxhash64(text).alias("d"), _second(text).alias("d2"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    copies = rows.where(F.col("n_bytes") >= length).groupBy("d", "d2").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("d", "d2", F.lit(True).alias("copied"))
    if lean:
        rows = rows.drop("text")
    # tables on the right, so that Spark can split the rows of a frequent text
    out = rows.join(spans, ["d", "d2"], "left").join(store(copies, "copies"), ["d", "d2"], "left")
    none = F.expr("cast(array() as array<struct<start:long,end:long>>)")
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    kept: Column = F.when(F.col("copied"), F.lit(b"")).otherwise(F.col("kept") if lean else F.coalesce("kept", F.col("text").cast("binary")))
    return out.select(*(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)), "n_bytes", F.when(F.col("copied"), all_).otherwise(F.coalesce("spans", none)).alias("spans"), kept.alias("kept"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    out = without_repeats(docs, keep=("doc_id", "sha"), lean=True)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.coalesce(F.sha2("kept", 256), "sha").alias("kept_sha256"))
