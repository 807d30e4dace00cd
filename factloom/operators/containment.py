"""Which texts hold which passages, word for word: one pass over the texts, whatever the number of passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

#: Bytes of a passage that are looked up: the largest of these that no passage is shorter than.
WIDTHS = (64, 32, 16)
#: Names of passages that are sent to the tasks as they are, eight bytes each; beyond, a table of so many bits says which may be there.
NAMES, BITS = 1 << 21, 1 << 28
#: Bytes of texts that are looked at, at once.
CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def window_names(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit name of each stretch of ``width`` bytes, a power of two, made from the names of its halves."""
    h, w = (data.astype(np.uint64) + np.uint64(1)) * _ODD, 1
    while w < width:
        if len(h) <= w:
            return np.zeros(0, np.uint64)
        h = (h[:-w] ^ (h[:-w] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (h[w:] ^ (h[w:] >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        w *= 2
    return h


def _name(column: pa.Array, width: int) -> list[int]:
    return [int(window_names(np.frombuffer(t[:width], np.uint8), width)[0].view(np.int64)) for t in column.cast(pa.binary()).to_pylist()]


def named(passages: DataFrame, column: str, width: int) -> DataFrame:
    """Passages with the ``name`` of their first ``width`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_name(b.column(column), width), pa.int64())], names=[*b.schema.names, "name"])

    return passages.mapInArrow(run, StructType([*passages.schema.fields]).add("name", LongType()))


def holders(texts: DataFrame, passages: DataFrame, text: str = "text", passage: str = "passage", names: int = NAMES) -> DataFrame:
    """texts and passages -> a row of both for each text that holds a passage, once.

    Every stretch of a text is looked up among the passages' beginnings, in one pass in which texts stay where they are; only texts with a hit
    go on, once for each name hit, and are compared in full. What the tasks get has a fixed size: up to ``names`` names, or else a table of
    bits. Passages shorter than the least width are a stated set of queries and are compared with every text. Null and empty passages are in no text.
    """
    spark = texts.sparkSession
    size = F.octet_length(passage)
    least = passages.where(size >= WIDTHS[-1]).agg(F.min(size), F.count(F.lit(1))).first()
    width = next((w for w in WIDTHS if least[0] is not None and w <= least[0]), None)
    short = passages.where((size > 0) & (size < WIDTHS[-1]))
    out = None
    if width is not None:
        long = named(passages.where(size >= width), passage, width)
        if least[1] <= names:
            known, bits = np.unique(np.array([r[0] for r in long.select("name").distinct().toLocalIterator()], np.int64).view(np.uint64)), None
        else:
            bits = np.zeros(BITS // 8, np.uint8)
            for r in long.select(F.pmod("name", F.lit(BITS)).alias("b")).distinct().toLocalIterator():
                bits[r[0] >> 3] |= 1 << (r[0] & 7)
            known = None
        sent = spark.sparkContext.broadcast((known, bits))

        def hits(h: np.ndarray) -> np.ndarray:
            known, bits = sent.value
            if known is None:
                at = h.view(np.int64) % BITS
                return np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            return np.flatnonzero(known[at] == h)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                column = pc.fill_null(b.column(text), "").cast(pa.large_binary())
                ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
                low = 0
                while low < b.num_rows:
                    before = ends[low - 1] if low else 0
                    high = max(low + 1, int(np.searchsorted(ends, before + CHUNK, side="right")))
                    part = column.slice(low, high - low)
                    off = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
                    data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
                    h = window_names(data, width)
                    at = hits(h) if len(h) else np.zeros(0, np.int64)
                    row = np.searchsorted(off - off[0], at, side="right") - 1
                    fits = at + width <= (off - off[0])[row + 1]  # a stretch may not cross into the next text
                    pairs = np.unique(np.stack([row[fits], h[at[fits]].view(np.int64)]), axis=1)
                    if pairs.size:
                        found = b.slice(low, high - low).take(pa.array(pairs[0]))
                        yield pa.RecordBatch.from_arrays([*found.columns, pa.array(pairs[1])], names=[*found.schema.names, "name"])
                    low = high

        near = texts.mapInArrow(run, StructType([*texts.schema.fields]).add("name", LongType()))
        out = near.join(long, "name").where(F.contains(text, passage)).drop("name")
    if out is None or not short.isEmpty():
        rest = texts.join(short, F.contains(text, passage))
        out = rest if out is None else out.unionByName(rest)
    return out
