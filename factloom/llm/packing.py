"""Packing of documents into fixed-length training sequences: bounded-space online best fit."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, pieces, store, table
from .pretokens import encoder, tokenizer_path

END_ID = (1).to_bytes(4, "little")
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, closed boolean, part long"
#: Partitions whose leftover windows one merging task takes.
FAN_IN = 64


class Packer:
    """A fixed number of open windows. A piece goes where it leaves least room; if it fits nowhere, the fullest window is emitted:
    as it is if at most ``slack`` tokens are free, otherwise topped up with the head of the piece, whose tail is placed again."""

    def __init__(self, size: int, windows: int, slack: int):
        self.size, self.windows, self.slack = size, windows, slack
        self.open: list[list] = []  # [free, pieces]

    def place(self, piece: tuple) -> Iterator[list[tuple]]:
        """piece: (doc_id, start, ids, doc_tokens). Yields windows that are finished."""
        doc_id, start, ids, total = piece
        at, n = 0, len(ids) // 4
        while n - at >= self.size:
            yield [(doc_id, start + at, ids[4 * at : 4 * (at + self.size)], total)]
            at += self.size
        while at < n:
            need = n - at
            fits = [w for w in self.open if w[0] >= need]
            if fits or len(self.open) < self.windows:
                if fits:
                    best = min(fits, key=lambda w: w[0])
                else:
                    self.open.append(best := [self.size, []])
                best[0] -= need
                best[1].append((doc_id, start + at, ids[4 * at :], total))
                at = n
                full = best if best[0] == 0 else None
            else:
                full = min(self.open, key=lambda w: w[0])
                if full[0] > self.slack:
                    full[1].append((doc_id, start + at, ids[4 * at : 4 * (at + full[0])], total))
                    at += full[0]
            if full is not None:
                self.open = [w for w in self.open if w is not full]
                yield full[1]

    def rest(self) -> Iterator[list[tuple]]:
        yield from (w[1] for w in self.open)
        self.open = []


def _rows(windows: Iterable[tuple[bool, list[tuple]]], part: int, base: int) -> Iterator[pa.RecordBatch]:
    cols: list[list] = [[] for _ in range(9)]
    held, k = 0, 0

    def batch() -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    for closed, window in windows:
        offset = 0
        for doc_id, start, ids, total in window:
            n = len(ids) // 4
            for c, v in zip(cols, (doc_id, start, n, ids, total, base + k, offset, closed, part), strict=True):
                c.append(v)
            offset, held = offset + n, held + len(ids)
        k += 1
        if held > 4 << 20:
            yield batch()
            cols, held = [[] for _ in range(9)], 0
    if cols[0]:
        yield batch()


def pack(docs: DataFrame, path: str, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, windows: int = 16, slack: int = 8) -> DataFrame:
    """Pieces of all documents, laid gapless into sequences of at most ``size`` tokens.

    Each partition packs online with ``windows`` open windows, so its memory is bounded; the windows left at its end are merged, ``FAN_IN``
    partitions to a task and level by level, by filling them up to the brim, until one task has the last of them. Only the last sequence of
    all is not nearly full. Columns: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A null or empty text is one piece with the end id alone; null ids stay null; equal rows are packed one by one; no documents give no rows.
    Other columns, whatever their names, are not read.
    """

    @frugal
    def first(batches):
        part = TaskContext.get().partitionId()
        enc, packer = encoder(path, ranks_path), Packer(size, windows, slack)

        def run():
            for b in pieces(batches, "text"):
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    ids = enc.ids(text or "") + END_ID
                    yield from ((True, w) for w in packer.place((doc_id, 0, ids, len(ids) // 4)))
            yield from ((False, w) for w in packer.rest())

        yield from _rows(run(), part, part << 32)

    def merge(level: int):
        @frugal
        def filled(batches):
            part = TaskContext.get().partitionId()
            packer = Packer(size, 1, 0)

            def run():
                for b in batches:
                    for x in b.to_pylist():
                        yield from ((True, w) for w in packer.place((x["doc_id"], x["start"], x["ids"], x["doc_tokens"])))
                yield from ((False, w) for w in packer.rest())

            yield from _rows(run(), part, (level << 56) + (part << 32))

        return filled

    rows = store(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(first, SCHEMA), "packed")
    done, left, level = [rows.where("closed")], rows.where("not closed"), 0
    parts = left.agg(F.max("part")).first()[0]
    while parts is not None and (parts > 0 or level == 0):
        level += 1
        parts = parts // FAN_IN
        group = F.floor(F.col("part") / FAN_IN).cast("int")
        dealt = left.withColumn("part", group.cast("long")).repartitionByRange(parts + 1, "part").sortWithinPartitions("part", "sequence_id", "offset")
        rows = store(dealt.mapInArrow(merge(level), SCHEMA), "packed")
        # each merging task is a new partition of the next level
        done.append(rows.where("closed"))
        left = rows.where("not closed")
    out = done[0]
    for d in [*done[1:], left]:
        out = out.unionByName(d)
    return out.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str, path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), path or tokenizer_path(), ranks_path or tokenizer_path("byte_bpe_50k.tiktoken"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
