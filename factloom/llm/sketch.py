"""A counting sketch of fixed size over all rows: summed by block, so that no task and no message grows with the data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, mix

#: 2**BITS counters, one byte each when broadcast (16 MB); 2**BLOCK_BITS counters to a block.
BITS, BLOCK_BITS = 24, 18


class Sketch:
    """Counts of 64-bit keys by their leading bits; a count is never less than the key's own."""

    def __init__(self):
        self.counts = np.zeros(1 << BITS, np.uint16)

    def add(self, keys: np.ndarray) -> None:
        slot, c = np.unique((keys >> np.uint64(64 - BITS)).astype(np.int32), return_counts=True)
        self.counts[slot] = np.minimum(self.counts[slot].astype(np.int64) + c, 65535)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """The blocks that have any count: low bytes, then high bytes, compressed."""
        for i, block in enumerate(self.counts.reshape(-1, 1 << BLOCK_BITS)):
            if block.any():
                planes = np.ascontiguousarray(block.astype("<u2").view(np.uint8).reshape(-1, 2).T)
                yield i, pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def merged(blocks: DataFrame) -> np.ndarray:
    """The sum of all blocks (block int, blob binary), on a logarithmic scale in one byte: 8 * log2(1 + count)."""

    @frugal
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for block, blob in zip(b.column("block").to_pylist(), b.column("blob").to_pylist(), strict=True):
                planes = np.frombuffer(pa.decompress(blob, 2 << BLOCK_BITS, codec="zstd", asbytes=True), np.uint8).reshape(2, -1)
                total = held.setdefault(block, np.zeros(1 << BLOCK_BITS, np.uint64))
                total += planes[0]
                total += planes[1].astype(np.uint64) << np.uint64(8)
        for block, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([level(total).tobytes()], pa.binary())], names=["block", "blob"])

    dealt = blocks.select("block", "blob").repartition(1 << (BITS - BLOCK_BITS), "block")
    out = np.zeros((1 << (BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.uint8)
    for r in dealt.mapInArrow(run, "block int, blob binary").toLocalIterator():
        out[r["block"]] = np.frombuffer(r["blob"], np.uint8)
    return out.reshape(-1)


def level(count: np.ndarray | int) -> np.ndarray:
    return np.minimum(8 * np.log2(1 + np.asarray(count, float)), 255).astype(np.uint8)


def present(df: DataFrame, column: str) -> np.ndarray:
    """A sketch of one column of 64-bit keys, whose zeros prove that a key is absent."""

    @frugal
    def run(batches):
        s = Sketch()
        for b in batches:
            s.add(spread(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
        for block, blob in s.blocks():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([blob], pa.binary())], names=["block", "blob"])

    return merged(df.select(F.col(column)).where(F.col(column).isNotNull()).mapInArrow(run, "block int, blob binary"))


def spread(keys: np.ndarray) -> np.ndarray:
    return mix(keys)
