"""Sums of large arrays over all tasks: cut into blocks, added up block by block in a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import frugal

BLOCK = 4096
SCHEMA = "block int, blob binary"


def blocks(a: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The blocks of a float32 array that are not zero."""
    a = np.ascontiguousarray(a, np.float32).reshape(-1)
    ids, blobs = [], []
    for i in range(0, len(a), BLOCK):
        part = a[i : i + BLOCK]
        if part.any():
            ids.append(i // BLOCK)
            blobs.append(part.tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["block", "blob"])


def summed(rows: DataFrame, size: int) -> np.ndarray:
    """The sum, whose size does not depend on the data, on the driver. Memory of a summing task: its blocks once."""

    @frugal
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for block, blob in zip(b.column("block").to_pylist(), b.column("blob").to_pylist(), strict=True):
                part = np.frombuffer(blob, np.float32)
                if block in held:
                    held[block] += part
                else:
                    held[block] = part.astype(np.float64)
        for block, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["block", "blob"])

    out = np.zeros(size, np.float32)
    for r in rows.repartition("block").mapInArrow(run, SCHEMA).toLocalIterator():
        part = np.frombuffer(r["blob"], np.float32)
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(part)] = part
    return out
