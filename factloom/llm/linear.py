"""Hashed sparse text features, and linear models on them fitted in numpy, in one task, on a bounded sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_LOWER, byte_view, frugal, mix, pieces, prefix_hash, span_hash, word_hashes, words

BITS = 16


def _slot(h: np.ndarray, family: int) -> np.ndarray:
    return (mix(h + np.uint64(family * 0x632BE59BD9B4E019 % 2**64)) >> np.uint64(64 - BITS)).astype(np.int64)


def quality_features(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, slot) of words and word pairs (A-Z lower-cased) and of character 4-grams (bytes, case kept); one array pair for each family."""
    h, row, _ = word_hashes(data, off)
    pair = row[1:] == row[:-1]
    grams = np.zeros(0, np.uint64)
    at = np.zeros(0, np.int64)
    if len(data) >= 4:
        d = data.astype(np.uint64)
        grams = d[:-3] | d[1:-2] << np.uint64(8) | d[2:-1] << np.uint64(16) | d[3:] << np.uint64(24)
        at = np.repeat(np.arange(len(off) - 1), np.diff(off))
        same = at[:-3] == at[3:]
        grams, at = grams[same], at[:-3][same]
    return [(row, _slot(h, 1)), (row[1:][pair], _slot(h[:-1] * np.uint64(3) + h[1:], 2)[pair]), (at, _slot(grams, 3))]


def toxicity_features(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, slot) of words and of their first 4 and 5 bytes, lower-cased: one family, in which each slot counts once per row."""
    starts, ends, row = words(data, off)
    if not len(starts):
        return [(row, row)]
    p = prefix_hash(data, BYTE_LOWER)
    rows, slots = [row], [_slot(span_hash(p, starts, ends), 1)]
    for n in (4, 5):
        long = ends - starts >= n
        rows.append(row[long])
        slots.append(_slot(span_hash(p, starts[long], starts[long] + n), n))
    key = np.unique(np.concatenate(rows) << BITS | np.concatenate(slots))
    return [(key >> BITS, key & ((1 << BITS) - 1))]


def sparse(families: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of entries of each row, and the slots and values of all rows end to end; within a family a slot's value is its share of the
    family's occurrences."""
    keys, values = [], []
    for row, slot in families:
        total = np.bincount(row, minlength=n)
        k, c = np.unique(row << BITS | slot, return_counts=True)
        keys.append(k)
        values.append((c / total[k >> BITS]).astype(np.float32))
    k, v = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(k, kind="stable")
    k, v = k[order], v[order]
    return np.bincount(k >> BITS, minlength=n), (k & ((1 << BITS) - 1)).astype(np.uint16), v


def scores(families: list[tuple[np.ndarray, np.ndarray]], n: int, weights: np.ndarray) -> np.ndarray:
    """Weights times features of each row, without building the sparse rows."""
    out = np.zeros(n)
    for row, slot in families:
        total = np.maximum(np.bincount(row, minlength=n), 1)
        out += np.bincount(row, weights=weights[slot], minlength=n) / total
    return out


class Rows:
    """Sparse rows: number of entries of each, and all slots and values end to end."""

    def __init__(self, sizes: np.ndarray, slots: np.ndarray, values: np.ndarray):
        self.n, self.sizes, self.slot, self.value = len(sizes), np.asarray(sizes, np.int64), np.asarray(slots, np.uint16), np.asarray(values, np.float32)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), self.sizes)
        self.full = np.flatnonzero(self.sizes)
        self.start = (np.cumsum(self.sizes) - self.sizes)[self.full]
        # the same entries by slot, so that both products are sums over stretches
        order = np.argsort(self.slot, kind="stable")
        self.by_slot = self.row[order], self.value[order]
        ends = np.bincount(self.slot, minlength=1 << BITS)
        self.used = np.flatnonzero(ends)
        self.slot_start = (np.cumsum(ends) - ends)[self.used]

    def take(self, mask: np.ndarray) -> Rows:
        """The rows under the mask."""
        inside = mask[self.row]
        return Rows(self.sizes[mask], self.slot[inside], self.value[inside])

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.full):
            out[self.full] = np.add.reduceat(w[self.slot] * self.value, self.start)
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << BITS)
        if len(self.used):
            out[self.used] = np.add.reduceat(g[self.by_slot[0]] * self.by_slot[1], self.slot_start)
        return out


def fitted(docs: DataFrame, labels: DataFrame, label: str, rows: int, features, fit) -> list[np.ndarray] | None:
    """The arrays that ``fit(labels, Rows)`` makes of at most ``rows`` labelled documents: those whose ids come first in a fixed pseudo-random
    order. None if there are none.

    The sample (bounded by ``rows``) is gathered in one task, which fits the model; only the model comes to the driver. Labels and documents
    without an id or label are left out; of several labels for an id the largest holds, of several texts the one with the smallest hash.
    """
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .withColumn("draw", F.xxhash64("doc_id")).orderBy("draw", "doc_id").limit(rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "draw", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    @frugal
    def featured(batches):
        for b in pieces(batches, "text"):
            sizes, slots, values = sparse(features(*byte_view(b.column("text"))), b.num_rows)
            ends = np.cumsum(sizes)
            cut = [pa.array([x[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary()) for x in (slots, values)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("draw"), b.column("y"), *cut], names=["doc_id", "draw", "y", "slots", "values"])

    @frugal
    def fit_all(batches):
        y, sizes, slots, values = [], [], [], []
        for b in batches:
            y.append(b.column("y").to_numpy(zero_copy_only=False))
            sizes.append(pc.binary_length(b.column("slots")).to_numpy(zero_copy_only=False) // 2)
            slots.append(_joined(b.column("slots"), np.uint16))
            values.append(_joined(b.column("values"), np.float32))
        if y:
            model = fit(np.concatenate(y), Rows(*map(np.concatenate, (sizes, slots, values))))
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(x, float).tobytes() for x in model], pa.binary())], names=["part"])

    sample = found.mapInArrow(featured, "doc_id long, draw long, y int, slots binary, values binary").repartition(1).sortWithinPartitions("draw", "doc_id")
    got = sample.mapInArrow(fit_all, "part binary").collect()
    return [np.frombuffer(r["part"]) for r in got] or None


def _joined(column: pa.Array, dtype: type) -> np.ndarray:
    """The contents of a binary column end to end."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer((column.buffers()[2] or b"")[off[0] : off[-1]], dtype).copy()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def adam(grad, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w
