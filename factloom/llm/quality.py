"""Quality rules: fixed counts, and a calibrated hashed n-gram logistic regression with fixed thresholds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, byte_view, frugal, mix, pieces, table, word_hashes
from .linear import BITS, Rows, adam, fitted, quality_features, scores, sigmoid

#: Labelled rows that the classifier is fitted on, at most; every fifth calibrates it.
SAMPLE = 3000
THRESHOLD = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def base_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    n = len(off) - 1
    at = np.repeat(np.arange(n), np.diff(off))
    h, row, first = word_hashes(data, off, lower=False)
    chars = np.bincount(at[~SPACE[data] & ((data & 0xC0) != 0x80)], minlength=n)
    symbols = np.bincount(at[_SYMBOL[data]], minlength=n)
    covered = np.zeros(len(h), bool)
    if len(h) >= 3:
        at3 = np.flatnonzero(row[2:] == row[:-2])
        key = mix(h[at3] + mix(h[at3 + 1] + mix(h[at3 + 2] + mix(row[at3].astype(np.uint64)))))
        order = np.argsort(key)
        twice = np.zeros(len(key), bool)
        same = key[order][1:] == key[order][:-1]
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            covered[at3[twice] + k] = True
    raw = data.tobytes()
    dup = np.zeros(n, np.int64)
    for i in range(n):
        lines = [x for x in raw[off[i] : off[i + 1]].split(b"\n") if x and not x.isspace() and x.strip()]
        dup[i] = len(lines) - len(set(lines))
    return {"n_words": np.diff(first), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": np.bincount(row[covered], minlength=n)}


def fit(labels: np.ndarray, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the regression, and scale and shift that calibrate its scores. With labels of one class only, all is kept."""
    y = (labels > 0).astype(float)
    if len(set(y)) < 2:
        return np.zeros(1 << BITS), np.array([0.0, 20.0])
    hold = np.arange(rows.n) % 5 == 4
    if len(set(y[hold])) < 2 or len(set(y[~hold])) < 2:
        hold = np.zeros(rows.n, bool)
    train, yt = rows.take(~hold), y[~hold]
    rows, yc = (rows.take(hold), y[hold]) if hold.any() else (train, yt)
    balance = np.where(yt > 0, 0.5 / yt.mean(), 0.5 / (1 - yt.mean())) / len(yt)

    def grad(p):
        e = (sigmoid(train.dot(p[:-1]) + p[-1]) - yt) * balance
        return np.append(train.back(e) + 1e-6 * p[:-1], e.sum())

    p = adam(grad, np.zeros((1 << BITS) + 1), 150, 0.3)
    s = rows.dot(p[:-1]) + p[-1]
    # targets of Platt's method keep the calibrated odds finite
    up, down = (yc.sum() + 1) / (yc.sum() + 2), 1 / ((1 - yc).sum() + 2)
    t = np.where(yc > 0, up, down)
    q = adam(lambda q: np.array([((e := sigmoid(q[0] * s + q[1]) - t) * s).mean(), e.mean()]), np.array([1.0, 0.0]), 500, 0.05)
    return p[:-1], np.array([q[0], q[0] * p[-1] + q[1]])


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every document with its counts, its probability of good quality and the verdict.

    base_failed: fewer than 50 words, or over half of the words repeat in 3-word windows. kept: not base_failed and probability >= threshold.
    Null text has no words and fails; equal rows get equal verdicts; other columns are not read; no documents give no rows;
    without labels of both classes the regression keeps everything.
    """
    weights, (scale, shift) = fitted(docs, labels, "quality", sample, quality_features, fit) or fit(np.zeros(0), None)
    schema = docs.select(*keep).schema
    given = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]
    fields = ", ".join(f"kept_{i} {f.dataType.simpleString()}" for i, f in enumerate(schema))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    @frugal
    def run(batches):
        for b in pieces(batches, "text"):
            data, off = byte_view(b.column("text"))
            counts = base_counts(data, off)
            p = sigmoid(scale * scores(quality_features(data, off), b.num_rows, weights) + shift)
            failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
            cols = [b.column(f"kept_{i}") for i in range(len(keep))] + [pa.array(counts[c].astype(np.int64)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)], names=[*(f"kept_{i}" for i in range(len(keep))), *names, "base_failed", "kept", "probability"])

    out = docs.select(*given, F.col("text")).mapInArrow(run, f"{fields}, {', '.join(f'{c} long' for c in names)}, base_failed boolean, kept boolean, probability double")
    return out.select(*(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)), *names, "base_failed", "kept", "probability")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
