"""Toxicity: cumulative-link ordinal regression from sparse text features to severity grades."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_view, frugal, pieces, table
from .linear import BITS, Rows, adam, fitted, scores, sigmoid, toxicity_features

#: Labelled rows that the regression is fitted on, at most; every fourth chooses among the strengths of regularisation.
SAMPLE = 8000
STRENGTHS = (1e-3, 3e-4, 1e-4, 3e-5, 1e-5, 1e-6)
GRADES = 3
TOXIC_FROM = 0.5


def observed(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest and the highest grade that each label stands for. Labels above 1 are grades themselves; where there are only 0 and 1, a flagged
    document has some grade from 1 on: the labels don't tell which."""
    y = np.minimum(np.maximum(labels, 0), GRADES).astype(int)
    return y, y if labels.max(initial=0) > 1 else np.where(y > 0, GRADES, 0)


def thresholds(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the parameters: the first threshold, then the logarithms of the steps."""
    return p[: 1 << BITS], p[1 << BITS] + np.concatenate([[0.0], np.cumsum(np.exp(p[(1 << BITS) + 1 :]))])


def loss_and_slope(p: np.ndarray, rows: Rows, grade: tuple[np.ndarray, np.ndarray], weight: np.ndarray, strength: float) -> tuple[float, np.ndarray]:
    """Weighted negative log-likelihood of the observed grades (lowest, highest), P(grade <= k) = sigmoid(threshold k - score), with half the
    strength times the squared weights, and its gradient."""
    w, theta = thresholds(p)
    (low, high), i, k = grade, np.arange(rows.n), np.arange(len(theta))
    below = sigmoid(theta[None, :] - rows.dot(w)[:, None])
    bounds = np.concatenate([np.zeros((rows.n, 1)), below, np.ones((rows.n, 1))], axis=1)
    mass = np.maximum(bounds[i, high + 1] - bounds[i, low], 1e-9)
    slope = below * (1 - below)
    up, down = (k[None, :] == high[:, None]) * slope, (k[None, :] == low[:, None] - 1) * slope
    d_theta = -(up - down) / mass[:, None] * weight[:, None]
    tail = np.cumsum(d_theta.sum(axis=0)[::-1])[::-1]
    g = np.concatenate([rows.back(-d_theta.sum(axis=1)) + strength * w, [tail[0]], tail[1:] * np.exp(p[(1 << BITS) + 1 :])])
    return float(-(weight * np.log(mass)).sum() + strength / 2 * (w @ w)), g


def _balance(flagged: np.ndarray) -> np.ndarray:
    """Weights that sum to one half for flagged rows and for the others."""
    return np.where(flagged, 0.5 / flagged.mean(), 0.5 / (~flagged).mean()) / len(flagged)


def fit(labels: np.ndarray, rows: Rows | None) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered thresholds. The strength of regularisation is the one under which rows held out are most likely; all rows are
    then fitted with it. Thresholds about which the labels say nothing split the flagged documents held out into equal parts by their scores.
    Without both classes: weights 0 and thresholds at which everything is clean."""
    flagged = labels > 0
    if len(set(flagged)) < 2:
        return np.zeros(1 << BITS), np.full(GRADES, 20.0)
    # a feature counts 1 / sqrt(features of the document)
    rows = Rows(rows.sizes, rows.slot, np.repeat(np.maximum(rows.sizes, 1) ** -0.5, rows.sizes))
    low, high = observed(labels)
    start = np.concatenate([np.zeros(1 << BITS), [1.0], np.zeros(GRADES - 1)])

    def fitted_to(mask: np.ndarray, p: np.ndarray, strength: float, steps: int) -> np.ndarray:
        part, weight = rows.take(mask), _balance(flagged[mask])
        return adam(lambda p: loss_and_slope(p, part, (low[mask], high[mask]), weight, strength)[1], p, steps, 0.1)

    hold = np.arange(rows.n) % 4 == 3
    if len(set(flagged[hold])) < 2 or len(set(flagged[~hold])) < 2:
        hold[:] = True
    test, judge = rows.take(hold), _balance(flagged[hold])
    p, least, strength, at = start, np.inf, STRENGTHS[2], np.zeros(test.n)
    for s in STRENGTHS:  # from strong to weak, each from the one before
        p = fitted_to(~hold if not hold.all() else hold, p, s, 60)
        now = loss_and_slope(p, test, (low[hold], high[hold]), judge, 0.0)[0]
        if now > least:
            break
        least, strength, at = now, s, test.dot(p[: 1 << BITS])
    weights, theta = thresholds(fitted_to(np.ones(rows.n, bool), start, strength, 200))
    if high.max() > low.max():
        parts = np.quantile(at[flagged[hold]], np.arange(1, GRADES) / GRADES)
        theta = np.maximum.accumulate(np.concatenate([theta[:1], np.maximum(parts, theta[0] + 0.1 * np.arange(1, GRADES))]))
    return weights, theta


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """doc_id, severity (expected grade, 0 to GRADES), grade (most probable one), p_toxic (probability of a grade above 0) and toxic.

    Null or empty text has no features: it is clean, with severity by the thresholds alone and toxic false. Equal texts get equal results,
    other columns of both tables are not read, no documents give no rows, and without labels of both classes nothing is toxic.
    """
    weights, theta = fitted(docs, labels, "toxic", sample, toxicity_features, fit) or fit(np.zeros(0), None)

    @frugal
    def run(batches):
        for b in pieces(batches, "text"):
            data, off = byte_view(b.column("text"))
            (row, slot) = features = toxicity_features(data, off)[0]
            n = np.bincount(row, minlength=b.num_rows)
            x = scores([features], b.num_rows, weights) * np.sqrt(n)
            above = 1 - sigmoid(theta[None, :] - x[:, None])
            mass = -np.diff(np.concatenate([np.ones((len(x), 1)), above, np.zeros((len(x), 1))], axis=1), axis=1)
            toxic = (above[:, 0] >= toxic_from) & (n > 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(mass.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0]), pa.array(toxic)], names=["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
