"""What the label-trained operators share: the split, the training rows, logistic fits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.session import durable

FOLDS = 5


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; fold 0 is held out. Null for a null id."""
    return F.crc32(F.col(f"`{doc_id}`").cast("string")) % FOLDS


def _picked(labels: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """The labelled ids outside fold 0; with ``rows`` at most so many, those smallest by a hash of the id, so the same in each run."""
    ids = (labels.filter((fold() > 0) & F.col(label).isNotNull())
           .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label")))
    return ids if rows is None else ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``doc_id``, ``label``, ``fold`` of at most ``rows`` labelled documents outside fold 0, one for each distinct text.

    Null ids and null labels are left out; of conflicting labels of one id the largest counts.
    """
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    unlike = (texts.join(F.broadcast(_picked(labels, label, rows)), "doc_id")  # at most `rows` rows
              .groupBy("h", "label").agg(F.min("doc_id").alias("doc_id")))
    return unlike.select("doc_id", "label", fold().cast("int").alias("fold"))


def training_features(docs: DataFrame, labels: DataFrame, label: str, featured: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """``doc_id``, ``label``, ``fold`` and ``x`` of every labelled document outside fold 0, one for each distinct text and label; stored.

    ``featured`` turns texts to features ``x`` where they are read, once; what is joined and stored is these. Ids and labels are
    chosen as in ``training_sample``. Rows that repeat an id and a text are all in it.
    """
    texts = docs.filter(fold() > 0).select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    stored = durable(featured(texts, ["doc_id", "h"]).join(_picked(labels, label), "doc_id"))
    unlike = stored.groupBy("h", "label").agg(F.min("doc_id").alias("doc_id"))
    return durable(stored.join(unlike, ["h", "label", "doc_id"], "left_semi").select("doc_id", "label", fold().cast("int").alias("fold"), "x"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; ``x`` carries its own constant column."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        slope = x.T @ (p - y) / len(y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def steady(values: np.ndarray) -> np.ndarray:
    """Twelve digits: sums of tasks may differ in the last ones from run to run."""
    return np.array([float(f"{v:.12g}") for v in values])


def logistic_fit_table(rows: DataFrame, points: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], size: int,
                       ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """``logistic_fit`` over a stored table: ``points`` turns a batch of it into ``x`` (``size`` columns) and ``y``; a task sends its sums only."""
    w = np.zeros(size)
    for _ in range(rounds):
        def sums(batches: Iterator[pa.RecordBatch], w: np.ndarray = w) -> Iterator[pa.RecordBatch]:
            n, slope, curve = 0, np.zeros(size), np.zeros((size, size))
            for batch in batches:
                for x, y in points(batch):
                    p = sigmoid(x @ w)
                    n += len(y)
                    slope += x.T @ (p - y)
                    curve += (x * (p * (1 - p))[:, None]).T @ x
            yield pa.RecordBatch.from_arrays([pa.array([[float(n), *slope, *curve.ravel()]], pa.list_(pa.float64()))], ["sums"])

        total = np.array(rows.mapInArrow(sums, "sums array<double>").toArrow().column("sums").to_pylist()).sum(axis=0)
        n = max(1.0, total[0])
        slope = total[1:size + 1] / n + ridge * w
        step = np.linalg.solve(total[size + 1:].reshape(size, size) / n + ridge * np.eye(size), slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return steady(w)
