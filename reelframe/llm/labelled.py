"""Bounded samples of labelled documents, and a one-line logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def own_labels(labels: DataFrame, label: str, train: Column) -> DataFrame:
    """(doc_id, y) of the labels that may be learnt from: one row an id; null labels, and ids labelled both ways, are left out."""
    y = F.col(label).cast("int")
    own = labels.where(F.col("doc_id").isNotNull() & y.isin(0, 1) & train).groupBy("doc_id").agg(F.min(y).alias("y"), F.max(y).alias("y2"))
    return own.where("y = y2").select("doc_id", "y")


def class_sizes(labels: DataFrame, label: str, train: Column) -> tuple[int, int]:
    """How many documents are labelled 0 and 1, all labels counted."""
    row = own_labels(labels, label, train).agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")).first()
    return row["n0"], row["n1"]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, *, per_class: int, max_chars: int | None = None) -> DataFrame:
    """(doc_id, text, y) of at most `per_class` training documents of each class, dealt by the hash of the id.

    `train` says which labels may be learnt from.  Only the bounded list of ids meets the documents, so no other
    text is shuffled.  An id on several rows counts once, with the least of its texts; `max_chars` leaves longer texts out.
    """
    own = own_labels(labels, label, train)
    pick = lambda k: own.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    rows = [(r["doc_id"], r["y"]) for r in pick(0).unionByName(pick(1)).collect()]  # at most 2 * per_class pairs of integers
    chosen = docs.sparkSession.createDataFrame(rows, "doc_id long, y int")
    texts = docs.select("doc_id", "text")
    if max_chars is not None:
        texts = texts.where(F.length(F.coalesce("text", F.lit(""))) <= max_chars)
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, *, ridge: float = 0.1, steps: int = 100) -> np.ndarray:
    """Weights of 1 / (1 + exp(-(x @ w[1:] + w[0]))): damped Newton steps on standardised columns; neutral weights without both classes.

    `weight` counts a row more or less than once, as where classes are sampled at different rates.
    """
    if not len(y) or not 0 < y.sum() < len(y):
        return np.zeros(x.shape[1] + 1)
    of = np.ones(len(y)) if weight is None else weight * len(y) / weight.sum()
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    penalty = np.array([1e-6, *[ridge] * x.shape[1]])

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float((of * (np.logaddexp(0, m) - y * m)).sum() + (penalty * w * w).sum() / 2)

    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * np.maximum(of * p * (1 - p), 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (of * (y - p)) - penalty * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-7:
            break
    raw = w[1:] / spread
    return np.concatenate([[w[0] - raw @ mean], raw])


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -30, 30)))
