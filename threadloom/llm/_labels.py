"""Bounded samples of labelled rows, and small fits that the classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(labels: DataFrame, column: str, most: int, doc_id: str = "doc_id", usable=None) -> DataFrame:
    """At most ``most`` rows (``doc_id``, ``y``) of ``labels`` with a 0 or 1 in ``column``, those of the smallest id hashes.

    Null ids and labels are left out; of rows that share an id the larger label counts. ``usable`` restricts the ids.
    """
    rows = labels.select(F.col(doc_id).alias("doc_id"), F.col(column).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if usable is not None:
        rows = rows.where(usable(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    return rows.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(most)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(z: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights (last: bias) of a logistic fit of ``y`` on the columns of ``z``, by Newton steps; smoothed targets."""
    x = np.column_stack([z, np.ones(len(z))])
    pos, neg = int((y == 1).sum()), int((y == 0).sum())
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - t) + ridge * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w
