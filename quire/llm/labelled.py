"""A bounded sample of labelled documents for the trained operators, and score calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

HELD_OUT = 2


def sample(docs: DataFrame, labels: DataFrame, label: str, max_docs: int) -> list[tuple[str, int]]:
    """At most max_docs (text, label) pairs outside the held-out fold, chosen by a hash of the id.

    The labels are cut to max_docs rows before the join, so what is broadcast and
    collected has a fixed bound. A label row whose document is missing only makes the
    sample smaller.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
        .filter(F.col("_id").isNotNull() & F.col("_label").isNotNull() & (fold(F.col("_id")) != HELD_OUT))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    )
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
        .select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("_label").alias("label"))
        .orderBy("doc_id", "text").limit(max_docs).collect()
    )
    return [(r["text"], r["label"]) for r in rows]


def held_out(docs_column="doc_id"):
    return F.coalesce(fold(F.col(docs_column)) == HELD_OUT, F.lit(False))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
