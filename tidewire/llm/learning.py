"""Labelled samples of bounded size and a small logistic model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that no model learns from: crc32 of the id as text is divisible by ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def sample(labels: DataFrame, label: str, per_class: int, seed: int = 11) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y) of at most ``per_class`` documents of each class, and all counts by class.

    Taken are those of the smallest hash of the id; a document with two labels has the larger.
    Null ids and labels are left out, and so are the held-out ids.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [
        known.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(per_class)
        for y in (0, 1)
    ]
    return parts[0].unionByName(parts[1]), counts


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients, the constant last, by Newton steps with a ridge penalty."""
    design = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(design.shape[1], ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - penalty * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        norm = np.abs(step).max()
        beta += step * min(1.0, 5.0 / max(norm, 1e-12))
        if norm < 1e-6:
            break
    return beta
