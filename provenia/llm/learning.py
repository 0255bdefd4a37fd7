"""Labelled samples of bounded size, and a small logistic regression for calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, fold: tuple[int, int], most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, text): at most `most` labelled rows of each class, those of smallest hash.

    fold = (n, r) leaves out the rows whose remainder modulo n is r. An id with several
    labels takes the largest; labels and texts that are null don't count. The ids are at
    most 2 * most, so they are broadcast.
    """
    n, r = fold
    known = labels.where(F.col(label_col).isin(0, 1) & (remainder(id_col, n) != r)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    picked = None
    for k in (0, 1):
        part = known.where(F.col("label") == k).orderBy(F.xxhash64(F.col("id"), F.lit(k)), "id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return rows.join(F.broadcast(picked), "id").select("id", "label", "text")


class Logistic:
    """Logistic regression by Newton's method on standardised columns with a ridge penalty."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        x, y = np.asarray(x, float), np.asarray(y, float)
        self.mean = x.mean(0)
        self.scale = np.where(x.std(0) > 1e-12, x.std(0), 1.0)
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        w, penalty = np.zeros(z.shape[1]), np.r_[1e-6, np.full(z.shape[1] - 1, ridge)]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.w = w

    def __call__(self, x) -> np.ndarray:
        z = (np.atleast_2d(np.asarray(x, float)) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.w[0] + z @ self.w[1:], -30, 30)))
