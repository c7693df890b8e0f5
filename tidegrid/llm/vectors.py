"""What the vector operators share: which vectors count, and their bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null, not empty, not zero, and every component finite."""
    v = F.col(vector)
    wrong = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~wrong & F.exists(v, lambda x: x != 0), F.lit(False))


def classes(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """One row per distinct vector: ``rep`` (smallest id), ``cnt``, ``vec`` and its hash ``h``."""
    part = rows.where(usable(vector)).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    return part.withColumn("h", F.xxhash64("vec")).groupBy("h", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("cnt"))


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled by the largest component first, so no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
