"""Labels as targets, and the rows they let us keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.config import GridConfig
from tidegrid.operators.downsample import bucket
from tidegrid.sources.tables import drop_unlabelled


def bucket_labels(labels: DataFrame, grid: GridConfig) -> DataFrame:
    """``series_id, step, onset, wakeup`` with one row per labelled bucket."""

    def hit(event: str):
        return F.max((F.col("event") == event).cast("int")).alias(event)

    return (
        drop_unlabelled(labels).groupBy("series_id", bucket(grid).alias("step")).agg(hit("onset"), hit("wakeup"))
    )


def label_targets(df: DataFrame, labels: DataFrame, grid: GridConfig) -> DataFrame:
    """Add 0/1 columns ``onset`` and ``wakeup`` to bucket rows."""
    out = df.join(bucket_labels(labels, grid), ["series_id", "step"], "left")
    return out.fillna(0, ["onset", "wakeup"])


def last_night(labels: DataFrame) -> DataFrame:
    return labels.groupBy("series_id").agg(F.max("night").alias("max_night"))


def trim_unlabelled_tail(df: DataFrame, labels: DataFrame, grid: GridConfig) -> DataFrame:
    """Keep rows up to the last labelled night; series without labels drop out."""
    return df.join(last_night(labels), "series_id").where(within_last_night(grid))


def within_last_night(grid: GridConfig) -> Column:
    """False or null for bucket rows after ``max_night``."""
    return F.col("step") <= F.col("max_night") * grid.night_rows


def in_fold(df: DataFrame, folds: DataFrame, fold: int) -> DataFrame:
    """Rows of the fold's series; fold -1 validates on fold 0."""
    wanted = folds.where(F.col("fold") == max(fold, 0))
    return df.join(wanted.select("series_id"), "series_id", "left_semi")


def out_of_fold(df: DataFrame, folds: DataFrame, fold: int) -> DataFrame:
    """Rows to train on: all series not listed in the fold; fold -1 trains on all."""
    if fold == -1:
        return df
    return df.join(folds.where(F.col("fold") == fold).select("series_id"), "series_id", "left_anti")


def in_known_folds(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of series that belong to any fold."""
    return df.join(folds.select("series_id"), "series_id", "left_semi")
