"""Repeat noise: the same angle at the same time of day more than once in a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.config import GridConfig
from tidegrid.functions.scalar import time_of_night
from tidegrid.operators.blocks import over_blocks

KEYS = ["series_id"]


def repeated_rows(df: DataFrame, grid: GridConfig) -> DataFrame:
    """Rows whose absolute angle occurs again at the same time of day.

    ``df`` has ``series_id, step, step_first, anglez``.  A window count stands for the
    self join on four keys; a group has at most one row per day.  Rows without an
    anchor or a value never count as repeated.
    """
    keyed = df.withColumn("_tod", time_of_night(F.col("step"), F.col("step_first"), grid)).where(
        F.col("_tod").isNotNull() & F.col("anglez").isNotNull()
    )
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id", "_tod", "anglez"))
    return keyed.withColumn("repeat", n).where("repeat > 1").drop("_tod")


def with_repeat_flag(df: DataFrame, grid: GridConfig) -> DataFrame:
    """All rows with ``repeat`` (null without anchor or value) and ``noise`` (0/1)."""
    tod = time_of_night(F.col("step"), F.col("step_first"), grid)
    keyed = df.withColumn("_tod", tod)
    known = F.col("_tod").isNotNull() & F.col("anglez").isNotNull()
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id", "_tod", "anglez"))
    counted = keyed.where(known).withColumn("repeat", n)
    rest = keyed.where(~known).withColumn("repeat", F.lit(None).cast("long"))
    out = counted.unionByName(rest).drop("_tod")
    return out.withColumn("noise", (F.coalesce("repeat", F.lit(0)) > 1).cast("int"))


def long_noise(noisy: DataFrame, min_run: int, block_rows: int) -> DataFrame:
    """Add ``noise_removal`` to noisy rows: 1 in unbroken stretches of more than
    ``min_run`` rows.  Only noisy rows are moved."""

    def build(d: DataFrame, w) -> DataFrame:
        island = F.col("pos") - F.row_number().over(w)
        d = d.withColumn("_island", island)
        n = F.count(F.lit(1)).over(Window.partitionBy("series_id", "block", "_island"))
        return d.withColumn("noise_removal", (n > min_run).cast("int")).drop("_island")

    return over_blocks(noisy, KEYS, block_rows, min_run + 1, min_run + 1, build)


def drop_trailing_noise(df: DataFrame) -> DataFrame:
    """Drop the noisy run at the end of each series; ``df`` has ``pos`` and ``noise``."""
    last_clean = df.where("noise = 0").groupBy("series_id").agg(F.max("pos").alias("_last"))
    kept = df.join(last_clean, "series_id", "left")
    return kept.where(F.col("pos") <= F.coalesce("_last", F.lit(-1))).drop("_last")


def drop_noisy_nights(df: DataFrame, night_rows: int, share: float = 0.5) -> DataFrame:
    """Drop nights with more than ``share`` of noise, except those before night 0."""
    noise = df.groupBy("series_id", "night").agg(F.sum("noise_removal").alias("_noise"))
    bad = noise.where((F.col("_noise") > night_rows * share) & (F.coalesce("night", F.lit(0)) > -1))
    bad = bad.select(F.col("series_id").alias("_sid"), F.col("night").alias("_night"))
    same = (F.col("series_id") == F.col("_sid")) & F.col("night").eqNullSafe(F.col("_night"))
    return df.join(bad, same, "left_anti")
