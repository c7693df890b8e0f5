"""Buckets of ``downsample`` steps: the working resolution of everything after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.config import GridConfig
from tidegrid.functions.scalar import floor_div, is_anchor, iso_local, local_seconds, night_of, time_of_night
from tidegrid.operators.series_index import at_step


def bucket(grid: GridConfig, step: str = "step") -> Column:
    return floor_div(step, grid.downsample)


def downsample(df: DataFrame, grid: GridConfig) -> DataFrame:
    """One row per ``(series_id, bucket)`` from full-resolution rows with all features.

    Rows of a clustered stage (``sources.stage_store``) have a ``block``; they are grouped inside
    it, so they are not moved.
    """
    k = float(grid.downsample)
    keys = ["series_id", *[c for c in ("block",) if c in df.columns], "step"]
    return (
        df.withColumn("_step", F.col("step"))
        .withColumn("step", bucket(grid))
        .groupBy(*keys)
        .agg(
            F.min_by("timestamp", "_step").alias("timestamp"),
            F.min_by("night", "_step").alias("night"),
            F.max("st_hour").alias("st_hour"),
            F.max("st_step").alias("st_step"),
            F.avg("anglez").alias("anglez"),
            F.avg("enmo").alias("enmo"),
            F.stddev_samp("anglez").alias("anglez_std_norm"),
            F.stddev_samp("anglez_orig").alias("anglez_std_norm_orig"),
            F.stddev_samp("enmo").alias("enmo_std_norm"),
            F.max("fe__check_c").alias("fe__check_c"),
            F.avg("porc_step").alias("porc_step"),
            F.avg("group_len_c_norm").alias("group_len_c_norm"),
            (F.sum("noise") / k).alias("noise"),
            (F.sum("noise_removal") / k).alias("noise_removal"),
        )
        .drop("block")
    )


def downsample_signals(df: DataFrame, constants: DataFrame, grid: GridConfig) -> DataFrame:
    """Signal part of the bucket table, straight from the scan.

    Means and deviations of z-scores are linear in those of the raw values, so rows
    are reduced before anything is shuffled and scaled afterwards.  ``raw_anglez``
    keeps the unscaled mean for the day-lag comparison.  ``timestamp`` is the local time
    of the first row without its zone: it is carried as a number, since text would turn
    the hash aggregation into two sorts of all rows.
    """
    anchored = at_step(df, constants, {"step_first": F.col("step_first")}, grid)
    since = time_of_night(F.col("step"), F.col("step_first"), grid)
    hour = floor_div(since, grid.steps_per_hour)
    reduced = (
        anchored.withColumns({"_step": F.col("step"), "_hour": hour, "_rest": since - hour * grid.steps_per_hour})
        .withColumn("step", bucket(grid))
        .groupBy("series_id", "step")
        .agg(
            F.min_by(local_seconds(), "_step").alias("_local"),
            F.min("_step").alias("_from"),
            F.max("_hour").alias("st_hour"),
            F.max("_rest").alias("st_step"),
            F.avg("anglez").alias("raw_anglez"),
            F.avg("enmo").alias("_enmo"),
            F.stddev_samp("anglez").alias("_anglez_sd"),
            F.stddev_samp("anglez_orig").alias("_orig_sd"),
            F.stddev_samp("enmo").alias("_enmo_sd"),
        )
    )

    def scaled(x: Column, mean: Column | float, sd: str) -> Column:
        return F.try_divide(x - mean, F.col(sd))

    stats = {c: F.col(c) for c in constants.columns if c.endswith(("_mean", "_sd", "step_first"))}
    return at_step(reduced, constants, stats, grid, stride=grid.downsample).select(
        "series_id",
        "step",
        iso_local(F.col("_local")).alias("timestamp"),
        night_of(F.col("_from"), F.col("step_first"), grid).alias("night"),
        "st_hour",
        "st_step",
        "raw_anglez",
        scaled(F.col("raw_anglez"), F.col("anglez_mean"), "anglez_sd").alias("anglez"),
        scaled(F.col("_enmo"), F.col("enmo_mean"), "enmo_sd").alias("enmo"),
        F.try_divide(F.col("_anglez_sd"), F.col("anglez_sd")).alias("anglez_std_norm"),
        F.try_divide(F.col("_orig_sd"), F.col("anglez_orig_sd")).alias("anglez_std_norm_orig"),
        F.try_divide(F.col("_enmo_sd"), F.col("enmo_sd")).alias("enmo_std_norm"),
    )


def downsample_flat(flat: DataFrame, grid: GridConfig) -> DataFrame:
    return (
        flat.groupBy("series_id", bucket(grid).alias("step")).agg(
            F.max("fe__check_c").alias("fe__check_c"),
            F.avg("porc_step").alias("porc_step"),
            F.avg("group_len_c_norm").alias("group_len_c_norm"),
        )
    )


def downsample_noise(noisy: DataFrame, grid: GridConfig) -> DataFrame:
    k = float(grid.downsample)
    return noisy.groupBy("series_id", bucket(grid).alias("step")).agg(
        (F.count(F.lit(1)) / k).alias("noise"), (F.sum("noise_removal") / k).alias("noise_removal")
    )


def bucket_anchor(df: DataFrame, grid: GridConfig, short_series: int | None = 40) -> DataFrame:
    """First anchor bucket per series.  Series of at most ``short_series`` buckets start
    at 0; pass None to skip that rule."""
    first = F.min(F.when(is_anchor(grid), F.col("step")))
    if short_series is not None:
        first = F.when(F.count(F.lit(1)) <= short_series, F.lit(0).cast("long")).otherwise(first)
    return df.groupBy("series_id").agg(first.alias("step_first"))
