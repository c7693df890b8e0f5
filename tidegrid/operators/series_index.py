"""Per-series constants and row positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.config import GridConfig
from tidegrid.functions.scalar import floor_div, is_anchor
from tidegrid.operators.blocks import join_constants, with_positions
from tidegrid.staging import stage


def step_first(df: DataFrame, grid: GridConfig) -> DataFrame:
    """First step of each series at the day anchor (``init_hour:00``)."""
    return df.where(is_anchor(grid)).groupBy("series_id").agg(F.min("step").alias("step_first"))


def series_constants(df: DataFrame, grid: GridConfig) -> DataFrame:
    """One row per series with everything later steps need as constants.

    A single aggregation over the scan: row count, step range, anchor, and the mean
    and sample deviation of each signal.  ``df`` carries ``anglez`` (absolute),
    ``anglez_orig`` and ``enmo``.
    """
    stats = []
    for name in ("anglez", "anglez_orig", "enmo"):
        stats += [F.avg(name).alias(f"{name}_mean"), F.stddev_samp(name).alias(f"{name}_sd")]
    return df.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("step").alias("min_step"),
        F.max("step").alias("max_step"),
        F.min(F.when(is_anchor(grid), F.col("step"))).alias("step_first"),
        *stats,
    )


def staged_constants(df: DataFrame, grid: GridConfig) -> DataFrame:
    return stage(series_constants(df, grid), "series-constants")


def at_step(
    df: DataFrame, constants: DataFrame, values: dict[str, Column], grid: GridConfig, stride: int = 1, how: str = "inner"
) -> DataFrame:
    """Add per-series ``values`` to rows with a ``step`` of ``stride`` full steps.

    ``constants`` has ``min_step`` and ``max_step`` at full resolution."""
    rows = -(-grid.block_rows // grid.downsample) * grid.downsample  # whole buckets
    first, last = F.col("min_step"), F.col("max_step")
    return join_constants(df, constants, values, ["series_id"], F.col("step") * stride, first, last, rows, how)


def zscore(df: DataFrame, constants: DataFrame, grid: GridConfig = GridConfig()) -> DataFrame:
    """Scale the signals by the mean and sample deviation of their series; null if the
    deviation is zero."""
    names = ("anglez", "enmo", "anglez_orig")
    stats = {f"_{c}_{s}": F.col(f"{c}_{s}") for c in names for s in ("mean", "sd")}
    scaled = {c: F.try_divide(F.col(c) - F.col(f"_{c}_mean"), F.col(f"_{c}_sd")) for c in names}
    return at_step(df, constants, stats, grid).withColumns(scaled).drop(*stats)


def index_rows(
    df: DataFrame, grid: GridConfig, constants: DataFrame | None = None, stride: int = 1, block_rows: int | None = None
) -> DataFrame:
    """Add ``pos`` (row number in the series) and ``n_rows``.

    With ``dense_steps`` the position is plain arithmetic on the step, ``stride`` steps
    per row; otherwise rows are counted, block by block.
    """
    block_rows = block_rows or grid.block_rows
    if constants is None:
        constants = stage(
            df.groupBy("series_id").agg(
                F.count(F.lit(1)).alias("n_rows"), F.min("step").alias("min_step"), F.max("step").alias("max_step")
            ),
            "series-range",
        )
    block_steps = block_rows * stride
    span = F.col("step"), F.col("min_step"), F.col("max_step"), block_steps
    if not grid.dense_steps:
        df = join_constants(df, constants, {"n_rows": F.col("n_rows")}, ["series_id"], *span)
        return with_positions(df, ["series_id"], ["step"], floor_div("step", block_steps))
    gap_free = F.col("n_rows") * stride == F.col("max_step") - F.col("min_step") + stride
    checked = F.when(gap_free, F.col("min_step")).otherwise(
        F.raise_error(F.concat(F.lit("steps with gaps or repeats, use dense_steps=False: "), F.col("series_id")))
    )
    values = {"n_rows": F.col("n_rows"), "_base": checked.cast("long")}
    pos = ((F.col("step") - F.col("_base")) / stride).cast("long")
    return join_constants(df, constants, values, ["series_id"], *span).withColumn("pos", pos).drop("_base")
