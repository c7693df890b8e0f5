"""Full feature build: from the sensor scan to the bucket feature table and chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.config import FlatSignalConfig, GridConfig
from tidegrid.functions.scalar import half_minute, with_time_parts
from tidegrid.operators.chunks import labelled_only, night_chunks, with_reversed
from tidegrid.operators.downsample import bucket_anchor, downsample_flat, downsample_noise, downsample_signals
from tidegrid.operators.encoding import join_encoding, join_mean_encoding
from tidegrid.operators.features import Hook, apply_hook, day_equality
from tidegrid.operators.flat_signal import detected_runs, run_buckets, run_rows
from tidegrid.operators.labels import label_targets, last_night, trim_unlabelled_tail, within_last_night
from tidegrid.operators.repeats import drop_noisy_nights, long_noise, repeated_rows
from tidegrid.operators.series_index import at_step, index_rows, staged_constants
from tidegrid.sources.tables import with_absolute_angle
from tidegrid.staging import stage


def bucket_table(series: DataFrame, grid: GridConfig, cfg: FlatSignalConfig, drop_tail: bool = False) -> DataFrame:
    """Signals, device-off features and repeat noise per bucket.

    The three parts read narrow projections of the scan and are reduced to buckets
    before they meet, so wide full-resolution rows are never shuffled.  With
    ``drop_tail`` the noisy run at the end of each series is left out.
    """
    raw = with_absolute_angle(series)
    constants = staged_constants(raw, grid)

    indexed = index_rows(raw.select("series_id", "step", "anglez"), grid, constants)
    if not grid.dense_steps:
        indexed = stage(indexed, "positions")
    runs = detected_runs(indexed, constants, grid, cfg)
    anchored = at_step(indexed, constants, {"step_first": F.col("step_first")}, grid)
    noisy = stage(
        long_noise(
            repeated_rows(anchored, grid).select("series_id", "step", "pos"), cfg.noise_run, grid.block_rows
        ),
        "noise",
    )
    if grid.dense_steps and not drop_tail:
        flat = run_buckets(runs, constants, grid)
    else:
        steps = indexed.select("series_id", "pos", "step")
        flat = run_rows(runs, grid).join(steps, ["series_id", "pos"])
        if drop_tail:
            clean = steps.join(noisy.select("series_id", "pos"), ["series_id", "pos"], "left_anti")
            last = clean.groupBy("series_id").agg(F.max("step").alias("_last"))
            # a series that is noise from end to end has no row left
            last = stage(constants.select("series_id", "min_step", "max_step").join(last, "series_id"), "last-clean")
            raw, flat, noisy = (
                at_step(d, last, {"_last": F.col("_last")}, grid).where(F.col("step") <= F.col("_last")).drop("_last")
                for d in (raw, flat, noisy)
            )
        flat = downsample_flat(flat, grid)

    by = ["series_id", "step"]
    table = (
        downsample_signals(raw, constants, grid)
        .join(flat, by)
        .join(downsample_noise(noisy, grid), by, "left")
        .fillna(0, ["noise", "noise_removal"])
    )
    return stage(table, "buckets")


def with_bucket_features(
    buckets: DataFrame,
    folds: DataFrame,
    grid: GridConfig,
    short_series: int | None = None,
    nights: DataFrame | None = None,
) -> DataFrame:
    """Time parts, day lags, medians, anchor, half minute and fold on the bucket table.

    ``nights`` (``series_id, max_night``), if given, adds its column."""
    timed = with_time_parts(index_rows(buckets, grid, block_rows=grid.bucket_block_rows))
    lagged = day_equality(timed, grid, col="raw_anglez")
    # everything that is constant in a series in one table, so rows meet it once
    k = grid.downsample
    spans = buckets.groupBy("series_id").agg((F.min("step") * k).alias("min_step"), (F.max("step") * k).alias("max_step"))
    facts = spans.join(bucket_anchor(buckets, grid, short_series), "series_id").join(folds, "series_id", "left")
    values = {"step_first": F.col("step_first"), "fold": F.coalesce("fold", F.lit(0))}
    if nights is not None:
        facts, values = facts.join(nights, "series_id", "left"), {**values, "max_night": F.col("max_night")}
    facts = stage(facts, "series-facts")
    out = at_step(lagged, facts, values, grid, stride=k)
    hminute = half_minute(F.col("hour"), F.col("minute"), F.col("second"))
    return out.withColumns({"hminute": hminute, "invert": F.lit(0)}).drop("n_rows")


def training_features(
    series: DataFrame,
    labels: DataFrame,
    folds: DataFrame,
    encoding: DataFrame,
    grid: GridConfig = GridConfig(),
    cfg: FlatSignalConfig = FlatSignalConfig(),
    trim: bool = True,
    drop_tail: bool = False,
    drop_noisy: bool = False,
) -> DataFrame:
    """Features with labels and the encoding of the own fold.

    ``trim`` cuts after the last labelled night; the other two switches are off by default.
    """
    buckets = bucket_table(series, grid, cfg, drop_tail)
    rows = with_bucket_features(buckets, folds, grid, nights=last_night(labels) if trim else None)
    if trim:
        rows = rows.where(within_last_night(grid))
    rows = label_targets(join_encoding(rows, encoding), labels, grid)
    if drop_noisy:
        rows = drop_noisy_nights(rows, grid.night_rows)
    return rows


def scoring_features(
    series: DataFrame,
    encoding: DataFrame,
    grid: GridConfig = GridConfig(),
    cfg: FlatSignalConfig = FlatSignalConfig(),
    short_series: int = 40,
) -> DataFrame:
    """Features of series without labels, with the encoding averaged over folds."""
    buckets = bucket_table(series, grid, cfg)
    no_folds = series.sparkSession.createDataFrame([], "series_id string, fold int")
    rows = with_bucket_features(buckets, no_folds, grid, short_series)
    rows = join_mean_encoding(rows, encoding)
    return rows.withColumns({"onset": F.lit(0), "wakeup": F.lit(0)})


@dataclass(frozen=True)
class DatasetVariant:
    """One of the training/validation data sets derived from the same features."""

    train: bool
    invert: bool = False
    clean: bool = False


# fixed values: the four data sets
VARIANTS = {
    "basic_test": DatasetVariant(train=False),
    "basic_train": DatasetVariant(train=True, invert=True),
    "no_inv_train": DatasetVariant(train=True),
    "clean_train": DatasetVariant(train=True, invert=True, clean=True),
}


def build_dataset(
    rows: DataFrame,
    labels: DataFrame,
    variant: DatasetVariant,
    grid: GridConfig,
    hook: Hook | None = None,
) -> tuple[DataFrame, list[str]]:
    """Chunk rows of one variant and the hook's columns; ``rows`` are untrimmed features.

    Padding, chunk places and reversal are row-wise; the one exchange is by chunk, and the
    soft targets and arrays that usually follow use it too.
    """
    if variant.train:
        rows = trim_unlabelled_tail(rows, labels, grid)
    rows, added = apply_hook(rows, hook)
    chunks = night_chunks(rows, grid)
    if variant.train and variant.clean:
        chunks = labelled_only(chunks)
    if variant.train and variant.invert:
        chunks = with_reversed(chunks, grid.night_rows)
    else:
        chunks = chunks.withColumn("invert", F.lit(0))
    return chunks, added
