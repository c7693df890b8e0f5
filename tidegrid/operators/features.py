"""Features on bucket rows: day lags, rolling medians, hooks and robust scaling."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.config import GridConfig
from tidegrid.functions.rolling import pairwise_frames, rolling_median
from tidegrid.functions.scalar import floor_div
from tidegrid.operators.blocks import over_blocks
from tidegrid.operators.order_stats import quantiles
from tidegrid.staging import stage

KEYS = ["series_id"]
Hook = Callable[[DataFrame], DataFrame]

# fixed values: feature order of the two builds; hook columns follow, sorted by name
TRAIN_FEATURES = [
    "step_first", "hour", "minute", "noise_removal",
    "enmo_std_norm", "anglez_std_norm", "anglez_std_norm_orig",
    "anglez_equal1", "anglez_equal2", "fe__check_c", "porc_step", "group_len_c_norm",
    "hmin_onset", "hmin_wakeup",
]
SCORE_FEATURES = [
    "step_first", "hour", "minute", "noise_removal",
    "enmo_std_norm", "anglez_std_norm", "anglez_std_norm_orig", "anglez", "enmo",
    "anglez_equal1", "anglez_equal2", "std_q50_left", "std_q50_right",
    "fe__check_c", "porc_step", "group_len_c_norm", "hmin_onset", "hmin_wakeup",
]

# fixed values: columns each experiment feeds to its model
FEATURE_SETS = {
    "gru_abs": [
        "hmin_onset", "hmin_wakeup", "anglez_equal1", "anglez_equal2",
        "anglez_std_norm", "enmo_std_norm", "noise_removal",
    ],
    "gru_abs_comb": [
        "hmin_onset", "hmin_wakeup", "anglez_equal1", "anglez_equal2",
        "anglez_std_norm", "anglez_std_norm_orig", "enmo_std_norm", "noise_removal",
    ],
    "gru_abs_new": [
        "hmin_onset", "hmin_wakeup", "anglez_equal1", "anglez_equal2",
        "anglez_std_norm", "enmo_std_norm", "noise_removal",
        "fe__check_c", "porc_step", "group_len_c_norm",
    ],
    "gru_no_abs": [
        "hmin_onset", "hmin_wakeup", "anglez_equal1", "anglez_equal2",
        "anglez_std_norm_orig", "enmo_std_norm", "noise_removal",
    ],
}


def day_equality(df: DataFrame, grid: GridConfig, col: str = "anglez", median_rows: int = 15) -> DataFrame:
    """Add ``anglez_equal1/2`` (same value one day earlier / later, by rows) and the
    trailing and leading rolling medians of ``anglez_std_norm``.

    ``df`` has ``pos``.  All four share one exchange and one sort.  The leading median is the
    trailing one of a later row, so each frame is sorted once.
    """
    day = grid.night_rows

    def build(d: DataFrame, w) -> DataFrame:
        def same(other):
            return F.when(F.col(col) == other, 1).otherwise(0)

        d = d.withColumns(
            {
                "anglez_equal1": same(F.lag(col, day).over(w)),
                "anglez_equal2": same(F.lead(col, day).over(w)),
                "std_q50_left": rolling_median("anglez_std_norm", w, 1 - median_rows, 0),
            }
        )
        return d.withColumn("std_q50_right", F.lead("std_q50_left", median_rows - 1).over(w))

    halo = max(day, median_rows)
    return over_blocks(df, KEYS, grid.bucket_block_rows, halo, halo, build)


def time_of_day_profile(df: DataFrame, col: str = "anglez_std_norm", part_steps: int = 65536) -> DataFrame:
    """Hook: mean of ``col`` at the same time of day of the series.

    A mean per key joined back: the keys repeat once a day, so the partial sums are
    what gets shuffled.  Rows without an anchor have no time of day and share one mean of their series, which
    may be all of its rows: that mean is laid out once per ``part_steps`` steps, and the rows meet it
    there, so no join key grows with the length of a series.  Without a column ``step`` there is one part.
    """
    keys = ["series_id", "st_hour", "st_step"]
    anchored = F.col("st_hour").isNotNull() & F.col("st_step").isNotNull()
    part = floor_div("step", part_steps) if "step" in df.columns else F.lit(0).cast("long")
    means = df.groupBy(*keys).agg(F.avg(col).alias(f"mean_{col}"), F.min(part).alias("_lo"), F.max(part).alias("_hi"))
    parts = F.when(anchored, F.array(F.lit(0).cast("long"))).otherwise(F.sequence("_lo", "_hi"))

    # -1 is no time of day, so it can stand for a missing one
    def joined(place: Column) -> list[Column]:
        known = [F.coalesce(F.col(k).cast("long"), F.lit(-1)).alias(f"_{k}") for k in keys[1:]]
        return [F.col("series_id").alias("_series_id"), *known, place.alias("_part")]

    right = means.select(*joined(F.explode(parts)), f"mean_{col}")
    place = F.when(anchored, F.lit(0).cast("long")).otherwise(part)
    left = df.select("*", *joined(place)[1:])
    same = F.col("l.series_id").eqNullSafe(F.col("r._series_id"))
    for c in ("_st_hour", "_st_step", "_part"):
        same = same & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    out = left.alias("l").join(right.alias("r"), same, "left")
    return out.select(*[F.col(f"l.`{c}`") for c in df.columns], F.col(f"r.mean_{col}").alias(f"mean_{col}"))


def activity_burst(df: DataFrame, grid: GridConfig, sizes: Sequence[int] = (60, 30, 15, 6)) -> DataFrame:
    """Hook: largest recent sum of absolute angle changes, for several window sizes.

    ``df`` has ``pos``.  Sums and their maxima are built by doubling, in one exchange and one sort.
    """

    def build(d: DataFrame, w) -> DataFrame:
        d = d.withColumn("_move", F.abs(F.col("anglez") - F.lag("anglez").over(w)))
        d = pairwise_frames(d, w, lambda a, b: a + b, {f"_sum{n}": ("_move", n) for n in sizes})
        tops = {f"anglez_diff_last_halfhour{n}": (f"_sum{n}", n) for n in sizes}
        d = pairwise_frames(d.drop("_move"), w, F.greatest, tops)
        return d.drop(*[f"_sum{n}" for n in sizes])

    return over_blocks(df, KEYS, grid.bucket_block_rows, 2 * max(sizes), 0, build)


def robust_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(x - median) / IQR`` per series; an IQR of 0 counts as 1, nulls stay null.

    All columns share one quantile job, with the column name as a second key.
    """
    if not columns:
        return df
    values = df.select("series_id", *[F.col(c).cast("double").alias(c) for c in columns])
    long = values.unpivot(["series_id"], list(columns), "_name", "_value")
    q = quantiles(long, ["series_id", "_name"], "_value", [0.25, 0.5, 0.75])
    wide = q.groupBy("series_id").agg(
        *[F.first(F.when(F.col("_name") == c, F.col("q")), ignorenulls=True).alias(f"_q_{c}") for c in columns]
    )
    out = df.join(wide, "series_id", "left")

    def scaled(c: str):
        q1, median, q3 = (F.col(f"_q_{c}")[i] for i in range(3))
        return (F.col(c) - median) / F.when(q3 == q1, 1.0).otherwise(q3 - q1)

    return out.withColumns({c: scaled(c) for c in columns}).drop(*[f"_q_{c}" for c in columns])


def apply_hook(df: DataFrame, hook: Hook | None) -> tuple[DataFrame, list[str]]:
    """Run a user hook; its new columns, sorted by name, are robust-scaled per series."""
    if hook is None:
        return df, []
    out = stage(df.transform(hook), "hooked")
    added = sorted(set(out.columns) - set(df.columns))
    return robust_scale(out, added), added


def select_features(df: DataFrame, base: Sequence[str], added: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Ordered projection: base features, then the hook's; null and NaN become 0."""
    features = [*base, *added]
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in features]).fillna(0, features)
