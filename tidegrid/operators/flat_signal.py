"""Device-off detector: long stretches in which the angle hardly moves.

The rolling deviation of the absolute angle is reduced to a low quantile of the rows
ahead and scaled by its maximum in the series.  Stretches at the floor of that ratio
that last long enough are flagged, delayed and widened; the flag's runs give the
progress features.  From the ratio on, stretches are intervals: rows are read once to find
them, and the features of a row or a bucket follow from the interval it lies in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.config import FlatSignalConfig, GridConfig, centred_frame
from tidegrid.functions.rolling import clip, nan_to_null
from tidegrid.functions.scalar import floor_div
from tidegrid.operators import intervals
from tidegrid.operators.blocks import Carry, block_window, carry, explode_blocks, join_constants, spread
from tidegrid.operators.order_stats import at_offset, sliding_rank_value, sliding_std
from tidegrid.staging import stage

KEYS = ["series_id"]


def noise_floors(df: DataFrame, cfg: FlatSignalConfig, block_rows: int) -> DataFrame:
    """``series_id, pos, noise_floor, prev_floor``: low quantile of the rolling deviation
    ahead, of the row and of the one before it.

    ``df`` has ``series_id, pos, anglez``.
    """
    lo, hi = cfg.quantile_frame
    std_lo, std_hi = centred_frame(cfg.std_rows)
    narrow = df.select("series_id", "pos", F.col("anglez").cast("double").alias("x"))
    blocks = explode_blocks(narrow, block_rows, 1 + max(0, -(lo + std_lo)), max(0, hi + std_hi))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        x = pdf["x"].to_numpy(float, na_value=np.nan)
        spread = at_offset(sliding_std(x, cfg.std_rows), len(x), std_lo)
        low = at_offset(sliding_rank_value(spread, cfg.quantile_rows, cfg.quantile_index), len(x), lo)
        before = np.concatenate([[np.nan], low[:-1]])
        core = pdf["pos"] // block_rows == pdf["block"]
        return pdf.loc[core, ["series_id", "pos"]].assign(noise_floor=low[core], prev_floor=before[core])

    blocks = spread(blocks, "series_id", "block").groupBy("series_id", "block")
    out = blocks.applyInPandas(kernel, "series_id string, pos long, noise_floor double, prev_floor double")
    return out.withColumns({c: nan_to_null(c) for c in ("noise_floor", "prev_floor")})


def noise_floor(df: DataFrame, cfg: FlatSignalConfig, block_rows: int) -> DataFrame:
    """``series_id, pos, noise_floor``."""
    return noise_floors(df, cfg, block_rows).drop("prev_floor")


def clipped_ratio(floors: DataFrame, cfg: FlatSignalConfig, block_rows: int = 69120) -> DataFrame:
    """``ratio``: noise floor relative to the series maximum, clipped; null if that is zero.

    ``prev_floor`` becomes ``prev_ratio``.  ``floors`` is read twice, so stage it."""
    top = floors.groupBy("series_id").agg(F.max("noise_floor").alias("max_floor"), F.max("pos").alias("last_pos"))
    top = stage(top, "noise-maximum")
    rows = join_constants(
        floors, top, {"max_floor": F.col("max_floor")}, KEYS, F.col("pos"), F.lit(0).cast("long"), F.col("last_pos"), block_rows
    )

    def ratio(c: str) -> Column:
        return clip(F.try_divide(F.col(c), F.col("max_floor")), cfg.floor, 1.0)

    named = {"noise_floor": "ratio", "prev_floor": "prev_ratio"}
    return rows.select("series_id", "pos", *[ratio(c).alias(n) for c, n in named.items() if c in floors.columns])


OTHER, KNOWN, UNKNOWN = 0, 1, 2  # rows off the floor; at it, with and without a difference to the row before


def floor_pieces(ratios: DataFrame, cfg: FlatSignalConfig, block_rows: int) -> DataFrame:
    """Each block as a sequence of pieces at and off the floor, a few numbers each.

    Rows have a difference to the row before or not; ``n_known`` counts those that have, and
    changes of the ratio are placed by the number of such rows before and at them."""
    w = block_window(KEYS)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("ratio").isNotNull() & F.col("prev_ratio").isNotNull()
    at_floor = F.coalesce(F.col("ratio") == cfg.floor, F.lit(False))
    rows = ratios.withColumns(
        {
            "block": floor_div("pos", block_rows),
            "_known": known.cast("long"),
            "_kind": F.when(at_floor & known, KNOWN).when(at_floor, UNKNOWN).otherwise(OTHER),
        }
    )
    rows = rows.withColumns({"_k": F.sum("_known").over(up), "_fresh": F.coalesce(F.lag("_kind").over(w) != F.col("_kind"), F.lit(True))})
    rows = rows.withColumn("piece", F.sum(F.col("_fresh").cast("long")).over(up))
    change = F.when(known & (F.col("ratio") != F.col("prev_ratio")), F.col("_k"))
    return rows.groupBy(*KEYS, "block", "piece").agg(
        F.first("_kind").alias("kind"),
        F.min("pos").alias("first"),
        F.max("pos").alias("last"),
        F.sum("_known").alias("n_known"),
        F.min(change).alias("first_change"),
        F.max(change).alias("last_change"),
    )


def flat_stretches(floors: DataFrame, cfg: FlatSignalConfig, block_rows: int) -> DataFrame:
    """``series_id, first, last`` of rows at the floor in runs longer than ``min_run``.

    A run is all rows between two changes of the ratio, whatever lies at block borders; rows
    without a difference, and those before the first change, form one run of their own.
    """
    pieces = stage(floor_pieces(clipped_ratio(floors, cfg, block_rows), cfg, block_rows), "floor-pieces")
    known = pieces.groupBy(*KEYS, "block").agg(F.sum("n_known").alias("_n"))
    base = carry(known, KEYS, "block", [Carry("_base", "sum", "_n")])
    moved = {c: F.col(c) + F.col("_base") for c in ("first_change", "last_change")}
    pieces = stage(pieces.join(base, [*KEYS, "block"]).withColumns(moved).drop("_base"), "floor-pieces")
    per_block = pieces.groupBy(*KEYS, "block").agg(F.min("first_change").alias("_first"), F.max("last_change").alias("_last"))
    around = carry(per_block, KEYS, "block", [Carry("_before", "max", "_last"), Carry("_after", "min", "_first", "after")])
    series = pieces.groupBy(*KEYS).agg(
        F.sum("n_known").alias("s_known"), F.sum(F.col("last") - F.col("first") + 1).alias("s_rows"), F.min("first_change").alias("s_first")
    )
    w = Window.partitionBy(*KEYS, "block")
    upto = Window.unboundedPreceding
    start = F.coalesce(F.col("last_change"), F.max("last_change").over(w.orderBy("first").rowsBetween(upto, -1)), F.col("_before"))
    end = F.coalesce(F.min("first_change").over(w.orderBy(F.desc("first")).rowsBetween(upto, -1)), F.col("_after"), F.col("s_known") + 1)
    zero = F.coalesce(F.col("s_first"), F.col("s_known") + 1) - 1 + F.col("s_rows") - F.col("s_known")
    length = F.when((F.col("kind") == UNKNOWN) | start.isNull(), zero).otherwise(end - start)
    found = pieces.join(around, [*KEYS, "block"]).join(series, KEYS).withColumn("_len", length)
    return found.where((F.col("kind") != OTHER) & (F.col("_len") > cfg.min_run)).select(*KEYS, "first", "last")


def flag_runs(stretches: DataFrame, constants: DataFrame, cfg: FlatSignalConfig, block_rows: int) -> DataFrame:
    """The runs of the flag, cut into blocks: ``series_id, block, first, last, flat, run_first, run_len``.

    The flag is the stretches delayed by ``delay_rows`` and widened by a centred maximum; it is
    null (``flat`` too) where either reaches over an end of the series.  Those rows and the ones before
    the first change are one run, which has two parts.  A row's place in its run is ``pos - run_first``.
    Together the intervals hold every row of every series once.
    """
    wide_lo, wide_hi = centred_frame(cfg.widen_rows)
    low = F.lit(cfg.delay_rows - wide_lo).cast("long")
    high = F.col("n_rows") - 1 - wide_hi
    ends = constants.select(*KEYS, "n_rows")
    wide = intervals.dilate(
        stretches.join(ends, KEYS), wide_hi - cfg.delay_rows, cfg.delay_rows - wide_lo, low, high
    )
    flagged = stage(intervals.union(wide, KEYS, block_rows), "flag-intervals")
    firsts = flagged.groupBy(*KEYS).agg(
        F.min("first").alias("_first"), F.min_by("last", "first").alias("_end"), F.max("last").alias("_final")
    )
    # the first change: the first interval begins or, where it begins with the flag itself, ends
    begins = F.when(F.col("_first") > low, F.col("_first")).otherwise(F.col("_end") + 1)
    change = F.least(F.coalesce(begins, high + 1), high + 1)
    short = low > high
    series = ends.join(firsts, KEYS, "left").withColumns({"_change": F.when(short, F.col("n_rows")).otherwise(change), "_short": short})
    series = series.withColumn("_zero", F.when(F.col("_short"), F.col("n_rows")).otherwise(F.col("_change") + wide_hi))
    series = stage(series, "flag-series")

    def run(first: Column, last: Column, flat: Column, run_first: Column, run_len: Column) -> Column:
        named = {"first": first, "last": last, "flat": flat, "run_first": run_first, "run_len": run_len}
        return F.struct(*[c.cast("int" if n == "flat" else "long").alias(n) for n, c in named.items()])

    def part(first: Column, last: Column, flat: int) -> Column:
        zero = first == low
        return run(first, last, F.lit(flat), F.when(zero, 0).otherwise(first), F.when(zero, F.col("_zero")).otherwise(last - first + 1))

    # an interval and the gap before it
    gap = F.coalesce(F.col("prev_last") + 1, low)
    inner = flagged.join(series.select(*KEYS, "_zero"), KEYS).select(
        *KEYS, F.inline(F.array(part(F.col("first"), F.col("last"), 1), part(gap, F.col("first") - 1, 0)))
    )
    none = F.lit(None)
    n, changed, zero = F.col("n_rows"), F.col("_change"), F.col("_zero")
    outer = series.select(
        *KEYS,
        F.inline(
            F.when(F.col("_short"), F.array(run(F.lit(0), n - 1, none, F.lit(0), n))).otherwise(
                F.array(
                    run(F.lit(0), low - 1, none, F.lit(0), zero),
                    part(F.coalesce(F.col("_final") + 1, low), high, 0),
                    # its places go on after the part before the first change
                    run(high + 1, n - 1, none, high + 1 - changed, zero),
                )
            )
        ),
    )
    return stage(intervals.in_blocks(inner.unionByName(outer).where("first <= last"), block_rows), "flag-runs")


def run_progress(df: DataFrame, grid: GridConfig) -> DataFrame:
    """Signed position in the run in half days, and run length in days."""
    at, half_day = F.col("run_pos"), grid.steps_per_day / 2
    flag = F.coalesce("flat", F.lit(0))
    return df.withColumns(
        {
            "fe__check_c": flag.cast("double"),
            "porc_step": F.when(flag == 1, at / half_day).when(flag == 0, -at / half_day).otherwise(F.lit(0.0)),
            "group_len_c_norm": F.col("run_len") / float(grid.steps_per_day),
        }
    )


def detected_runs(
    df: DataFrame, constants: DataFrame, grid: GridConfig, cfg: FlatSignalConfig = FlatSignalConfig()
) -> DataFrame:
    """:func:`flag_runs` of full-resolution rows.  The rows are shuffled twice: to the quantile and to the pieces."""
    floors = stage(noise_floors(df, cfg, grid.block_rows), "noise-floor")
    return flag_runs(flat_stretches(floors, cfg, grid.block_rows), constants, cfg, grid.block_rows)


def flat_rows(
    df: DataFrame, constants: DataFrame, grid: GridConfig, cfg: FlatSignalConfig = FlatSignalConfig()
) -> DataFrame:
    """``series_id, pos, flat`` from full-resolution rows."""
    return intervals.to_rows(detected_runs(df, constants, grid, cfg)).select("series_id", "pos", "flat")


def run_rows(runs: DataFrame, grid: GridConfig) -> DataFrame:
    """``series_id, pos, fe__check_c, porc_step, group_len_c_norm`` of every row of the runs."""
    rows = intervals.to_rows(runs).withColumn("run_pos", F.col("pos") - F.col("run_first"))
    return run_progress(rows, grid).select("series_id", "pos", "fe__check_c", "porc_step", "group_len_c_norm")


def flat_signal_features(
    df: DataFrame, constants: DataFrame, grid: GridConfig, cfg: FlatSignalConfig = FlatSignalConfig()
) -> DataFrame:
    """``series_id, pos, fe__check_c, porc_step, group_len_c_norm`` per full-resolution row."""
    return run_rows(detected_runs(df, constants, grid, cfg), grid)


def run_buckets(runs: DataFrame, constants: DataFrame, grid: GridConfig) -> DataFrame:
    """The features per bucket, ``series_id, step``, straight from the runs of series without gaps.

    In a bucket the progress of a run is an arithmetic series, so its mean needs the ends only."""
    k, half_day = grid.downsample, grid.steps_per_day / 2
    last_pos = F.col("n_rows") - 1
    based = join_constants(runs, constants, {"min_step": F.col("min_step")}, KEYS, F.col("first"), F.lit(0).cast("long"), last_pos, grid.block_rows)
    low, high = F.col("first") + F.col("min_step"), F.col("last") + F.col("min_step")
    rows = based.withColumn("step", F.explode(F.sequence(floor_div(low, k), floor_div(high, k))))
    first = F.greatest(F.col("first"), F.col("step") * k - F.col("min_step"))
    last = F.least(F.col("last"), (F.col("step") + 1) * k - 1 - F.col("min_step"))
    rows = rows.withColumns({"_first": first, "_last": last})
    n = F.col("_last") - F.col("_first") + 1
    flag = F.coalesce("flat", F.lit(0))
    places = n * (F.col("_first") + F.col("_last") - 2 * F.col("run_first")) / 2
    return rows.groupBy("series_id", "step").agg(
        F.max(flag.cast("double")).alias("fe__check_c"),
        (F.sum(F.when(flag == 1, places).otherwise(-places)) / F.sum(n) / half_day).alias("porc_step"),
        (F.sum(n * F.col("run_len")) / F.sum(n) / float(grid.steps_per_day)).alias("group_len_c_norm"),
    )
