"""Raw predictions: ensemble, long and wide form, smoothing and peaks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.config import GridConfig, PeakConfig, centred_frame
from tidegrid.functions.rolling import rolling_mean
from tidegrid.functions.scalar import floor_div, prediction_night
from tidegrid.operators.blocks import Carry, carry, explode_blocks, join_constants, over_blocks, spread, with_positions
from tidegrid.operators.order_stats import quantiles, running_totals, sliding_max
from tidegrid.operators.series_index import index_rows
from tidegrid.staging import stage

EVENTS = ["onset", "wakeup"]
KEYS = ["series_id", "event"]


def ensemble_scores(
    df: DataFrame, n_models: int, keys: Sequence[str] = ("series_id", "step"), threshold: float = 0.1
) -> DataFrame:
    """Mean over models plus the sum of the scores above ``threshold``."""

    def combined(e: str):
        p = F.col(e)
        return (F.sum(p / n_models) + F.sum(F.when(p > threshold, p).otherwise(0.0))).alias(e)

    return df.groupBy(*keys).agg(*[combined(e) for e in EVENTS])


def scores_long(df: DataFrame, id_columns: Sequence[str]) -> DataFrame:
    return df.unpivot(list(id_columns), EVENTS, "event", "score")


def scores_wide(df: DataFrame, id_columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*id_columns).pivot("event", EVENTS).agg(F.first("score"))


def raw_predictions(df: DataFrame, grid: GridConfig) -> DataFrame:
    """Bucket scores as ``series_id, step, event, score, sf, hour, minute, num_night``
    with steps at full resolution; further columns (such as ``noise``) are kept."""
    k = grid.downsample
    wide = df.withColumns({"step": F.col("step") * k, "sf": (F.col("step_first") * k).cast("long")}).drop("step_first")
    wide = wide.withColumn("num_night", prediction_night(F.col("step"), F.col("sf"), grid))
    return scores_long(wide, [c for c in wide.columns if c not in EVENTS])


def smooth(df: DataFrame, keys: Sequence[str], col: str, out: str, cfg: PeakConfig) -> DataFrame:
    """Two centred moving means in a row; rows without a full window become 0."""
    before, after = _reach(cfg)
    return over_blocks(df, keys, cfg.block_rows, before, after, lambda d, w: _smoothed(d, w, col, out, cfg))


def _reach(cfg: PeakConfig) -> tuple[int, int]:
    frames = [centred_frame(n) for n in cfg.smooth_rows]
    return -sum(lo for lo, _ in frames), sum(hi for _, hi in frames)


def _smoothed(d: DataFrame, w, col: str, out: str, cfg: PeakConfig) -> DataFrame:
    (lo1, hi1), (lo2, hi2) = (centred_frame(n) for n in cfg.smooth_rows)
    d = d.withColumn("_once", F.coalesce(rolling_mean(col, w, lo1, hi1), F.lit(0.0)))
    return d.withColumn(out, F.coalesce(rolling_mean("_once", w, lo2, hi2), F.lit(0.0))).drop("_once")


def _near(rows: np.ndarray, gap: int) -> np.ndarray:
    """Rows within ``gap`` of a marked one."""
    edge = np.zeros(len(rows) + 2 * gap + 1, np.int64)
    at = np.flatnonzero(rows)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + 2 * gap + 1, -1)
    return np.cumsum(edge)[gap : gap + len(rows)] > 0


def settle(
    prob: np.ndarray, gap: int, kept: np.ndarray, core: np.ndarray, there: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Greedy suppression as far as it is certain: rows kept, and rows still open.

    ``kept`` rows are kept already; only ``core`` rows are decided, the others are their
    neighbours.  In rounds, each open row that beats all open rows within ``gap`` (ties: the earlier
    row) is kept and closes those: whatever could still suppress it is worse.  Places not ``there``
    have no row and suppress nothing.
    """
    value = np.where(kept | _near(kept, gap), -np.inf, np.nan_to_num(prob, nan=-np.finfo(float).max, posinf=np.inf, neginf=-np.inf))
    if there is not None:
        value[~there] = -np.inf
    new = np.zeros(len(prob), bool)
    side = np.full(gap, -np.inf)
    while True:
        if gap:
            best = sliding_max(np.concatenate([side, value, side]), gap)
            left, right = best[: len(value)], best[gap + 1 :]
        else:
            left = right = np.full(len(value), -np.inf)
        now = core & (value > left) & (value >= right)
        if not now.any():
            return new, core & (value > -np.inf)
        new |= now
        value[_near(now, gap)] = -np.inf


def greedy_peaks(prob: np.ndarray, gap: int) -> np.ndarray:
    """Indices kept by greedy suppression: best first, ties to the earlier row, each kept
    row removing all within ``gap`` rows."""
    return np.flatnonzero(settle(prob, gap, np.zeros(len(prob), bool), np.ones(len(prob), bool))[0])


# rows that Python gets at once: a call costs the same for ten rows as for some thousands
PARCEL_ROWS = 8192


def _apart(places: np.ndarray, group: np.ndarray, gap: int) -> np.ndarray:
    """Places of sorted groups in one array, more than ``gap`` from group to group, so that groups don't meet."""
    fresh = np.concatenate([[True], group[1:] != group[:-1]])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(group)), 0))
    own = places - places[first]
    length = np.concatenate([[0], np.cumsum(np.where(np.concatenate([fresh[1:], [True]]), own + gap + 1, 0))[:-1]])
    return own + length


def _parcel(place: Column) -> Column:
    return floor_div(place, PARCEL_ROWS).alias("_parcel")


def _settled_in_blocks(rows: DataFrame, keys: list[str], prob: str, gap: int, block_rows: int) -> DataFrame:
    """Kept rows of stretches that are too long for one task.

    Blocks decide what they can from their own rows and those within ``gap`` of them.  What depends
    on a neighbour's decision waits for the next round, in which the blocks lie half a block
    further, and which sees the open rows and the last round's peaks only.  Small blocks are taken several
    at a time, for fewer rounds; those of neighbouring stretches share a call.
    """
    columns = rows.columns
    numbered = with_positions(rows, keys, ["pos"], floor_div("pos", block_rows), "_i")
    state = stage(numbered.withColumn("_kept", F.lit(False)), "open-rows")
    names = state.columns
    block_rows = max(block_rows, 4 * gap + 4, min(8 * block_rows, PARCEL_ROWS))
    found, turn = [], 0
    while not state.where("not _kept").isEmpty():
        shift = turn % 2 * (block_rows // 2)
        moved = state.withColumn("_i", F.col("_i") + shift)
        copies = explode_blocks(moved, block_rows, gap, gap, "_i")
        # stretches don't overlap, so a parcel holds its own places and at most one block more
        copies = copies.withColumn("_parcel", _parcel(F.col("_from") + F.col("block") * block_rows))

        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["_from", "block", "_i"], ignore_index=True)
            group = pdf.groupby(["_from", "block"]).ngroup().to_numpy()
            at = _apart(pdf["_i"].to_numpy(), group, gap)
            value, (kept, core, there) = np.zeros(at[-1] + 1), np.zeros((3, at[-1] + 1), bool)
            value[at], kept[at], there[at] = pdf[prob].to_numpy(float), pdf["_kept"].to_numpy(bool), True
            core[at] = (pdf["_i"] // block_rows == pdf["block"]).to_numpy()
            new, still = settle(value, gap, kept, core & ~kept, there)
            out = pdf[new[at] | still[at]]
            return out.assign(_kept=new[at][new[at] | still[at]], _i=out["_i"] - shift)[names]

        parcels = spread(copies, *KEYS, "_parcel").groupBy(*KEYS, "_parcel")
        state = stage(parcels.applyInPandas(kernel, state.schema), "open-rows")
        found.append(state.where("_kept").select(*columns))
        turn += 1
    return reduce(DataFrame.unionByName, found) if found else rows


def nms_peaks(
    df: DataFrame, cfg: PeakConfig, prob: str = "rolling_prob", smooth_from: str | None = None
) -> DataFrame:
    """Greedy non-maximum suppression per ``(series_id, event)``; ``df`` has ``pos``.

    With ``smooth_from`` the probability is first smoothed from that column, in the same
    pass over the blocks.

    A row that is the best of its own ``gap`` neighbourhood is certainly kept and its
    neighbours are certainly dropped, so nothing passes across it.  The first such row
    of each block is a cut: the stretches between cuts are suppressed independently,
    many of them in a call, and the result equals that of the whole series.

    Only a long plateau of equal values has no such row.  Inside it the kept rows repeat
    every ``gap + 1`` rows, so whole periods are taken out before and get the fate of
    their counterpart in the second period afterwards.  A monotone stretch has none either:
    stretches over more than two blocks are settled block by block.
    """
    gap, rows, period = cfg.gap_rows, cfg.block_rows, cfg.gap_rows + 1
    reach_back, reach_ahead = _reach(cfg) if smooth_from else (0, 0)
    columns = df.columns if prob in df.columns else [*df.columns, prob]
    columns = [c for c in columns if c != smooth_from]

    def build(d: DataFrame, w) -> DataFrame:
        if smooth_from:
            d = _smoothed(d, w, smooth_from, prob, cfg)
        p = F.col(prob)
        left = F.max(prob).over(w.rowsBetween(-gap, -1))
        right = F.max(prob).over(w.rowsBetween(1, gap))
        best = F.coalesce(left < p, F.lit(True)) & F.coalesce(right <= p, F.lit(True))
        # plateau of equal values inside the block proper
        fresh = F.coalesce(F.lag(prob).over(w) != p, F.lit(True)) | (F.col("pos") % rows == 0)
        d = d.withColumn("_best", best).withColumn("_fresh", F.when(fresh, F.col("pos")))
        d = d.withColumn("_start", F.max("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        core = F.when(F.col("pos") < (F.col("block") + 1) * rows, F.col("pos"))
        last = F.max(core).over(Window.partitionBy(*KEYS, "block", "_start"))
        at = F.col("pos") - F.col("_start")
        periods = F.floor((last - F.col("_start") + 1 - 3 * period) / period)
        inner = (at >= 2 * period) & (at < (2 + periods) * period)
        return d.withColumn("_twin", F.when(inner, F.col("_start") + period + at % period)).drop("_fresh", "_start")

    marked = over_blocks(df, KEYS, rows, gap + reach_back, gap + reach_ahead, build, keep_block=True)
    marked = stage(marked.select(*columns, "block", "_best", "_twin"), "peak-marks")
    cuts = stage(marked.groupBy(*KEYS, "block").agg(F.min(F.when(F.col("_best"), F.col("pos"))).alias("_cut")), "cuts")
    sides = [Carry("_prev", "max", "_cut"), Carry("_next", "min", "_cut", "after")]
    around = carry(cuts, KEYS, "block", sides, staged=True).join(cuts, [*KEYS, "block"])
    after_cut = F.coalesce(F.col("pos") >= F.col("_cut"), F.lit(False))
    cut_rows = marked.where("_twin is null").join(around, [*KEYS, "block"]).withColumns(
        {
            "_from": F.when(after_cut, F.col("_cut")).otherwise(F.coalesce("_prev", F.lit(-1))),
            "_upto": F.when(after_cut, F.col("_next")).otherwise(F.coalesce("_cut", "_next")),
        }
    )
    # rows just before the next cut are dropped by it
    open_rows = cut_rows.where(F.col("_upto").isNull() | (F.col("pos") < F.col("_upto") - gap))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        at = _apart(np.arange(len(pdf)), pdf["_from"].to_numpy(), gap)
        value, (kept, there) = np.zeros(at[-1] + 1), np.zeros((2, at[-1] + 1), bool)
        value[at], there[at] = pdf[prob].to_numpy(float), True
        return pdf.loc[settle(value, gap, kept, there, there)[0][at], columns]

    # a stretch is as long as from its cut to the next one, or to the end of the series
    ends = stage(marked.groupBy(*KEYS).agg(F.max("pos").alias("_end")), "series-ends")
    open_rows = join_constants(open_rows, ends, {"_end": F.col("_end")}, KEYS, F.col("pos"), F.lit(0).cast("long"), F.col("_end"), rows)
    length = F.coalesce("_upto", F.col("_end") + 1) - F.greatest(F.col("_from"), F.lit(0))
    open_rows = stage(open_rows.select(*columns, "_from", (length > 2 * rows).alias("_long")), "stretches")
    short_rows = open_rows.where("not _long").select(*columns, "_from", _parcel(F.col("_from")))
    kept = spread(short_rows, *KEYS, "_parcel").groupBy(*KEYS, "_parcel").applyInPandas(kernel, marked.select(*columns).schema)
    long_rows = open_rows.where("_long").select(*columns, "_from")
    if not long_rows.isEmpty():
        kept = kept.unionByName(_settled_in_blocks(long_rows, [*KEYS, "_from"], prob, gap, rows).select(*columns))
    kept = stage(kept, "kept-rows")
    fate = kept.select(*KEYS, F.col("pos").alias("_twin"))
    copies = marked.where("_twin is not null").join(fate, [*KEYS, "_twin"], "left_semi")
    return kept.unionByName(copies.select(*columns))


def with_rank(peaks: DataFrame, cfg: PeakConfig, prob: str = "rolling_prob") -> DataFrame:
    """0-based ``rank`` per ``(series_id, event)`` by falling probability, ties by row."""
    peaks = stage(peaks, "unranked-peaks")
    counts = stage(peaks.groupBy(*KEYS, prob).agg(F.count(F.lit(1)).alias("_m")), "peak-levels")
    above = running_totals(counts, KEYS, prob, ["_m"]).select(
        *KEYS, prob, (F.col("c__m") - F.col("_m")).alias("_above")
    )
    tied = with_positions(peaks, [*KEYS, prob], ["pos"], floor_div("pos", cfg.block_rows), "_tie")
    return (
        tied.join(above, [*KEYS, prob])
        .withColumn("rank", (F.col("_above") + F.col("_tie")).cast("long"))
        .drop("_above", "_tie")
    )


def above_quantile(peaks: DataFrame, q: float, prob: str = "rolling_prob") -> DataFrame:
    """Peaks strictly above the ``q`` quantile of all peaks of their series and event."""
    limits = quantiles(peaks, KEYS, prob, [q]).select(*KEYS, F.col("q")[0].alias("_limit"))
    return peaks.join(limits, KEYS).where(F.col(prob) > F.col("_limit")).drop("_limit")


def pick_peaks(raw: DataFrame, grid: GridConfig, cfg: PeakConfig = PeakConfig(), ranked: bool = False) -> DataFrame:
    """From long raw predictions to detections: ``series_id, step, time, event, score``.

    ``raw`` has ``series_id, step, event, score`` with one row per bucket and event.
    Steps move back by half a step; ``time`` is in minutes.
    """
    wide = scores_wide(raw, ["series_id", "step"])
    indexed = index_rows(wide, grid, stride=grid.downsample, block_rows=cfg.block_rows)
    long = indexed.select("series_id", "step", "pos", *EVENTS).unpivot(
        ["series_id", "step", "pos"], EVENTS, "event", "score"
    )
    peaks = nms_peaks(long, cfg, smooth_from="score")
    if ranked:
        peaks = stage(with_rank(peaks, cfg), "ranked-peaks")
    kept = above_quantile(peaks, cfg.quantile)
    step = F.col("step") - 0.5
    return kept.select(
        "series_id",
        step.alias("step"),
        (step / (60 / grid.step_seconds)).alias("time"),
        "event",
        F.col("rolling_prob").alias("score"),
        *(["rank"] if ranked else []),
    )


def submission(detections: DataFrame) -> DataFrame:
    """All detections in order of series, step and event with a running ``row_id``.

    The rows are range-sorted and written; the id is the row's place in its sorted part
    plus the sizes of the parts before it, a table with one row per part.  Written parts
    are read back in any order, so the result is put in order of the id: collected or
    written, the rows come as ``row_id`` counts.
    """
    ordered = detections.select("series_id", F.col("step").cast("double").alias("step"), "event", "score").orderBy(
        "series_id", "step", "event"
    )
    mono = F.monotonically_increasing_id()
    part = F.shiftright(mono, 33)
    ordered = ordered.withColumns({"_part": part, "_local": mono - F.shiftleft(part, 33)})
    ordered = stage(ordered, "submission")
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(0))
    shift = carry(sizes, ["_all"], "_part", [Carry("_shift", "sum", "_n")]).select("_part", "_shift")
    return (
        ordered.join(F.broadcast(shift), "_part")
        .withColumn("row_id", (F.col("_shift") + F.col("_local")).cast("long"))
        .select("row_id", "series_id", "step", "event", "score")
        .orderBy("row_id")
    )
