"""Order statistics: long rolling frames and exact quantiles of large groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.rolling import nan_to_null
from tidegrid.operators.blocks import Carry, carry, explode_blocks, spread
from tidegrid.staging import stage


def sliding_rank_value(x: np.ndarray, rows: int, index: int) -> np.ndarray:
    """For each full frame ``x[i:i+rows]`` its value at sorted position ``index``
    (NaN if the frame holds a NaN); one result per frame start.

    All frames descend together through the bits of the ranks, highest first.  At each bit, running counts
    say how many ranks of a frame have a 0 there; that decides the bit of the rank sought, and
    a stable split by the bit keeps every frame contiguous.  The work per row
    is a few operations for each bit of the block's length, whatever the frame's.
    """
    n = len(x)
    if n < rows:
        return np.empty(0)
    order = np.argsort(x, kind="stable")
    rank = np.empty(n, np.int32)
    rank[order] = np.arange(n, dtype=np.int32)
    first = np.arange(n - rows + 1, dtype=np.int32)
    last = first + np.int32(rows)
    left = np.full(len(first), index, np.int32)  # how many smaller ones of the frame are still to be passed
    found = np.zeros(len(first), np.int32)
    for bit in range(max(n - 1, 1).bit_length() - 1, -1, -1):
        high = (rank >> bit & 1).astype(bool)
        low_before = np.zeros(n + 1, np.int32)
        np.cumsum(~high, out=low_before[1:])
        a, b = low_before[first], low_before[last]
        up = left >= b - a
        left -= np.where(up, b - a, 0)
        found |= up.astype(np.int32) << bit
        lows = low_before[-1]
        first, last = np.where(up, lows + first - a, a), np.where(up, lows + last - b, b)
        rank = np.concatenate([rank[~high], rank[high]])
    out = np.asarray(x, float)[order[found]]
    bad = np.concatenate([[0], np.cumsum(np.isnan(x))])
    out[bad[rows:] - bad[:-rows] > 0] = np.nan
    return out


def sliding_std(x: np.ndarray, rows: int, slab: int = 65536) -> np.ndarray:
    """Sample deviation of each full frame ``x[i:i+rows]``, one result per frame start."""
    if len(x) < rows:
        return np.empty(0)
    frames = np.lib.stride_tricks.sliding_window_view(x, rows)
    return np.concatenate([frames[a : a + slab].std(axis=1, ddof=1) for a in range(0, len(frames), slab)])


def sliding_max(x: np.ndarray, rows: int) -> np.ndarray:
    """Largest value of each full frame ``x[i:i+rows]``, one result per frame start.

    A frame is the end of one piece of ``rows`` values and the beginning of the next, so its
    maximum comes from running maxima of pieces, from either side: constant work per row.
    """
    n = len(x)
    if n < rows:
        return np.empty(0)
    pieces = np.concatenate([x, np.full(-n % rows, -np.inf)]).reshape(-1, rows)
    upto = np.maximum.accumulate(pieces, axis=1).ravel()
    onward = np.maximum.accumulate(pieces[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.maximum(onward[: n - rows + 1], upto[rows - 1 : n])


def at_offset(values: np.ndarray, n: int, lo: int) -> np.ndarray:
    """Place per-frame-start results on rows: the frame of row i starts at ``i + lo``."""
    out = np.full(n, np.nan)
    first, last = max(0, -lo), min(n, len(values) - lo)
    if last > first:
        out[first:last] = values[first + lo : last + lo]
    return out


def rolling_rank(
    df: DataFrame, keys: Sequence[str], col: str, out: str, lo: int, hi: int, index: int, block_rows: int
) -> DataFrame:
    """``keys, pos, out``: value at sorted ``index`` of rows ``lo..hi`` around each row.

    Spark would sort every frame from scratch; here a block (bounded by
    ``block_rows`` plus the halo) is one Arrow batch, ranked once for all its frames.
    """
    keys = list(keys)
    rows = hi - lo + 1
    narrow = df.select(*keys, "pos", F.col(col).cast("double").alias("x"))
    blocks = explode_blocks(narrow, block_rows, max(0, -lo), max(0, hi))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        x = pdf["x"].to_numpy(float, na_value=np.nan)
        value = pd.Series(at_offset(sliding_rank_value(x, rows, index), len(x), lo), pdf.index)
        core = pdf["pos"] // block_rows == pdf["block"]
        return pdf.loc[core, [*keys, "pos"]].assign(**{out: value[core]})

    schema = T.StructType([narrow.schema[k] for k in [*keys, "pos"]] + [T.StructField(out, T.DoubleType())])
    result = spread(blocks, *keys, "block").groupBy(*keys, "block").applyInPandas(kernel, schema)
    return result.withColumn(out, nan_to_null(out))


def running_totals(
    df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], descending: bool = True
) -> DataFrame:
    """Inclusive running sums of ``values`` in the order of ``order``, one row per
    distinct ``order`` value, without gathering a key in one task.

    ``df`` has one row per ``(keys, order)``.  Rows are dealt into ranges of ``(keys, order)``, as
    many as there are shuffle partitions; each range is summed alone and takes over what
    the ranges of its key before it hold.
    """
    keys = list(keys)
    ranged = df.repartitionByRange(*keys, order).withColumn("bucket", F.spark_partition_id().cast("long"))
    parts = stage(ranged, "value-ranges")
    totals = parts.groupBy(*keys, "bucket").agg(*[F.sum(v).alias(v) for v in values])
    side = "after" if descending else "before"
    shift = carry(totals, keys, "bucket", [Carry(f"_s_{v}", "sum", v, side) for v in values])
    ordering = F.col(order).desc() if descending else F.col(order)
    w = Window.partitionBy(*keys, "bucket").orderBy(ordering).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(shift, [*keys, "bucket"])
    out = out.withColumns({f"c_{v}": F.sum(v).over(w) + F.col(f"_s_{v}") for v in values})
    return out.drop("bucket", *[f"_s_{v}" for v in values])


def quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group: ``keys, q`` (array as ``probs``).

    Rows are counted by value and ranked by running counts over value ranges, so no group
    is held in one buffer.
    """
    keys, probs = list(keys), list(probs)
    df = df.select(*keys, F.col(col).cast("double").alias(col)).where(F.col(col).isNotNull() & ~F.isnan(col))
    # one row per distinct value, so ties weigh nothing
    counted = stage(df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("m")), "value-counts")
    ranked = running_totals(counted, keys, col, ["m"], descending=False)
    ranked = ranked.join(counted.groupBy(*keys).agg(F.sum("m").alias("n")), keys)
    # the value at 0-based rank r is the first one whose running count exceeds r
    targets = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(s).alias("side"), f(F.lit(p) * (F.col("n") - 1)).alias("rank"))
            for i, p in enumerate(probs)
            for s, f in (("lo", F.floor), ("hi", F.ceil))
        ]
    )
    here = lambda t: (t["rank"] < F.col("c_m")) & (t["rank"] >= F.col("c_m") - F.col("m"))
    hits = ranked.select("*", F.explode(F.filter(targets, here)).alias("t"))
    ends = hits.groupBy(*keys, "n", F.col("t.i").alias("i")).agg(
        F.max(F.when(F.col("t.side") == "lo", F.col(col))).alias("lo"),
        F.max(F.when(F.col("t.side") == "hi", F.col(col))).alias("hi"),
    )
    h = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1) * (F.col("n") - 1)
    value = F.col("lo") + (h - F.floor(h)) * (F.col("hi") - F.col("lo"))
    pairs = ends.select(*keys, F.struct("i", value.alias("v")).alias("p"))
    ordered = F.sort_array(F.collect_list("p"))
    return pairs.groupBy(*keys).agg(F.transform(ordered, lambda p: p["v"]).alias("q"))
