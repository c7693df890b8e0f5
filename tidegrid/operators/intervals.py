"""Sets of rows as intervals of positions: ``keys, first, last``, both ends included.

A stretch of rows is one interval however long it is, so what happens to stretches (delay,
widening, union, runs) costs by their number, not by that of their rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.scalar import floor_div
from tidegrid.operators.blocks import Carry, carry, spread
from tidegrid.staging import stage


def dilate(intervals: DataFrame, before: int, after: int, low: Column, high: Column) -> DataFrame:
    """Every interval longer by ``before`` and ``after`` rows, cut to ``low..high``; what is empty goes."""
    first, last = F.greatest(F.col("first") - before, low), F.least(F.col("last") + after, high)
    return intervals.withColumns({"first": first, "last": last}).where("first <= last")


def union(intervals: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Disjoint intervals that neither overlap nor touch, with the end of the one before (``prev_last``).

    Intervals are swept in pieces of ``rows`` places of their starts; the farthest end and the last
    fresh start of earlier pieces are carried over.
    """
    keys = list(keys)
    table = stage(intervals.select(*keys, "first", "last", floor_div("first", rows).alias("_piece")), "intervals")
    part = Window.partitionBy(*keys, "_piece").orderBy("first", "last")
    ends = table.groupBy(*keys, "_piece").agg(F.max("last").alias("_end"))
    before = carry(ends, keys, "_piece", [Carry("_reach", "max", "_end")])
    own = F.max("last").over(part.rowsBetween(Window.unboundedPreceding, -1))
    swept = table.withColumn("_own", own).join(before, [*keys, "_piece"])
    swept = swept.withColumn("prev_last", F.greatest("_own", "_reach"))
    fresh = F.col("prev_last").isNull() | (F.col("first") > F.col("prev_last") + 1)
    swept = stage(swept.withColumn("_fresh", F.when(fresh, F.col("first"))).drop("_own", "_reach"), "intervals")
    starts = swept.groupBy(*keys, "_piece").agg(F.max("_fresh").alias("_start"))
    before = carry(starts, keys, "_piece", [Carry("_earlier", "max", "_start")])
    start = F.max("_fresh").over(part.rowsBetween(Window.unboundedPreceding, 0))
    named = swept.withColumn("_own", start).join(before, [*keys, "_piece"])
    named = named.withColumn("_group", F.coalesce("_own", "_earlier"))
    return named.groupBy(*keys, F.col("_group").alias("first")).agg(
        F.max("last").alias("last"), F.min(F.when(F.col("_fresh").isNotNull(), F.col("prev_last"))).alias("prev_last")
    )


def in_blocks(intervals: DataFrame, rows: int) -> DataFrame:
    """Intervals cut at the ends of blocks of ``rows`` places, ``block`` added, spread by series and block."""
    block = F.explode(F.sequence(floor_div("first", rows), floor_div("last", rows)))
    cut = intervals.withColumn("block", block)
    first, last = F.greatest("first", F.col("block") * rows), F.least("last", (F.col("block") + 1) * rows - 1)
    return spread(cut.withColumns({"first": first, "last": last}), "series_id", "block")


def to_rows(intervals: DataFrame) -> DataFrame:
    """One row per position; the intervals are cut into blocks before."""
    return intervals.withColumn("pos", F.explode(F.sequence("first", "last")))
