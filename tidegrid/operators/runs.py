"""Runs of equal values (gaps and islands) on series of any length.

Rows whose difference to the previous row is unknown (first row, null value, null
predecessor) all belong to run 0 together with the rows before the first change.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.blocks import Carry, block_window, carry, explode_blocks, is_core
from tidegrid.staging import stage


def with_changes(df: DataFrame, keys: Sequence[str], col: str, eps: float, block_rows: int) -> DataFrame:
    """Add ``block``, ``known`` (difference defined, 0/1) and ``change`` (0/1)."""
    keys = list(keys)
    w = block_window(keys)
    out = explode_blocks(df, block_rows, before=1)
    out = out.withColumn("_diff", F.abs(F.col(col) - F.lag(col).over(w))).where(is_core(block_rows))
    return out.withColumns(
        {
            "known": F.col("_diff").isNotNull().cast("long"),
            "change": F.when(F.col("_diff") > eps, 1).otherwise(0).cast("long"),
        }
    ).drop("_diff")


def with_runs(df: DataFrame, keys: Sequence[str], col: str, eps: float, block_rows: int) -> DataFrame:
    """Add ``run`` (id), ``run_len`` and ``run_pos`` (0-based) for ``col``.

    ``df`` has ``keys`` and ``pos`` and is read twice, so stage it if it is dear.  Inside
    a block the answers follow from running counts; a block table carries the counts and
    the nearest change on either side.
    """
    keys = list(keys)
    rows = with_changes(df, keys, col, eps, block_rows)
    # ordinal of a known row among the known rows of its series, counted in the block
    up = block_window(keys).rowsBetween(Window.unboundedPreceding, 0)
    down = (
        Window.partitionBy(*keys, "block").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = rows.withColumns({"_k": F.sum("known").over(up), "_c": F.sum("change").over(up)})
    at_change = F.when(F.col("change") == 1, F.col("_k"))

    # known rows and changes before each block, then the ordinal of changes around it
    per_block = rows.groupBy(*keys, "block").agg(
        F.sum("known").alias("n_known"),
        F.sum("change").alias("n_change"),
        F.count(F.lit(1)).alias("n_rows_b"),
        F.min(at_change).alias("first_change"),
        F.max(at_change).alias("last_change"),
    )
    per_block = stage(per_block, "run-blocks")
    totals = [Carry("b_known", "sum", "n_known"), Carry("b_change", "sum", "n_change")]
    base = carry(per_block, keys, "block", totals, staged=True)
    shifted = per_block.join(base, [*keys, "block"]).withColumns(
        {
            "first_change": F.col("first_change") + F.col("b_known"),
            "last_change": F.col("last_change") + F.col("b_known"),
        }
    )
    shifted = stage(shifted, "run-blocks")
    nearest = [Carry("prev_change", "max", "last_change"), Carry("next_change", "min", "first_change", "after")]
    around = carry(shifted, keys, "block", nearest, staged=True)
    series = shifted.groupBy(*keys).agg(
        F.sum("n_rows_b").alias("s_rows"),
        F.sum("n_known").alias("s_known"),
        F.min("first_change").alias("s_first"),
    )
    own = shifted.select(*keys, "block", "b_known", "b_change")
    carried = own.join(around, [*keys, "block"]).join(series, keys)

    out = rows.join(carried, [*keys, "block"])
    known, k = F.col("known") == 1, F.col("_k") + F.col("b_known")
    change_at = F.when(F.col("change") == 1, k)
    out = out.withColumns(
        {
            "_run": F.when(known, F.col("_c") + F.col("b_change")).otherwise(F.lit(0)).cast("long"),
            "_ord": k,
            "_start": F.coalesce(F.max(change_at).over(up), "prev_change"),
            "_next": F.coalesce(F.min(change_at).over(down), "next_change"),
        }
    )
    # run 0: rows before the first change plus every later row of unknown difference
    first = F.coalesce(F.col("s_first"), F.col("s_known") + 1)
    unknown_before = F.col("pos") + 1 - F.col("_ord") - F.when(known, 0).otherwise(1)
    zero_pos = F.least(F.col("_ord"), first - 1) + unknown_before - F.when(known, 1).otherwise(0)
    zero_len = first - 1 + F.col("s_rows") - F.col("s_known")
    end = F.coalesce(F.col("_next"), F.col("s_known") + 1)
    in_zero = F.col("_run") == 0
    out = out.withColumns(
        {
            "run": F.col("_run"),
            "run_len": F.when(in_zero, zero_len).otherwise(end - F.col("_start")).cast("long"),
            "run_pos": F.when(in_zero, zero_pos).otherwise(F.col("_ord") - F.col("_start")).cast("long"),
        }
    )
    return out.select(*df.columns, "run", "run_len", "run_pos")
