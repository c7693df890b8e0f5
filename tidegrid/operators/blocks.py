"""Window work on series of any length.

A single series can hold a large share of all rows, so no window here is
partitioned by series alone.  Each series is cut into blocks of consecutive rows;
rows near an edge are copied into the neighbouring block (the halo), windows run
per ``(keys, block)`` and the copies are dropped again.  What has to cross blocks
(row positions, running totals, last or next change) goes through a table with
one row per block, see :func:`carry`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tidegrid.functions.scalar import floor_div
from tidegrid.staging import stage


@dataclass(frozen=True)
class Carry:
    """One value carried across blocks: ``fn`` of ``col`` over all blocks on ``side``."""

    out: str
    fn: str  # sum | max | min
    col: str
    side: str = "before"  # before | after


def carry(
    table: DataFrame,
    keys: Sequence[str],
    bucket: str,
    specs: Sequence[Carry],
    span: int = 4096,
    staged: bool = False,
) -> DataFrame:
    """Exclusive running aggregates over a block table, in two levels.

    ``table`` has one row per ``(keys, bucket)``.  Buckets are gathered in groups
    of ``span`` so that even a key with very many blocks is spread out.  Both levels
    read the table, so it is staged unless the caller has done that.
    """
    keys = list(keys)
    if not staged:
        table = stage(table, "block-table")
    agg = {"sum": F.sum, "max": F.max, "min": F.min}

    def windows(part: list[str], order: str) -> dict[str, WindowSpec]:
        w = Window.partitionBy(*part)
        return {
            "before": w.orderBy(F.col(order)).rowsBetween(Window.unboundedPreceding, -1),
            "after": w.orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1),
        }

    table = table.withColumn("_span", floor_div(bucket, span))
    inner_w = windows([*keys, "_span"], bucket)
    outer_w = windows(keys, "_span")
    totals = table.groupBy(*keys, "_span").agg(*[agg[s.fn](s.col).alias(f"_t_{s.out}") for s in specs])
    totals = totals.select(
        *keys, "_span", *[agg[s.fn](f"_t_{s.out}").over(outer_w[s.side]).alias(f"_o_{s.out}") for s in specs]
    )
    inner = table.select(
        *keys, "_span", bucket, *[agg[s.fn](s.col).over(inner_w[s.side]).alias(f"_i_{s.out}") for s in specs]
    )
    combine = {
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
        "max": F.greatest,
        "min": F.least,
    }
    return inner.join(totals, [*keys, "_span"]).select(
        *keys, bucket, *[combine[s.fn](F.col(f"_i_{s.out}"), F.col(f"_o_{s.out}")).alias(s.out) for s in specs]
    )


def with_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, out: str = "pos") -> DataFrame:
    """Add the 0-based row position per key.

    ``bucket`` is a coarse, monotone function of ``order``; rows are numbered inside
    each bucket and shifted by the number of rows in earlier buckets.
    """
    keys = list(keys)
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    shift = carry(counts, keys, "_bucket", [Carry("_shift", "sum", "_n")])
    local = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    return (
        df.join(shift, [*keys, "_bucket"])
        .withColumn(out, (F.col("_shift") + local).cast("long"))
        .drop("_bucket", "_shift")
    )


def explode_blocks(df: DataFrame, rows: int, before: int = 0, after: int = 0, pos: str = "pos") -> DataFrame:
    """Assign rows to blocks of ``rows`` positions, with halo copies in the neighbours."""
    if before == 0 and after == 0:
        return df.withColumn("block", floor_div(pos, rows))
    first = F.greatest(F.lit(0).cast("long"), floor_div(F.col(pos) - after, rows))
    last = floor_div(F.col(pos) + before, rows)
    return df.withColumn("block", F.explode(F.sequence(first, last)))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by ``keys`` for Python work.  The fixed number keeps adaptive execution
    from merging partitions that are small in bytes but long in computation."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


# wide rows that a task may get where it sorts them; some hundred MB
TASK_ROWS = 100_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Number of tasks for ``rows`` wide rows, so that a task's memory does not grow with the input."""
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(least, -(-rows // TASK_ROWS))


def fits_broadcast(table: DataFrame) -> bool:
    """Whether Catalyst's estimate of ``table`` is within the broadcast threshold."""
    limit = table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return 0 <= int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit


def join_constants(
    df: DataFrame,
    constants: DataFrame,
    values: dict[str, Column],
    keys: Sequence[str],
    at: Column,
    first: Column,
    last: Column,
    rows: int,
    how: str = "inner",
) -> DataFrame:
    """Add ``values``, columns of a table with one row per key, to the rows of the key.

    A table that is small enough to broadcast is joined by key.  A larger one is laid out with
    one row per key and block of ``rows`` places between ``first`` and ``last``, and meets the rows
    by key and block of ``at``, so a long series is never one task.  Every row's ``at`` must lie between
    ``first`` and ``last`` of its key.
    """
    keys = list(keys)
    named = [c.alias(n) for n, c in values.items()]
    if fits_broadcast(constants):
        return df.join(constants.select(*keys, *named), keys, how)
    blocks = F.sequence(floor_div(first, rows), floor_div(last, rows))
    laid_out = constants.select(*keys, *named, F.explode(blocks).alias("_at"))
    return df.withColumn("_at", floor_div(at, rows)).join(laid_out, [*keys, "_at"], how).drop("_at")


def is_core(rows: int, pos: str = "pos") -> Column:
    return floor_div(pos, rows) == F.col("block")


def block_window(keys: Sequence[str], pos: str = "pos") -> WindowSpec:
    return Window.partitionBy(*keys, "block").orderBy(pos)


def over_blocks(
    df: DataFrame,
    keys: Sequence[str],
    rows: int,
    before: int,
    after: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    pos: str = "pos",
    keep_block: bool = False,
) -> DataFrame:
    """Run ``build(df, window)`` per block with a halo wide enough for its frames."""
    out = build(explode_blocks(df, rows, before, after, pos), block_window(keys, pos))
    out = out.where(is_core(rows, pos))
    return out if keep_block else out.drop("block")
