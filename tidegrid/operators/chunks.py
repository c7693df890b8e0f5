"""Nightly chunks of equal length, in long form (one row per slot) and as arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.config import GridConfig
from tidegrid.functions.scalar import floor_div

# fixed values: weight of a label at row offsets around it, by sharpness, and the peak
SOFT_KERNELS = {
    0: {0: 2.5, 1: 1.0},
    1: {-2: 0.5, -1: 1.7, 0: 2.5, 1: 1.0, 2: 1.7, 3: 0.5},
    2: {-1: 2.5, 0: 2.5, 1: 1.0, 2: 2.5},
}
SOFT_PEAK = 2.5


def pad_rows(length: int) -> Column:
    """Rows to put before a series so that its first night starts at the anchor; none
    if it starts there, or if the anchor is more than one night away."""
    first = F.coalesce("step_first", F.lit(0))
    return F.when((first > 0) & (first <= length), length - first).otherwise(0).cast("long")


def pad_first_night(df: DataFrame, length: int) -> DataFrame:
    """Put empty rows with steps ``step_first - length .. -1`` before each series; add
    ``pad`` (rows put in front) and ``is_pad``.

    ``df`` has ``pos``.  The row at position 0 unfolds into the padding and itself, so
    nothing is shuffled or read twice.
    """
    df = df.withColumn("pad", pad_rows(length))
    here = F.lit(0).cast("long")
    unfolded = F.when(F.col("pos") == 0, F.sequence(-F.col("pad"), here)).otherwise(F.array(here))
    rows = df.withColumn("_shift", F.explode(unfolded))
    is_pad = F.col("_shift") < 0
    kept = {"series_id", "pad", "step", "_shift"}
    blank = {c: F.when(~is_pad, F.col(c)) for c in df.columns if c not in kept}
    step = F.when(is_pad, F.col("_shift")).otherwise(F.col("step"))
    return rows.withColumns({**blank, "step": step, "is_pad": is_pad.cast("int")}).drop("_shift")


def night_chunks(df: DataFrame, grid: GridConfig) -> DataFrame:
    """Add ``chunk``, ``slot`` and ``mask``; ``df`` has ``pos`` and ``step_first``.

    The place of a row is plain arithmetic, so nothing moves.  Padding has mask 0.
    """
    length = grid.night_rows
    padded = pad_first_night(df, length)
    place = F.when(F.col("is_pad") == 1, F.col("step") + F.col("pad")).otherwise(F.col("pos") + F.col("pad"))
    chunk = floor_div(place, length)
    return padded.withColumns({"chunk": chunk, "slot": place - chunk * length, "mask": 1 - F.col("is_pad")}).drop(
        "pad", "is_pad"
    )


def labelled_only(chunks: DataFrame) -> DataFrame:
    """Chunks that hold at least one label."""
    hit = F.coalesce("onset", F.lit(0)) + F.coalesce("wakeup", F.lit(0)) > 0
    hits = F.max(hit).over(Window.partitionBy("series_id", "chunk"))
    return chunks.withColumn("_hit", hits).where("_hit").drop("_hit")


def with_reversed(chunks: DataFrame, length: int) -> DataFrame:
    """Add each chunk once more with time running backwards (``invert`` = 1): slots
    mirrored, onset and wakeup swapped.  ``step`` stays that of the source row."""
    backwards = F.col("invert") == 1
    return chunks.withColumn("invert", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns(
        {
            "slot": F.when(backwards, length - 1 - F.col("slot")).otherwise(F.col("slot")),
            "onset": F.when(backwards, F.col("wakeup")).otherwise(F.col("onset")),
            "wakeup": F.when(backwards, F.col("onset")).otherwise(F.col("wakeup")),
        }
    )


def soft_targets(chunks: DataFrame, sharpness: int = 1) -> DataFrame:
    """Replace 0/1 labels by the kernel spread around them inside the chunk.

    Overlaps add up; a sum of exactly 1 counts as the peak; then all is scaled by the
    peak.  A window group is one chunk; its slots have no holes, so offsets are rows.
    """
    keys = [c for c in ("series_id", "chunk", "invert") if c in chunks.columns]
    w = Window.partitionBy(*keys).orderBy("slot")

    def level(c: str) -> Column:
        total = F.lit(0.0)
        for by, weight in SOFT_KERNELS[sharpness].items():
            source = F.lag(c, by).over(w) if by >= 0 else F.lead(c, -by).over(w)
            total = total + F.coalesce(source, F.lit(0)) * weight
        return F.when(total == 1, SOFT_PEAK).otherwise(total) / SOFT_PEAK

    return chunks.withColumns({"onset": level("onset"), "wakeup": level("wakeup")})


def chunk_arrays(chunks: DataFrame, features: Sequence[str], length: int) -> DataFrame:
    """One row per chunk: ``features [length][n]``, ``target [length][2]``, ``mask`` and
    ``time`` ``[length]``, zero where no row exists.

    A group has at most ``length`` rows and its slots have no holes, so zeros go only
    before the first and after the last slot.  ``time`` is never reversed.
    """
    keys = [c for c in ("series_id", "chunk", "invert") if c in chunks.columns]

    def zero_filled(cols: Sequence[str]) -> Column:
        return F.array(*[F.coalesce(F.nanvl(F.col(c).cast("float"), F.lit(0.0)), F.lit(0.0)).cast("float") for c in cols])

    slot = F.struct(
        F.col("slot").alias("slot"),
        zero_filled(features).alias("x"),
        zero_filled(["onset", "wakeup"]).alias("y"),
        F.col("mask").cast("int").alias("m"),
        F.col("step").cast("long").alias("t"),
    )
    packed = chunks.groupBy(*keys).agg(F.sort_array(F.collect_list(slot)).alias("rows"))
    head = F.col("rows")[0]["slot"].cast("int")
    tail = (F.lit(length - 1) - F.element_at("rows", -1)["slot"]).cast("int")

    def dense(field: str, zero: Column) -> Column:
        body = F.transform("rows", lambda r: r[field])
        return F.concat(F.array_repeat(zero, head), body, F.array_repeat(zero, tail))

    def zeros(n: int) -> Column:
        return F.array_repeat(F.lit(0.0).cast("float"), n)

    time = dense("t", F.lit(0).cast("long"))
    if "invert" in keys:
        time = F.when(F.col("invert") == 1, F.reverse(time)).otherwise(time)
    return packed.select(
        *keys,
        dense("x", zeros(len(features))).alias("features"),
        dense("y", zeros(2)).alias("target"),
        dense("m", F.lit(0)).alias("mask"),
        time.alias("time"),
    )


def flatten_chunks(chunks: DataFrame, columns: Sequence[str] = ("features",)) -> DataFrame:
    """Back to one row per slot, valid slots only; ``slot`` and ``step`` from the arrays."""
    keys = [c for c in ("series_id", "chunk", "invert") if c in chunks.columns]
    zipped = F.arrays_zip("mask", "time", *columns)
    rows = chunks.select(*keys, F.posexplode(zipped).alias("slot", "_r")).where(F.col("_r.mask") == 1)
    return rows.select(
        *keys, "slot", F.col("_r.time").alias("step"), *[F.col(f"_r.{c}").alias(c) for c in columns]
    )
