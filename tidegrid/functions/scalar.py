"""Scalar column functions on the time grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.config import GridConfig


def floor_div(a: Column | str, b: int) -> Column:
    """Floor division for integers; Spark's ``div`` truncates towards zero."""
    col = F.col(a) if isinstance(a, str) else a
    return F.floor(col / F.lit(b)).cast("long")


def local_time(ts: Column | str = "timestamp") -> Column:
    """Wall-clock time of an ISO string: the zone offset is dropped, not applied."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.substring(col, 1, 19).cast("timestamp_ntz")


def local_seconds(ts: Column | str = "timestamp") -> Column:
    """Wall-clock seconds since 1970-01-01 of an ISO string, as a number that
    aggregates without sorting."""
    col = F.col(ts) if isinstance(ts, str) else ts

    def part(start: int) -> Column:
        return F.substring(col, start, 2).cast("int")

    days = F.unix_date(F.substring(col, 1, 10).cast("date")).cast("long")
    return days * 86400 + part(12) * 3600 + part(15) * 60 + part(18)


def iso_local(seconds: Column) -> Column:
    """Back from :func:`local_seconds` to ``yyyy-MM-ddTHH:mm:ss``."""
    day = F.floor(seconds / 86400)
    rest = seconds - day * 86400
    clock = F.format_string("T%02d:%02d:%02d", F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60)
    return F.concat(F.date_from_unix_date(day.cast("int")).cast("string"), clock)


def with_time_parts(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    t = local_time(ts)
    return df.withColumns(
        {
            "minute": F.minute(t),
            "second": F.second(t),
            "hour": F.hour(t),
            "day": F.dayofmonth(t),
            "year": F.year(t),
            "weekday": F.weekday(t) + 1,
        }
    )


def half_minute(hour: Column, minute: Column, second: Column) -> Column:
    """Half-minute slot of the day, 0..2879."""
    return hour * 120 + minute * 2 + F.when(second >= 30, 1).otherwise(0)


def is_anchor(grid: GridConfig, ts: str = "timestamp") -> Column:
    """Local time within the minute ``init_hour:00``, read off the text."""
    return F.substring(ts, 12, 5) == f"{grid.init_hour:02d}:00"


def night_of(step: Column, step_first: Column, grid: GridConfig) -> Column:
    return floor_div(step - step_first, grid.steps_per_day)


def time_of_night(step: Column, step_first: Column, grid: GridConfig) -> Column:
    """Steps since the day anchor.  Rows before the first anchor count as the day
    before it, with one day added whatever their distance."""
    rel = step - step_first
    night = floor_div(rel, grid.steps_per_day)
    return F.when(rel >= 0, rel - night * grid.steps_per_day).otherwise(rel + grid.steps_per_day)


def with_night_grid(df: DataFrame, grid: GridConfig) -> DataFrame:
    """Add ``rel_step, night, st_hour, st_step`` from ``step`` and ``step_first``."""
    step, first = F.col("step"), F.col("step_first")
    since = time_of_night(step, first, grid)
    hour = floor_div(since, grid.steps_per_hour)
    return df.withColumns(
        {
            "rel_step": step - first,
            "night": night_of(step, first, grid),
            "st_hour": hour,
            "st_step": since - hour * grid.steps_per_hour,
        }
    )


def prediction_night(step: Column, step_first: Column, grid: GridConfig) -> Column:
    return night_of(step, step_first, grid) + 1


def fill_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null and NaN to 0 on numeric columns."""
    return df.fillna(0, subset=columns)
