"""Column helpers for rolling windows that need every row of their frame."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def full_frame(agg: Column, x: Column | str, w: WindowSpec, lo: int, hi: int) -> Column:
    """``agg`` over rows ``lo..hi``, null unless all of them exist and are non-null."""
    frame = w.rowsBetween(lo, hi)
    return F.when(F.count(_col(x)).over(frame) == hi - lo + 1, agg.over(frame))


def rolling_mean(x: Column | str, w: WindowSpec, lo: int, hi: int) -> Column:
    return full_frame(F.avg(_col(x)), x, w, lo, hi)


def rolling_std(x: Column | str, w: WindowSpec, lo: int, hi: int) -> Column:
    return full_frame(F.stddev_samp(_col(x)), x, w, lo, hi)


def pairwise_frames(
    df: DataFrame, w: WindowSpec, fold: Callable[[Column, Column], Column], frames: Mapping[str, tuple[str, int]]
) -> DataFrame:
    """Add ``out: fold over the last n rows of col`` for every ``out: (col, n)``; null unless all n are there.

    Frames of 1, 2, 4, ... rows come from two of half the size; a frame of any length is put together
    from them.  So a row costs a few lags for each doubling instead of one step for each row of the
    frame, and nothing is subtracted again.  ``fold`` gets non-null values.
    """

    def both(a: Column, b: Column) -> Column:
        return F.when(a.isNotNull() & b.isNotNull(), fold(a, b))

    base = list(df.columns)
    longest: dict[str, int] = {}
    for col, n in frames.values():
        longest[col] = max(n, longest.get(col, 1))
    half = 1
    while any(2 * half <= n for n in longest.values()):
        own = {col: col if half == 1 else f"_{col}_{half}" for col in longest}
        twice = {
            f"_{col}_{2 * half}": both(F.col(own[col]), F.lag(own[col], half).over(w))
            for col, n in longest.items()
            if 2 * half <= n
        }
        df = df.withColumns(twice)
        half *= 2
    whole: dict[str, Column] = {}
    for out, (col, n) in frames.items():
        value, back = None, 0
        for power in (1 << i for i in range(n.bit_length() - 1, -1, -1)):
            if n & power:
                part = F.col(col if power == 1 else f"_{col}_{power}")
                part = F.lag(part, back).over(w) if back else part
                value, back = part if value is None else both(value, part), back + power
        whole[out] = value
    return df.withColumns(whole).select(*[c for c in base if c not in frames], *frames)


def rolling_rank_value(x: Column | str, w: WindowSpec, lo: int, hi: int, index: int) -> Column:
    """Value at 0-based ``index`` of the sorted frame; for short frames only, since
    the frame is sorted anew for each row (see ``operators.order_stats`` for long ones)."""
    values = F.sort_array(F.collect_list(_col(x)).over(w.rowsBetween(lo, hi)))
    return F.when(F.size(values) == hi - lo + 1, F.element_at(values, index + 1))


def rolling_median(x: Column | str, w: WindowSpec, lo: int, hi: int) -> Column:
    """Middle value of an odd-sized frame."""
    return rolling_rank_value(x, w, lo, hi, (hi - lo) // 2)


def clip(x: Column, low: float, high: float) -> Column:
    """Clip that keeps nulls (``greatest``/``least`` would replace them)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def nan_to_null(x: Column | str) -> Column:
    col = _col(x)
    return F.when(~F.isnan(col), col)
