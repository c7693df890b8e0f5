"""Parameters of the time grid and of the detectors.

The defaults are fixed values of the data model (5 s steps, 30 s buckets, days
that start at 17:00).  Tests use a coarser grid through the same dataclasses.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class GridConfig:
    step_seconds: int = 5
    steps_per_hour: int = 720
    steps_per_day: int = 17280
    downsample: int = 6
    init_hour: int = 17
    # True promises one row per step between the first and last step of each
    # series, which saves a shuffle; a series that breaks it raises an error.
    dense_steps: bool = False
    # rows of one series handled by one window group, full resolution / buckets
    block_rows: int = 69120
    bucket_block_rows: int = 46080

    @property
    def night_rows(self) -> int:
        """Buckets per night, which is also the chunk length."""
        return self.steps_per_day // self.downsample


@dataclass(frozen=True)
class FlatSignalConfig:
    """Sizes (in rows) of the device-off detector."""

    std_rows: int = 21
    quantile_rows: int = 180
    quantile: float = 0.1
    ahead_rows: int = 180
    floor: float = 0.1
    min_run: int = 360
    delay_rows: int = 120
    widen_rows: int = 241
    noise_run: int = 360  # repeat noise counts from runs longer than this

    @property
    def quantile_frame(self) -> tuple[int, int]:
        lo, hi = centred_frame(self.quantile_rows)
        return lo + self.ahead_rows, hi + self.ahead_rows

    @property
    def quantile_index(self) -> int:
        """0-based index of the wanted value in the sorted frame."""
        return int(self.quantile_rows * self.quantile + 1e-9)


@dataclass(frozen=True)
class PeakConfig:
    smooth_rows: tuple[int, int] = (7, 7)
    gap_rows: int = 11
    quantile: float = 0.87
    block_rows: int = 46080


# fixed values: peak settings for validation while training
TRAIN_PEAKS = PeakConfig(smooth_rows=(5, 5), quantile=0.85)

# fixed values: matching tolerances in steps, for each event
TOLERANCES = {
    "onset": [12, 36, 60, 90, 120, 150, 180, 240, 300, 360],
    "wakeup": [12, 36, 60, 90, 120, 150, 180, 240, 300, 360],
}


def centred_frame(rows: int) -> tuple[int, int]:
    """Row offsets of a centred window; an even size looks one row further back."""
    return -(rows // 2), (rows - 1) // 2
