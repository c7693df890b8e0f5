"""How often labels fall on each half minute of the day, without the own fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalar import half_minute, local_time
from tidegrid.sources.tables import assign_fold, drop_unlabelled

# fixed values: each label counts at its own half minute and at the one before
OFFSET_SECONDS = (0, -30)
EVENTS = ("onset", "wakeup")


def label_frequency(
    labels: DataFrame, folds: DataFrame, n_folds: int = 5, offsets: Sequence[int] = OFFSET_SECONDS
) -> DataFrame:
    """``fold, event, hminute, weight``: label counts over all folds but ``fold``.

    Labels are counted once per own fold, which leaves at most folds x events x half
    minutes rows; only those are spread over the held-out folds.
    """
    t = F.timestamp_add("SECOND", F.col("offset"), local_time())
    counted = (
        assign_fold(drop_unlabelled(labels), folds)
        .withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets])))
        .withColumn("_t", t)
        .groupBy("event", "fold", half_minute(F.hour("_t"), F.minute("_t"), F.second("_t")).alias("hminute"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    held_out = F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda f: f != F.col("fold"))
    return (
        counted.withColumn("held_out", F.explode(held_out))
        .groupBy(F.col("held_out").alias("fold"), "event", "hminute")
        .agg(F.sum("n").cast("double").alias("weight"))
    )


def target_encoding(frequency: DataFrame) -> DataFrame:
    """Wide form, each event scaled by its largest weight over all folds."""
    wide = (
        frequency.groupBy("hminute", "fold").pivot("event", list(EVENTS)).agg(F.sum("weight")).fillna(0, list(EVENTS))
    )
    top = wide.agg(*[F.max(e).alias(e) for e in EVENTS])
    scaled = [
        F.try_divide(F.col(e), top.select(e).scalar()).cast("float").alias(f"hmin_{e}") for e in EVENTS
    ]
    return wide.select("hminute", "fold", *scaled)


def join_encoding(df: DataFrame, encoding: DataFrame) -> DataFrame:
    """Encoding of the row's own fold, by half minute."""
    return df.join(encoding, ["hminute", "fold"], "left")


def mean_encoding(encoding: DataFrame) -> DataFrame:
    return encoding.groupBy("hminute").agg(
        F.avg("hmin_onset").alias("hmin_onset"), F.avg("hmin_wakeup").alias("hmin_wakeup")
    )


def join_mean_encoding(df: DataFrame, encoding: DataFrame) -> DataFrame:
    """Encoding averaged over folds, for series that belong to none."""
    return df.join(mean_encoding(encoding), "hminute", "left")
