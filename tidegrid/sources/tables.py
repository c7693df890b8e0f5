"""Readers and writers with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SERIES = T.StructType(
    [
        T.StructField("series_id", T.StringType()),
        T.StructField("step", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("anglez", T.DoubleType()),
        T.StructField("enmo", T.DoubleType()),
    ]
)
LABELS = T.StructType(
    [
        T.StructField("series_id", T.StringType()),
        T.StructField("night", T.LongType()),
        T.StructField("event", T.StringType()),
        T.StructField("step", T.DoubleType()),
        T.StructField("timestamp", T.StringType()),
    ]
)
ENCODING = T.StructType(
    [
        T.StructField("hminute", T.IntegerType()),
        T.StructField("fold", T.IntegerType()),
        T.StructField("hmin_onset", T.FloatType()),
        T.StructField("hmin_wakeup", T.FloatType()),
    ]
)


def read_series(spark: SparkSession, path: str, ids: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Sensor series; ``ids`` is a short literal list (pushed to the parquet scan) or
    a table with a ``series_id`` column (semi join)."""
    found = spark.read.parquet(path)
    df = found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SERIES.fields])
    return only_series(df, ids)


def only_series(df: DataFrame, ids: Sequence[str] | DataFrame | None) -> DataFrame:
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select("series_id"), "series_id", "left_semi")
    return df.where(F.col("series_id").isin(list(ids)))


def with_absolute_angle(df: DataFrame) -> DataFrame:
    """Keep the signed angle as ``anglez_orig`` and make ``anglez`` absolute."""
    return df.withColumns(
        {
            "step": F.col("step").cast("long"),
            "anglez_orig": F.col("anglez").cast("double"),
            "anglez": F.abs(F.col("anglez").cast("double")),
        }
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labelled events from CSV; ``step`` may be empty and is a whole number otherwise."""
    df = spark.read.schema(LABELS).csv(path, header=True)
    return df.withColumn("step", F.when(~F.isnan("step"), F.col("step")).cast("long"))


def drop_unlabelled(labels: DataFrame) -> DataFrame:
    """Labels without a step (null or NaN) are nights nobody annotated."""
    step = F.col("step")
    return labels.where(step.isNotNull() & ~F.isnan(step.cast("double")))


def read_encoding(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENCODING).csv(path, header=True)


def distinct_series(df: DataFrame) -> DataFrame:
    return df.select("series_id").distinct()


def assign_fold(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Add ``fold`` from ``(series_id, fold)``; a series not listed is in fold 0."""
    folds = folds.select("series_id", F.col("fold").cast("int").alias("fold"))
    return df.join(folds, "series_id", "left").withColumn("fold", F.coalesce("fold", F.lit(0)))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_stage(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Save a per-row stage, split into folders by a hash of the series."""
    part = F.pmod(F.xxhash64("series_id"), F.lit(buckets)).cast("int")
    df.withColumn("series_bucket", part).write.mode("overwrite").partitionBy("series_bucket").parquet(path)


def read_stage(spark: SparkSession, path: str, ids: Sequence[str] | DataFrame | None = None) -> DataFrame:
    return only_series(spark.read.parquet(path), ids).drop("series_bucket")


def write_chunks(chunks: DataFrame, path: str, features: Sequence[str]) -> None:
    """Chunk arrays as parquet; the feature order travels in the column metadata."""
    meta = {"features": list(features)}
    chunks.withMetadata("features", meta).write.mode("overwrite").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    df = spark.read.parquet(path)
    return df, list(df.schema["features"].metadata["features"])
