"""Frames of any length, scoring in batches, and keys that do not grow with a series."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.test_io_and_plans import plan
from tidegrid.config import GridConfig
from tidegrid.functions.rolling import pairwise_frames
from tidegrid.operators import features, model
from tidegrid.operators.order_stats import sliding_rank_value


@pytest.mark.parametrize("n,rows", [(0, 3), (2, 3), (1, 1), (7, 7), (200, 1), (500, 6), (3000, 180)])
@pytest.mark.parametrize("values", ["many", "ties", "gaps"])
def test_sliding_rank_against_sorted_frames(n, rows, values):
    rng = np.random.default_rng(n + rows)
    x = rng.normal(size=n) if values == "many" else rng.integers(-2, 3, n).astype(float)
    if values == "gaps":
        x[rng.random(n) < 0.01] = np.nan
    for index in {0, rows // 10, rows - 1}:
        want = [np.nan if np.isnan(f).any() else np.sort(f)[index] for f in (x[i : i + rows] for i in range(n - rows + 1))]
        assert np.array_equal(sliding_rank_value(x, rows, index), np.array(want, float), equal_nan=True)


def test_frames_by_doubling_against_loops(spark):
    rng = np.random.default_rng(5)
    values = [None if rng.random() < 0.03 else int(rng.integers(0, 50)) for _ in range(150)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, pos long, v long")
    w = Window.partitionBy("k").orderBy("pos")
    sizes = (1, 2, 3, 6, 13, 32)
    df = pairwise_frames(df, w, lambda a, b: a + b, {f"sum{n}": ("v", n) for n in sizes})
    df = pairwise_frames(df, w, F.greatest, {f"top{n}": ("v", n) for n in sizes} | {"twice": ("sum3", 5)})

    def plain(x, n, fold):
        frames = [x[i - n + 1 : i + 1] if i >= n - 1 else [None] for i in range(len(x))]
        return [None if None in f else fold(f) for f in frames]

    rows = sorted(df.collect(), key=lambda r: r.pos)
    assert df.columns == ["k", "pos", "v", *[f"sum{n}" for n in sizes], *[f"top{n}" for n in sizes], "twice"]
    for n in sizes:
        assert [r[f"sum{n}"] for r in rows] == plain(values, n, sum)
        assert [r[f"top{n}"] for r in rows] == plain(values, n, max)
    assert [r.twice for r in rows] == plain(plain(values, 3, sum), 5, max)


def test_bursts_take_no_aggregate_over_a_frame(spark):
    rows = spark.range(500).select(F.lit("s").alias("series_id"), F.col("id").alias("pos"), (F.col("id") * 7 % 31).alias("anglez"))
    text = plan(features.activity_burst(rows, GridConfig()))
    frames = [line for line in text.splitlines() if "windowspecdefinition" in line]
    assert frames and not any(f"{fn}(" in line for line in frames for fn in ("sum", "max", "count"))
    assert text.split("(1)")[0].count("Exchange") == 1 and text.split("(1)")[0].count("Sort") == 1


def test_profile_of_a_series_without_anchor_meets_its_mean_in_parts(spark):
    def of(sid, n, hour):
        return spark.range(n).select(
            F.lit(sid).alias("series_id"), F.col("id").alias("step"), hour.cast("long").alias("st_hour"),
            F.lit(0).cast("long").alias("st_step"), F.col("id").cast("double").alias("v"),
        )

    df = of("none", 5000, F.lit(None)).unionByName(of("some", 240, F.col("id") % 24))
    out = features.time_of_day_profile(df, "v", part_steps=100)
    assert out.columns == [*df.columns, "mean_v"] and out.count() == 5240
    got = {(r.series_id, r.st_hour): r.m for r in out.groupBy("series_id", "st_hour").agg(F.avg("mean_v").alias("m")).collect()}
    assert got["none", None] == 2499.5 and got["some", 3] == 111.0 and len(got) == 25
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        moves = [m for m in plan(features.time_of_day_profile(df, "v", part_steps=100)).splitlines() if "hashpartitioning" in m]
        assert sum("_part" in m for m in moves) == 2 and len(moves) == 3  # the third sums up partial means
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scoring_calls_once_a_batch_and_returns_no_features(spark):
    n, length = 40, 3
    x = np.random.default_rng(2).normal(size=(n, length, 2))
    rows = [(f"s{i}", i, x[i].tolist(), [1, 1, 0]) for i in range(n)]
    df = spark.createDataFrame(rows, "series_id string, chunk long, features array<array<double>>, mask array<int>").coalesce(1)

    def fn(features, mask):
        assert features.shape[1:] == (length, 2) and mask.shape == features.shape[:2]
        return np.stack([features.sum(axis=2), np.full(mask.shape, float(len(features)))], axis=2)

    out = model.score_chunks(df, fn)
    assert out.columns == ["series_id", "chunk", "mask", "scores"]
    for r in out.collect():
        assert np.allclose([s[0] for s in r.scores], x[r.chunk].sum(axis=1))
        assert r.scores[0][1] == n
    assert model.score_chunks(df, fn, keep=["chunk"]).columns == ["chunk", "scores"]
    assert model.score_chunks(df.limit(0), fn).count() == 0
    ragged = df.withColumn("features", F.slice("features", 1, F.when(F.col("chunk") == 3, 2).otherwise(3)))
    with pytest.raises(Exception, match="one length"):
        model.score_chunks(ragged, fn).count()
