"""Small hand-made cases for the rules that are easy to get wrong."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogue import fixtures
from tidegrid.config import GridConfig, centred_frame
from tidegrid.functions import rolling, scalar
from tidegrid.operators import chunks, encoding, features, labels, predictions, series_index
from tidegrid.operators.blocks import over_blocks
from tidegrid.operators.repeats import drop_noisy_nights, drop_trailing_noise
from tidegrid.sources import tables


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_floor_division_of_negative_steps(spark):
    df = spark.createDataFrame([(-5, 3), (5, 3), (-6, 3)], "a long, b long")
    assert [r[0] for r in df.select(scalar.floor_div("a", 3)).collect()] == [-2, 1, -2]


def test_night_grid_before_the_first_anchor(spark):
    grid = GridConfig()
    df = spark.createDataFrame([(0, 100), (99, 100), (100, 100), (17480, 100)], "step long, step_first long")
    got = [tuple(r) for r in scalar.with_night_grid(df, grid).select("rel_step", "night", "st_hour", "st_step").collect()]
    assert got == [(-100, -1, 23, 620), (-1, -1, 23, 719), (0, 0, 0, 0), (17380, 1, 0, 100)]


def test_clip_keeps_null_and_zero_maximum_gives_null(spark):
    df = spark.createDataFrame([(None,), (0.0,), (5.0,), (0.5,)], "x double")
    got = [r[0] for r in df.select(rolling.clip(F.col("x"), 0.1, 1.0)).collect()]
    assert got == [None, 0.1, 1.0, 0.5]
    zero = df.select(F.try_divide(F.col("x"), F.lit(0.0))).collect()
    assert all(r[0] is None for r in zero)


def test_even_frame_looks_back_one_row_more():
    assert centred_frame(180) == (-90, 89)
    assert centred_frame(21) == (-10, 10)


def test_rolling_needs_every_row(spark):
    df = spark.createDataFrame([("s", i, None if i == 4 else float(i)) for i in range(9)], "series_id string, pos long, x double")
    got = over_blocks(
        df, ["series_id"], 4, 1, 1, lambda d, w: d.withColumn("m", rolling.rolling_mean("x", w, -1, 1))
    )
    assert [r.m for r in got.orderBy("pos").collect()] == [None, 1.0, 2.0, None, None, None, 6.0, 7.0, None]


def test_local_time_drops_the_zone_and_weeks_start_on_monday(spark):
    df = spark.createDataFrame([("2018-08-14T15:30:45-0400",), ("2018-08-19T00:00:30+0200",)], "timestamp string")
    out = scalar.with_time_parts(df)
    got = rows(out, "hour", "minute", "second", "day", "year", "weekday")
    assert got == [(0, 0, 30, 19, 2018, 7), (15, 30, 45, 14, 2018, 2)]
    back = df.select(scalar.iso_local(scalar.local_seconds())).collect()
    assert sorted(r[0] for r in back) == ["2018-08-14T15:30:45", "2018-08-19T00:00:30"]
    slot = out.select(scalar.half_minute(F.col("hour"), F.col("minute"), F.col("second"))).collect()
    assert sorted(r[0] for r in slot) == [1, 15 * 120 + 61]


@pytest.mark.parametrize(
    "sharpness,want",
    [(0, {0: 1, 1: 1}), (1, {-2: 0.2, -1: 0.68, 0: 1, 1: 1, 2: 0.68, 3: 0.2}), (2, {-1: 1, 0: 1, 1: 1, 2: 1})],
)
@pytest.mark.parametrize("at", [0, 8, 15])
def test_soft_target_of_one_label(spark, sharpness, want, at):
    data = [("s", 0, i, int(i == at), 0) for i in range(16)]
    df = spark.createDataFrame(data, "series_id string, chunk long, slot long, onset int, wakeup int")
    got = {r.slot: r.onset for r in chunks.soft_targets(df, sharpness).collect()}
    assert got == {i: pytest.approx(want.get(i - at, 0)) for i in range(16)}


def test_soft_targets_add_up(spark):
    data = [("s", 0, i, int(i in (4, 9)), 0) for i in range(16)]
    df = spark.createDataFrame(data, "series_id string, chunk long, slot long, onset int, wakeup int")
    got = {r.slot: r.onset for r in chunks.soft_targets(df, 1).collect()}
    x = np.zeros(16)
    x[[4, 9]] = 1
    y = np.convolve(x, [0.5, 1.7, 2.5, 1, 1.7, 0.5], mode="same")
    y[y == 1] = 2.5
    assert [got[i] for i in range(16)] == pytest.approx(list(y / 2.5))


def chunk_input(spark, n, first):
    data = [("s", i, i, first, float(i), int(i == 3), int(i == 7)) for i in range(n)]
    return spark.createDataFrame(data, "series_id string, step long, pos long, step_first long, x double, onset int, wakeup int")


@pytest.mark.parametrize("n,first", [(25, 4), (25, 0), (25, None), (25, 10), (25, 13), (3, 4), (20, 0)])
def test_chunk_arrays(spark, n, first):
    grid = GridConfig(steps_per_day=60, downsample=6)  # ten rows per night
    long = chunks.night_chunks(chunk_input(spark, n, first), grid)
    arrays = chunks.chunk_arrays(chunks.with_reversed(long, 10), ["x"], 10).collect()
    pad = 10 - first if first and first <= 10 else 0
    steps = list(range((first or 0) - 10, 0))[:pad] + list(range(n))
    total = -(-len(steps) // 10)
    assert len(arrays) == 2 * total
    for a in arrays:
        part = steps[a.chunk * 10 : a.chunk * 10 + 10]
        fill = [0] * (10 - len(part))
        mask = [int(s >= 0) for s in part] + fill
        x = [float(max(s, 0)) for s in part] + fill
        onset, wakeup = ([float(s == k) for s in part] + fill for k in (3, 7))
        if a.invert:
            mask, x, onset, wakeup = mask[::-1], x[::-1], wakeup[::-1], onset[::-1]
        assert a.time == part + fill
        assert a["mask"] == mask
        assert [v[0] for v in a.features] == x
        assert [v[0] for v in a.target] == onset and [v[1] for v in a.target] == wakeup
    flat = chunks.flatten_chunks(chunks.chunk_arrays(long, ["x"], 10))
    assert sorted(r.step for r in flat.collect()) == list(range(n))


def test_reversing_twice_is_the_identity(spark):
    grid = GridConfig(steps_per_day=60, downsample=6)
    long = chunks.night_chunks(chunk_input(spark, 25, 4), grid).fillna(0)
    once = chunks.with_reversed(long, 10).where("invert = 1").drop("invert")
    twice = chunks.with_reversed(once, 10).where("invert = 1")
    cols = ["series_id", "chunk", "slot", "step", "x", "onset", "wakeup", "mask"]
    assert rows(twice, *cols) == rows(long, *cols)


def test_two_labels_in_one_bucket_do_not_repeat_rows(spark):
    lab = spark.createDataFrame(
        [("s", 1, "onset", 6), ("s", 1, "onset", 7), ("s", 1, "wakeup", None)],
        "series_id string, night long, event string, step long",
    )
    df = spark.createDataFrame([("s", 0), ("s", 1)], "series_id string, step long")
    assert rows(labels.label_targets(df, lab, GridConfig()), "step", "onset", "wakeup") == [(0, 0, 0), (1, 1, 0)]


def test_folds(spark):
    folds = spark.createDataFrame([("a", 0), ("b", 1)], "series_id string, fold int")
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "series_id string")
    assert rows(tables.assign_fold(df, folds)) == [("a", 0), ("b", 1), ("c", 0)]
    assert rows(labels.in_fold(df, folds, 1)) == [("b",)]
    assert rows(labels.out_of_fold(df, folds, 1)) == [("a",), ("c",)]
    assert rows(labels.in_fold(df, folds, -1)) == [("a",)] and labels.out_of_fold(df, folds, -1).count() == 3


def test_encoding_leaves_the_own_fold_out(spark):
    lab = spark.createDataFrame(
        [("a", 1, "onset", 5, "2020-01-01T00:00:10-0400"), ("b", 1, "onset", 5, "2020-01-01T00:00:10-0400"),
         ("b", 1, "wakeup", 5, "2020-01-01T00:00:40-0400"), ("b", 2, "wakeup", None, None)],
        "series_id string, night long, event string, step long, timestamp string",
    )
    folds = spark.createDataFrame([("a", 0), ("b", 1)], "series_id string, fold int")
    freq = encoding.label_frequency(lab, folds, n_folds=3)
    assert rows(freq, "fold", "event", "hminute", "weight") == [
        (0, "onset", 0, 1.0), (0, "onset", 2879, 1.0), (0, "wakeup", 0, 1.0), (0, "wakeup", 1, 1.0),
        (1, "onset", 0, 1.0), (1, "onset", 2879, 1.0),
        (2, "onset", 0, 2.0), (2, "onset", 2879, 2.0), (2, "wakeup", 0, 1.0), (2, "wakeup", 1, 1.0),
    ]
    table = {(r.fold, r.hminute): (r.hmin_onset, r.hmin_wakeup) for r in encoding.target_encoding(freq).collect()}
    assert table[0, 0] == (0.5, 1.0) and table[0, 1] == (0.0, 1.0) and table[2, 2879] == (1.0, 0.0)


def test_trailing_noise_and_noisy_nights(spark):
    data = [("a", i, i // 4, z) for i, z in enumerate([1, 1, 0, 0, 0, 1, 1, 1])] + [("b", 0, None, 1)]
    df = spark.createDataFrame(data, "series_id string, pos long, night long, noise int")
    assert [r[0] for r in drop_trailing_noise(df).orderBy("pos").select("pos").collect()] == [0, 1, 2, 3, 4]
    noisy = df.withColumn("noise_removal", F.col("noise"))
    assert rows(drop_noisy_nights(noisy, 4), "series_id", "pos") == [("a", i) for i in range(4)] + [("b", 0)]


def test_robust_scale_with_zero_spread(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", None), ("b", 3.0), ("b", 3.0)], "series_id string, x double"
    )
    got = rows(features.robust_scale(df, ["x"]))
    assert got == sorted([("a", -1 / 1.5), ("a", 0.0), ("a", 2 / 1.5), ("a", None), ("b", 0.0), ("b", 0.0)], key=repr)


def test_hook_columns_are_sorted_and_scaled(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(5)], "series_id string, x double")
    out, added = features.apply_hook(df, lambda d: d.withColumns({"z": F.col("x") * 2, "b": F.col("x") + 1}))
    assert added == ["b", "z"]
    assert rows(out, "x", "b", "z") == [(float(i), (i - 2) / 2, (i - 2) / 2) for i in range(5)]
    assert features.select_features(out, ["x"], added).columns == ["x", "b", "z"]


def test_ensemble_adds_confident_scores(spark):
    df = spark.createDataFrame([("s", 1, 0.4, 0.1), ("s", 1, 0.05, 0.2)], "series_id string, step long, onset double, wakeup double")
    (r,) = predictions.ensemble_scores(df, 2).collect()
    assert (r.onset, r.wakeup) == (pytest.approx(0.225 + 0.4), pytest.approx(0.15 + 0.2))


def test_submission_comes_in_order_of_its_ids(spark):
    # parts of very different size, which a scan would take largest first
    series = F.when(F.col("id") < 20_000, F.col("id") % 7).otherwise(F.col("id") % 400)
    df = spark.range(40_000).select(
        F.format_string("s%03d", series).alias("series_id"),
        (F.col("id") * 7919 % 40_000).cast("double").alias("step"),
        F.when(F.col("id") % 2 == 0, "onset").otherwise("wakeup").alias("event"),
        F.rand(1).alias("score"),
    )
    # small parts would be merged into one
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")
    try:
        out = predictions.submission(df)
        parts = out.select(F.spark_partition_id().alias("p")).distinct().count()
        got = out.collect()
    finally:
        spark.conf.unset(merging)
    assert parts > 1
    assert [r.row_id for r in got] == list(range(40_000))
    keys = [(r.series_id, r.step, r.event) for r in got]
    assert keys == sorted(keys)


def test_submission_ids_are_global(spark):
    data = [(f"s{i % 7}", float(i * 37 % 101), "onset", 0.5) for i in range(300)]
    df = spark.createDataFrame(data, "series_id string, step double, event string, score double").repartition(8)
    got = predictions.submission(df).orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(300))
    assert [(r.series_id, r.step) for r in got] == sorted((d[0], d[1]) for d in data)


def test_series_without_anchor(spark):
    df = spark.createDataFrame(
        [("s", i, f"2020-01-01T0{i}:00:00-0400", 1.0, 0.1) for i in range(3)], tables.SERIES
    )
    const = series_index.series_constants(tables.with_absolute_angle(df), GridConfig()).first()
    assert const.step_first is None and const.anglez_sd == 0
    scaled = series_index.zscore(
        tables.with_absolute_angle(df), series_index.series_constants(tables.with_absolute_angle(df), GridConfig())
    )
    assert all(r.anglez is None for r in scaled.collect())


def test_text_before_1970_keeps_its_clock(spark):
    df = spark.createDataFrame([("1969-12-31T23:59:58+0100",), ("1960-02-29T00:00:01Z",)], "timestamp string")
    got = [r[0] for r in df.select(scalar.iso_local(scalar.local_seconds())).collect()]
    assert got == ["1969-12-31T23:59:58", "1960-02-29T00:00:01"]


def test_text_after_2038_keeps_its_clock(spark):
    """More seconds since 1970 than an integer holds."""
    df = spark.createDataFrame([("2038-01-20T23:59:58-0400",), ("2126-02-28T00:00:01Z",)], "timestamp string")
    got = [r[0] for r in df.select(scalar.iso_local(scalar.local_seconds())).collect()]
    assert got == ["2038-01-20T23:59:58", "2126-02-28T00:00:01"]


def test_stamp_of_a_series_of_millions_of_rows(spark):
    """Step times 900 seconds is more than an integer holds."""
    df = spark.createDataFrame([(0,), (31,), (3_600_000,)], "step long")
    got = sorted(r[0] for r in df.select(fixtures.stamp("step")).collect())
    assert got == ["2024-01-01T09:00:00-0400", "2024-01-01T16:45:00-0400", "2126-09-03T09:00:00-0400"]
