"""Sources and sinks, whole builds, and the shape of the physical plans."""

import contextlib
import io
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalogue import queries
from catalogue.fixtures import FLAT, GRID, fixtures
from tidegrid.config import GridConfig
from tidegrid.operators import blocks, chunks, model
from tidegrid.operators.blocks import over_blocks
from tidegrid.operators.downsample import downsample_signals
from tidegrid.operators.features import TRAIN_FEATURES, time_of_day_profile
from tidegrid.plans import feature_table
from tidegrid.sources import tables

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_series_filter_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "series")
    fixtures(spark, SF).series.write.parquet(path)
    text = plan(tables.read_series(spark, path, ["s1", "s2"]).select("series_id", "enmo"))
    assert "In(series_id" in text.split("PushedFilters")[1]
    assert "anglez" not in text.split("ReadSchema")[1]


def test_labels_round_trip(spark, tmp_path):
    fx, path = fixtures(spark, SF), str(tmp_path / "labels")
    tables.write_csv(fx.labels, path)
    back = tables.read_labels(spark, path)
    assert back.schema["step"].dataType.simpleString() == "bigint"
    assert sorted(map(str, back.collect())) == sorted(map(str, fx.labels.select(back.columns).collect()))


def test_encoding_round_trip(spark, tmp_path):
    fx, path = fixtures(spark, SF), str(tmp_path / "encoding")
    table = entry.queries()["target_encoding"](spark, SF)
    tables.write_csv(table, path)
    back = tables.read_encoding(spark, path)
    assert back.count() == table.count() and back.schema == tables.ENCODING


def test_stage_round_trip(spark, tmp_path):
    fx, path = fixtures(spark, SF), str(tmp_path / "stage")
    tables.write_stage(fx.series, path, buckets=4)
    assert tables.read_stage(spark, path).count() == fx.series.count()
    assert tables.read_stage(spark, path, ["s3"]).select("series_id").distinct().count() == 1


def test_chunk_store_keeps_the_feature_order(spark, tmp_path):
    fx, path = fixtures(spark, SF), str(tmp_path / "chunks")
    long = chunks.night_chunks(fx.buckets.withColumns({"onset": F.lit(0), "wakeup": F.lit(0)}), GRID)
    arrays = chunks.chunk_arrays(long, ["enmo", "anglez"], GRID.night_rows)
    tables.write_chunks(arrays, path, ["enmo", "anglez"])
    back, names = tables.read_chunks(spark, path)
    assert names == ["enmo", "anglez"] and back.count() == arrays.count()
    weights = [[1.0, 0.0], [0.0, 0.1]]
    scored = model.score_chunks(back, model.logistic_scorer(weights, [0.0, 0.0]))
    assert "features" not in scored.columns
    first = scored.join(back.select("series_id", "chunk", "features"), ["series_id", "chunk"]).first()
    x = np.array(first.features)
    assert np.allclose(first.scores, 1 / (1 + np.exp(-(x @ np.array(weights).T))))


def test_windows_of_one_series_share_one_exchange(spark):
    df = spark.range(1000).select(F.lit("s").alias("series_id"), F.col("id").alias("pos"), F.rand(1).alias("x"))

    def build(d, w):
        d = d.withColumn("a", F.lag("x").over(w)).withColumn("b", F.avg("x").over(w.rowsBetween(-5, 5)))
        return d.withColumn("c", F.sum("a").over(w.rowsBetween(-100, 0)))

    text = plan(over_blocks(df, ["series_id"], 100, 110, 5, build))
    assert text.split("(1)")[0].count("Exchange") == 1 and text.split("(1)")[0].count("Sort") == 1


def test_chunks_targets_and_arrays_share_one_exchange(spark):
    fx = fixtures(spark, SF)
    rows = fx.buckets.withColumns({"onset": F.lit(0), "wakeup": F.lit(1)})
    long, _ = feature_table.build_dataset(rows, fx.labels, feature_table.VARIANTS["clean_train"], GRID)
    text = plan(chunks.chunk_arrays(chunks.soft_targets(long), ["anglez"], GRID.night_rows))
    moves = [line for line in text.splitlines() if line.startswith("Arguments: hashpartitioning")]
    assert sum("chunk" in line for line in moves) == 1
    assert len(moves) == 2  # the other one finds the last labelled night


def test_bucket_reduction_hashes(spark):
    fx = fixtures(spark, SF)
    text = plan(downsample_signals(fx.absolute, fx.constants, GRID))
    assert "HashAggregate" in text and "SortAggregate" not in text and "Sort (" not in text


@pytest.mark.parametrize("variant,inverted", [("basic_test", 1), ("basic_train", 2), ("no_inv_train", 1)])
def test_variants(spark, variant, inverted):
    fx = fixtures(spark, SF)
    rows = fx.buckets.withColumns({"onset": F.lit(0), "wakeup": F.lit(1)})
    long, _ = feature_table.build_dataset(rows, fx.labels, feature_table.VARIANTS[variant], GRID)
    assert long.select("invert").distinct().count() == inverted
    assert (long.where("mask = 1").count() == fx.buckets.count()) == (variant == "basic_test")


@pytest.mark.parametrize("name", ["feature_table", "match_detections", "nms_peaks", "peak_picking", "soft_targets"])
def test_no_cross_joins_and_no_row_wise_python(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for bad in ("CartesianProduct", "BatchEvalPython", "BroadcastNestedLoopJoin"):
        assert bad not in text


def test_whole_build_does_not_depend_on_blocks_or_dense_steps(spark):
    fx = fixtures(spark, "/root/testdata/sf0.01")
    enc = entry.queries()["target_encoding"](spark, "/root/testdata/sf0.01")
    few = fx.series.where("series_id in ('s0', 's4', 's9')")

    def build(**change):
        grid = GridConfig(**{**{f: getattr(GRID, f) for f in GRID.__dataclass_fields__}, **change})
        rows = feature_table.training_features(few, fx.labels, fx.folds, enc, grid, FLAT)
        names = [*TRAIN_FEATURES, "std_q50_left", "std_q50_right", "onset", "wakeup"]
        return (
            rows.select("series_id", "step", *[F.col(c).cast("double").alias(c) for c in names])
            .orderBy("series_id", "step")
            .toPandas()
        )

    a = build()
    b = build(dense_steps=False, block_rows=100, bucket_block_rows=50)
    assert len(a) == len(b) > 1000
    for c in a.columns[2:]:
        assert np.allclose(a[c].fillna(-9), b[c].fillna(-9)), c


def test_scoring_build_and_switches(spark):
    fx = fixtures(spark, SF)
    enc = entry.queries()["target_encoding"](spark, SF)
    scored = feature_table.scoring_features(fx.series, enc, GRID, FLAT)
    assert scored.where("onset + wakeup > 0").count() == 0 and scored.count() == fx.buckets.count()
    plain = feature_table.training_features(fx.series, fx.labels, fx.folds, enc, GRID, FLAT, trim=False)
    cut = feature_table.training_features(
        fx.series, fx.labels, fx.folds, enc, GRID, FLAT, trim=False, drop_tail=True, drop_noisy=True
    )
    assert 0 < cut.count() <= plain.count()


def test_profile_hook_matches_a_plain_group_mean(spark):
    data = [("a", 0, 1, 1.0), ("a", 0, 1, 3.0), ("a", None, None, 5.0), ("b", 0, 1, 9.0)]
    df = spark.createDataFrame(data, "series_id string, st_hour int, st_step int, v double")
    got = sorted((r.series_id, r.v, r.mean_v) for r in time_of_day_profile(df, "v").collect())
    assert got == [("a", 1.0, 2.0), ("a", 3.0, 2.0), ("a", 5.0, 5.0), ("b", 9.0, 9.0)]


def test_workers_do_not_need_the_package(tmp_path):
    script = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "import __spark_entry__ as e\n"
        "from tests.support import make_session\n"
        "spark = make_session()\n"
        "names = ['rolling_quantile', 'nms_peaks', 'match_detections', 'score_linear']\n"
        "print([e.queries()[n](spark, sys.argv[2]).count() > 0 for n in names])\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run(
        [sys.executable, "-c", script, repo, SF], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "[True, True, True, True]" in out.stdout, out.stderr[-2000:]


def test_tasks_follow_the_rows(spark):
    few, many = (blocks.tasks_for(spark, n) for n in (1000, 36_000_000))
    assert few <= spark.sparkContext.defaultParallelism and many * blocks.TASK_ROWS >= 36_000_000


def test_wide_rows_meet_in_tasks_that_follow_them(spark, monkeypatch):
    """Both joins of the full-resolution rows keep the number of tasks that the rows ask for."""
    monkeypatch.setattr(blocks, "TASK_ROWS", 1)
    fx = fixtures(spark, SF)
    text = plan(queries._full_rows(fx))
    n = fx.series.count()
    assert text.count(f", {n}), REPARTITION_BY_NUM") == 3
