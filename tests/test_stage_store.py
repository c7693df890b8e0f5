"""The clustered stage: reuse, rebuilding, broken writes, and reductions without an exchange."""

import shutil

import pytest
from pyspark.sql import functions as F

from tests.test_io_and_plans import plan
from tidegrid.config import GridConfig
from tidegrid.operators import downsample
from tidegrid.sources import stage_store

GRID = GridConfig(downsample=6, block_rows=100)


def rows(spark, n=1000):
    return spark.range(3 * n).select(
        F.concat(F.lit("s'"), (F.col("id") % 3).cast("string")).alias("series_id"),
        F.floor(F.col("id") / 3).alias("step"),
        (F.col("id") * 7 % 101).cast("double").alias("x"),
    )


@pytest.fixture
def store(spark, tmp_path):
    calls = []

    def run(recipe, n=1000, buckets=4):
        def build():
            calls.append(recipe)
            return rows(spark, n)

        return stage_store.reuse_or_build(spark, str(tmp_path / "it's"), recipe, build, GRID, buckets)

    return run, calls, tmp_path / "it's"


def test_same_recipe_is_read_and_another_is_built(spark, store):
    run, calls, _ = store
    first = run({"a": 1})
    want = sorted(map(tuple, rows(spark).collect()))
    assert sorted(map(tuple, first.drop("block").collect())) == want
    assert sorted(map(tuple, run({"a": 1}).drop("block").collect())) == want and len(calls) == 1
    assert run({"a": 2}, n=50).count() == 150 and len(calls) == 2
    assert run({"a": 2}, n=50, buckets=2).count() == 150 and len(calls) == 3


def test_a_later_session_declares_the_buckets_again(spark, store):
    run, calls, path = store
    run({"a": 1})
    spark.sql(f"drop table {stage_store._table_name(str(path))}")
    again = run({"a": 1})
    assert len(calls) == 1 and again.count() == 3000
    assert "hashpartitioning" not in plan(again.groupBy("series_id", "block").agg(F.sum("x")))


def test_a_broken_write_is_built_anew(spark, store):
    run, calls, path = store
    run({"a": 1})
    shutil.rmtree(path / "manifest")
    assert run({"a": 1}).count() == 3000 and len(calls) == 2


def test_no_rows(spark, store):
    run, calls, _ = store
    assert run({"a": 1}, n=0).count() == 0 and run({"a": 1}, n=0).count() == 0 and len(calls) == 1


def test_bucket_reduction_moves_no_rows(spark, store):
    run, _, _ = store
    names = "timestamp night st_hour st_step anglez enmo anglez_orig fe__check_c porc_step group_len_c_norm noise noise_removal".split()

    def reduced(df):
        return downsample.downsample(df.withColumns({c: F.col("x") for c in names}), GRID)

    stored = run({"a": 1})
    text = plan(reduced(stored))
    assert "Exchange" not in text and "Bucketed: true" in text
    plain = reduced(rows(spark))
    assert plain.columns == reduced(stored).columns
    cells = [[tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect()] for d in (plain, reduced(stored))]
    assert sorted(cells[0]) == sorted(cells[1])
