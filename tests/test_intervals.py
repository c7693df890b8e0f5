"""Interval sets, the device-off runs built from them, and the plans of the whole build without broadcasts."""

import re
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalogue.fixtures import FLAT, GRID, fixtures
from tests.test_series_rules import plain_runs
from tidegrid.config import FlatSignalConfig, GridConfig
from tidegrid.operators import flat_signal, intervals
from tidegrid.operators.blocks import fits_broadcast, join_constants
from tidegrid.plans import feature_table
from tidegrid.staging import plan_text, recorded_plans, stage

SF = "/root/testdata/sf0.001"


@contextmanager
def no_broadcast(spark):
    names = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = [spark.conf.get(n, None) for n in names]
    for n in names:
        spark.conf.set(n, "-1")
    try:
        yield
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


@pytest.mark.parametrize("rows", [3, 20, 10_000])
def test_union_of_intervals(spark, rows):
    rng = np.random.default_rng(rows)
    data, want = [], []
    for sid, n in (("a", 60), ("b", 9), ("c", 1)):
        spans = [(int(s), int(s + rng.integers(0, 40))) for s in rng.integers(0, 900, n)]
        data += [(sid, *s) for s in spans]
        covered = np.zeros(1000, bool)
        for a, b in spans:
            covered[a : b + 1] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
        before = None
        for a, b in zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True):
            want.append((sid, a, b, before))
            before = b
    df = spark.createDataFrame(data, "series_id string, first long, last long")
    got = [tuple(r) for r in intervals.union(df, ["series_id"], rows).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    cut = intervals.in_blocks(df, rows)
    assert cut.where((F.floor(F.col("first") / rows) != F.col("block")) | (F.floor(F.col("last") / rows) != F.col("block"))).count() == 0
    assert intervals.to_rows(cut).count() == sum(b - a + 1 for _, a, b in data)


@pytest.mark.parametrize("block_rows", [5, 16, 1000])
def test_stretches_of_ratios_with_nulls(spark, block_rows):
    """Runs at the floor, with rows of unknown difference anywhere, against runs counted row by row."""
    cfg = FlatSignalConfig(min_run=3)
    rng = np.random.default_rng(8)
    data = []
    for sid, n in (("a", 300), ("b", 41), ("c", 1), ("d", 12)):
        value = [None if rng.random() < 0.07 else (0.1, 0.1, 0.3, 0.5)[v] for v in np.repeat(rng.integers(0, 4, n), 5)[:n]]
        if sid == "d":
            value = [0.1] * n  # one run without any change
        data += [(sid, i, v, value[i - 1] if i else None) for i, v in enumerate(value)]
    ratios = spark.createDataFrame(data, "series_id string, pos long, ratio double, prev_ratio double")
    # a maximum of 1, in a row far off, leaves the floors as they are
    floors = ratios.withColumnsRenamed({"ratio": "noise_floor", "prev_ratio": "prev_floor"})
    scaled = floors.unionByName(spark.createDataFrame([(s, 5000, 1.0, None) for s in "abcd"], floors.schema))
    found = flat_signal.flat_stretches(scaled, cfg, block_rows)
    got = {tuple(r) for r in intervals.to_rows(found).select("series_id", "pos").collect()}
    # the added row has no difference to a row before: it joins the run of such rows
    want = set()
    for sid in "abcd":
        value = [r[2] for r in data if r[0] == sid] + [None, 1.0]
        length = plain_runs(value, 0)[1]
        shift = -1  # the null before the added row is not a row of the series
        for i, v in enumerate(value[:-2]):
            unknown = i == 0 or v is None or value[i - 1] is None
            first_run = unknown or not any(
                value[j] is not None and value[j - 1] is not None and value[j] != value[j - 1] for j in range(1, i + 1)
            )
            if v == 0.1 and length[i] + (shift if first_run else 0) > cfg.min_run:
                want.add((sid, i))
    assert got == want


def test_buckets_from_runs_equal_buckets_from_rows(spark):
    fx = fixtures(spark, SF)
    runs = stage(flat_signal.detected_runs(fx.indexed, fx.constants, GRID, FLAT), "runs")
    direct = flat_signal.run_buckets(runs, fx.constants, GRID)
    rows = flat_signal.run_rows(runs, GRID).withColumn("step", F.floor(F.col("pos") / GRID.downsample))
    want = rows.groupBy("series_id", "step").agg(*[F.avg(c).alias(f"w_{c}") for c in ("porc_step", "group_len_c_norm")], F.max("fe__check_c").alias("w_flag"))
    both = direct.join(want, ["series_id", "step"], "full")
    same = F.col("w_flag") == F.col("fe__check_c")
    for c in ("porc_step", "group_len_c_norm"):
        same = same & (F.abs(F.col(c) - F.col(f"w_{c}")) < 1e-12)
    assert both.count() == fx.buckets.count() and both.where(~F.coalesce(same, F.lit(False))).count() == 0


def test_constants_by_block(spark):
    rows = spark.createDataFrame([(s, t) for s in "ab" for t in range(-7, 50)], "series_id string, step long")
    table = stage(spark.createDataFrame([("a", -7, 49, 1.5), ("b", -7, 49, None)], "series_id string, lo long, hi long, v double"), "constants")

    def joined():
        return join_constants(rows, table, {"v": F.col("v")}, ["series_id"], F.col("step"), F.col("lo"), F.col("hi"), 10)

    want = sorted(map(tuple, joined().collect()), key=str)
    assert fits_broadcast(table) and len(want) == 114
    with no_broadcast(spark):
        assert not fits_broadcast(table)
        assert sorted(map(tuple, joined().collect()), key=str) == want
        assert "_at" in plan_text(joined())


def parents_of_series_exchanges(text):
    """Operators above exchanges by ``series_id`` alone, skipping sorts, with the operator below."""
    tree = text.split("\n\n")[0].splitlines()
    detail = dict(re.findall(r"\((\d+)\) Exchange\n.*?Arguments: (\w+\(.*?\))", text, re.S))
    lines = [(len(re.match(r"[\s:+\-|*]*", t).group()), t) for t in tree]
    for at, (depth, t) in enumerate(lines):
        number = re.search(r"Exchange \((\d+)\)", t)
        if not number or not re.fullmatch(r"hashpartitioning\(series_id#\d+, \d+\)", detail.get(number[1], "")):
            continue
        above = next((x for d, x in reversed(lines[:at]) if d < depth and not re.search(r"Sort \(|AQEShuffleRead", x)), "")
        below = lines[at + 1][1]
        yield re.sub(r"[^A-Za-z]", "", above), re.sub(r"[^A-Za-z]", "", below)


#: tables with one row per series, block or interval, whose joins by series move no rows
NARROW = {"series-facts", "flag-intervals", "flag-series", "flag-runs", "intervals", "block-table", "floor-pieces"}


@pytest.mark.parametrize("dense", [True, False])
def test_no_series_is_one_task_without_broadcasts(spark, dense):
    fx = fixtures(spark, SF)
    enc = stage(entry.queries()["target_encoding"](spark, SF), "encoding")
    fields = {f: getattr(GRID, f) for f in GRID.__dataclass_fields__}
    grid = GridConfig(**{**fields, "dense_steps": dense, "block_rows": 96, "bucket_block_rows": 48})

    def build():
        return feature_table.training_features(fx.series, fx.labels, fx.folds, enc, grid, FLAT)

    def rows(df):
        cols = [c for c in sorted(df.columns) if c not in ("timestamp",)]
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(cols).fillna(-9).collect())

    want = rows(build())
    with no_broadcast(spark), recorded_plans() as plans:
        out = build()
        plans.append(("result", plan_text(out)))
        assert rows(out) == want
    assert {"noise-floor", "floor-pieces", "noise", "buckets", "result"} <= {name for name, _ in plans}
    for name, text in plans:
        for above, below in parents_of_series_exchanges(text):
            # partial sums, or one row per many blocks (the upper level of a carry)
            partial = "Aggregate" in below and ("Aggregate" in above or above == "Window")
            assert partial or name in NARROW, (name, above, below, text)
    if dense:
        # to the quantile, to the pieces, to the repeats: the rows that move before buckets are reduced
        moved = {n: [t for name, t in plans if name == n] for n in ("noise-floor", "floor-pieces", "noise")}
        assert [len(v) for v in moved.values()] == [1, 2, 1]


def test_full_resolution_rows_move_three_times(spark):
    """With constants broadcast, as they are unless there are very many series."""
    fx = fixtures(spark, SF)
    with recorded_plans() as plans:
        feature_table.bucket_table(fx.series, GRID, FLAT)
    moved = {n: next(t for name, t in plans if name == n) for n in ("noise-floor", "floor-pieces", "noise", "buckets")}

    def exchanges(text):
        return len(re.findall(r"\n\(\d+\) Exchange\n", text))

    # the second one in noise moves repeated rows only; all those of the buckets move partial sums
    assert exchanges(moved["noise-floor"]) == 1 and exchanges(moved["floor-pieces"]) == 1 and exchanges(moved["noise"]) == 2
    scan_parts = moved["buckets"].split("\n\n")[0]
    assert scan_parts.count("HashAggregate") >= 6 and "Window" not in scan_parts
