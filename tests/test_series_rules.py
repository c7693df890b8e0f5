"""Block-wise operators against plain loops over whole series."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.config import FlatSignalConfig, GridConfig
from tidegrid.operators import flat_signal, order_stats, repeats, runs, series_index
from tidegrid.operators.blocks import Carry, carry, with_positions
from tidegrid.functions.scalar import floor_div


def plain_runs(values, eps):
    """Run id, length and position with unknown differences in run 0."""
    ids, count = [], 0
    for i, v in enumerate(values):
        prev = values[i - 1] if i else None
        if v is None or prev is None:
            ids.append(0)
            continue
        count += abs(v - prev) > eps
        ids.append(count)
    seen, pos = {}, []
    for r in ids:
        pos.append(seen.get(r, 0))
        seen[r] = seen.get(r, 0) + 1
    return ids, [seen[r] for r in ids], pos


@pytest.mark.parametrize("block_rows", [7, 50, 1000])
def test_runs_with_nulls(spark, block_rows):
    rng = np.random.default_rng(3)
    data, want = [], []
    for sid, n in (("a", 200), ("b", 33), ("c", 1)):
        values = [None if rng.random() < 0.1 else int(v) for v in np.repeat(rng.integers(0, 3, n), 4)[:n]]
        if sid == "a":
            values[:5] = [None] * 5
            values[-9:] = [None] * 9
        data += [(sid, i, v) for i, v in enumerate(values)]
        want += [(sid, i, *t) for i, t in enumerate(zip(*plain_runs(values, 0), strict=True))]
    df = spark.createDataFrame(data, "series_id string, pos long, v int")
    got = runs.with_runs(df, ["series_id"], "v", 0.0, block_rows).select("series_id", "pos", "run", "run_len", "run_pos")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def plain_flat(angle, cfg):
    """The device-off chain written as loops."""
    n = len(angle)
    spread = [None] * n
    for i in range(cfg.std_rows // 2, n - cfg.std_rows // 2):
        spread[i] = float(np.std(angle[i - cfg.std_rows // 2 : i + cfg.std_rows // 2 + 1], ddof=1))
    low = [None] * n
    half = cfg.quantile_rows // 2
    for i in range(n):
        a, b = i + cfg.ahead_rows - half, i + cfg.ahead_rows + half
        frame = spread[max(a, 0) : b] if a >= 0 and b <= n else []
        if len(frame) == cfg.quantile_rows and None not in frame:
            low[i] = sorted(frame)[math.floor(cfg.quantile_rows * cfg.quantile)]
    top = max((v for v in low if v is not None), default=0)
    ratio = [None if v is None or not top else min(max(v / top, cfg.floor), 1.0) for v in low]
    _, length, _ = plain_runs(ratio, 0)
    flag = [int(r == cfg.floor and k > cfg.min_run) for r, k in zip(ratio, length, strict=True)]
    late = [None] * cfg.delay_rows + flag[: n - cfg.delay_rows] if n > cfg.delay_rows else [None] * n
    wide, h = [None] * n, cfg.widen_rows // 2
    for i in range(h, n - h):
        frame = late[i - h : i + h + 1]
        wide[i] = None if None in frame else max(frame)
    _, length, pos = plain_runs(wide, 0.1)
    return [(v or 0, (1 if v else -1) * p, k) for v, p, k in zip(wide, pos, length, strict=True)]


@pytest.mark.parametrize(
    "cfg,block_rows",
    [
        (FlatSignalConfig(), 1500),
        (FlatSignalConfig(), 100000),
        (FlatSignalConfig(std_rows=5, quantile_rows=18, ahead_rows=18, min_run=40, delay_rows=4, widen_rows=9), 64),
    ],
)
def test_flat_signal(spark, cfg, block_rows):
    rng = np.random.default_rng(11)
    data, want = [], {}
    for sid, n in (("long", 6000), ("short", 150), ("tiny", 3), ("head", 2500)):
        angle = np.abs(rng.normal(0, 30, n).round(2))
        for start in range(700, n, 1900):
            angle[start : start + 900] = 12.5
        if sid == "head":
            angle[:620] = 3.0  # first run only long enough with the rows of unknown difference
        data += [(sid, i, float(a)) for i, a in enumerate(angle)]
        for i, row in enumerate(plain_flat(angle, cfg)):
            want[sid, i] = row
    grid = GridConfig(dense_steps=True, block_rows=block_rows)
    df = spark.createDataFrame(data, "series_id string, pos long, anglez double")
    const = df.groupBy("series_id").agg(F.count("*").alias("n_rows"))
    got = flat_signal.flat_signal_features(df, const, grid, cfg).toPandas()
    assert len(got) == len(want)
    assert got["fe__check_c"].sum() > 0
    for r in got.itertuples():
        flag, pos, length = want[r.series_id, r.pos]
        assert r.fe__check_c == flag
        assert r.porc_step == pytest.approx(pos / 8640)
        assert r.group_len_c_norm == pytest.approx(length / 17280)


def test_positions_with_gaps_and_strides(spark):
    rng = np.random.default_rng(5)
    data = []
    for sid in "abc":
        steps = np.sort(rng.choice(5000, 300, replace=False))
        data += [(sid, int(s), i) for i, s in enumerate(steps)]
    df = spark.createDataFrame(data, "series_id string, step long, want long")
    out = with_positions(df, ["series_id"], ["step"], floor_div("step", 100))
    assert out.where("pos <> want").count() == 0 and out.count() == len(data)
    with pytest.raises(Exception, match="dense_steps"):
        series_index.index_rows(df, GridConfig(dense_steps=True)).collect()
    sparse = series_index.index_rows(df, GridConfig(block_rows=64))
    assert sparse.where("pos <> want").count() == 0


def test_carry_levels(spark):
    rng = np.random.default_rng(6)
    rows = [("a", i, int(rng.integers(0, 9))) for i in range(100)] + [("b", i * 3, 1) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, b long, v long")
    specs = [Carry("s", "sum", "v"), Carry("m", "max", "v"), Carry("n", "min", "v", "after")]
    got = {(r.k, r.b): (r.s, r.m, r.n) for r in carry(df, ["k"], "b", specs, span=7).collect()}
    for k in "ab":
        own = sorted((b, v) for kk, b, v in rows if kk == k)
        for b, _ in own:
            before, after = [v for c, v in own if c < b], [v for c, v in own if c > b]
            assert got[k, b] == (sum(before), max(before, default=None), min(after, default=None))


@pytest.mark.parametrize("size,index", [(180, 18), (15, 7), (4, 0)])
def test_rolling_rank(spark, size, index):
    rng = np.random.default_rng(7)
    x = rng.normal(size=500).round(3)
    x[100] = np.nan
    rows = [("s", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "series_id string, pos long, v double")
    lo = -(size // 2)
    got = order_stats.rolling_rank(df, ["series_id"], "v", "r", lo, lo + size - 1, index, 90)
    got = {r.pos: r.r for r in got.collect()}
    for i in range(500):
        a, b = i + lo, i + lo + size
        full = a >= 0 and b <= 500 and not np.isnan(x[a:b]).any()
        assert got[i] == (pytest.approx(np.sort(x[a:b])[index]) if full else None)


def test_quantiles_of_large_groups(spark):
    rng = np.random.default_rng(8)
    data = {"hot": np.round(rng.normal(size=5000), 2), "same": np.full(3000, 4.0), "small": rng.normal(size=20)}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("hot", None), ("small", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.25, 0.5, 0.87, 1.0]
    got = {r.k: r.q for r in order_stats.quantiles(df, ["k"], "v", probs).collect()}
    for k, vs in data.items():
        assert got[k] == pytest.approx(list(np.quantile(vs, probs)))


def test_running_totals(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 400), "x": rng.integers(0, 90, 400) / 7.0})
    pdf = pdf.groupby(["k", "x"], as_index=False).size().rename(columns={"size": "n"})
    out = order_stats.running_totals(spark.createDataFrame(pdf), ["k"], "x", ["n"]).toPandas()
    for k, part in out.groupby("k"):
        part = part.sort_values("x", ascending=False)
        assert part["c_n"].tolist() == part["n"].cumsum().tolist(), k


def test_repeat_noise_and_long_runs(spark):
    grid = GridConfig(steps_per_day=20, steps_per_hour=5, block_rows=16)
    rng = np.random.default_rng(10)
    rows, want = [], {}
    for sid, first in (("a", 7), ("b", 0), ("none", None)):
        angle = rng.integers(0, 4, 120)
        tod = [None if first is None else ((i - first) % 20 if i >= first else i - first + 20) for i in range(120)]
        seen = {}
        for t, a in zip(tod, angle, strict=True):
            seen[t, a] = seen.get((t, a), 0) + 1
        noise = [int(t is not None and seen[t, a] > 1) for t, a in zip(tod, angle, strict=True)]
        _, length, _ = plain_runs(noise, 0)
        rows += [(sid, i, i, first, float(a)) for i, a in enumerate(angle)]
        want |= {(sid, i): int(k > 3) for i, (z, k) in enumerate(zip(noise, length, strict=True)) if z}
    df = spark.createDataFrame(rows, "series_id string, step long, pos long, step_first long, anglez double")
    got = repeats.long_noise(repeats.repeated_rows(df, grid), 3, grid.block_rows)
    assert {(r.series_id, r.pos): r.noise_removal for r in got.collect()} == want
