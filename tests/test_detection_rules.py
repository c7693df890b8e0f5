"""Peaks and matching against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.config import GridConfig, PeakConfig
from tidegrid.operators import evaluation, order_stats, predictions
from tidegrid.staging import recorded_plans


def plain_peaks(prob, gap):
    alive, kept = [True] * len(prob), []
    for i in sorted(range(len(prob)), key=lambda i: (-prob[i], i)):
        if alive[i]:
            kept.append(i)
            for j in range(max(0, i - gap), min(len(prob), i + gap + 1)):
                alive[j] = False
    return kept


def shapes():
    rng = np.random.default_rng(1)
    yield "noise", rng.random(700)
    yield "coarse", rng.integers(0, 4, 700) / 4
    yield "zeros", np.zeros(900)
    yield "plateau", np.concatenate([rng.random(50), np.full(433, 0.5), rng.random(40), np.full(301, 0.2), [0.9] * 80])
    yield "stairs", np.repeat([0.9, 0.7, 0.8, 0.3, 0.3, 0.1], 97)
    yield "ramp", np.arange(300) / 300
    yield "one", np.array([0.4])
    for seed in range(12):
        r = np.random.default_rng(seed)
        parts = [np.full(r.integers(1, 130), r.integers(0, 5) / 4) for _ in range(r.integers(3, 12))]
        yield f"mix{seed}", np.concatenate(parts)


@pytest.mark.parametrize("gap,block_rows", [(11, 64), (11, 150), (3, 50), (11, 100000)])
def test_peaks_equal_whole_series_greedy(spark, gap, block_rows):
    rows, want = [], set()
    for name, prob in shapes():
        rows += [(name, "onset", i, float(p)) for i, p in enumerate(prob)]
        want |= {(name, i) for i in plain_peaks(list(prob), gap)}
    df = spark.createDataFrame(rows, "series_id string, event string, pos long, p double")
    cfg = PeakConfig(gap_rows=gap, block_rows=block_rows)
    peaks = predictions.nms_peaks(df, cfg, "p")
    got = [(r.series_id, r.pos) for r in peaks.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_rank_follows_the_greedy_order(spark):
    rng = np.random.default_rng(2)
    prob = rng.integers(0, 9, 500) / 9
    df = spark.createDataFrame(
        [("s", "onset", i, float(p)) for i, p in enumerate(prob)], "series_id string, event string, pos long, p double"
    )
    cfg = PeakConfig(block_rows=60)
    ranked = predictions.with_rank(predictions.nms_peaks(df, cfg, "p"), cfg, "p")
    got = [r.pos for r in sorted(ranked.collect(), key=lambda r: r.rank)]
    assert got == plain_peaks(list(prob), 11)


def test_pick_peaks_pipeline(spark):
    rng = np.random.default_rng(4)
    grid = GridConfig(block_rows=100)
    rows = [
        (sid, i * 6, e, float(rng.random())) for sid, n in (("a", 400), ("b", 90)) for i in range(n) for e in ("onset", "wakeup")
    ]
    df = spark.createDataFrame(rows, "series_id string, step long, event string, score double")
    got = predictions.pick_peaks(df, grid, PeakConfig(block_rows=70)).toPandas()
    pdf = pd.DataFrame(rows, columns=["series_id", "step", "event", "score"])
    want = []
    for (sid, event), part in pdf.groupby(["series_id", "event"]):
        part = part.sort_values("step")
        smooth = part["score"].rolling(7, center=True).mean().fillna(0).rolling(7, center=True).mean().fillna(0).to_numpy()
        kept = plain_peaks(list(smooth), 11)
        limit = np.quantile(smooth[kept], 0.87)
        want += [(sid, event, part["step"].iloc[i] - 0.5, smooth[i]) for i in kept if smooth[i] > limit]
    got = sorted(zip(got.series_id, got.event, got.step, got.score, strict=True))
    want = sorted(want)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


@pytest.mark.parametrize("gap", [0, 1, 4])
def test_settle_and_sliding_maximum(gap):
    rng = np.random.default_rng(gap)
    for prob in (rng.integers(0, 5, 300) / 4, np.arange(90.0), -np.arange(90.0), np.zeros(50), rng.random(1), np.zeros(0)):
        assert predictions.greedy_peaks(prob, gap).tolist() == sorted(plain_peaks(prob, gap))
        for rows in (1, 3, 7):
            frames = [max(prob[i : i + rows]) for i in range(len(prob) - rows + 1)]
            assert order_stats.sliding_max(np.asarray(prob, float), rows).tolist() == frames


@pytest.mark.parametrize("block_rows", [20, 64])
def test_stretches_over_many_blocks(spark, block_rows):
    """Slopes, valleys and plateaus without a cut for many blocks; none of their groups is longer than a block."""
    rng = np.random.default_rng(4)
    n, cfg = 700, PeakConfig(gap_rows=4, block_rows=block_rows)
    shapes = {
        "up": np.arange(n) / n,
        "down": -np.arange(n) / n,
        "valley": np.abs(np.arange(n) - 350.0),
        "wavy": np.arange(n) / n + np.sin(np.arange(n)) / 300,
        "steps": np.floor(np.arange(n) / 90),
        "mixed": np.where(np.arange(n) < 400, np.arange(n) / n, rng.integers(0, 4, n)),
    }
    rows = [(s, "onset", i, float(p)) for s, prob in shapes.items() for i, p in enumerate(prob)]
    df = spark.createDataFrame(rows, "series_id string, event string, pos long, p double")
    with recorded_plans() as plans:
        got = predictions.nms_peaks(df, cfg, "p").select("series_id", "pos").collect()
    assert sorted(map(tuple, got)) == sorted((s, i) for s, prob in shapes.items() for i in plain_peaks(prob, 4))
    assert sum(name == "open-rows" for name, _ in plans) > 2


def test_slopes_over_small_blocks_in_few_rounds(spark):
    """Many slopes and saws longer than a block: parcels hold several stretches, and rounds don't follow their blocks."""
    i = np.arange(9000)
    shapes = {"slopes": np.where(i % 400 < 300, i, i * 7 % 40) / 1e5, "falls": -(i % 450) / 1e5, "steps": i // 150 * 5 % 3 / 4}
    rows = [(s, "onset", int(n), float(p)) for s, prob in shapes.items() for n, p in enumerate(prob)]
    df = spark.createDataFrame(rows, "series_id string, event string, pos long, p double")
    with recorded_plans() as plans:
        got = predictions.nms_peaks(df, PeakConfig(block_rows=48), "p").select("series_id", "pos").collect()
    assert sorted(map(tuple, got)) == sorted((s, n) for s, prob in shapes.items() for n in plain_peaks(prob, 11))
    assert sum(name == "open-rows" for name, _ in plans) <= 4


def test_places_without_a_row_suppress_nothing():
    none, there = np.zeros(9, bool), np.array([1, 1, 0, 0, 1, 1, 0, 1, 1], bool)
    prob = np.array([np.nan, 1.0, 9.0, 9.0, np.nan, -np.inf, 9.0, -5.0, -5.0])
    new, still = predictions.settle(prob, 2, none, there, there)
    assert np.flatnonzero(new).tolist() == [1, 4, 7] and not still.any()


def plain_match(truths, dets, tolerance):
    free, hits = sorted(truths), []
    for step, score in sorted(dets, key=lambda d: (-d[1], d[0])):
        near = [t for t in free if abs(t - step) < tolerance]
        hit = min(near, key=lambda t: (abs(t - step), t), default=None)
        if hit is not None:
            free.remove(hit)
        hits.append((step, score, int(hit is not None)))
    return hits


@pytest.mark.parametrize("spacing", [3, 40, 900])
def test_matching(spark, spacing):
    rng = np.random.default_rng(spacing)
    tolerances = {"onset": [5, 30], "wakeup": [12]}
    truths, dets, want = [], [], []
    for sid in ("a", "b", "c"):
        for event, tols in tolerances.items():
            own = sorted({int(t) for t in np.cumsum(rng.integers(1, 2 * spacing, 40))})
            truths += [(sid, event, t) for t in own]
            found = [(float(rng.integers(0, own[-1])) - 0.5, float(rng.integers(0, 6)) / 6) for _ in range(150)]
            found = list(dict.fromkeys(found))
            dets += [(sid, event, *d) for d in found]
            for tol in tols:
                want += [(event, float(tol), sid, *h) for h in plain_match(own, found, tol)]
    truths.append(("a", "onset", None))
    dets += [("unknown", "onset", 5.0, 0.9), ("a", "onset", 5.0, None)]
    t = spark.createDataFrame(truths, "series_id string, event string, step long")
    d = spark.createDataFrame(dets, "series_id string, event string, step double, score double")
    got = evaluation.match_detections(t, d, tolerances, block_steps=130)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_matching_in_rounds(spark):
    """Repeated truths and detections, and scores that rise along a chain: a round for each truth."""
    truths = [("a", "onset", t) for t in (10, 10, 10, 12, 15, 15)] + [("b", "onset", 8 * k) for k in range(12)]
    dets = [("a", "onset", s, p) for s, p in ((9.5, 0.5), (9.5, 0.5), (9.5, 0.5), (9.5, 0.5), (13.5, 0.9), (11.0, 0.9), (30.0, 1.0))]
    dets += [("b", "onset", 8.0 * k + 3, k / 12) for k in range(12)]
    want = []
    for sid in "ab":
        own = [(s, p) for i, _, s, p in dets if i == sid]
        want += [("onset", 12.0, sid, *h) for h in plain_match([t for i, _, t in truths if i == sid], own, 12)]
    t = spark.createDataFrame(truths, "series_id string, event string, step long")
    d = spark.createDataFrame(dets, "series_id string, event string, step double, score double")
    with recorded_plans() as plans:
        got = evaluation.match_detections(t, d, {"onset": [12]}, block_steps=30).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    rounds = [text for name, text in plans if name == "certain-links"]
    assert 3 < len(rounds) < 20 and not any("Python" in text or "InPandas" in text for text in rounds)


def plain_ap(matched, scores, p):
    order = np.argsort(scores, kind="stable")[::-1]
    m, s = np.asarray(matched)[order], np.asarray(scores)[order]
    last = np.r_[np.flatnonzero(np.diff(s)), len(s) - 1]
    tp = np.cumsum(m)[last]
    precision, recall = tp / (last + 1), tp / p
    return float(np.sum(np.diff(np.r_[0, recall]) * precision))


def test_average_precision(spark):
    rng = np.random.default_rng(12)
    rows = [
        (e, t, "s", float(i), float(rng.integers(0, 30)) / 30, int(rng.random() < 0.4))
        for e in ("onset", "wakeup") for t in (1.0, 2.0) for i in range(80)
    ]
    matched = spark.createDataFrame(rows, "event string, tolerance double, series_id string, step double, score double, matched int")
    truths = spark.createDataFrame(
        [("s", e, i) for e, n in (("onset", 50), ("wakeup", 60), ("start", 4)) for i in range(n)],
        "series_id string, event string, step long",
    )
    table = evaluation.average_precision(matched, truths)
    got = {(r.event, r.tolerance): r.ap for r in table.collect()}
    for e, n in (("onset", 50), ("wakeup", 60)):
        for t in (1.0, 2.0):
            part = [r for r in rows if r[:2] == (e, t)]
            assert got[e, t] == pytest.approx(plain_ap([r[5] for r in part], [r[4] for r in part], n))
    score = evaluation.mean_ap(table, truths).first().mean_ap
    assert score == pytest.approx(sum(got.values()) / 4)
    # an event without detections counts 0
    only = table.where("event = 'onset'")
    assert evaluation.mean_ap(only, truths).first().mean_ap == pytest.approx((got["onset", 1.0] + got["onset", 2.0]) / 4)


def test_input_checks(spark):
    truths = spark.createDataFrame([("s", "onset", 1)], "series_id string, event string, step long")
    found = spark.createDataFrame([("s", "onset", 1.0, 0.5)], "series_id string, event string, step double, score double")
    evaluation.check_inputs(truths, found, {"onset": [1]})
    for bad_truths, bad_found, tolerances in (
        (truths, found, {}),
        (truths, found, {"onset": [1], "wakeup": [1]}),
        (truths, found.drop("score"), {"onset": [1]}),
        (truths, found.withColumn("score", F.lit("x")), {"onset": [1]}),
        (truths.withColumn("step", F.lit("x")), found, {"onset": [1]}),
    ):
        with pytest.raises(ValueError):
            evaluation.check_inputs(bad_truths, bad_found, tolerances)
