"""Bend waves against a direct transform, and made series of stage moves with known faults."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import kernels, stage, waves
from trackloom.functions.timeseries import Track
from trackloom.operators import events, tracking


def plain_window(x, i, least, most):
    """The window around one sample by looking at all sign changes, one after another."""
    n = len(x)
    change = [k for k in range(n - 1) if not np.sign(x[k]) == np.sign(x[k + 1])]
    left, right = [k for k in change if k < i], [k + 1 for k in change if k >= i]
    if not left or not right or math.isnan(x[i]):
        return None
    a, b = left.pop(), right.pop(0)
    while b - a + 1 < least:
        side = left if i - a < b - i else right
        if not side:
            return None
        if side is left:
            a = left.pop()
        else:
            b = right.pop(0)
    half = max(i - a, b - i)
    return (i - half, i + half) if half <= most and i - half >= 0 and i + half < n else None


def plain_wave(x, i, fps, seconds, samples):
    bounds = plain_window(x, i, round(seconds[0] * fps), round(seconds[1] * fps))
    if bounds is None:
        return math.nan, math.nan
    view = x[bounds[0] : bounds[1] + 1]
    t = np.arange(len(view))
    size = [abs(sum(view * np.exp(-2j * math.pi * k * t / samples))) for k in range(samples // 2 + 1)]
    top = int(np.argmax(size))
    step = int(fps) / 2 / (samples // 2 - 1)
    if top == 0 or not 1 / (4 * seconds[1]) <= step * top <= int(fps) / 4:
        return math.nan, math.nan
    apart, troughs = round(math.sqrt(len(view))), []
    for k in sorted(range(len(size)), key=lambda k: (size[k], k)):
        low = (k == 0 or size[k] < size[k - 1]) and (k == len(size) - 1 or size[k] < size[k + 1])
        if low and all(abs(k - t) > apart for t in troughs):
            troughs.append(k)
    before, after = [k for k in troughs if k < top], [k for k in troughs if k > top]
    if not before or not after:
        return math.nan, math.nan
    a, b = min(before), min(after)
    energy = [s * s for s in size]
    if max(size[a], size[b]) > size[top] / 2 or sum(energy[a:b]) < sum(energy) / 2:
        return math.nan, math.nan
    sign = np.sign(view.mean())
    return 2 * size[top] / len(view) * sign, step * top * sign


@pytest.mark.parametrize("seed", range(3))
def test_bend_waves_against_a_direct_transform(seed):
    rng = np.random.default_rng(seed)
    t = np.arange(160)
    x = 20 * np.sin(2 * np.pi * t / (11 + 5 * seed)) + 4 * np.cos(t / 30) + rng.normal(0, 1 + 3 * seed, 160)
    x[40:43] = np.nan
    got = waves.bend_waves(x, 10.0, seconds=(0.5, 4.0), samples=256, block=7)
    want = np.array([plain_wave(x, i, 10.0, (0.5, 4.0), 256) for i in range(160)]).T
    np.testing.assert_allclose(got[0], want[0], rtol=1e-7)
    np.testing.assert_allclose(got[1], want[1], rtol=1e-9)
    assert np.isfinite(got[0]).sum() > 20


def test_windows_and_series_without_changes():
    x = np.sin(np.arange(100) / 3)
    first, last = waves.crossing_windows(x, 5, 40)
    for i in range(100):
        assert plain_window(x, i, 5, 40) == ((first[i], last[i]) if first[i] >= 0 else None)
    assert (waves.crossing_windows(np.ones(20), 3, 10)[0] == -1).all()
    assert np.isnan(waves.bend_waves(np.ones(20), 10.0)[0]).all() and len(waves.bend_waves(np.zeros(0), 10.0)[0]) == 0


def test_crawling_bends(spark):
    t = np.arange(600)
    x = 30 * np.sin(2 * np.pi * t / 50)
    rows = [(k, 1, int(i), None if i % 97 == 5 else float(v), bool(k == 1 and i > 300)) for k in range(2) for i, v in zip(t, x)]
    df = spark.createDataFrame(rows, "file_id int, worm_index int, timestamp int, bend double, still boolean")
    out = events.crawling_bends(df, Track(), "bend", 25.0, "mid", "still").orderBy("file_id", "timestamp").toPandas()
    one = out[out["file_id"] == 0]
    inner = one[(one["timestamp"] > 60) & (one["timestamp"] < 540)]
    assert inner["mid_frequency"].abs().median() == pytest.approx(0.45, rel=0.2) and inner["mid_frequency"].notna().mean() > 0.4
    assert out[(out["file_id"] == 1) & out["still"]]["mid_frequency"].isna().all()
    assert events.crawling_bends(df.limit(0), Track(), "bend", 25.0, "mid").count() == 0


def series(n, starts, seed=0, height=1.0):
    """Noise with ramps of ten frames from each start."""
    v = np.random.default_rng(seed).uniform(0.5, 1.5, n)
    for s in starts:
        v[s : s + 10] += 100 * height * np.array([0.3, 0.6, 0.9, 1, 1, 1, 0.9, 0.7, 0.5, 0.2])[: max(0, n - s)]
    return v


TIMES = np.array([0, 8.0, 20.0, 33.0, 41.0, 60.0, 75.0, 82.0])


def test_moves_are_found_and_matched():
    rng = np.random.default_rng(1)
    starts = [int(30 * t + 12 + rng.integers(-3, 4)) for t in TIMES[1:]]
    out = stage.align(series(2700, starts), 30.0, TIMES, 1.0)
    assert out["error"] is None and not out["spurious"]
    assert [out["moves"][k].start for k in out["match"][1:]] == starts and out["state"].tolist() == [stage.BEFORE] + [stage.MATCHED] * 7
    assert out["moving"].sum() == 70


def test_spurious_and_missing_peaks_are_told_apart():
    starts = [int(30 * t + 12) for t in TIMES[1:]]
    v = series(2700, [*starts[:3], *starts[4:], 1500])
    out = stage.align(v, 30.0, TIMES, 1.0)
    assert out["error"] is None and out["state"].tolist() == [stage.BEFORE] + [stage.MATCHED] * 3 + [stage.NO_PEAK] + [stage.MATCHED] * 3
    assert [out["moves"][k].start for k in out["spurious"]] == [1500]
    assert not out["moving"][1495:1515].any()


def test_logs_and_videos_that_end_early_or_begin_late():
    starts = [int(30 * t + 12) for t in TIMES[1:]]
    out = stage.align(series(2300, starts[:6]), 30.0, TIMES, 1.0)
    assert out["error"] is None and out["state"].tolist()[-1] == stage.AFTER
    longer = stage.align(series(3200, [*starts, 2900, 3000]), 30.0, TIMES, 1.0)
    assert longer["error"] is None and longer["moving"][2900:].all() and not longer["moving"][2600:2890].any()
    still = stage.align(series(500, []), 30.0, np.array([0.0]), 1.0)
    assert still["error"] is None and not still["moving"].any()


def test_series_that_do_not_fit_give_an_error():
    rng = np.random.default_rng(3)
    out = stage.align(series(2700, sorted(rng.integers(0, 2680, 4).tolist())), 30.0, TIMES, 1.0)
    assert out["error"] in ("too many unmatched moves", "no peaks")
    assert stage.align(np.full(100, np.nan), 30.0, TIMES, 1.0)["error"] == "no peaks"
    many = sorted([int(30 * t + 12) for t in TIMES[1:]] + list(range(150, 2400, 100)))
    assert stage.align(series(2700, many), 30.0, TIMES, 1.0)["error"] is not None


def test_stage_moves_of_files(spark):
    starts = [int(30 * t + 12) for t in TIMES[1:]]
    v = {0: series(2700, starts), 1: series(2700, starts[:2])}
    frames = spark.createDataFrame([(f, i, float(x)) for f, s in v.items() for i, x in enumerate(s)], "file_id int, frame long, variance double")
    moves = spark.createDataFrame([(f, k, float(t)) for f in (0, 1, 2) for k, t in enumerate(TIMES)], "file_id int, move int, seconds double")
    out = tracking.align_stage_moves(frames, moves, 30.0)
    good = {r["move"]: r for r in out.where("file_id = 0").collect()}
    assert [good[k]["first"] for k in range(1, 8)] == starts and good[0]["first"] is None and {r["error"] for r in good.values()} == {None}
    assert {r["error"] for r in out.where("file_id = 1").collect()} == {"too many unmatched moves"}
    assert {(r["error"], r["frame"]) for r in out.where("file_id = 2").collect()} == {("no peaks", None)}


def test_noisy_blocks_stay_and_reversed_ones_turn(spark):
    rng = np.random.default_rng(0)
    shape = np.array([1, 2, 3, 5, 9, 9, 5, 4, 6, 2.0])
    rows = []
    for i in range(90):
        p = shape + rng.normal(0, 0.3, 10)
        if 20 <= i < 35:
            p = p[::-1]
        if 60 <= i < 70:  # a stretch whose profile changes little by little until it looks like its reverse, and back
            share = min(i - 60, 69 - i) / 4.0
            p = (1 - min(1, share) * 0.6) * shape + 0.6 * min(1, share) * shape[::-1] + rng.normal(0, 0.05, 10)
        rows.append((0, 0, i, None if i == 27 else p.tolist()))
    df = spark.createDataFrame(rows, "file_id int, worm_index int, timestamp int, profile array<double>")
    out = {r["timestamp"] for r in tracking.orient_by_intensity(df, Track(), "profile", 3).where("is_switched").collect()}
    assert out == set(range(20, 35))
    assert kernels.confirmed_blocks(np.array([[1, 2, 3.0]] * 4 + [[3, 2, 1.0]] * 3 + [[1, 2, 3.0]] * 4), [(4, 7)], 4) == [(4, 7)]
    assert kernels.confirmed_blocks(np.array([[3, 2, 1.0]] * 11), [(4, 7)], 4) == []
    assert tracking.orient_by_intensity(df.limit(0), Track(), "profile", 3).agg(F.count("*")).first()[0] == 0


def test_sides_of_windows_near_zero():
    """Numpy's mean of these is 0, their sum one by one is not."""
    v = np.array([6.1, -26.3, -8.6, 2.6, -14.8, 47.5, 36.7, 9.1, -13.9, -38.4])
    assert np.nanmean(v) == 0 and waves.side(v) == 1.0
