"""The feature route against straight-line numpy and pandas versions of its rules."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom.functions import kernels as K
from trackloom.functions import timeseries
from trackloom.functions.geometry import PARTS
from trackloom.functions.timeseries import Track
from trackloom.operators import events, features

A = "array<struct<x:double,y:double>>"
T = Track(("k",), ("i",))


def moving_poses(n=60, missing=(), seed=0):
    """(frames, 49, 2): a crawling, turning body."""
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    angle = 0.09 * t + rng.normal(0, 0.02, n)
    centre = np.cumsum(4.0 * np.column_stack((np.cos(angle), np.sin(angle))), axis=0)
    along = np.linspace(240, -240, 49)
    side = 30 * np.sin(along / 60 + t[:, None] / 4)
    poses = np.stack([centre[:, :1] + along * np.cos(angle)[:, None] - side * np.sin(angle)[:, None], centre[:, 1:] + along * np.sin(angle)[:, None] + side * np.cos(angle)[:, None]], axis=-1)
    poses[list(missing)] = np.nan
    return poses


def pose_rows(spark, poses):
    rows = [(0, 1, t, None if np.isnan(p).any() else [{"x": float(x), "y": float(y)} for x, y in p]) for t, p in enumerate(poses)]
    return spark.createDataFrame(rows, f"file_id int, worm_index int, timestamp int, skeleton {A}")


def with_nan(rows, name):
    return np.array([np.nan if r[name] is None else r[name] for r in rows], float)


def unwrapped(x):
    filled = pd.Series(x).ffill().bfill().to_numpy()
    out = np.unwrap(filled)
    out[np.isnan(x)] = np.nan
    return out


def rate(x, d, fps):
    out = np.full(x.shape, np.nan)
    if len(x) > d:
        out[d // 2 : len(x) - math.ceil(d / 2)] = (x[d:] - x[:-d]) / (d / fps)
    return out


def plain_velocities(poses, fps):
    d = max(1, round(fps / 3))
    bad, t, out = np.isnan(poses[:, 0, 0]), np.arange(len(poses)), {}
    for part, others in features.RELATIVE_TO.items():
        a, b = PARTS[part]
        c, v = poses[:, a:b].mean(1), poses[:, a] - poses[:, b - 1]
        if (~bad).sum() > 2:
            c, v = (np.column_stack([np.interp(t, t[~bad], m[~bad, j]) for j in range(2)]) for m in (c, v))
        move = rate(c, d, fps)
        speed = np.hypot(*move.T) * np.sign((move * v).sum(1))
        o = unwrapped(np.arctan2(v[:, 0], v[:, 1]))
        spin = rate(o, d, fps)
        speed[bad] = spin[bad] = np.nan
        tag = "" if part == "body" else f"_{part}"
        out[f"speed{tag}"], out[f"angular_velocity{tag}"] = speed, spin

        def local(name, c=c, o=o):
            p = poses[:, slice(*PARTS[name])].mean(1) - c
            return np.column_stack((p[:, 0] * np.cos(o) - p[:, 1] * np.sin(o), p[:, 0] * np.sin(o) + p[:, 1] * np.cos(o)))

        if part == "body":
            out["relative_to_body_speed_midbody"] = rate(local("midbody")[:, 0], d, fps)
        for name in others:
            p = local(name)
            out[f"relative_to_{part}_radial_velocity_{name}"] = rate(np.hypot(*p.T), d, fps)
            out[f"relative_to_{part}_angular_velocity_{name}"] = rate(unwrapped(np.arctan2(p[:, 1], p[:, 0])), d, fps)
    return out


@pytest.mark.parametrize(("missing", "fps"), [((), 25.0), ((0, 1, 17, 18, 19, 40, 59), 25.0), ((30,), 2.0)])
def test_velocities(spark, missing, fps):
    poses = moving_poses(missing=missing)
    rows = features.velocities(pose_rows(spark, poses), Track(), fps).orderBy("timestamp").collect()
    want = plain_velocities(poses, fps)
    assert set(want) == set(features.VELOCITIES)
    for name, v in want.items():
        np.testing.assert_allclose(with_nan(rows, name), v, atol=1e-7, err_msg=name)


def test_velocities_of_short_tracks(spark):
    poses = moving_poses(6, missing=(0, 1, 2, 3))
    rows = features.velocities(pose_rows(spark, poses), Track(), 25.0).collect()
    assert len(rows) == 6 and all(r[c] is None for r in rows for c in features.VELOCITIES)


def test_curvature_by_gradient(spark):
    poses = moving_poses(8, missing=(3,))
    rows = features.curvature(pose_rows(spark, poses), track=Track()).orderBy("timestamp").collect()
    k = K.curvature_gradient(poses)
    # Plain version of the stencil on one pose.
    p = poses[0]
    grad = lambda x: np.array([(x[min(i + 2, 48)] - x[max(i - 2, 0)]) / (2 + min(i, 48 - i, 2)) for i in range(49)])
    d, dd = grad(p), None
    dd = grad(d)
    plain = (d[:, 0] * dd[:, 1] - d[:, 1] * dd[:, 0]) / (d**2).sum(1) ** 1.5
    np.testing.assert_allclose(k[0, 4:-4], plain[4:-4])
    assert np.isnan(k[0, :4]).all() and np.isnan(k[0, -4:]).all()
    for part, at in (("head", 5), ("neck", 15), ("midbody", 24), ("hips", 33), ("tail", 44)):
        piece = k[:, slice(*PARTS[part])]
        np.testing.assert_allclose(with_nan(rows, f"curvature_{part}"), k[:, at], atol=1e-9)
        good = ~np.isnan(poses[:, 0, 0])
        np.testing.assert_allclose(with_nan(rows, f"curvature_mean_{part}")[good], np.nanmean(piece[good], axis=1), atol=1e-9)
        np.testing.assert_allclose(with_nan(rows, f"curvature_std_{part}")[good], np.nanstd(piece[good], axis=1), atol=1e-9)
    short = features.curvature(pose_rows(spark, poses[:3]), track=Track()).collect()
    assert all(r.curvature_midbody is None for r in short)


def test_curvature_of_circles():
    a = np.linspace(0, 3, 49)
    circle = 50 * np.column_stack((np.cos(a), np.sin(a)))[None]
    np.testing.assert_allclose(K.curvature_gradient(circle)[0, 4:-4], 1 / 50, rtol=2e-2)
    np.testing.assert_allclose(K.curvature_savgol(circle)[0, 4:-4], 1 / 50, rtol=2e-2)
    # The angle between chords of four edges each, over six of them.
    np.testing.assert_allclose(K.curvature_angle(circle)[0], 3 / 48 * 4 / (2 * 3 / 47 * 150), rtol=1e-2)
    t = np.linspace(0, 3, 900)
    got = K.path_curvature(np.cos(t) * 500, np.sin(t) * 500, 11.0)
    np.testing.assert_allclose(got[300:600], 1 / 500, rtol=3e-2)
    assert np.isnan(K.path_curvature(np.arange(15.0), np.zeros(15), 11.0)).all()


def plain_regions(x, low, high, smooth, least):
    """Three-region flags as runs and slices over whole arrays."""
    s = pd.Series(x, dtype=float).ffill().bfill().rolling(smooth, center=True).mean().to_numpy()
    flag = np.where(s > high, 1.0, np.where(s < -high, -1.0, 0.0))
    padded = np.concatenate(([0], ((s > -low) & (s < low)).astype(int), [0]))
    on = np.clip(np.flatnonzero(np.diff(padded) == 1) - 1, 0, None)
    off = np.flatnonzero(np.diff(padded) == -1) - 1
    keep = off - on > least
    for a, b in zip([0, *off[keep]], [*on[keep], len(s) - 1], strict=True):
        part = flag[a : b + 1]
        kinds = set(part[part != 0])
        if len(kinds) == 1:
            flag[a : b + 1] = kinds.pop()
        elif kinds:
            flag[a : b + 1] = pd.Series(part).replace(0, np.nan).ffill().bfill()
    return flag


@pytest.mark.parametrize("seed", range(4))
def test_regions(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.choice([0.0, 0.0, 4.0, -4.0, 12.0, -12.0], 40), rng.integers(1, 12, 40)) + rng.normal(0, 0.5, 1)[0]
    x = x + rng.normal(0, 0.6, len(x))
    x[rng.random(len(x)) < 0.05] = np.nan
    df = spark.createDataFrame([(0, i, None if np.isnan(v) else float(v), 100.0, None if np.isnan(v) else float(v) * 10) for i, v in enumerate(x)], "k int, i int, speed double, length double, dist_from_food_edge double")
    rows = events.behaviour(df, T, 5.0).orderBy("i").collect()
    assert [r.motion_mode for r in rows] == plain_regions(x, 2.5, 5.0, 3, 15).tolist()
    assert [r.food_region for r in rows] == plain_regions(10 * x, 50.0, 100.0, 3, 5).tolist()


def plain_turns(htd, axis, spin, fps):
    size = int(fps * 0.5)
    size += size % 2 == 0
    bend = pd.Series(1 - htd / axis).rolling(size).min().to_numpy()
    fast = pd.Series(np.abs(spin)).rolling(size).max().to_numpy()
    (bend, a), (fast, b) = K.fill_inner_cubic(bend), K.fill_inner_cubic(fast)
    if not (a and b):
        return [None] * len(htd)
    seed = (bend > 0.15) & (fast > 0.75)
    out = np.zeros(len(htd), int)
    for over in (bend > 0.075, fast > 0.35):
        edge = np.diff(np.concatenate(([0], over.astype(int), [0])))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1, strict=True):
            a = max(a - 1, 0)
            if b > a and seed[a : b + 1].any():
                out[a : b + 1] = 1
    return out.tolist()


@pytest.mark.parametrize("seed", range(3))
def test_turns(spark, seed):
    rng = np.random.default_rng(seed)
    n = 300
    smooth = lambda scale: np.convolve(rng.normal(0, scale, n + 30), np.ones(31) / 31, "valid")
    axis = np.full(n, 100.0)
    htd, spin = 85 - 60 * np.abs(smooth(1)), smooth(3)
    htd[rng.random(n) < 0.02] = np.nan
    df = spark.createDataFrame([(0, i, None if np.isnan(h) else float(h), 100.0, float(s)) for i, (h, s) in enumerate(zip(htd, spin, strict=True))], "k int, i int, head_tail_distance double, major_axis double, angular_velocity double")
    rows = events.behaviour(df, T, 5.0).orderBy("i").collect()
    assert [r.turn for r in rows] == plain_turns(htd, axis, spin, 5.0)


def test_inner_cubic_fill():
    x = np.array([np.nan, 1, 8, np.nan, 64, 125, np.nan])
    out, ok = K.fill_inner_cubic(x)
    assert ok and np.isnan(out[[0, 6]]).all() and abs(out[3] - 27) < 1e-9
    assert K.fill_inner_cubic(np.array([1.0, np.nan, 2.0]))[1] is False
    assert K.fill_inner_cubic(np.full(3, np.nan))[1] and K.fill_inner_cubic(np.arange(3.0))[1]
    t = np.sort(np.random.default_rng(1).choice(5000, 2000, replace=False)).astype(float)
    big = K.cubic_spline(t, np.sin(t / 50), t)
    np.testing.assert_allclose(big, np.sin(t / 50), atol=1e-9)


def test_food_edge(spark):
    poses = moving_poses(40, missing=(7,))
    rng = np.random.default_rng(2)
    ring = np.column_stack((np.cos(np.linspace(0, 6, 30)), np.sin(np.linspace(0, 6, 30)))) * 90 + rng.normal(0, 1, (30, 2))
    contour = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(ring)], "file_id int, seq int, x double, y double")
    df = features.part_coordinates(pose_rows(spark, poses))
    rows = features.food_features(df, contour, ["file_id"]).orderBy("timestamp").collect()
    for r, p in zip(rows, poses, strict=True):
        if np.isnan(p).any():
            assert r.dist_from_food_edge is None and r.orientation_food_edge is None
            continue
        c, v = p[8:41].mean(0), p[8] - p[40]
        d = np.hypot(*(ring - c).T)
        k = int(np.argmin(d))
        u = ring[(k + 1) % 30] - ring[k - 1]
        normal = np.array([u[1], -u[0]]) / np.hypot(*u)
        inside = False
        for q, s in zip(ring, np.roll(ring, -1, 0), strict=True):
            if (q[1] > c[1]) != (s[1] > c[1]) and c[0] < (s[0] - q[0]) * (c[1] - q[1]) / (s[1] - q[1]) + q[0]:
                inside = not inside
        assert abs(r.dist_from_food_edge - (d[k] if inside else -d[k])) < 1e-9
        assert abs(r.orientation_food_edge - (90 - math.degrees(math.acos(normal @ v / np.hypot(*v))))) < 1e-6


def test_assembled_series(spark):
    poses = moving_poses(80, missing=(20, 21))
    df = pose_rows(spark, poses)
    out = features.frame_features(df, Track(), 25.0)
    assert out.columns == ["file_id", "worm_index", "timestamp", *features.SERIES, *features.EVENTS, *features.AUXILIARY]
    assert (len(features.BASE), len(features.SERIES), len(features.SIDED), len(out.columns) - 3) == (69, 138, 86, 150)
    plain = out.orderBy("timestamp").toPandas()
    turned = features.frame_features(df, Track(), 25.0, side=F.lit("clockwise")).orderBy("timestamp").toPandas()
    for c in features.SERIES:
        if plain[c].notna().any():
            np.testing.assert_allclose(turned[c], -plain[c] if c in features.SIDED else plain[c], err_msg=c)
    np.testing.assert_allclose(plain["d_length"].to_numpy(float)[4:-4], (plain["length"].to_numpy(float)[8:] - plain["length"].to_numpy(float)[:-8]) / (8 / 25))
    assert plain["area"].isna().all() and plain["dist_from_food_edge"].isna().all()
    for part in ("body", "tail", "midbody", "head"):
        c = poses[:, slice(*PARTS[part])].mean(1)
        np.testing.assert_allclose(plain[f"path_curvature_{part}"].to_numpy(float), K.path_curvature(c[:, 0], c[:, 1], 11.0), err_msg=part)


def test_track_kernels_keep_rows_of_equal_order(spark):
    df = spark.createDataFrame([(0, 1, 5.0, "a"), (0, 1, 6.0, "b"), (0, 2, 7.0, "c"), (1, 1, None, "d")], "k int, i int, x double, s string")
    out = K.with_tracks(df, ("k",), ("i",), ["x"], lambda p: {"y": p["x"].to_numpy(float) * 2}, {"y": "double"})
    assert sorted(out.select("s", "y").collect(), key=lambda r: r.s) == [("a", 10.0), ("b", 12.0), ("c", 14.0), ("d", None)]


def test_looking_ahead_takes_time_in_proportion_to_a_track(spark):
    """Twice as many rows of one track take about twice the time, not four times, where values ahead are looked for."""

    def seconds(rows):
        df = spark.range(0, rows, 1, 4).select(F.lit(1).alias("file_id"), F.lit(1).alias("worm_index"), F.col("id").alias("timestamp"))
        df = df.withColumns({"length": F.lit(1000.0), "speed": F.when(F.col("timestamp") % 7 != 0, 100 * F.sin(F.col("timestamp") / 500))})
        out = events.motion_mode(df, Track(), 25.0)
        out = out.withColumn("filled", timeseries.lerp(F.col("speed"), F.col("timestamp"), Track()))
        began = time.time()
        assert out.agg(F.count("motion_mode"), F.count("filled")).first()[1] == rows
        return time.time() - began

    seconds(2_000)
    assert seconds(100_000) < 20
    assert seconds(40_000) < 3 * seconds(20_000) + 2
