import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import geometry as G
from trackloom.functions import kernels as K
from trackloom.functions import timeseries as S

def win():
    return Window.partitionBy("k").orderBy("i")


TRACK = S.Track(("k",), ("i",))


def column(spark, values, expr):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "k int, i int, x double")
    return [r[0] for r in df.withColumn("o", expr(F.col("x"))).orderBy("i").select("o").collect()]


def test_unwrap_equals_numpy(spark):
    x = np.cumsum(np.random.default_rng(0).normal(0, 2, 60))
    wrapped = (x + math.pi) % (2 * math.pi) - math.pi
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(wrapped)], "k int, i int, x double")
    got = [r.o for r in S.unwrap(df, "x", S.Track(("k",), ("i",)), "o").orderBy("i").collect()]
    np.testing.assert_allclose(got, np.unwrap(wrapped), atol=1e-9)


def test_fills_and_rolling(spark):
    v = [None, 1.0, None, None, 4.0, None, 6.0, None]
    assert column(spark, v, lambda x: S.ffill(x, win())) == [None, 1, 1, 1, 4, 4, 6, 6]
    assert column(spark, v, lambda x: S.fill_both(x, TRACK)) == [1, 1, 1, 1, 4, 4, 6, 6]
    assert column(spark, v, lambda x: S.lerp(x, F.col("i"), TRACK)) == [1, 1, 2, 3, 4, 5, 6, 6]
    assert column(spark, v, lambda x: S.lerp(x, F.col("i"), TRACK, max_gap=1, hold_edges=False)) == [None, 1, None, None, 4, 5, 6, None]
    x = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0]
    assert column(spark, x, lambda c: S.rolling_mean(c, win(), 3)) == [None, 7 / 3, 14 / 3, 28 / 3, 56 / 3, None]
    assert column(spark, x, lambda c: S.central_difference(c, win(), 3, 1.5)) == [None, (8 - 1) / 2, (16 - 2) / 2, (32 - 4) / 2, None, None]
    np.testing.assert_allclose([v if v is not None else np.nan for v in column(spark, x, lambda c: S.rolling_std(c, win(), 3, 2))], pd.Series(x).rolling(3, min_periods=2).std())
    assert S.delta_frames(25, 0.1) == 2 and S.delta_frames(1, 0.1) == 1


def test_savgol_is_exact_on_cubics():
    t = np.arange(40.0)
    x = 2 + t - 0.3 * t**2 + 0.01 * t**3
    np.testing.assert_allclose(K.savgol(x, 9), x, atol=1e-8)
    np.testing.assert_allclose(K.savgol(x, 9, 3, 1), 1 - 0.6 * t + 0.03 * t**2, atol=1e-8)


def test_splines_resampling_hull_and_peaks():
    t = np.array([0, 1, 3, 4, 7.0])
    f = lambda u: 1 - u + u**2 - 0.2 * u**3
    np.testing.assert_allclose(K.cubic_spline(t, f(t), np.linspace(0, 7, 20)), f(np.linspace(0, 7, 20)), atol=1e-9)
    gap = f(np.arange(10.0))
    gap[[3, 4, 9]] = np.nan
    np.testing.assert_allclose(K.fill_cubic(gap)[:9], f(np.arange(9.0)), atol=1e-9)
    assert K.resample_curve([(0, 0), (1, 0), (1, 3)], 5).tolist() == [[0, 0], [1, 0], [1, 1], [1, 2], [1, 3]]
    a, b, q = K.min_rectangle([(0, 0), (4, 0), (4, 3), (0, 3), (2, 1)])
    assert (round(a, 9), round(b, 9)) == (4, 3) and math.isclose(q, math.sqrt(1 - 9 / 16))
    assert K.greedy_peaks(np.array([1, 5, 4, 3, 6, 0]), 1).tolist() == [1, 4]
    freq, amp = K.fft_peak(2 * np.sin(2 * np.pi * 2 * np.arange(250) / 25), 25, 0.5, 5)
    assert abs(freq - 2) < 1e-9 and abs(amp - 2) < 0.1
    assert K.median_filter(np.array([1, 9, 2, 3]), 3).tolist() == [1, 2, 3, 3]


def test_robust_covariance_ignores_outliers():
    rng = np.random.default_rng(3)
    x = np.vstack((rng.normal(size=(200, 2)), rng.normal(30, 1, size=(40, 2))))
    centre, cov = K.robust_covariance(x)
    d = K.mahalanobis(x, centre, cov)
    assert np.abs(centre).max() < 0.4 and d[200:].min() > d[:200].max()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=60), st.integers(0, 4))
def test_region_flags(x, least):
    flag = K.three_regions(np.array(x), 1.0, 2.0, 1, least)
    extreme = np.where(np.array(x) > 2, 1, np.where(np.array(x) < -2, -1, 0))
    assert set(np.unique(flag)) <= {-1, 0, 1} and len(flag) == len(x)
    if not (extreme == 1).any():
        assert (flag <= 0).all()


def test_pose_geometry(spark):
    line = [{"x": float(i), "y": 0.0} for i in range(49)]
    up = [{"x": float(i), "y": 2.0} for i in range(49)]
    df = spark.createDataFrame([(line, up, [1.0] * 49)], "p array<struct<x:double,y:double>>, q array<struct<x:double,y:double>>, w array<double>")
    p = F.col("p")
    r = df.select(G.length(p).alias("l"), G.area(p, F.col("q")).alias("a"), G.head_tail_distance(p).alias("h"), G.width_of(F.col("w"), "midbody").alias("w"), G.centroid(p)["x"].alias("c"), F.array_max(F.transform(G.tangent_angles(p), F.abs)).alias("t"), G.eccentricity(p)[0].alias("e"), G.amplitude(p)[0].alias("m"), F.size(G.part(p, "head")).alias("n"), F.array_max(F.filter(G.bend_angles(p), lambda x: x.isNotNull())).alias("b")).first()
    assert np.allclose((r.l, r.a, r.h, r.w, r.c, r.t, r.e, r.m, r.n, r.b), (48, 96, 48, 1, 24, 0, 1, 0, 8, 0))
    assert np.allclose(np.array(G.cosine_basis(48, 7)) @ np.array(G.cosine_basis(48, 7)).T, np.eye(7))


def test_savgol_columns_equal_the_kernel(spark):
    x = np.random.default_rng(5).normal(size=40)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)] + [(1, i, float(i * i)) for i in range(4)], "k int, i int, x double")
    got = [r.o for r in df.withColumn("o", S.savgol(F.col("x"), S.Track(("k",), ("i",)), 9)).orderBy("k", "i").collect()]
    np.testing.assert_allclose(got[:40], K.savgol(x, 9), atol=1e-9)
    assert got[40:] == [0, 1, 4, 9]


def test_windowed_spectra_equal_single_ones():
    x = np.sin(np.arange(200) / 3) + np.random.default_rng(1).normal(0, 0.1, 200)
    freq, amp = K.short_time_peak(x, 25.0, 31, 0.5, 10.0, 0.1, block=37)
    for i in (15, 16, 99, 184):
        f, a = K.fft_peak(x[i - 15 : i + 16], 25.0, 0.5, 10.0, 0.1)
        np.testing.assert_allclose((freq[i], amp[i]), (f, a))
    assert np.isnan(freq[:15]).all() and np.isnan(freq[185:]).all()


def test_polygons_waves_and_coils():
    a = np.linspace(0, 2 * np.pi, 200)
    ring = np.column_stack((np.cos(a), np.sin(a))) * 100 + np.random.default_rng(0).normal(0, 1, (200, 2))
    smooth = K.smooth_polygon(ring)
    assert smooth.shape == (1000, 2) and np.abs(np.hypot(*smooth.T) - 100).max() < 4
    x = np.linspace(480, 0, 49)
    wave = np.column_stack((x, 20 * np.sin(2 * np.pi * x / 160)))
    first, second = K.wavelengths(wave)
    assert abs(first - 160) < 25 and np.isfinite(second)
    side = np.column_stack((x, np.full(49, 5.0)))
    flat = np.full(49, 10.0)
    assert not K.is_coil(flat, side, side * [1, -1]) and K.is_coil(np.where(np.arange(49) // 17 == 1, 30.0, 10.0), side, side * [1, -1])


def test_savgol_needs_a_window():
    with pytest.raises(ValueError):
        K.savgol(np.arange(3.0), 5)
