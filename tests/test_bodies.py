"""Outlines of drawn bodies whose middle lines and widths are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import bodies
from trackloom.operators import features, images


def drawn(bend, waves=1.0, length=110.0, size=200, wide=6.5, n=300):
    """(mask, middle line, half widths) of a tapered body that bends by ``bend`` radians, in waves or (0) in one arc."""
    t = np.linspace(0, 1, n)
    angle = bend * np.sin(2 * np.pi * waves * t) if waves else bend * t
    line = np.cumsum(np.column_stack((np.cos(angle), np.sin(angle))) * length / n, axis=0)
    line += size / 2 - line.mean(0)
    half = np.maximum(wide * np.sin(np.pi * (0.03 + 0.97 * t)) ** 0.6, 0.5)
    y, x = np.mgrid[:size, :size]
    mask = np.zeros((size, size), bool)
    for (a, b), r in zip(line, half, strict=True):
        mask |= np.hypot(x - a, y - b) <= r
    return mask, line, half


def misfit(pose, line, half):
    """The largest distances of the middle line and of inner widths from those drawn, for the better direction."""
    want, wide = bodies.resample_line(line, 2 * half, 49)
    found = []
    for s, w in ((pose["skeleton"], pose["widths"]), (pose["skeleton"][::-1], pose["widths"][::-1])):
        found.append((np.hypot(*(s - want).T).max(), np.abs(w - wide)[3:-3].max()))
    return min(found)


@pytest.mark.parametrize(("bend", "waves"), [(0.1, 0), (0.3, 1), (1.0, 1), (1.5, 1), (1.2, 1.5), (1.5, 0), (2.5, 0), (3.5, 0), (4.2, 0), (5.0, 0), (6.0, 0)])
def test_bent_bodies_get_their_middle_line(bend, waves):
    mask, line, half = drawn(bend, waves)
    pose, code = bodies.body_pose(images.trace_contour(mask))
    off, wide = misfit(pose, line, half)
    assert code == bodies.OK and off < 2.2 and wide < 2.2
    assert np.hypot(*(pose["ventral"][0] - pose["dorsal"][0])) < 1e-9


def test_specks_on_necks_and_loops_go():
    mask, line, half = drawn(0.8)
    y, x = np.mgrid[:200, :200]
    cx, cy = line[150]
    speck = mask | ((np.abs(x - cx) <= 1) & (y < cy) & (y > cy - 14)) | (np.hypot(x - cx, y - cy + 17) <= 5)
    pose, code = bodies.body_pose(images.trace_contour(speck))
    assert code == bodies.OK and misfit(pose, line, half)[0] < 2.5
    t = np.linspace(0, 2 * np.pi, 300, endpoint=False)
    ellipse = np.column_stack((50 * np.cos(t), 8 * np.sin(t)))
    u = np.linspace(0, 2 * np.pi, 40)
    loop = np.column_stack((3 * np.sin(u), 3 - 3 * np.cos(u))) + ellipse[75]
    plain = abs(bodies.signed_area(bodies.clean_outline(ellipse)))
    for turned in (loop, loop[::-1]):
        clean = bodies.clean_outline(np.vstack((ellipse[:75], turned, ellipse[76:])))
        assert abs(abs(bodies.signed_area(clean)) - plain) < 0.02 * plain and clean[:, 1].max() < 8.6


def test_thin_ends_stay():
    t = np.linspace(0, 1, 200)
    half = 8 * (1 - t) ** 0.5 * np.minimum(1, 8 * t) ** 0.5
    line = np.column_stack((120 * t, 15 * np.sin(4 * t)))
    outline = np.vstack((line + np.column_stack((0 * t, half)), (line - np.column_stack((0 * t, half)))[::-1]))
    assert bodies.clean_outline(outline)[:, 0].max() > 115


def test_codes_of_outlines_without_a_pose():
    y, x = np.mgrid[:100, :100]
    disc = np.hypot(x - 50, y - 50) < 30
    assert bodies.body_pose(images.trace_contour(disc)) == (None, bodies.FEW_ENDS)
    t = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    star = np.column_stack((np.cos(t), np.sin(t))) * (8 + 40 * np.abs(np.cos(1.5 * t)) ** 8)[:, None]
    assert bodies.body_pose(star) == (None, bodies.MANY_ENDS)
    assert bodies.body_pose(np.zeros((0, 2))) == (None, bodies.EMPTY)
    assert bodies.body_pose(np.zeros((60, 2))) == (None, bodies.EMPTY)


def test_sides_are_matched_along_normals():
    """Sides of unlike length, as at a bend, with points at other places on each: widths within a fraction of a pixel."""
    for bend in (0.3, 1.5, 3.0):
        t = np.linspace(0, 1, 400)
        line = np.cumsum(np.column_stack((np.cos(bend * t), np.sin(bend * t))), axis=0) * 0.4
        half = 7 * np.sin(np.pi * t) ** 0.5
        normal = np.column_stack((-np.sin(bend * t), np.cos(bend * t)))
        left, right = (line + normal * half[:, None])[::2], (line - normal * half[:, None])[::3]
        left, right = (np.vstack((line[0], s, line[-1])) for s in (left, right))
        lines, widths = bodies.skeletons_from_sides([left], [right])
        want, wide = bodies.resample_line(line, 2 * half, 49)
        assert np.hypot(*(lines[0] - want).T).max() < 1.0 and np.abs(widths[0] - wide)[2:-2].max() < 1.0


def test_skeletons_of_poses(spark):
    rows = []
    for k in range(5):
        t = np.linspace(0, 1, 49)
        line, half = np.column_stack((100 * t, 10 * np.sin(3 * t + k))), 5 * np.sin(np.pi * t)
        rows.append((k, *([{"x": float(x), "y": float(y)} for x, y in line + np.column_stack((0 * t, s * half))] for s in (1, -1))))
    rows += [(5, None, rows[0][2]), (6, rows[0][1], None), (7, [], [])]
    df = spark.createDataFrame(rows, "frame int, ventral array<struct<x:double,y:double>>, dorsal array<struct<x:double,y:double>>")
    out = {r["frame"]: r for r in features.skeletons(df).collect()}
    assert all(out[k]["skeleton"] is None and out[k]["widths"] is None for k in (5, 6, 7))
    for k in range(5):
        assert len(out[k]["skeleton"]) == 49 and max(out[k]["widths"]) == pytest.approx(9.5, abs=1)
    assert features.skeletons(df.limit(0)).count() == 0


def test_contours_pass_pinches_once_for_each_part():
    legs = np.zeros((45, 41), bool)
    for k in range(20):
        legs[1 + 2 * k : 4 + 2 * k, 20 - k] = legs[1 + 2 * k : 4 + 2 * k, 20 + k] = True
    contour = images.trace_contour(legs)
    assert contour[:, 0].min() == 1 and contour[:, 0].max() == 39
    two = np.zeros((12, 24), bool)
    two[1:9, 1:9] = two[2:10, 12:22] = True
    two[5, 8:13] = True  # a bridge one pixel wide
    contour = images.trace_contour(two)
    assert contour[:, 0].min() == 1 and contour[:, 0].max() == 21 and (contour == [10, 5]).all(1).sum() == 2
    assert images.trace_contour(np.eye(5, dtype=bool)).tolist() == [[0, 0], [1, 1], [2, 2], [3, 3], [4, 4], [3, 3], [2, 2], [1, 1]]
    one = np.zeros((3, 3), bool)
    one[1, 1] = True
    assert images.trace_contour(one).tolist() == [[1, 1]]


def test_poses_follow_the_last_one_before_a_gap(spark):
    rows = []
    for k in range(5):
        mask = drawn(0.5 + 0.05 * k)[0] if k != 2 else np.zeros((200, 200), bool)
        rows.append((0, 1, k, 200, 200, bytearray(np.where(mask, 50, 200).astype(np.uint8).tobytes()), 0.0, 0.0))
    rois = spark.createDataFrame(rows, "file_id int, worm_index_joined int, frame_number int, h int, w int, pixels binary, roi_x double, roi_y double")
    out = images.poses_of_rois(rois.repartition(3)).orderBy("frame_number").collect()
    assert [r["code"] for r in out] == [1, 1, bodies.EMPTY, 1, 1] and out[2]["skeleton"] is None
    heads = np.array([(r["skeleton"][0]["x"], r["skeleton"][0]["y"]) for r in out if r["skeleton"]])
    assert np.hypot(*np.diff(heads, axis=0).T).max() < 8
    assert images.poses_of_rois(rois).where(F.col("skeleton").isNotNull()).count() == 4


def test_curvature_of_noisy_circles():
    from trackloom.functions import kernels

    rng = np.random.default_rng(0)
    t = np.linspace(0, 2, 49)
    poses = np.stack([np.column_stack((r * np.cos(t), r * np.sin(t))) + rng.normal(0, s, (49, 2)) for r in (60, 120) for s in (0, 0.7)])
    poses = np.concatenate((poses, np.full((1, 49, 2), np.nan)))
    got = kernels.curvature_spline(poses, residual=0.7**2 * 49)
    assert np.isnan(got[4]).all()
    for row, r in zip(got, (60, 60, 120, 120), strict=False):
        assert np.median(np.abs(row[5:-5] - 1 / r)) < 0.3 / r
    exact = kernels.smoothing_spline(poses[:1, :, 0], residual=1e-12)
    np.testing.assert_allclose(exact, poses[:1, :, 0], atol=1e-5)
    line = kernels.smoothing_spline(np.arange(20.0)[None] + rng.normal(0, 0.1, (1, 20)), residual=100.0)
    assert np.abs(np.diff(line[0], n=3)).max() < 1e-6
    assert features.curvature.__doc__ and "spline" in kernels.CURVATURES


def test_two_peaks_give_an_axis(spark):
    y, x = np.mgrid[:60, :80]
    bump = lambda cx, cy, s, h: h * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * s * s))
    cases = {
        0: (bump(30, 30, 7, 200) + bump(50, 34, 5, 180), [(30, 30), (50, 34)]),
        1: (bump(50, 34, 7, 190) + bump(30, 30, 5, 200), [(50, 34), (30, 30)]),
        2: (bump(40, 30, 8, 220), None),
        3: (bump(20, 30, 5, 200) + bump(40, 30, 5, 200) + bump(60, 30, 5, 200), None),
        4: (np.zeros((60, 80)), None),
    }
    rows = [(k, 60, 80, bytearray(np.clip(a, 0, 255).astype(np.uint8).tobytes()), 100.0, 10.0, 40.0) for k, (a, _) in cases.items()]
    rois = spark.createDataFrame(rows, "frame_number int, h int, w int, pixels binary, roi_x double, roi_y double, area double")
    out = {r["frame_number"]: r["skeleton"] for r in images.two_point_axes(rois, ("frame_number",)).collect()}
    for k, (_, want) in cases.items():
        if want is None:
            assert out[k] is None
        else:
            assert len(out[k]) == 2 and all(np.hypot(p["x"] - 100 - cx, p["y"] - 10 - cy) <= 2 for p, (cx, cy) in zip(out[k], want, strict=True))


def test_a_broken_ring_gives_one_smooth_contour(spark):
    rng = np.random.default_rng(4)
    y, x = np.mgrid[:220, :260]
    angle, away = np.arctan2(y - 108, x - 133), np.hypot(x - 133, y - 108)
    border = 70 + 5 * np.cos(2 * angle)
    rim = (np.abs(away - border) < 2.5) & (np.abs(np.sin(2.5 * angle)) > 0.25)  # five gaps
    a = np.where(rim, 120, 150) + rng.integers(-2, 3, (220, 260))
    for cx, cy in rng.integers(10, 200, (8, 2)):  # spots
        a[cy : cy + 5, cx : cx + 5] = 110
    frames = spark.createDataFrame([(0, 220, 260, bytearray(a.astype(np.uint8).tobytes())), (1, 60, 60, bytearray(np.full(3600, 90, np.uint8).tobytes()))], "file_id int, h int, w int, pixels binary")
    out = images.food_contours(frames, method="ring").orderBy("file_id", "seq").collect()
    assert {r["file_id"] for r in out} == {0} and len(out) == 480
    p = np.array([(r["x"], r["y"]) for r in out]) - [133, 108]
    off = np.hypot(*p.T) - 70 - 5 * np.cos(2 * np.arctan2(p[:, 1], p[:, 0]))
    assert np.abs(off).mean() < 1.5 and np.abs(off).max() < 4
    assert np.hypot(*np.diff(np.vstack((p, p[:1])), axis=0).T).max() < 3


def test_local_fits_and_circles():
    from trackloom.functions import kernels

    x = np.linspace(0, 10, 80)
    y = np.sin(x)
    y[[10, 40, 41]] += 5
    assert np.abs(kernels.lowess(x, y, 0.12) - np.sin(x)).max() < 0.12
    np.testing.assert_allclose(kernels.lowess(x, 2 * x + 1, 0.2), 2 * x + 1, atol=1e-9)
    t = np.linspace(0, 4, 60)
    points = np.vstack((np.column_stack((30 + 20 * np.cos(t), 40 + 20 * np.sin(t))), np.random.default_rng(0).uniform(0, 80, (30, 2))))
    assert np.allclose(kernels.best_circle(points, 1.0, 5, 50), (30, 40, 20), atol=0.5)
    assert kernels.best_circle(points[:2], 1.0, 5, 50) is None and kernels.best_circle(np.zeros((9, 2)), 1.0, 5, 50) is None
    assert images.thinned(np.pad(np.ones((5, 30), bool), 3)).sum() < 60


def test_curves_and_polygons_of_tables(spark):
    pose = lambda pts: [{"x": float(x), "y": float(y)} for x, y in pts]
    square = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    rows = [(0, pose(square)), (1, None), (2, []), (3, pose([(5, 5)])), (4, pose([(0, 0), (3, 4)]))]
    df = spark.createDataFrame(rows, "k int, skeleton array<struct<x:double,y:double>>")
    even = {r["k"]: r["skeleton"] for r in features.resampled(df, "skeleton", 5).collect()}
    assert [(p["x"], p["y"]) for p in even[0]] == [tuple(map(float, p)) for p in square] and even[1] is None and even[2] is None
    assert [p["x"] for p in even[3]] == [5.0] * 5 and [p["y"] for p in even[4]] == [0, 1, 2, 3, 4]
    round_ = {r["k"]: r["skeleton"] for r in features.smoothed_polygons(df, "skeleton", 80, 9).collect()}
    assert len(round_[0]) == 80 and round_[1] is None and round_[2] is None and round_[3] is None
    assert features.resampled(df.limit(0), "skeleton", 5).count() == 0 and features.smoothed_polygons(df.limit(0), "skeleton").count() == 0


def test_coil_test_of_tables(spark):
    side = lambda d: [{"x": float(i), "y": float(d)} for i in range(49)]
    wide = [5.0] * 49
    fat = [2.0] * 16 + [9.0] * 17 + [2.0] * 16
    rows = [(0, side(2), side(-2), wide), (1, side(2), side(-2), fat), (2, None, None, None), (3, side(2), side(-2), [0.0] * 49)]
    df = spark.createDataFrame(rows, "k int, ventral array<struct<x:double,y:double>>, dorsal array<struct<x:double,y:double>>, widths array<double>")
    assert {r["k"]: r["may_coil"] for r in features.coil_test(df).collect()} == {0: False, 1: True, 2: None, 3: True}


def test_profiles_along_bodies(spark):
    a = np.tile(np.arange(30, dtype=np.uint8)[:, None], (1, 40))
    rois = spark.createDataFrame([(k, 30, 40, bytearray(a.tobytes()), 100.0, 50.0) for k in range(3)], "frame_number int, h int, w int, pixels binary, roi_x double, roi_y double")
    line = [{"x": 105.0 + i, "y": 60.5} for i in range(20)]
    poses = spark.createDataFrame([(0, line), (1, None), (2, line[:1])], "frame_number int, skeleton array<struct<x:double,y:double>>")
    out = {r["frame_number"]: r for r in images.intensity_profiles(rois, poses, ("frame_number",), 3.0, 7, points=10).collect()}
    assert out[0]["profile"] == pytest.approx([10.5] * 10) and len(out[0]["intensity_map"]) == 10 * 7 * 8
    assert out[1]["profile"] is None and out[2]["profile"] is None
