import numpy as np
from pyspark.sql import functions as F

from trackloom.functions import kernels as K
from trackloom.functions.bodies import skeletons_from_sides
from trackloom.functions.timeseries import Track
from trackloom.operators import tracking


def test_gradients_and_crossings():
    x = np.arange(10.0) ** 2
    np.testing.assert_allclose(K.wide_gradient(x, 3)[1:-1], 2 * np.arange(1, 9))
    before, after = K.zero_crossings(np.array([1, 1, -1, -1, 1, 1.0]))
    assert before.tolist() == [-1, -1, -1, 2, 2, 4] and after.tolist() == [2, 2, 4, 4, -1, -1]


def test_skeletons_and_straightening():
    left, right = [(x, 2.0) for x in range(11)], [(x, -2.0) for x in range(11)]
    mid, wide = (x[0] for x in skeletons_from_sides(np.array([left], float), np.array([right], float), 5))
    assert mid[:, 0].tolist() == [0, 2.5, 5, 7.5, 10] and (wide == 4).all() and (mid[:, 1] == 0).all()
    image = np.tile(np.arange(20.0)[:, None], (1, 30))
    flat = K.straighten(image, np.column_stack((np.arange(5, 25.0), np.full(20, 10.0))), 4, 9)
    np.testing.assert_allclose(flat, np.tile(np.arange(6.0, 15.0), (20, 1)))


def test_orientation_by_intensity(spark):
    base = [1.0, 2.0, 3.0, 9.0, 4.0]
    rows = [(0, 0, i, base[::-1] if 10 <= i < 16 or i == 3 else (None if i == 5 else base)) for i in range(30)]
    df = spark.createDataFrame(rows, "file_id int, worm_index int, timestamp int, profile array<double>")
    out = tracking.orient_by_intensity(df, Track(), "profile", 3).where("is_switched").orderBy("timestamp").collect()
    assert [r.timestamp for r in out] == list(range(10, 16))


def test_single_animal_and_stage(spark):
    rows = [(0, f, 2 * f + a, 10.0 * f if a else 200.0 - f, 0.0, 50.0) for f in range(6) for a in range(2)]
    df = spark.createDataFrame(rows, "file_id int, frame_number int, row_id long, coord_x double, coord_y double, area double")
    assert sorted(r.row_id for r in tracking.pick_single_animal(df, max_distance=20.0).collect()) == [1, 3, 5, 7, 9, 11]
    v = np.ones(200)
    v[[32, 82, 152]] = 100
    frames = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(v)], "file_id int, frame long, variance double")
    moves = spark.createDataFrame([(0, k, s) for k, s in enumerate((3.0, 8.0, 12.0, 15.0))], "file_id int, move int, seconds double")
    assert {r.move: r.frame for r in tracking.align_stage_moves(frames, moves, 10.0).collect()} == {0: 32, 1: 82, 2: None, 3: 152}


def test_head_and_tail_by_movement(spark):
    rng = np.random.default_rng(0)
    rows = [(0, 1, i, float(rng.normal(0, 0.1 if i < 50 else 1)), float(rng.normal(0, 1 if i < 50 else 0.1))) for i in [*range(50), *range(70, 120)]]
    df = spark.createDataFrame(rows, "file_id int, worm_index int, timestamp int, head double, tail double")
    out = tracking.orient_by_movement(df, Track(), "head", "tail", "timestamp", 10, 10, 5)
    assert out.where(F.col("timestamp") < 50).select("is_switched").distinct().collect() == [(True,)]
    assert out.where(F.col("timestamp") >= 70).select("is_switched").distinct().collect() == [(False,)]


def test_linked_frames_in_blocks():
    rng = np.random.default_rng(7)
    prev, cur = (tuple(rng.uniform(1, 40, n) for _ in range(3)) for n in (60, 70))
    cur[2][5] = np.nan
    whole = K.link_frame(prev, cur, 6.0, (0.5, 2.0))
    np.testing.assert_array_equal(whole, K.link_frame(prev, cur, 6.0, (0.5, 2.0), block=130))
    assert (whole >= 0).any() and len(set(whole[whole >= 0])) == (whole >= 0).sum() and whole[5] == -1
    cost = np.hypot(cur[0][:, None] - prev[0], cur[1][:, None] - prev[1])
    share = prev[2] / cur[2][:, None]
    cost = np.where((share >= 0.5) & (share <= 2), cost, 1e20)
    for i, j in enumerate(whole):
        if j >= 0:
            assert cost[i, j] == cost[i].min() <= 6


def test_linking_ties_of_roots_of_squares():
    """Both previous points are as far from the first one by the root of squares, the second nearer by hypot."""
    prev = (np.array([6.96, 0.26]), np.array([6.0, 6.0]), np.array([9.0, 9.0]))
    cur = (np.array([3.61, -4.74]), np.array([0.0, 6.0]), np.array([9.0, 9.0]))
    assert K.link_frame(prev, cur, 10.0, (0.5, 2.0)).tolist() == [0, 1]
