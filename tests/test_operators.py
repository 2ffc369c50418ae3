import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions.timeseries import Track
from trackloom.operators import events, features, images, islands, joins, selection, summary, tracking, wells
from trackloom.plans.stages import Parameters, Plan, Stage, file_states, next_steps, steps
from trackloom.sources import export, ingest
from trackloom.streaming import stream

T = Track(("k",), ("i",))


def test_mask_runs_of_all_short_vectors(spark):
    """Runs by padded differences, for every boolean vector of up to 7 rows."""
    vectors = [v for n in range(1, 8) for v in itertools.product([False, True], repeat=n)]
    df = spark.createDataFrame([(k, i, b) for k, v in enumerate(vectors) for i, b in enumerate(v)], "k int, i int, b boolean")
    got = sorted(tuple(r) for r in islands.mask_runs(df, F.col("b"), T).collect())
    want = []
    for k, v in enumerate(vectors):
        d = np.diff(np.array([0, *map(int, v), 0]))
        n = len(v)
        for a, b in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1), strict=True):
            start, end = max(a - 1, 0), min(max(b - 1, 0), n - 1)
            if end - start > 0:
                want.append((k, start, end, end - start, 1 if end >= n - 1 else -1 if start <= 0 else 0))
    assert got == sorted(want)


def test_windows_grammar():
    assert selection.parse_windows("") == [(0, None)]
    assert selection.parse_windows("0:60, 120:end") == [(0, 60), (120, None)]
    assert selection.parse_windows("0:100:30") == [(0, 30), (30, 60), (60, 90), (90, 100)]
    for bad in ("5:3", "0:end:10", "1:2:3:4", "5"):
        with pytest.raises(ValueError):
            selection.parse_windows(bad)
    assert selection.select_features(["a_x", "b_x", "c"], ["﻿c", "a_x"], exclude="b") == ["c", "a_x"]


def test_window_join_by_buckets(spark, monkeypatch):
    df = spark.range(50).withColumn("at", F.col("id"))
    w = spark.createDataFrame([(i, i * 3, i * 3 + 10 if i % 4 else None) for i in range(20)], "w int, start long, end long")
    few = sorted(map(tuple, joins.window_join(df, w, "at").select("id", "w").collect()))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 5)
    assert sorted(map(tuple, joins.window_join(df, w, "at").select("id", "w").collect())) == few


def test_linking_and_gap_joining(spark):
    """Animal 0 is missing in frame 3: both last places pick animal 1 there (a merge), both animals pick it after (a split)."""
    rows = [(0, f, 10 * f + a, 40.0 * a + f, 5.0, 100.0, 15.0) for f in range(7) for a in range(2) if (a, f) != (0, 3)]
    df = spark.createDataFrame(rows, "file_id int, frame_number int, row_id long, coord_x double, coord_y double, area double, box_length double")
    linked = tracking.link_detections(df, max_distance=5.0)
    ids = {r.row_id: r.worm_index_blob for r in linked.collect()}
    assert [ids[k] for k in (0, 20, 1, 31, 40, 60, 41, 61)] == [1, 1, 2, 3, 4, 4, 5, 5]
    joined = {r.row_id: r.worm_index_joined for r in tracking.join_gaps(linked, max_gap=3).collect()}
    assert [joined[k] for k in (0, 60, 1, 31, 61)] == [1, 1, 2, 2, 2]
    none = {r.row_id: r.worm_index_joined for r in tracking.join_gaps(linked, max_gap=0, min_rows=3).collect()}
    assert [none[k] for k in (0, 60, 31, 61)] == [1, 4, None, 5]


def test_streamed_linking_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(f % 2, f // 2, 100 * f + a, float(rng.uniform(0, 60)), float(rng.uniform(0, 60)), float(rng.uniform(50, 150))) for f in range(24) for a in range(4)]
    df = spark.createDataFrame(rows, "file_id int, frame_number int, row_id long, coord_x double, coord_y double, area double")
    for part, (a, b) in enumerate(((0, 5), (5, 12))):
        df.where((F.col("frame_number") >= a) & (F.col("frame_number") < b)).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = stream.link_stream(src, 20.0).writeStream.format("memory").queryName("linked").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.file_id, r.row_id): r.worm_index_blob for r in spark.table("linked").collect()}
    want = {(r.file_id, r.row_id): r.worm_index_blob for r in tracking.link_detections(df, max_distance=20.0).collect()}
    assert got == want


def test_streaming_windows(spark, tmp_path):
    df = spark.createDataFrame([("a", m * 60, float(m)) for m in (0, 1, 2, 11, 30, 31)], "k string, s long, v double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    found = {}
    for name, make in {"t": lambda s: stream.tumbling(s, ["k"], "ts", "v", "10 minutes"), "s": lambda s: stream.session_blocks(s, ["k"], "ts", "v", "5 minutes"), "l": lambda s: stream.sliding(s, ["k"], "ts", "v", "10 minutes", "5 minutes"), "d": lambda s: stream.without_repeats(s, ["k"], "ts")}.items():
        src = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        q = make(src).writeStream.format("memory").queryName(f"w_{name}").option("checkpointLocation", f"{tmp_path}/{name}").outputMode("append" if name == "d" else "complete" if name != "s" else "append").start()
        q.processAllAvailable()
        q.stop()
        found[name] = spark.table(f"w_{name}").count()
    assert found["t"] == 3 and found["l"] == 6 and found["d"] == 1 and found["s"] >= 1


def test_manual_edits(spark):
    df = spark.createDataFrame([(t, f, 0) for t, fs in ((1, (0, 1)), (2, (3, 4)), (3, (1, 2, 3))) for f in fs], "worm int, frame_number int, worm_label int")
    df = tracking.set_label(df, "worm", [1], 2)
    merged = tracking.merge_tracks(df, "worm", 1, 2)
    assert {(r.worm, r.worm_label) for r in merged.collect()} == {(4, 2), (3, 0)}
    with pytest.raises(ValueError):
        tracking.merge_tracks(df, "worm", 1, 3)
    with pytest.raises(ValueError):
        tracking.merge_tracks(df, "worm", 1, 1)
    assert sorted(r.worm for r in tracking.split_track(df, "worm", 3, 2).collect()) == [1, 1, 2, 2, 4, 5, 5]


def test_event_statistics_fill_the_grid(spark):
    df = spark.createDataFrame([(0, w, t) for w in (1, 2) for t in range(11)], "file_id int, worm int, timestamp int")
    runs = spark.createDataFrame([(0, "motion_mode", 1, 4, 0), (0, "motion_mode", 1, 2, -1), (0, "motion_mode", 0, 2, 1)], "file_id int, event_type string, region int, duration int, edge_flag int")
    out = {(r.event_type, r.region): r for r in summary.event_statistics(runs, df, ["file_id"], {"motion_mode": (-1, 0, 1), "turn": (0, 1)}, 5.0).collect()}
    assert set(out) == {("motion_mode", v) for v in (-1, 0, 1)}
    assert out["motion_mode", -1].fraction == 0 and out["motion_mode", 1].fraction == 0.75
    assert out["motion_mode", 1].frequency == 1 / 2 / 2 and abs(out["motion_mode", 1].duration_50th - 0.6) < 1e-9


def poses(spark, n=30, speed=2.0):
    rows = []
    for t in range(n):
        body = [{"x": 5.0 * i - speed * t, "y": float(np.sin(i / 6 + t / 5))} for i in range(49)]
        rows.append((0, 1, t, body if t != 10 else None, [{"x": p["x"], "y": p["y"] + 3} for p in body], [{"x": p["x"], "y": p["y"] - 3} for p in body], [6.0] * 49))
    a = "array<struct<x:double,y:double>>"
    return spark.createDataFrame(rows, f"file_id int, worm_index int, timestamp int, skeleton {a}, ventral {a}, dorsal {a}, widths array<double>")


def test_frame_features_of_a_moving_body(spark):
    track = Track()
    p = poses(spark)
    box = spark.createDataFrame([(0, "A1", -1000.0, 1000.0, -1000.0, 1000.0)], "file_id int, well_name string, x_min double, x_max double, y_min double, y_max double")
    ring = spark.createDataFrame([(0, i, x, y) for i, (x, y) in enumerate([(-500.0, -500.0), (500.0, -500.0), (500.0, 500.0), (-500.0, 500.0)])], "file_id int, seq int, x double, y double")
    out = features.frame_features(p, track, 5.0, ring, box, F.lit("clockwise")).orderBy("timestamp").collect()
    assert len(out) == 30 and out[10].speed is None and out[15].well_name == "A1"
    assert abs(out[15].speed - 10.0) < 0.2 and abs(out[15].length - 240) < 3 and out[15].dist_from_food_edge > 0
    # The shoelace sum leaves out the edge that closes the contour.
    assert out[15].width_midbody == 6 and out[15].d_speed is not None and out[15].area > 0
    smooth = features.smooth_poses(p, track, 5).orderBy("timestamp").collect()
    assert smooth[10].skeleton is not None and abs(smooth[10].skeleton[0].x + 20) < 1e-6
    turned = tracking.flip_poses(p.withColumn("is_switched", F.lit(True))).where("timestamp = 0").first()
    assert turned.skeleton[0].x == 240 and turned.ventral[0].y < turned.dorsal[0].y
    odd = p.where("timestamp <> 10").withColumn("skeleton", F.when(F.col("timestamp") % 3 == 1, F.reverse("skeleton")).otherwise(F.col("skeleton")))
    flips = {r.timestamp: r.flip for r in tracking.consistent_flips(odd, track, "skeleton").collect()}
    assert all(f == (t % 3 == 1) for t, f in flips.items())


def test_motion_modes_and_durations(spark):
    v = [0.0] * 20 + [30.0] * 20 + [-30.0] * 20 + [0.0] * 20
    df = spark.createDataFrame([(0, i, x, 100.0) for i, x in enumerate(v)], "k int, i int, speed double, length double")
    out = events.motion_mode(df, T, 5.0)
    assert {r.motion_mode for r in out.where("i between 25 and 35").collect()} == {1}
    assert {r.motion_mode for r in out.where("i between 45 and 55").collect()} == {-1}
    runs = events.durations(out, T, {"motion_mode": (-1, 0, 1)})
    assert {r.region for r in runs.collect()} == {-1, 0, 1}
    found = events.find_events(df, T, "speed", "i", events.Finder(low=10, min_rows=5)).collect()
    assert [(r.start, r.end) for r in found] == [(20, 39)]
    lists = events.event_list(events.find_events(df, T, "speed", "i", events.Finder(low=10)), df.withColumn("d", F.lit(1.0)), T, "i", 5.0, "d")
    total = events.event_totals(lists, ["k"]).first()
    assert total.time_ratio == 0.25 and total.distance_ratio == 0.25 and total.frequency == 1 / 16
    labelled = events.label_by_events(df, T, "i", {1: events.find_events(df, T, "speed", "i", events.Finder(low=10)), -1: events.find_events(df, T, "speed", "i", events.Finder(high=-10))})
    assert labelled.where("motion_mode = 1").count() == 20 and labelled.where("motion_mode = -1").count() == 20


def test_images(spark):
    a = np.full((40, 50), 200, np.uint8)
    a[5:15, 10:20] = 50
    a[30:32, 30:45] = 60
    rows = [(0, f, 40, 50, bytearray(np.roll(a, f, 1).tobytes())) for f in range(3)]
    frames = spark.createDataFrame(rows, "file_id int, frame_number int, h int, w int, pixels binary")
    found = images.detect_blobs(frames, 100, 20).where("frame_number = 1").orderBy("blob").collect()
    assert [(r.area, r.coord_x, r.coord_y) for r in found] == [(100, 15.5, 9.5), (30, 38, 30.5)]
    assert images.background(frames).first().pixels == bytes(np.maximum.reduce([np.roll(a, f, 1) for f in range(3)]).tobytes())
    assert images.label_components(np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0], [1, 1, 0]], bool)).tolist() == [[1, 0, 1], [0, 1, 0], [0, 0, 0], [2, 2, 0]]
    masked = images.mask_frames(frames, block=21, offset=15, min_area=20, grow=1)
    assert masked.count() == 3 and images.mean_intensity(masked).where("intensity is not null").count() == 3
    less = images.subtract_background(frames, images.background(frames))
    assert less.count() == 3 and images.normalise(less).count() == 3
    tracks = spark.createDataFrame([(0, 0, 1, 15.0, 10.0, 12)], "file_id int, frame_number int, worm_index_joined int, coord_x double, coord_y double, roi_size int")
    roi = images.crop(frames, tracks).first()
    assert (roi.h, roi.w) == (12, 12) and np.frombuffer(roi.pixels, np.uint8).min() == 50


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.csv").write_text("junk\nReal Time,Media Time,Stage Position X,Stage Position Y\n10:00,0:01:02.5,1,2\n10:01,0:01:03\n10:02,1:00:00,3,4\n")
    log = ingest.stage_log(spark, f"{tmp_path}/logs").orderBy("stage_time").collect()
    assert [(r.stage_time, r.stage_x) for r in log] == [(62.5, 1), (3600, 3)]
    lines = spark.createDataFrame([(1, "a=1|b=N/A|c=2.5")], "file_id int, line string")
    assert {r.name: r.value for r in ingest.frame_metadata(lines, ["file_id"]).collect()} == {"a": 1, "b": None, "c": 2.5}
    t = spark.createDataFrame([(1, i, s) for i, s in enumerate((0.0, 0.04, 0.12, 0.16))], "file_id int, i int, s double")
    assert [r.timestamp_raw for r in ingest.timestamps(t, ["file_id"], "i", "s").orderBy("i").collect()] == [0, 1, 3, 4]
    assert abs(ingest.frame_rate(t, ["file_id"], "i", "s").first().fps - 25) < 1e-6
    x = spark.createDataFrame([("<a><info><microns-per-unit><x>2.5</x><y>1</y></microns-per-unit></info></a>", "[s]\nk = v\n;c = d\n")], "x string, i string")
    r = x.select(ingest.calibration(F.col("x"))["microns_x"].alias("m"), ingest.ini_values(F.col("i")).alias("i")).first()
    assert r.m == 2.5 and r.i == {"k": "v"}
    for name in ("v1.avi", "v1_features.avi", "img_1.png", "img_2.png"):
        (tmp_path / "files").mkdir(exist_ok=True)
        (tmp_path / "files" / name).write_bytes(b"x")
    assert sorted(r.name for r in ingest.manifest(ingest.find_files(spark, f"{tmp_path}/files")).collect()) == ["img_1.png", "v1.avi"]
    nan = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "v double, i int")
    assert ingest.nan_to_null(nan).where("v is null").count() == 1
    record = json.loads(export.wcon_data(poses(spark, 3), ["worm_index"], F.col("timestamp") / 25.0, ventral="ventral", dorsal="dorsal").first().record)
    assert record["id"] == "1" and record["t"] == [0, 0.04, 0.08] and len(record["px"][0]) == 98
    assert json.loads(export.wcon_metadata({"lab": "x", "fps": 2, "who": None})) == {"lab": "x", "@OMG": {"fps": 2}}
    a, b = export.write_csv_pair(nan, nan, str(tmp_path), "frames", "plate", 2)
    assert spark.read.csv(a, header=True).count() == 2 and "window_2" in b
    export.replace(nan, f"{tmp_path}/t", ["i"])
    export.replace(nan.where("i = 1"), f"{tmp_path}/t", ["i"])
    export.append(nan.withColumn("file_id", F.lit(3)), f"{tmp_path}/t2")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2 and spark.read.parquet(f"{tmp_path}/t2").count() == 2


def test_summary_levels_and_folds(spark):
    rows = [(0, w, t, float(w * t), float(t % 3 - 1), "A1") for w in range(1, 6) for t in range(100)]
    df = spark.createDataFrame(rows, "file_id int, worm int, timestamp int, speed double, mode double, well string")
    out = summary.summarise(df, ["file_id", "worm"], ["speed"], {"speed": ("mode", {-1: "w_backward", 1: "w_forward"})}, absolute=["speed"])
    assert {"speed_abs_w_forward_50th", "speed_abs_w_backward_IQR"} <= set(out.columns)
    long = {(r.worm, r.feature): r.value_50th for r in summary.summarise_long(df, ["worm"], ["speed", "mode"]).collect()}
    assert long[2, "speed"] == 99 and len(long) == 10
    info = summary.trajectory_info(df, ["worm"], 25.0, "speed", "well").first()
    assert (info.tot_time, info.frac_valid, info.well_name) == (4.0, 1.0, "A1")
    one = sorted(map(tuple, summary.random_folds(df, ["file_id"], "worm", "timestamp", 3, 20.0, 1.0, 0.6).select("i_fold", "worm", "timestamp").collect()))
    two = sorted(map(tuple, summary.random_folds(df.repartition(7), ["file_id"], "worm", "timestamp", 3, 20.0, 1.0, 0.6).select("i_fold", "worm", "timestamp").collect()))
    assert one == two and {len({w for f, w, _ in one if f == k}) for k in range(3)} == {3}
    norm = summary.normalised(df.withColumn("length", F.lit(2.0)), {"speed": "L", "mode": "1/L", "timestamp": "L^2"}, "length", ["worm"]).where("worm = 1 and timestamp = 3").first()
    assert (norm.speed_norm, norm.timestamp_norm) == (1.5, 12)


def test_plates(spark):
    plate = wells.plate_map(spark, 96, 6)
    assert plate.select("well_name").distinct().count() == 96 and plate.groupBy("channel").count().select("count").distinct().count() == 1
    boxes = spark.createDataFrame([(0, 10.0), (0, 11.0), (0, 50.0), (0, 52.0)], "file_id int, cx double")
    assert sorted(r.row for r in wells.label_axis(boxes, ["file_id"], "cx", 10, "row").collect()) == [0, 0, 1, 1]


def test_stages(spark):
    assert steps("CURRENT", "SKE_INIT", "SKE_FILT") == ["SKE_INIT", "BLOB_FEATS", "SKE_CREATE", "SKE_FILT"]
    with pytest.raises(ValueError):
        steps("CURRENT", "SKE_FILT", "SKE_INIT")
    p = Parameters.of('{"fps": 30, "min_area": 7}').resolved(30)
    assert (p.expected_fps, p.min_area, p.save_interval_frames) == (30.0, 7, 6000)
    with pytest.raises(ValueError):
        Parameters.of('{"nonsense": 1}')
    plan = Plan([Stage("A", ("x",), "y", lambda x: x.withColumn("b", F.lit(1))), Stage("B", ("y",), "z", lambda y: y.limit(1))], {"x": spark.range(3)})
    assert plan.run()["z"].columns == ["id", "b"]
    with pytest.raises(ValueError):
        Plan(plan.stages, {}).run()
    files = spark.createDataFrame([(0,), (1,), (2,)], "file_id int")
    done = export.provenance(spark, 0, "A", "f", {}, {}).unionByName(export.provenance(spark, 1, "A", "f", {}, {})).unionByName(export.provenance(spark, 1, "B", "f", {}, {}))
    todo = next_steps(files, done, ["A", "B"])
    assert {r.file_id: r.next_step for r in todo.collect()} == {0: "B", 1: None, 2: "A"}
    bad = spark.createDataFrame([(2,)], "file_id int")
    assert {r.file_id: r.state for r in file_states(files, todo, bad).collect()} == {0: "SOURCE_GOOD", 1: "FINISHED_GOOD", 2: "SOURCE_BAD"}


def test_many_windows(spark):
    rng = np.random.default_rng(4)
    wins = [(k, float(a), float(a + w) if k % 20 else None) for k, (a, w) in enumerate(zip(rng.uniform(0, 500, 140), rng.uniform(1, 40, 140), strict=True))]
    rows = [(i, float(v)) for i, v in enumerate(rng.uniform(0, 700, 200))]
    want = sorted((i, k) for i, v in rows for k, a, b in wins if v >= a and (b is None or v < b))
    df, windows = spark.createDataFrame(rows, "i int, v double"), spark.createDataFrame(wins, "k int, start double, end double")
    assert sorted(map(tuple, joins.window_join(df, windows, "v").select("i", "k").collect())) == want
    stamp = lambda c: F.timestamp_seconds(F.col(c))
    timed = joins.window_join(df.withColumn("v", stamp("v")), windows.withColumns({"start": stamp("start"), "end": stamp("end")}), "v")
    assert sorted(map(tuple, timed.select("i", "k").collect())) == want


def test_gap_links_equal_brute_force(spark):
    """Crowds, equal tracks and starts without a place; before, one of those hid the nearest start of every end."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(700):
        a = int(rng.integers(0, 60))
        b = a + int(rng.integers(0, 9))
        x = [float(v) for v in (rng.normal(0, 3, 4) if k % 3 else rng.integers(-90, 90, 4))]
        rows.append((k % 2, k, a, b, b - a + 1, *x, *(float(v) for v in rng.integers(50, 200, 2)), float(rng.choice([2.0, 8.0, 300.0]))))
    rows += [(r[0], r[1] + 1000, *r[2:]) for r in rows[:90]] + [(0, 5000, 20, 21, 2, None, 1.0, None, 1.0, 90.0, 90.0, 300.0)]
    df = spark.createDataFrame(rows, "file_id int, w long, start long, end long, n long, x0 double, y0 double, x1 double, y1 double, size0 double, size1 double, reach double")
    best = {}
    for p in rows:
        if p[7] is not None:
            near = [(math.sqrt((p[7] - q[5]) ** 2 + (p[8] - q[6]) ** 2), q[1]) for q in rows if q[5] is not None and q[0] == p[0] and p[3] < q[2] <= p[3] + 12 and 0.5 < p[10] / q[9] < 2]
            if near and min(near)[0] <= p[11]:
                best[p[0], min(near)[1]] = max(p[1], best.get((p[0], min(near)[1]), -1))
    got = joins.gap_links(df, ["file_id"], "w", 12, (0.5, 2.0)).collect()
    assert {(r.file_id, r.w): r.previous for r in got} == best and len(got) == len(best) > 100


def test_calibration_is_read_in_one_pass(spark):
    """What each path of XPath finds, from one reading of a document: each path was a reading of its own."""
    unit = "<i><microns-per-unit><x>{}</x><y>{}</y></microns-per-unit></i>"
    documents = [unit.format(*v) for v in ((" 1.25 ", "1e3"), ("-0", "+5"), ("5.", ".5"), ("&#49;2", "1<![CDATA[7]]>2"), ("1<!--c-->2", "1<b>9</b>2"), ("<b/>3", "Infinity"), ("1 2", "\n3\t"), ("1.2.3", ""))]
    documents += ["<i xmlns='u'><a><q:microns-per-unit xmlns:q='v'><x>4</x></q:microns-per-unit></a></i>", "<i><pixels-per-unit><w><x>1</x></w><x/></pixels-per-unit><pixels-per-unit><x>3</x><y>-2</y></pixels-per-unit></i>", "<i/>", "", None]
    df = spark.createDataFrame([(d,) for d in documents], "xml string")
    numbers = ingest.calibration(F.col("xml"))
    paths = {f"{unit}_{axis}": F.xpath_double("xml", F.lit(f"//{unit}-per-unit/{axis}/text()")) for unit in ("microns", "pixels") for axis in "xy"}
    assert numbers.keys() == paths.keys()
    out = df.select(F.array(*numbers.values()).alias("got"), F.array(*paths.values()).alias("want"))
    assert all(repr(r.got) == repr(r.want) for r in out.collect())
    plan = df.select(*numbers.values())._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("ArrowEvalPython") == 1 and "XPath" not in plan


def test_smoothed_positions_against_plain_ones(spark):
    """Positions of tracks with gaps, missing values and ends by a plain version; dense rows are not shuffled or sorted."""
    rng = np.random.default_rng(3)
    rows = []
    for track, n in ((1, 1), (2, 2), (3, 40), (4, 60), (5, 6)):
        for f in np.cumsum(rng.integers(1, 2 + 5 * (track % 2), n)):
            x = [None if rng.random() < 0.3 or (track == 5 and c == 2) else float(rng.integers(0, 99)) for c in range(4)]
            rows.append((track, int(f), *x, float(rng.integers(9)), float(rng.integers(9))))
    df = spark.createDataFrame(rows, "k int, frame_number long, coord_x double, coord_y double, area double, threshold double, box_length double, box_width double")
    for window in (1, 4, 5, 9):
        want = {}
        for k in range(1, 6):
            mine = {r[1]: r for r in rows if r[0] == k}
            frames = np.arange(min(mine), max(mine) + 1)
            lines = []
            for c in range(2, 6):
                known = [f for f in mine if mine[f][c] is not None]
                y = np.interp(frames, known, [mine[f][c] for f in known]) if known else np.full(len(frames), np.nan)
                h = window // 2 if c < 5 else 0
                lines.append([np.median(y[max(0, i - h) : i + h + 1]) for i in range(len(y))])
            for i, f in enumerate(frames):
                want[k, f] = (*(line[i] for line in lines), max(max(r[6:8]) for r in mine.values()) + 10)
        out = features.smooth_track_positions(df, ["k"], window=window)
        got = out.collect()
        assert out.columns == ["k", "frame_number", "coord_x", "coord_y", "area", "threshold", "roi_size"]
        assert len(got) == len(want)
        for r in got:
            np.testing.assert_allclose([np.nan if v is None else v for v in r[2:]], want[r.k, r.frame_number], atol=1e-9)
    plan = features.smooth_track_positions(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert plan.index("Generate explode") < plan.index("Sort ")


def test_filled_tracks_are_made_from_their_rows(spark):
    """Rows between those that are there, which were a table of their own to join."""
    df = spark.createDataFrame([(1, 3, "a"), (1, 4, None), (1, 7, "c"), (2, 5, "d"), (2, None, "e"), (None, 1, "f"), (None, 3, "g")], "k int, i int, v string").repartition(3)
    out = joins.dense_fill(df, ["k"], "i")
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted([(1, 3, "a"), (1, 4, None), (1, 5, None), (1, 6, None), (1, 7, "c"), (2, 5, "d"), (None, 1, None), (None, 2, None), (None, 3, None)], key=repr)
    assert "Join" not in joins.dense_fill(df, ["k"], "i")._jdf.queryExecution().executedPlan().toString()


def test_single_animal_across_batches(spark):
    """One animal a file by a plain version, whatever rows come in one batch, with equal distances and places that are
    missing: whole files were in memory, and a missing place hid the frame's others."""
    rng = np.random.default_rng(5)
    rows = []
    for file in range(3):
        for f in range(40):
            for _ in range(int(rng.integers(1, 12))):
                x, y = (None if rng.random() < 0.1 else float(rng.integers(0, 30)) / 10 for _ in range(2))
                rows.append((file, f, len(rows), x, y, float(rng.integers(1, 4))))
    want = []
    for file in range(3):
        at = None
        for f in range(40):
            here = [r for r in rows if r[:2] == (file, f) and None not in r[3:5]]
            far = [(math.sqrt((r[3] - (at or (1, 1))[0]) ** 2 + (r[4] - (at or (1, 1))[1]) ** 2) / (1 if at else math.sqrt(r[5])), r[2]) for r in here]
            if far and (at is None or min(far)[0] <= 0.4):
                want.append(min(far)[1])
                at = next(r[3:5] for r in here if r[2] == want[-1])
    df = spark.createDataFrame(rows, "file_id int, frame_number int, row_id long, coord_x double, coord_y double, area double").repartition(5)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("1", "3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            out = tracking.pick_single_animal(df, centre=(1.0, 1.0), max_distance=0.4)
            assert sorted(r.row_id for r in out.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
