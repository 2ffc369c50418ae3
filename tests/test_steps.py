"""Whole steps over tables: from drawn frames to series, and the tables that steps, parameters and records make."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.__main__ import main
from trackloom.functions.timeseries import Track
from trackloom.operators import features, joins, selection, summary
from trackloom.plans import stages
from trackloom.sources import export

A = "array<struct<x:double,y:double>>"


def frame_of(k, size=(160, 260)):
    """Two tapered, bent, dark bodies that move."""
    y, x = np.mgrid[: size[0], : size[1]]
    out = np.full(size, 200)
    for cx, cy, turn in ((70 + 2 * k, 50, 0.05 * k), (170, 110 - k, 0.6)):
        t = np.linspace(-1, 1, 160)
        line = np.column_stack((45 * t, 8 * np.sin(2 * t + 0.2 * k)))
        c, s = np.cos(turn), np.sin(turn)
        line = line @ np.array([[c, s], [-s, c]]) + [cx, cy]
        for (a, b), r in zip(line, np.maximum(0.6, 5.5 * np.sqrt(np.clip(1 - t**2, 0, 1))), strict=True):
            out[np.hypot(x - a, y - b) <= r] = 60
    return out.astype(np.uint8)


def test_steps_from_frames_to_series(spark, tmp_path):
    rows = [(0, k, 160, 260, bytearray(frame_of(k).tobytes())) for k in range(12)]
    spark.createDataFrame(rows, "file_id int, frame_number int, h int, w int, pixels binary").write.parquet(f"{tmp_path}/frames")
    spark.createDataFrame([(0, 2.0)], "file_id int, microns_per_pixel double").write.parquet(f"{tmp_path}/meta")
    given = json.dumps({"expected_fps": 5.0, "min_area": 60, "threshold": 130})
    first = main(["run", str(tmp_path), "--end", "TRAJ_JOIN", "--parameters", given], spark)
    assert first == ["masked", "linked", "joined"]
    assert main(["run", str(tmp_path), "--start", "SKE_INIT", "--parameters", given], spark) == ["tracks", "poses", "pose_table", "series"]
    tracks = spark.read.parquet(f"{tmp_path}/tracks").groupBy("worm_index_joined").count().collect()
    assert [r["count"] for r in tracks] == [12, 12]
    series = spark.read.parquet(f"{tmp_path}/series")
    assert series.count() == 24 and set(features.SERIES) <= set(series.columns)
    stats = series.groupBy("worm_index").agg(F.avg("length").alias("length"), F.avg("width_midbody").alias("width"), F.max(F.abs("coord_x_body")).alias("x")).collect()
    for r in stats:
        assert 150 < r["length"] < 215 and 14 < r["width"] < 28 and r["x"] > 100


def test_smoothed_pose_table(spark):
    pose = lambda k, d: [{"x": float(10 * i), "y": float(k + d)} for i in range(9)]
    rows = [(0, 1, k, None if k == 4 else pose(k, 0), None if k == 4 else pose(k, 3), None if k == 4 else pose(k, -3), None if k == 4 else [6.0] * 9, float(k), 4.0) for k in range(12) if k != 6]
    poses = spark.createDataFrame(rows, f"file_id int, worm_index int, timestamp int, skeleton {A}, ventral {A}, dorsal {A}, widths array<double>, coord_x double, area double")
    meta = spark.createDataFrame([(0, 2.0)], "file_id int, microns_per_pixel double")
    stage = spark.createDataFrame([(0, k, 100.0, 10.0) for k in range(12) if k != 8], "file_id int, timestamp int, stage_x double, stage_y double")
    out = features.smoothed_pose_table(poses, meta, Track(), 5, stage).orderBy("timestamp").collect()
    assert [r["timestamp"] for r in out] == list(range(12))
    for k, r in enumerate(out):
        assert r["skeleton"][3]["x"] == pytest.approx(160) and r["skeleton"][3]["y"] == pytest.approx(2 * k + 10)
        assert r["ventral"][0]["y"] == pytest.approx(2 * k + 16) and r["widths"] == pytest.approx([12.0] * 9)
    assert out[1]["coord_x"] == 2 and out[1]["area"] == 16 and out[6]["coord_x"] is None
    gaps = features.smooth_poses(poses.withColumn("skeleton", F.when(F.col("timestamp") < 9, F.col("skeleton")).when(F.col("timestamp") == 11, F.col("skeleton"))), Track(), 5, max_gap=1).orderBy("timestamp").collect()
    assert [r["timestamp"] for r in gaps if r["skeleton"] is None] == [9, 10] and gaps[4]["skeleton"] is not None
    alone = features.smooth_poses(poses.where("timestamp = 3"), Track(), 5).first()
    assert alone["skeleton"][0]["y"] == 3 and features.smooth_poses(poses.limit(0), Track(), 5).count() == 0


def test_plans_and_parameters_of_files(spark):
    files = spark.createDataFrame([(0, "CURRENT", "SKE_INIT", "SKE_FILT"), (1, "LEGACY", "FEAT_CREATE", None), (2, "NONE", "", ""), (3, "BASE", "SKE_FILT", "SKE_INIT"), (4, None, None, None), (5, "BASE", "no step", None)], "file_id int, analysis string, start string, end string")
    got = stages.planned_steps(files).orderBy("file_id", "place").collect()
    by = {k: [(r["place"], r["step"]) for r in got if r["file_id"] == k] for k in range(6)}
    assert by[0] == list(enumerate(stages.steps("CURRENT", "SKE_INIT", "SKE_FILT"))) and by[1] == [(0, "FEAT_CREATE")]
    assert all(by[k] == [(None, None)] for k in (2, 3, 4, 5))
    texts = ['{"fps": 30, "min_area": 7}', None, '{"min_num_skel": 3, "min_frames": 4, "speed": 1, "smooth_window_s": 2}', "{}"]
    out = stages.resolved_parameters(spark.createDataFrame([(i, t, 30.0) for i, t in enumerate(texts)], "file_id int, parameters string, fps double")).orderBy("file_id").collect()
    for r, t in zip(out, texts, strict=True):
        known = {k: v for k, v in json.loads(t or "{}").items() if k not in ("speed", "min_num_skel")}
        want = stages.Parameters.of(json.dumps(known)).resolved(30.0)
        assert {f: r[f] for f in want.__dataclass_fields__} == {f: getattr(want, f) for f in want.__dataclass_fields__}
    assert [r["unknown"] for r in out] == [[], [], ["speed"], []]


def test_records_and_metadata(spark):
    files = spark.createDataFrame([(1, "a", None), (2, None, 5)], "file_id int, who string, fps int")
    rows = export.provenance_rows(files, "A", "f", {"x": F.col("fps"), "b": F.lit(True)}, {"v": "1"}).orderBy("file_id").collect()
    assert [json.loads(r["args_json"]) for r in rows] == [{"b": True}, {"b": True, "x": 5}] and rows[0]["versions"] == {"v": "1"}
    meta = files.select(export.wcon_metadata_column({"who": F.col("who"), "fps": F.col("fps")}).alias("m")).collect()
    assert [r["m"] for r in meta] == [export.wcon_metadata({"who": "a", "fps": None}).replace(": ", ":"), '{"@OMG":{"fps":5}}']


def test_shares_of_true_nulls(spark):
    rng = np.random.default_rng(0)
    p = np.concatenate((rng.uniform(0, 1, 800), rng.beta(0.2, 6, 200)))
    df = spark.createDataFrame([(k % 2, float(v)) for k, v in enumerate(p)] + [(0, None)], "k int, p double")
    for method in ("bootstrap", "smoother", 0.5):
        got = {r["k"]: r["pi0"] for r in summary.null_share(df, "p", ["k"], method).collect()}
        assert all(0.65 < v <= 1 for v in got.values())
    one = p[::2]
    shares = np.array([(one >= c).mean() / (1 - c) for c in summary.CUTS])
    assert {r["k"]: r["pi0"] for r in summary.null_share(df, "p", ["k"], "smoother").collect()}[0] == pytest.approx(min(1, np.polyval(np.polyfit(summary.CUTS, shares, 3), 0.9)))
    # The closed form is what many resamples come to.
    error = np.zeros(19)
    for _ in range(4000):
        over = np.array([rng.binomial(len(one), (one > c).mean()) for c in summary.CUTS]) / len(one)
        error += (over / (1 - np.array(summary.CUTS)) - shares.min()) ** 2
    best = {r["k"]: r["pi0"] for r in summary.null_share(df, "p", ["k"], "bootstrap").collect()}[0]
    assert error[np.argmin(np.abs(shares - best))] <= 1.1 * error.min()
    q = summary.q_values(df.where("k = 0"), "p", 0.8, robust=True).where("p is not null").toPandas().sort_values("p")
    assert (q["q_value"].diff().dropna() >= 0).all() and q["q_value"].max() <= 1
    with pytest.raises(ValueError):
        summary.null_share(df, "p", [], "none")


def test_large_groups_are_not_in_one_task(spark):
    """Medians, ranks and numbers of frames equal plain ones; q-values counted rows without p before."""
    df = spark.range(20_000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 50 > 0, (F.hash("id") % 5_000).cast("double") / 10_000 + 0.5).alias("p"), F.col("id"))
    df = df.where("k = 0 or id < 9")
    pdf = df.toPandas()
    got = {r.k: r.m for r in summary.group_median(df, ["k"], "p", "m").collect()}
    assert got == pytest.approx(pdf.groupby("k").p.median().to_dict(), abs=1e-15)
    q = summary.q_values(df, "p", keys=["k"]).toPandas().set_index("id").q_value
    for _, g in pdf.dropna(subset="p").groupby("k"):
        g = g.sort_values("p", ascending=False)
        want = (g.p * len(g) / g.p.rank(method="max")).clip(upper=1.0).cummin()
        want = want.groupby(g.p).transform("min")
        np.testing.assert_allclose(q.loc[g.id], want, rtol=1e-12)
    assert q.isna().sum() == pdf.p.isna().sum()
    kept = selection.every_kth_frame(df.where("p is not null"), ["k"], "p", 7)
    ranks = pdf.dropna(subset="p").groupby("k").p.rank(method="dense") - 1
    assert sorted(r.id for r in kept.collect()) == sorted(pdf.id[ranks.index[ranks % 7 == 0]])
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 1
    assert joins.spread(df, ["k", "id"], 1_000).rdd.getNumPartitions() == -(-len(pdf) // 1_000)
    assert summary.split_chunks(df, Track(("k",), ("id",)), 3).where("k = 1").groupBy("chunk").count().count() == 2
