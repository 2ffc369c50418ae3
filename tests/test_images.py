import json
import struct
import zipfile
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom.__main__ import main
from trackloom.operators import features, images, legacy
from trackloom.functions.timeseries import Track
from trackloom.plans.stages import Plan, Stage, isolated
from trackloom.sources import export, ingest
from trackloom.sources import images as files


def png(a, filters=(0, 1, 2, 3, 4)):
    """A grey PNG whose rows use the filters in turn."""
    rows, before = b"", np.zeros(a.shape[1], int)
    for y, line in enumerate(a.astype(int)):
        kind = filters[y % len(filters)]
        left, corner = np.concatenate(([0], line[:-1])), np.concatenate(([0], before[:-1]))
        p = left + before - corner
        paeth = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        near = [0, left, before, (left + before) // 2, paeth][kind]
        rows += bytes([kind]) + ((line - near) % 256).astype(np.uint8).tobytes()
        before = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def tiff(pages):
    out, at = b"II*\0" + struct.pack("<I", 8), 8
    for k, a in enumerate(pages):
        tags = [(256, 4, a.shape[1]), (257, 4, a.shape[0]), (258, 3, 8 * a.itemsize), (259, 3, 1), (273, 4, at + 2 + 8 * 12 + 4), (277, 3, 1), (278, 4, a.shape[0]), (279, 4, a.nbytes)]
        end = at + 2 + 8 * 12 + 4 + a.nbytes
        out += struct.pack("<H", 8) + b"".join(struct.pack("<HHII", t, kind, 1, v) for t, kind, v in tags) + struct.pack("<I", end if k < len(pages) - 1 else 0) + a.tobytes()
        at = end
    return out


def packed(a):
    one, two = a[::-1, ::-2].ravel(), a[::-1, -2::-2].ravel()
    raw = np.stack([one >> 4, (one & 15) | (two & 15) << 4, two >> 4], axis=1).astype(np.uint8).tobytes()
    end = np.zeros(20, "<u2")
    end[14:16] = a.shape[1], a.shape[0]
    return raw + end.tobytes()


def test_image_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    a = [rng.integers(0, 256, (7, 9)).astype(np.uint8) for _ in range(12)]
    (tmp_path / "png").mkdir()
    for k, x in enumerate(a):
        (tmp_path / "png" / f"img_{k + 1}.png").write_bytes(png(x))
    (tmp_path / "png" / "img_99.png").write_bytes(b"no image")
    out = files.image_frames(spark, str(tmp_path / "png"), "png").orderBy("frame_number").collect()
    assert [np.frombuffer(r.pixels, np.uint8).reshape(r.h, r.w).tolist() for r in out[:12]] == [x.tolist() for x in a]
    assert out[12].pixels is None and "not a PNG" in out[12].error
    good = {r.path.rsplit("/", 1)[1]: r.is_good for r in files.readable(files.image_frames(spark, str(tmp_path / "png"), "png")).collect()}
    assert good["img_99.png"] is False and sum(good.values()) == 12
    deep = [rng.integers(0, 4096, (4, 6)).astype(np.uint16) for _ in range(3)]
    assert [x.tolist() for x in files.decode_tiff(tiff(deep))] == [x.tolist() for x in deep]
    assert files.decode_pgm(b"P5\n# a note\n9 7\n255\n" + a[0].tobytes())[0].tolist() == a[0].tolist()
    (tmp_path / "dat").mkdir()
    for k, x in enumerate(deep):  # numbers written backwards
        (tmp_path / "dat" / f"{str(k + 9).zfill(5)[::-1]}spool.dat").write_bytes(packed(x))
    out = files.camera_frames(spark, str(tmp_path / "dat")).orderBy("frame_number").collect()
    assert [np.frombuffer(r.pixels, np.uint16).reshape(r.h, r.w).tolist() for r in out] == [x.tolist() for x in deep]
    with pytest.raises(ValueError):
        files.decode_packed(b"\0" * 50)


def body(turn=0.0, size=120, wide=5.0):
    """An image of a dark, tapered, bent body, and its middle line."""
    y, x = np.mgrid[:size, :size]
    t = np.linspace(-1, 1, 400)
    c, s = np.cos(turn), np.sin(turn)
    line = np.column_stack((45 * t, 8 * np.sin(2 * t)))
    line = line @ np.array([[c, s], [-s, c]]) + size / 2
    d = np.hypot(x[..., None] - line[:, 0], y[..., None] - line[:, 1]) - wide * np.sqrt(np.clip(1 - t**2, 0, 1))
    return np.where((d <= 0).any(-1), 50, 200).astype(np.uint8), line


def test_contours_and_shapes():
    y, x = np.mgrid[:60, :60]
    disc = np.hypot(x - 30, y - 28) <= 20
    contour = images.trace_contour(disc)
    assert np.abs(np.hypot(*(contour - [30, 28]).T) - 20).max() < 1.5
    s = images.shape(contour)
    assert abs(s["area"] - np.pi * 400) < 80 and s["solidity"] > 0.97 and s["compactness"] > 0.85 and s["quirkiness"] < 0.4
    assert abs(s["hu0"] - 1 / (2 * np.pi)) < 2e-3 and abs(s["hu1"]) < 1e-4
    square = np.array([[0, 0], [2, 0], [2, 3], [0, 3.0]])
    assert images.polygon_moment(square, 0, 0) == 6 and images.polygon_moment(square, 1, 1) == 2 * 4.5 and images.polygon_moment(square, 2, 0) == pytest.approx(8)
    rng = np.random.default_rng(1)
    p = np.column_stack((np.cos(np.arange(9)), np.sin(np.arange(9)))) * rng.uniform(1, 3, (9, 1))
    p = p[np.argsort(np.arctan2(p[:, 1], p[:, 0]))]
    turned = p @ np.array([[0.6, 0.8], [-0.8, 0.6]]) * 7 + 100
    np.testing.assert_allclose(images.hu_moments(p), images.hu_moments(turned), rtol=1e-6, atol=1e-12)
    two = np.zeros((20, 40), bool)
    two[2:5, 2:5], two[10:18, 20:38] = True, True
    assert images.trace_contour(two)[:, 0].min() == 20 and len(images.trace_contour(np.zeros((3, 3), bool))) == 0


def test_food_contours(spark):
    y, x = np.mgrid[:120, :140]
    rng = np.random.default_rng(2)
    radius = 35 + 4 * np.cos(3 * np.arctan2(y - 60, x - 70))
    a = np.where(np.hypot(x - 70, y - 60) < radius, 90, 160) + rng.integers(-8, 9, (120, 140))
    a[5:9, 5:9] = 60  # a small dark spot elsewhere
    frames = spark.createDataFrame([(0, 120, 140, bytearray(a.astype(np.uint8).tobytes())), (1, 20, 20, bytearray(np.full(400, 99, np.uint8).tobytes()))], "file_id int, h int, w int, pixels binary")
    out = images.food_contours(frames, scale=2.0).orderBy("file_id", "seq").collect()
    assert {r.file_id for r in out} == {0} and len(out) > 100
    p = np.array([(r.x, r.y) for r in out]) / 2 - [70, 60]
    far = np.hypot(*p.T) - 35 - 4 * np.cos(3 * np.arctan2(p[:, 1], p[:, 0]))
    assert np.abs(far).mean() < 1.5 and np.abs(far).max() < 4


def test_poses_from_images(spark):
    rows = []
    for k in range(6):
        a, _ = body(0.05 * k)
        rows.append((0, 1, k, a.shape[0], a.shape[1], bytearray(a.tobytes()), 100.0, 50.0))
    rows.append((0, 1, 6, 120, 120, bytearray(np.full(14400, 200, np.uint8).tobytes()), 0.0, 0.0))
    rois = spark.createDataFrame(rows, "file_id int, worm_index_joined int, frame_number int, h int, w int, pixels binary, roi_x double, roi_y double")
    out = images.poses_of_rois(rois).orderBy("frame_number").collect()
    assert out[6].skeleton is None
    heads = []
    for k in range(6):
        _, line = body(0.05 * k)
        s = np.array([(p.x, p.y) for p in out[k].skeleton]) - [100, 50]
        assert s.shape == (49, 2) and np.hypot(*(s[24] - line[200])) < 3
        near = min(np.hypot(*(s[0] - e)) for e in (line[0], line[-1]))
        assert near < 6 and np.median(out[k].widths[16:33]) == pytest.approx(10, abs=2.5)
        heads.append(s[0])
    assert np.hypot(*np.diff(heads, axis=0).T).max() < 10  # the head stays the head
    shapes = images.blob_shapes(rois, ("file_id", "frame_number"), 100).orderBy("frame_number").collect()
    assert shapes[6].area is None and shapes[0].solidity < 1 and 80 < shapes[0].box_length < 110
    assert features.morphology(images.poses_of_rois(rois)).where("length > 60").count() == 6


def test_masks_of_buffers(spark):
    a = np.full((40, 50), 200, np.uint8)
    a[5:15, 10:20] = 50
    rows = [(0, f, 40, 50, bytearray(np.roll(a, 3 * f, 1).tobytes())) for f in range(4)]
    frames = spark.createDataFrame(rows, "file_id int, frame_number int, h int, w int, pixels binary")
    out = images.mask_buffers(frames, 2, block=21, offset=15, min_area=20, grow=0).orderBy("frame_number").collect()
    masks = [np.frombuffer(r.pixels, np.uint8).reshape(40, 50) > 0 for r in out]
    assert (masks[0] == masks[1]).all() and (masks[2] == masks[3]).all() and (masks[0] != masks[2]).any()
    assert masks[0][10, 10:23].all()


def test_turns_and_sides_of_the_older_route(spark):
    track = Track(("k",), ("i",))
    n, fps = 120, 8.0
    head, body, tail, way = (np.zeros(n) for _ in range(4))

    def turn(at, size, sign):
        """A bend that runs from head to tail."""
        head[at : at + 4], body[at + 4 : at + 9], tail[at + 9 : at + 12] = sign * size, sign * size, sign * size

    turn(10, 25.0, 1)
    turn(40, 25.0, -1)
    turn(70, 17.0, 1)
    body[46] = np.nan
    way[95:] = 170.0
    way[:95] += np.linspace(0, 1, 95)
    rows = [(0, i, *(None if np.isnan(v[i]) else float(v[i]) for v in (head, body, tail, way))) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, i int, head_bend double, body_bend double, tail_bend double, direction_tail2head double")
    out = legacy.turn_flags(df, track, fps).orderBy("i").collect()
    omega, upsilon = np.array([r.omega_frames for r in out]), np.array([r.upsilon_frames for r in out])
    assert (omega[10:22] == 1).all() and (omega[40:52] == -1).all() and not omega[22:40].any()
    assert (upsilon[70:82] == 1).all() and not upsilon[:70].any() and not omega[70:82].any()
    # A sudden swing of head and tail is a turn too; its side is that of the body's mean bend.
    assert (omega[94:97] == -1).all() and set(np.flatnonzero(omega)) <= {*range(10, 22), *range(40, 52), *range(90, 101)}
    lists = legacy.signed_turns(legacy.turn_flags(df, track, fps).withColumn("d", F.lit(1.0)), track, "omega_frames", "i", fps, "d").orderBy("start").collect()
    assert [(r.start, r.end, r.is_ventral) for r in lists[:2]] == [(10, 21, False), (40, 51, True)]
    assert [legacy.frames_per_sample(f, s) for f, s in ((25, 0.5), (30, 0.25), (10, 0.5), (1, 0.1))] == [13, 7, 5, 1]
    up = [{"x": float(i), "y": 1.0} for i in range(5)]
    low = [{"x": float(i), "y": -1.0} for i in range(5)]
    a = "array<struct<x:double,y:double>>"
    p = spark.createDataFrame([(0, up, low, "clockwise"), (1, low, up, "clockwise"), (2, up, low, "unknown")], f"file_id int, ventral {a}, dorsal {a}, side string")
    assert {r.file_id: r.agrees for r in legacy.ventral_check(p, ["file_id"], "side").collect()} == {0: True, 1: False, 2: None}


def test_isolation_stages_and_families(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, -1.0), (3, 5.0)], "file_id int, x double")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        if (pdf["x"] < 0).any():
            raise ValueError("negative")
        return pd.DataFrame({"file_id": [pdf["file_id"].iloc[0]], "total": [pdf["x"].sum()]})

    out = {r.file_id: (r.total, r.error) for r in isolated(df, ["file_id"], kernel, "file_id int, total double").collect()}
    assert out == {1: (5.0, None), 2: (None, "ValueError: negative"), 3: (5.0, None)}
    plan = Plan([Stage("A", ("x",), "y", lambda x: x.where("id > 1"), before=lambda x: x.withColumn("id", F.col("id") + 1))], {"x": spark.range(3)})
    assert plan.run()["y"].count() == 2
    assert features.feature_family("morphology") is features.morphology
    with pytest.raises(ValueError):
        features.feature_family("colour")


def test_tables_documents_and_command_line(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "file_id int, v double")
    export.replace(df, f"{tmp_path}/t", attributes={"fps": 25})
    export.replace(df.withColumn("v", F.lit(3.0)), f"{tmp_path}/t", attributes={"fps": 30})
    back = ingest.read_table(spark, f"{tmp_path}/t", missing="file_id int")
    assert back.first().v == 3.0 and export.attributes(back)["fps"] == 30
    assert ingest.read_table(spark, f"{tmp_path}/none", missing="file_id int, v double").count() == 0
    a = "array<struct<x:double,y:double>>"
    poses = spark.createDataFrame([(1, 0, [{"x": 1.0, "y": 2.0}]), (1, 1, None)], f"worm_index int, timestamp int, skeleton {a}")
    export.write_wcon(export.wcon_data(poses, ["worm_index"], F.col("timestamp") / 25.0), {"lab": "x", "fps": 25}, f"{tmp_path}/a.wcon.zip")
    with zipfile.ZipFile(f"{tmp_path}/a.wcon.zip") as z:
        doc = json.loads(z.read("a.wcon"))
    assert doc["data"][0]["x"] == [[1.0], None] and doc["metadata"]["@OMG"] == {"fps": 25}
    rows = [(f, w, t, float(w * t), 100.0 + w, 0) for f in (0, 1) for w in (1, 2) for t in range(20 * (f + 1))]
    series = spark.createDataFrame(rows, "file_id int, worm_index int, timestamp int, speed double, length double, motion_mode int")
    features.save_series(series, f"{tmp_path}/series")
    pairs = main([f"{tmp_path}/series", f"{tmp_path}/out", "--windows", "0:20,20:end", "--include", "speed", "--exclude", "norm"], spark)
    first, second = (spark.read.csv(a, header=True, inferSchema=True) for a, _ in pairs)
    assert first.count() == 2 and second.count() == 1 and "speed_50th" in first.columns and not [c for c in first.columns if "norm" in c]
    good = {r.file_id: r.is_good for r in spark.read.csv(pairs[1][1], header=True, inferSchema=True).collect()}
    assert good == {0: False, 1: True}
    pairs = main([f"{tmp_path}/series", f"{tmp_path}/out2", "--level", "trajectory"], spark)
    assert spark.read.csv(pairs[0][0], header=True).count() == 4
    for name in ("a_featuresN.hdf5", "a_features.hdf5", "b_skeletons.hdf5"):
        (tmp_path / "found").mkdir(exist_ok=True)
        (tmp_path / "found" / name).write_bytes(b"x")
    assert [r.name for r in ingest.summary_inputs(spark, str(tmp_path / "found"), "current").collect()] == ["a_featuresN.hdf5"]


def test_background_of_a_stream_equals_that_of_the_table(spark, tmp_path):
    from trackloom.streaming.stream import background_stream

    rng = np.random.default_rng(0)
    rows = [(f, n, 3, 4, bytearray((np.zeros(12) if n == 4 else rng.integers(0, 250, 12)).astype(np.uint8).tobytes())) for f in range(2) for n in range(20)]
    schema = "file_id int, frame_number int, h int, w int, pixels binary"
    for part, (lo, hi) in enumerate(((0, 7), (7, 8), (8, 20))):
        spark.createDataFrame([r for r in rows if lo <= r[1] < hi], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{part}"))
    for dark in (True, False):
        got = []
        keep = lambda batch, _: got.extend(batch.collect())
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        background_stream(stream, 4, 3, dark).writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", str(tmp_path / f"state-{dark}")).trigger(availableNow=True).start().awaitTermination()
        assert len(got) == 40
        for f in range(2):
            mine = {r[1]: np.frombuffer(bytes(r[4]), np.uint8) for r in rows if r[0] == f}
            ring, last = [], None
            for n in range(20):
                if (last is None or n - last >= 4) and mine[n].any():
                    ring, last = [*ring, mine[n]][-3:], n
                want = np.max(ring, axis=0) if dark else np.min([np.where(x == 0, 255, x) for x in ring], axis=0)
                one = next(r for r in got if r.file_id == f and r.frame_number == n)
                assert bytes(one.pixels) == want.astype(np.uint8).tobytes()
