"""The steps from frames to series, each over tables that the one before wrote; and running them from a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.timeseries import Track
from trackloom.operators import features, images, tracking
from trackloom.plans.stages import Parameters, Plan, Stage

TRACK = Track(("file_id", "worm_index"), ("timestamp",))


def detections(masked: DataFrame, p: Parameters, dark: bool = True) -> DataFrame:
    """Blobs of masked frames that are darker (lighter) than the threshold, with a row_id, linked from frame to frame."""
    found = images.detect_blobs(masked, p.threshold, p.min_area, dark).withColumn("row_id", F.col("frame_number").cast("bigint") * (1 << 20) + F.col("blob"))
    return tracking.link_detections(found, max_distance=p.max_distance, ratio=(p.area_ratio_low, p.area_ratio_high))


def joined(linked: DataFrame, p: Parameters) -> DataFrame:
    """Tracks joined over gaps; short ones go."""
    out = tracking.join_gaps(linked, max_gap=p.max_frames_gap, ratio=(p.area_ratio_low, p.area_ratio_high), min_rows=p.min_track_size)
    return out.where("worm_index_joined is not null")


def followed(tracks: DataFrame) -> DataFrame:
    """Tracks on a dense frame axis, with the size of their regions of interest."""
    rows = tracks.withColumn("threshold", F.lit(None).cast("double"))
    return features.smooth_track_positions(rows, ["file_id", "worm_index_joined"])


def poses(masked: DataFrame, tracks: DataFrame, p: Parameters, dark: bool = True) -> DataFrame:
    """Poses of the animals, in pixels of the frames; what the masks cover is background."""
    rois = images.crop(masked, tracks)
    out = images.poses_of_rois(rois, ("file_id", "worm_index_joined"), "frame_number", p.threshold, dark)
    return out.withColumnsRenamed({"worm_index_joined": "worm_index", "frame_number": "timestamp"})


def pose_table(made: DataFrame, meta: DataFrame, p: Parameters) -> DataFrame:
    """Poses in microns on a dense frame axis, smoothed."""
    window = 2 * (round(p.expected_fps * p.smooth_window_s) // 2) + 1
    kept = made.drop("code")
    return features.smoothed_pose_table(kept, meta, TRACK, max(5, window), max_gap=max(1, round(p.expected_fps * p.max_gap_s)))


def standard_plan(tables: dict[str, DataFrame], p: Parameters, dark: bool = True, **mask) -> Plan:
    """Stages from ``frames`` (file_id, frame_number, h, w, pixels) and ``meta`` (file_id, microns_per_pixel) to ``series``."""
    return Plan(
        [
            Stage("COMPRESS", ("frames",), "masked", lambda f: images.mask_frames(f, dark=dark, min_area=p.min_area, **mask)),
            Stage("TRAJ_CREATE", ("masked",), "linked", lambda f: detections(f, p, dark)),
            Stage("TRAJ_JOIN", ("linked",), "joined", lambda d: joined(d, p)),
            Stage("SKE_INIT", ("joined",), "tracks", followed),
            Stage("SKE_CREATE", ("masked", "tracks"), "poses", lambda f, t: poses(f, t, p, dark)),
            Stage("FEAT_INIT", ("poses", "meta"), "pose_table", lambda d, m: pose_table(d, m, p)),
            Stage("FEAT_FRAMES", ("pose_table",), "series", lambda d: features.frame_features(d, TRACK, p.expected_fps)),
        ],
        tables,
    )


def run_folder(spark: SparkSession, folder: str, p: Parameters, start: str = "", end: str = "", dark: bool = True, **mask) -> list[str]:
    """Runs the steps from ``start`` to ``end`` in a folder of tables; returns the names of the tables that it wrote.

    Every step reads the tables that are there and writes its own, so that a run may go on where another one ended.
    """
    names = ("frames", "meta", "masked", "linked", "joined", "tracks", "poses", "pose_table", "series")
    plan, made = standard_plan({}, p.resolved(p.expected_fps), dark, **mask), []
    steps = [s.name for s in plan.stages]
    first, last = steps.index(start) if start else 0, steps.index(end) if end else len(steps) - 1
    for s in plan.stages[first : last + 1]:
        plan.tables = {n: spark.read.parquet(f"{folder}/{n}") for n in names if n in s.inputs}
        out = plan.run(s.name, s.name)[s.output]
        out.write.mode("overwrite").parquet(f"{folder}/{s.output}")
        made.append(s.output)
    return made
