"""Row and column selection: time windows, valid tracks, feature sets."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.operators.joins import small, window_join


def parse_windows(text: str) -> list[tuple[int, int | None]]:
    """Windows of ``a:b``, ``a:end`` and ``a:b:step``, separated by commas; nothing means everything.

    ``a:b:step`` gives windows of ``step`` from a on, the last one to b even if it is shorter.
    """
    out: list[tuple[int, int | None]] = []
    for part in (p.strip() for p in text.split(",")):
        if not part:
            continue
        pieces = [p.strip() for p in part.split(":")]
        if len(pieces) not in (2, 3):
            raise ValueError(f"not a window: {part!r}")
        start, end = int(pieces[0]), None if pieces[1] == "end" else int(pieces[1])
        if start < 0 or (end is not None and end <= start):
            raise ValueError(f"a window must end after its start: {part!r}")
        if len(pieces) == 2:
            out.append((start, end))
            continue
        step = int(pieces[2])
        if end is None or step < 1:
            raise ValueError(f"steps need an end and a positive width: {part!r}")
        stops = [*range(start + step, end, step), end]
        out += list(zip([start, *stops[:-1]], stops, strict=True))
    return out or [(0, None)]


def windows_table(spark: SparkSession, text: str, unit: str = "frame_numbers", fps: float = 1.0) -> DataFrame:
    """(window_id, start, end) in frames; seconds become rint(seconds * fps)."""
    if unit not in ("frame_numbers", "seconds"):
        raise ValueError(f"unknown time unit {unit!r}")
    scale = fps if unit == "seconds" else 1
    rows = [(i, round(a * scale), None if b is None else round(b * scale)) for i, (a, b) in enumerate(parse_windows(text))]
    return spark.createDataFrame(rows, "window_id int, start bigint, end bigint")


def in_windows(df: DataFrame, windows: DataFrame, at: str = "timestamp") -> DataFrame:
    return window_join(df, windows, at)


def select_features(columns: Sequence[str], names: Sequence[str] | None = None, include: str = "", exclude: str = "") -> list[str]:
    """Those of ``columns`` in ``names`` (in its order; a byte order mark is ignored) that hold an ``include`` keyword,
    if any is given, and no ``exclude`` keyword; keywords are separated by commas."""
    words = lambda s: [w.strip() for w in s.split(",") if w.strip()]
    out = list(columns) if names is None else [n for n in (n.lstrip("﻿").strip() for n in names) if n in set(columns)]
    if inc := words(include):
        out = [c for c in out if any(w in c for w in inc)]
    return [c for c in out if not any(w in c for w in words(exclude))]


def pad_columns(df: DataFrame, columns: Sequence[str], kind: str = "double") -> DataFrame:
    """Exactly ``columns``, in order; those that are missing are NULL."""
    have = set(df.columns)
    return df.select(*(F.col(c) if c in have else F.lit(None).cast(kind).alias(c) for c in columns))


def finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN and infinities become NULL."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumns({c: F.when(~bad(F.col(c)), F.col(c)) for c in columns})


def valid_tracks(df: DataFrame, keys: Sequence[str], track: str, valid: str, x: str, y: str, min_share: float, min_rows: int, min_size: float) -> DataFrame:
    """Rows of tracks with a share >= ``min_share`` and a count >= ``min_rows`` of valid rows, and a bounding box with a
    diagonal > ``min_size``.  Where a group of ``keys`` has a single track, all of it stays."""
    ok = F.col(valid).cast("int")
    box = F.hypot(F.max(x) - F.min(x), F.max(y) - F.min(y))
    per = df.groupBy(*keys, track).agg(F.avg(ok).alias("_share"), F.sum(ok).alias("_n"), box.alias("_size"))
    per = per.withColumn("_tracks", F.count("*").over(Window.partitionBy(*keys))) if keys else per.join(F.broadcast(per.agg(F.count("*").alias("_tracks"))), F.lit(True))
    keep = (F.col("_tracks") == 1) | ((F.col("_share") >= min_share) & (F.col("_n") >= min_rows) & (F.col("_size") > min_size))
    return df.join(per.where(keep).select(*keys, track), [*keys, track], "left_semi")


def dense_ids(df: DataFrame, good: DataFrame, on: Sequence[str], order: Sequence[str], name: str, group: Sequence[str]) -> DataFrame:
    """Numbers rows of ``good`` keys from 0 in ``order`` within ``group``; other rows get NULL."""
    marked = df.join(good.select(*on).distinct().withColumn("_good", F.lit(True)), list(on), "left")
    number = F.row_number().over(Window.partitionBy(*group, "_good").orderBy(*order)) - 1
    return marked.withColumn(name, F.when(F.col("_good"), number)).drop("_good")


def every_kth_frame(df: DataFrame, keys: Sequence[str], frame: str, k: int) -> DataFrame:
    """Rows of every k-th distinct frame, the first included.  Frames are numbered, not their rows; NULL is one, the first."""
    rank = F.row_number().over(Window.partitionBy(*(f"_{c}" for c in keys)).orderBy("_frame")) - 1
    every = df.select(*(F.col(c).alias(f"_{c}") for c in keys), F.col(frame).alias("_frame")).distinct()
    chosen = small(every.withColumn("_rank", rank).where(F.col("_rank") % k == 0))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys), F.col(frame).eqNullSafe(F.col("_frame")))
    return df.join(chosen, same, "left_semi")


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def median_probability(df: DataFrame, keys: Sequence[str], score: str, least: float = 0.5) -> DataFrame:
    """Rows of tracks whose median score is above ``least``."""
    return df.join(df.groupBy(*keys).agg(F.median(score).alias("_m")).where(F.col("_m") > least).select(*keys), list(keys), "left_semi")


#: Codes of hand labels of tracks.
LABELS = {"U": 0, "WORM": 1, "WORMS": 2, "BAD": 3, "GOOD_SKE": 4}


def labelled_animals(df: DataFrame, label: str = "worm_label", row: str = "skeleton_id", kinds: Sequence[str] = ("WORM", "WORMS")) -> DataFrame:
    """Rows that a hand label calls an animal or a cluster of them and that have a pose."""
    return df.where(F.col(label).isin([LABELS[k] for k in kinds]) & (F.col(row) >= 0))


def good_tracks(df: DataFrame, min_rows: int, by_hand: bool = False, filtered: bool = True, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """(keys, track): tracks with over ``min_rows`` poses, of rows labelled as animals (``by_hand``) and good poses (``filtered``).

    Tracks are those joined by hand, if asked for, else the joined ones.
    """
    track = ("worm_index_manual" if "worm_index_manual" in df.columns else "worm_index_N") if by_hand else "worm_index_joined"
    if by_hand:
        df = df.where(F.col("worm_label") == LABELS["WORM"])
    if filtered and "is_good_skel" in df.columns:
        df = df.where("is_good_skel = 1")
    found = df.groupBy(*keys, F.col(track).alias("track")).agg(F.sum(F.col("has_skeleton").cast("int")).alias("_n"))
    return found.where((F.col("_n") > min_rows) & F.col("track").isNotNull()).drop("_n")


def joined_detections(df: DataFrame, columns: Sequence[str], track: str = "worm_index_joined") -> DataFrame:
    """``columns`` of the rows that belong to a joined track."""
    return df.where(F.col(track) > 0).select(*columns)


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of ``columns`` that ``df`` has, in order."""
    have = set(df.columns)
    return [c for c in columns if c in have]


def paired_derivatives(columns: Sequence[str]) -> list[str]:
    """``columns`` and the derivatives of those that have none among them; derivatives that are given twice over go."""
    given = list(columns)
    made = [f"d_{c}" for c in given if not c.startswith("d_")]
    return [c for c in given if c not in made] + [c for c in made if c not in given]


#: First parts of the names of features by section.
SECTIONS = {"morphology": ("length", "area", "width"), "posture": ("quirkiness", "major_axis", "minor_axis", "eigen_projection", "curvature", "head_tail_distance"), "locomotion": ("speed", "angular_velocity", "relative_to", "motion_mode", "turn"), "path": ("path", "coord", "orientation_food_edge", "dist_from_food_edge", "food_region")}


def without_sections(columns: Sequence[str], sections: Sequence[str]) -> list[str]:
    """Columns that belong to none of the sections; a derivative belongs to its feature's."""
    starts = tuple(s for name in sections for s in SECTIONS[name])
    return [c for c in columns if not c.removeprefix("d_").startswith(starts)]


def whole_circles(circles: DataFrame, keys: Sequence[str], height: str, width: str, missing: float = 0.5) -> DataFrame:
    """Circles (x, y, r) whose centres are at least (1 - ``missing``) mean radii away from the image's border."""
    room = F.avg("r").over(Window.partitionBy(*keys)) * (1 - missing)
    inside = (F.col("x") - F.col("_room") >= 0) & (F.col("x") + F.col("_room") < F.col(width)) & (F.col("y") - F.col("_room") >= 0) & (F.col("y") + F.col("_room") < F.col(height))
    return circles.withColumn("_room", room).where(inside).drop("_room")


def first_frames(df: DataFrame, limit: int, frame: str = "frame_number") -> DataFrame:
    """Rows of frames under a limit."""
    return df.where(F.col(frame) < limit)


def largest(df: DataFrame, keys: Sequence[str], size: str, row: str, n: int = 2) -> DataFrame:
    """The ``n`` largest rows of each key, with their place from 1; ties go to the smaller row id."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(size), row))
    return df.withColumn("place", place).where(F.col("place") <= n)


def nearest_to_zero(df: DataFrame, keys: Sequence[str], angle: str, distance: str, bins: int) -> DataFrame:
    """(keys, bin, distance): of each angle bin, rint(angle / pi * ``bins``), the distance of least size; of equal ones the
    smaller."""
    place = F.rint(F.col(angle) / math.pi * bins).cast("bigint").alias("bin")
    return df.groupBy(*keys, place).agg(F.min_by(distance, F.struct(F.abs(distance), F.col(distance))).alias(distance))
