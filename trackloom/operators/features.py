"""Per-frame features of poses, and their assembly into one time series."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import geometry as G
from trackloom.functions import kernels
from trackloom.functions.bodies import skeletons_from_sides
from trackloom.functions.timeseries import Track, bfill, central_difference, delta_frames, ffill
from trackloom.operators.events import behaviour
from trackloom.operators.joins import dense_fill, in_polygon, point_in_rectangle, small
from trackloom.operators.selection import pad_columns

#: Vertices of 49 at which curvature is read, and the parts that velocities of a part are taken against.
CURVATURE_POINTS = {"head": 5, "neck": 15, "midbody": 24, "hips": 33, "tail": 44}
RELATIVE_TO = {
    "body": ("head_tip", "neck", "hips", "tail_tip"), "neck": ("head_tip",), "head_base": ("head_tip",), "hips": ("tail_tip",),
    "tail_base": ("tail_tip",), "midbody": (), "head_tip": (), "tail_tip": (),
}
PATH_PARTS = ("body", "tail", "midbody", "head")
#: Most poses that a worker draws at once.
POSES_AT_ONCE = 256


def morphology(df: DataFrame) -> DataFrame:
    """length, and, as far as contour sides and widths are there, area and the widths of head base, midbody and tail base."""
    out = {"length": G.length(F.col("skeleton"))}
    if {"ventral", "dorsal"} <= set(df.columns):
        out["area"] = G.area(F.col("ventral"), F.col("dorsal"))
    if "widths" in df.columns:
        out |= {f"width_{p}": G.width_of(F.col("widths"), p) for p in ("head_base", "midbody", "tail_base")}
    return df.withColumns(out)


def skeletons(df: DataFrame, n: int = 49, points: int = 200) -> DataFrame:
    """Adds skeleton and widths, from the contour sides ventral and dorsal (head to tail); NULL without both.

    Sides are drawn anew with ``points`` points.  Batches of poses are worked on as arrays (``bodies.skeletons_from_sides``),
    some hundred at a time, so that a worker's memory does not depend on how many poses come in a batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (b.iloc[i : i + POSES_AT_ONCE] for b in batches for i in range(0, len(b), POSES_AT_ONCE)):
            lines, widths = [None] * len(pdf), [None] * len(pdf)
            good = np.flatnonzero([all(s is not None and len(s) > 2 for s in sides) for sides in zip(pdf["ventral"], pdf["dorsal"], strict=True)])
            if len(good):
                sides = ([np.array([(p["x"], p["y"]) for p in pdf[c].iloc[i]], float) for i in good] for c in ("ventral", "dorsal"))
                for i, line, width in zip(good, *skeletons_from_sides(*sides, n, points), strict=True):
                    lines[i], widths[i] = [{"x": float(x), "y": float(y)} for x, y in line], width.tolist()
            yield pdf.assign(skeleton=lines, widths=widths)

    schema = df.drop("skeleton", "widths").withColumns({"skeleton": F.lit(None).cast("array<struct<x:double,y:double>>"), "widths": F.lit(None).cast("array<double>")}).schema
    return df.drop("skeleton", "widths").mapInPandas(run, schema)


def resampled(df: DataFrame, column: str, n: int) -> DataFrame:
    """A curve of each row drawn anew with ``n`` points at equal distances; NULL for curves without points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            curves = batch.column(column)
            bounds = curves.offsets.to_numpy()
            flat = curves.values
            points = np.column_stack([flat.field(c).to_numpy(zero_copy_only=False) for c in "xy"]).astype(float)
            keep = curves.is_valid().to_numpy(zero_copy_only=False) & (np.diff(bounds) > 0)
            made = np.zeros((batch.num_rows, n, 2))
            for i in np.flatnonzero(keep).tolist():
                made[i] = kernels.resample_curve(points[bounds[i] : bounds[i + 1]], n)
            yield pa.RecordBatch.from_arrays([_lists(made, keep, curves.type) if c == column else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return df.mapInArrow(run, df.schema)


def _flat(pose: str) -> tuple[Column, Column]:
    """The coordinates of a pose as two lists, which travel to numpy as they are."""
    return F.transform(pose, lambda p: p["x"]), F.transform(pose, lambda p: p["y"])


def smoothed_polygons(df: DataFrame, column: str, n: int = 1000, window: int | None = None) -> DataFrame:
    """A closed polygon of each row drawn anew with ``n`` points and smoothed around its whole length
    (``kernels.smooth_polygon``); NULL for polygons of under two points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            curves = batch.column(column)
            bounds, flat = curves.offsets.to_numpy(), curves.values
            points = np.column_stack([flat.field(c).to_numpy(zero_copy_only=False) for c in "xy"]).astype(float)
            keep = curves.is_valid().to_numpy(zero_copy_only=False) & (np.diff(bounds) > 1)
            made = np.zeros((batch.num_rows, n, 2))
            for i in np.flatnonzero(keep).tolist():
                made[i] = kernels.smooth_polygon(points[bounds[i] : bounds[i + 1]], n, window)
            yield pa.RecordBatch.from_arrays([_lists(made, keep, curves.type) if c == column else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return df.mapInArrow(run, df.schema)


def coil_test(df: DataFrame, width_ratio: float = 2.25, area_ratio: float = 6.0) -> DataFrame:
    """Adds may_coil: the midbody is too wide against the head or tail base, or the body too large against the head or tail.

    Widths are medians of parts, areas are those between the contour sides of a part; NULL without a pose.
    """
    middle, head, tail = (G.width_of(F.col("widths"), p) for p in ("midbody", "head_base", "tail_base"))

    def area(p: str) -> Column:
        ring = F.concat(G.part(F.col("ventral"), p), F.reverse(G.part(F.col("dorsal"), p)))
        nxt = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
        cross = F.zip_with(ring, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
        return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2

    body, ends = area("body"), (area("head"), area("tail"))
    wide = [(e <= 0) | (middle / F.nullif(e, F.lit(0.0)) > width_ratio) for e in (head, tail)]
    large = [(e <= 0) | (body / F.nullif(e, F.lit(0.0)) > area_ratio) for e in ends]
    known = F.col("widths").isNotNull() & F.col("ventral").isNotNull() & F.col("dorsal").isNotNull()
    return df.withColumn("may_coil", F.when(known, wide[0] | wide[1] | large[0] | large[1]))


def posture(df: DataFrame, basis: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """head_tail_distance, quirkiness, axes, and projections on a posture basis (cosines unless given)."""
    basis = basis or G.cosine_basis(48, 7)

    @F.pandas_udf("major_axis double, minor_axis double, quirkiness double")
    def boxes(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        rows = [(np.nan,) * 3 if x is None else kernels.min_rectangle(np.column_stack((x, y))) for x, y in zip(xs, ys, strict=True)]
        return pd.DataFrame(rows, columns=["major_axis", "minor_axis", "quirkiness"])

    df = df.withColumn("_box", boxes(*_flat("skeleton"))).withColumn("_angles", G.tangent_angles(F.col("skeleton")))
    out = {"head_tail_distance": G.head_tail_distance(F.col("skeleton"))} | {c: F.col(f"_box.{c}") for c in ("major_axis", "minor_axis", "quirkiness")}
    out |= {f"eigen_projection_{i + 1}": c for i, c in enumerate(G.projections(F.col("_angles"), basis))}
    return df.withColumns(out).drop("_box", "_angles")


def curvature(df: DataFrame, method: str = "gradient", track: Track | None = None) -> DataFrame:
    """Curvature at five points, and its mean and deviation over five parts.

    Method "gradient" is a column expression: differences over two points on both sides, NULL on the four outer points,
    and, with ``track``, on tracks of up to four rows.  The others of ``kernels.CURVATURES`` run in numpy.
    """
    if method == "gradient":
        df = df.withColumns({"_x": F.transform("skeleton", lambda p: p["x"]), "_y": F.transform("skeleton", lambda p: p["y"])})
        df = df.withColumns({f"_g{a}": G.gradient(F.col(f"_{a}"), 2) for a in "xy"})
        df = df.withColumns({f"_h{a}": G.gradient(F.col(f"_g{a}"), 2) for a in "xy"})
        turn = F.zip_with(F.arrays_zip("_gx", "_gy"), F.arrays_zip("_hx", "_hy"), lambda g, h: F.try_divide(g["_gx"] * h["_hy"] - g["_gy"] * h["_hx"], F.pow(g["_gx"] * g["_gx"] + g["_gy"] * g["_gy"], F.lit(1.5))))
        df = df.withColumn("_k", F.transform(turn, lambda k, i: F.when((i >= 4) & (i < F.size("_x") - 4), k)))
        if track is not None:
            df = df.withColumn("_k", F.when(F.count(F.lit(1)).over(track.whole()) > 4, F.col("_k")))
        df = df.drop("_x", "_y", "_gx", "_gy", "_hx", "_hy")
    else:
        kernel = kernels.CURVATURES[method]

        @F.pandas_udf("array<double>")
        def along(xs: pd.Series, ys: pd.Series) -> pd.Series:
            out = [None] * len(xs)
            good = [i for i, x in enumerate(xs) if x is not None]
            if good:
                poses = np.stack([np.stack(list(c.iloc[good])) for c in (xs, ys)], axis=-1).astype(float)
                for i, row in zip(good, kernel(poses), strict=True):
                    out[i] = [None if np.isnan(v) else float(v) for v in row]
            return pd.Series(out)

        df = df.withColumn("_k", along(*_flat("skeleton")))
    known = lambda p: F.filter(G.part(F.col("_k"), p), lambda x: x.isNotNull())
    out = {f"curvature_{p}": F.try_element_at("_k", F.lit(i + 1)) for p, i in CURVATURE_POINTS.items()}
    for p in CURVATURE_POINTS:
        some = F.size(known(p)) > 0
        out |= {f"curvature_mean_{p}": F.when(some, G.mean(known(p))), f"curvature_std_{p}": F.when(some, G.deviation(known(p)))}
    return df.withColumns(out).drop("_k")


def velocities(df: DataFrame, track: Track, fps: float, seconds: float = 1 / 3) -> DataFrame:
    """Adds the 33 velocities: of each part, of parts in the frames of others, and of the midbody across the body.

    Centroids and head-to-tail vectors of parts are interpolated over missing frames if more than two are known.  Speed
    has the sign of motion along the part's vector; it and the angular velocity of a part are NULL on missing frames.
    All rows of a track meet in one sort, whose windows carry structs of all parts.
    """
    w, delta, at = track.window(), delta_frames(fps, seconds), F.col(track.order[-1])
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead, back, step = -(-delta // 2), delta // 2, delta / fps
    known, parts = F.col("skeleton").isNotNull(), list(RELATIVE_TO)

    def measured(name: str) -> Column:
        piece = G.part(F.col("skeleton"), name)
        c, v = G.centroid(piece), G.orientation(piece)
        return F.struct(c["x"].alias("x"), c["y"].alias("y"), v["x"].alias("vx"), v["y"].alias("vy")).alias(name)

    df = df.withColumn("_p", F.when(known, F.struct(at.alias("t"), *map(measured, parts))))
    df = df.withColumns({"_a": ffill(F.col("_p"), w), "_b": bfill(F.col("_p"), track), "_many": F.count("_p").over(track.whole()) > 2})
    share = F.try_divide(at - F.col("_a.t"), F.col("_b.t") - F.col("_a.t"))

    def filled(name: str, field: str) -> Column:
        a, b = F.col(f"_a.{name}.{field}"), F.col(f"_b.{name}.{field}")
        return F.when(known, F.col(f"_p.{name}.{field}")).when(F.col("_many"), F.when(F.col("_a").isNull(), b).when(F.col("_b").isNull(), a).otherwise(a + (b - a) * share)).alias(field)

    df = df.withColumn("_q", F.struct(*(F.struct(*(filled(p, f) for f in ("x", "y", "vx", "vy"))).alias(p) for p in parts)))
    df = df.withColumn("_o", F.struct(*(F.atan2(f"_q.{p}.vx", f"_q.{p}.vy").alias(p) for p in parts)))

    def local(frame: str, name: str) -> Column:
        """The centroid of a part in the frame of another."""
        dx, dy, o = F.col(f"_p.{name}.x") - F.col(f"_q.{frame}.x"), F.col(f"_p.{name}.y") - F.col(f"_q.{frame}.y"), F.col(f"_o.{frame}")
        return F.struct((dx * F.cos(o) - dy * F.sin(o)).alias("x"), (dx * F.sin(o) + dy * F.cos(o)).alias("y"))

    pairs = [(f, n) for f, ns in RELATIVE_TO.items() for n in ns]
    df = df.withColumn("_l", F.struct(*(local(f, n).alias(f"{f}_{n}") for f, n in pairs), local("body", "midbody").alias("mid")))
    polar = [F.struct(F.hypot(f"_l.{f}_{n}.x", f"_l.{f}_{n}.y").alias("r"), F.atan2(f"_l.{f}_{n}.y", f"_l.{f}_{n}.x").alias("a")).alias(f"{f}_{n}") for f, n in pairs]
    df = df.withColumn("_r", F.struct(*polar))
    # Angles are unwrapped over known values; unknown ones repeat the last, which adds no turn.
    angles = {**{f"o_{p}": F.col(f"_o.{p}") for p in parts}, **{f"a_{f}_{n}": F.col(f"_r.{f}_{n}.a") for f, n in pairs}}
    df = df.withColumn("_f", F.struct(*(F.last(a, ignorenulls=True).over(before).alias(k) for k, a in angles.items())))
    df = df.withColumn("_e", F.lag("_f").over(w))

    def turned(k: str) -> Column:
        d = F.col(f"_f.{k}") - F.col(f"_e.{k}")
        near = F.pmod(d + math.pi, F.lit(2 * math.pi)) - math.pi
        near = F.when((near == -math.pi) & (d > 0), F.lit(math.pi)).otherwise(near)
        return F.when(F.abs(d) < math.pi, F.lit(0.0)).otherwise(F.coalesce(near - d, F.lit(0.0))).alias(k)

    df = df.withColumn("_s", F.struct(*map(turned, angles)))
    unwrapped = F.struct(*((a + F.sum(f"_s.{k}").over(before)).alias(k) for k, a in angles.items()))
    df = df.withColumn("_u", unwrapped).withColumn("_now", F.struct("_q", "_r", "_u", F.col("_l.mid.x").alias("mid")))
    df = df.withColumns({"_n": F.lead("_now", ahead).over(w), "_v": F.lag("_now", back).over(w)})
    rate = lambda field: (F.col(f"_n.{field}") - F.col(f"_v.{field}")) / F.lit(step)
    out: dict[str, Column] = {}
    for p in parts:
        dx, dy = rate(f"_q.{p}.x"), rate(f"_q.{p}.y")
        sign = F.signum(dx * F.col(f"_q.{p}.vx") + dy * F.col(f"_q.{p}.vy"))
        tag = "" if p == "body" else f"_{p}"
        out[f"speed{tag}"] = F.when(known, F.hypot(dx, dy) * sign)
        out[f"angular_velocity{tag}"] = F.when(known, rate(f"_u.o_{p}"))
    out["relative_to_body_speed_midbody"] = rate("mid")
    for f, n in pairs:
        out[f"relative_to_{f}_radial_velocity_{n}"] = rate(f"_r.{f}_{n}.r")
        out[f"relative_to_{f}_angular_velocity_{n}"] = rate(f"_u.a_{f}_{n}")
    return df.withColumns(out).drop("_p", "_a", "_b", "_many", "_q", "_o", "_l", "_r", "_f", "_e", "_s", "_u", "_now", "_n", "_v")


def derivatives(df: DataFrame, track: Track, columns: Sequence[str], fps: float, seconds: float = 1 / 3) -> DataFrame:
    """Adds d_<column>: central differences; NULL where the track is too short."""
    w, delta = track.window(), delta_frames(fps, seconds)
    return df.withColumns({f"d_{c}": central_difference(F.col(c), w, delta, fps) for c in columns})


def part_coordinates(df: DataFrame, parts: Sequence[str] = PATH_PARTS) -> DataFrame:
    """Adds coord_x_<part> and coord_y_<part>, the centres of parts."""
    centre = {p: G.centroid(G.part(F.col("skeleton"), p)) for p in parts}
    return df.withColumns({f"coord_{a}_{p}": F.when(F.col("skeleton").isNotNull(), c[a]) for p, c in centre.items() for a in "xy"})


def food_features(df: DataFrame, contour: DataFrame, keys: Sequence[str], x: str = "coord_x_body", y: str = "coord_y_body") -> DataFrame:
    """Adds dist_from_food_edge and orientation_food_edge, by a contour (keys, seq, x, y) for each of ``keys``.

    The distance is that to the nearest vertex, negative outside.  The orientation is the angle in degrees between the
    body and the contour at that vertex, positive towards the side that lies right of the contour's direction.
    """
    ring = contour.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("_ring"))
    df = df.join(small(ring), list(keys), "left")
    nearest = F.array_min(F.transform("_ring", lambda p, i: F.struct(F.hypot(p["x"] - F.col(x), p["y"] - F.col(y)).alias("d"), i.alias("i"))))
    df = df.withColumn("_i", F.when(F.col(x).isNotNull(), nearest)["i"]).withColumn("_inside", in_polygon(F.col(x), F.col(y), F.col("_ring")))
    n = F.size("_ring")
    after, before = F.element_at("_ring", F.pmod(F.col("_i") + 1, n).cast("int") + 1), F.element_at("_ring", F.pmod(F.col("_i") - 1, n).cast("int") + 1)
    at = F.element_at("_ring", F.col("_i") + 1)
    v = G.orientation(G.part(F.col("skeleton"), "body"))
    dx, dy = after["x"] - before["x"], after["y"] - before["y"]
    dot = F.try_divide(dy * v["x"] - dx * v["y"], F.hypot(dx, dy) * F.hypot(v["x"], v["y"]))
    d = F.hypot(at["x"] - F.col(x), at["y"] - F.col(y))
    out = {"dist_from_food_edge": F.when(F.col("_inside"), d).otherwise(-d), "orientation_food_edge": 90 - F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))}
    return df.withColumns({c: F.when(F.col(x).isNotNull() & F.col("_ring").isNotNull(), e) for c, e in out.items()}).drop("_ring", "_i", "_inside")


def path_features(df: DataFrame, track: Track, parts: Sequence[str] = PATH_PARTS, step: float = 11.0, width: int = 5) -> DataFrame:
    """Adds path_curvature_<part> from coord_x_<part> and coord_y_<part>: of the path at equal steps, read back in time."""
    cols = [f"coord_{a}_{p}" for p in parts for a in "xy"]

    def run(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        return {f"path_curvature_{p}": kernels.path_curvature(pdf[f"coord_x_{p}"].to_numpy(float), pdf[f"coord_y_{p}"].to_numpy(float), step, width) for p in parts}

    return kernels.with_tracks(df, track.keys, track.order, cols, run, {f"path_curvature_{p}": "double" for p in parts})


#: What a pose consists of, head to tail.
POSE_COLUMNS = ("skeleton", "ventral", "dorsal", "widths")


def _stack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values (rows, points, coordinates) of the rows that have any, their places) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    flat = column.flatten()
    values = [flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")] if pa.types.is_struct(flat.type) else [flat.to_numpy(zero_copy_only=False)]
    return np.stack(values, axis=-1).astype(float).reshape(len(at), -1 if len(at) else 1, len(values)), at


def _lists(values: np.ndarray, keep: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of the rows of ``values`` where ``keep`` holds, else NULL."""
    rows, points = values[keep], values.shape[1]
    flat = [pa.array(rows[..., k].ravel(), pa.float64()) for k in range(values.shape[2])]
    inner = flat[0] if len(flat) == 1 else pa.StructArray.from_arrays(flat, ["x", "y"])
    bounds = np.concatenate(([0], np.cumsum(keep * points)))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), inner, mask=pa.array(~keep)).cast(kind)


def smooth_poses(df: DataFrame, track: Track, window: int, along: int = 5, max_gap: int | None = None) -> DataFrame:
    """Fills gaps of poses linearly and smooths them in time and along the body (order 3).

    Skeleton, contour sides and widths, as far as ``df`` has them, are worked on alike; frames before the first pose and
    after the last one take its values.  Gaps of more than ``max_gap`` frames stay NULL.  A column with under two poses in
    a track stays as it is; tracks shorter than ``window`` are smoothed along the body only.  Rows pass through as whole
    rows, so that nothing is joined back.
    """
    made = [c for c in POSE_COLUMNS if c in df.columns]

    def smoothed(column: pa.Array) -> pa.Array:
        poses, at = _stack(column)
        if len(at) < 2:
            return column
        t = np.arange(len(column))
        flat = poses.reshape(len(at), -1)
        full = np.column_stack([np.interp(t, at, c) for c in flat.T]).reshape(len(t), *poses.shape[1:])
        if len(full) >= window:
            full = kernels.savgol(full, window, 3)
        if full.shape[1] >= along:
            full = kernels.savgol(full, along, 3, axis=1)
        keep = np.ones(len(t), bool)
        if max_gap is not None:
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if j - i - 1 > max_gap:
                    keep[i + 1 : j] = False
        return _lists(full, keep, column.type)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in track.order])
        for c in made:
            table = table.set_column(table.column_names.index(c), c, smoothed(table[c]))
        return table

    return df.groupBy(*track.keys).applyInArrow(run, df.schema)


def smoothed_pose_table(poses: DataFrame, meta: DataFrame, track: Track, window: int, stage: DataFrame | None = None, turn: float = 0.0, along: int = 5, max_gap: int | None = None) -> DataFrame:
    """The pose table as features take it: moved by the stage, in microns, on a dense frame axis, smoothed.

    ``poses`` (keys, frame, skeleton, ventral, dorsal, widths and, if measured, blob columns coord_x, coord_y, area) are in
    pixels; ``stage`` (file_id, frame, stage_x, stage_y) in microns has no row while the stage moves, and poses of such
    frames are filled like missing ones.  Blob positions are scaled by the file's microns_per_pixel, areas by its square.
    """
    at = track.order[-1]
    blobs = {c: F.col(c) * (F.col("microns_per_pixel") ** 2 if c == "area" else F.col("microns_per_pixel")) for c in ("coord_x", "coord_y", "area") if c in poses.columns}
    if blobs:
        poses = poses.join(small(meta.select("file_id", "microns_per_pixel")), "file_id").withColumns(blobs).drop("microns_per_pixel")
    df = extract_tracks(poses, meta, track)
    if stage is not None:
        df = moved_by_stage(df, stage, ["file_id"], at, turn)
    return smooth_poses(df, track, window, along, max_gap)


def extract_tracks(poses: DataFrame, meta: DataFrame, track: Track = Track()) -> DataFrame:  # noqa: B008
    """Poses on a dense frame axis, in microns: coordinates and widths are scaled by the file's microns_per_pixel."""
    at = track.order[-1]
    scaled = poses.join(small(meta.select("file_id", "microns_per_pixel")), "file_id")
    m = F.col("microns_per_pixel")
    pose = lambda c: F.transform(c, lambda p: F.struct((p["x"] * m).alias("x"), (p["y"] * m).alias("y")))
    scaled = scaled.withColumns({**{c: pose(c) for c in ("skeleton", "ventral", "dorsal")}, "widths": F.transform("widths", lambda x: x * m)}).drop("microns_per_pixel")
    return dense_fill(scaled, track.keys, at)


def ventral_sign(df: DataFrame, columns: Sequence[str], side: Column) -> DataFrame:
    """Changes the sign of side-dependent columns where the ventral side is clockwise."""
    return df.withColumns({c: F.when(side == "clockwise", -F.col(c)).otherwise(F.col(c)) for c in columns})


#: The columns of the assembled series, in order.
VELOCITIES = [
    "speed", "angular_velocity", "relative_to_body_speed_midbody",
    *(f"relative_to_body_{k}_velocity_{p}" for p in RELATIVE_TO["body"] for k in ("radial", "angular")),
    *(c for p in ("neck", "head_base", "hips", "tail_base") for c in (f"speed_{p}", f"angular_velocity_{p}", f"relative_to_{p}_radial_velocity_{RELATIVE_TO[p][0]}", f"relative_to_{p}_angular_velocity_{RELATIVE_TO[p][0]}")),
    *(f"{k}_{p}" for p in ("midbody", "head_tip", "tail_tip") for k in ("speed", "angular_velocity")),
]
MORPHOLOGY = ["length", "area", "width_head_base", "width_midbody", "width_tail_base"]
POSTURE = ["quirkiness", "major_axis", "minor_axis", *(f"eigen_projection_{i}" for i in range(1, 8))]
CURVATURE = [*(f"curvature_{p}" for p in ("head", "hips", "midbody", "neck", "tail")), *(f"curvature_{k}_{p}" for k in ("mean", "std") for p in ("head", "neck", "midbody", "hips", "tail"))]
FOOD = ["orientation_food_edge", "dist_from_food_edge"]
PATH = [f"path_curvature_{p}" for p in PATH_PARTS]
EVENTS = ["motion_mode", "food_region", "turn"]
AUXILIARY = ["head_tail_distance", *(f"coord_{a}_{p}" for p in PATH_PARTS for a in "xy")]
BASE = VELOCITIES + MORPHOLOGY + POSTURE + CURVATURE + FOOD + PATH
SERIES = BASE + [f"d_{c}" for c in BASE]
#: Columns whose sign depends on the side on which an animal lies.
_SIDED = ["relative_to_body_speed_midbody", *PATH, *CURVATURE, *(c for c in VELOCITIES if "angular_velocity" in c), *(c for c in POSTURE if c.startswith("eigen_projection"))]
SIDED = _SIDED + [f"d_{c}" for c in _SIDED]


def frame_features(poses: DataFrame, track: Track, fps: float, contour: DataFrame | None = None, wells: DataFrame | None = None, side: Column | None = None, basis: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """The assembled time series of poses: keys, 69 features, their derivatives, three events and nine other columns.

    Columns that cannot be made (food without a contour, widths or areas without their inputs) are NULL.
    """
    df = velocities(curvature(posture(morphology(poses), basis), track=track), track, fps)
    df = part_coordinates(df)
    if contour is not None:
        df = food_features(df, contour, [k for k in track.keys if k in contour.columns])
    # From here on rows are flat and pass through the kernels as they are.
    df = behaviour(path_features(df.drop("skeleton", "ventral", "dorsal", "widths"), track), track, fps)
    df = derivatives(df, track, [c for c in BASE if c in df.columns], fps)
    if side is not None:
        df = ventral_sign(df, [c for c in SIDED if c in df.columns], side)
    more: list[str] = []
    if wells is not None:
        df, more = point_in_rectangle(df, wells, [*track.keys, *track.order], "coord_x_body", "coord_y_body"), ["well_name"]
    given = [c for c in poses.columns if c not in ("skeleton", "ventral", "dorsal", "widths")]
    return pad_columns(df, [*given, *more, *SERIES, *EVENTS, *AUXILIARY])


#: Families of features by name: each adds its columns to poses (``velocities`` and ``path`` also take a track).
FEATURES = {"morphology": morphology, "posture": posture, "curvature": curvature, "velocities": velocities, "food": food_features, "path": path_features, "coordinates": part_coordinates, "derivatives": derivatives}


def feature_family(name: str):
    if name not in FEATURES:
        raise ValueError(f"no features {name!r}; there are {', '.join(sorted(FEATURES))}")
    return FEATURES[name]


def save_series(df: DataFrame, path: str) -> None:
    """The assembled series, partitioned by file."""
    df.write.mode("overwrite").partitionBy("file_id").parquet(path)


def robust_outliers(df: DataFrame, keys: Sequence[str], columns: dict[int, Sequence[str]], limit: float = 11.345, name: str = "skel_outliers_flag", sample_rows: int = 20_000) -> DataFrame:
    """Adds a bit flag of rows far from a robust centre of each group of columns; the cut is on the distance.

    ``keys`` name the group (a file) and then the row.  Centre and covariance are fitted on about ``sample_rows`` rows of
    a group (all, if it has no more), chosen by a hash of the row; every row is then cut by an expression.  A row lacking
    one of a group's columns, and a group with too few whole rows, is not flagged.
    """
    group, row = list(keys[:-1]), keys[-1]
    used = list(dict.fromkeys(c for cs in columns.values() for c in cs))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        made = {k: [pdf[k].iloc[0]] for k in group}
        for bit, cols in columns.items():
            x = pdf[list(cols)].to_numpy(float)
            x = x[np.isfinite(x).all(1)]
            centre, cov = kernels.robust_covariance(x) if len(x) > 2 * len(cols) else (None, None)
            made |= {f"_centre{bit}": [None if centre is None else centre.tolist()], f"_inverse{bit}": [None if centre is None else np.linalg.inv(cov).ravel().tolist()]}
        return pd.DataFrame(made)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in group), *(f"_centre{b} array<double>, _inverse{b} array<double>" for b in columns)])
    counts = small(df.groupBy(*group).agg(F.count("*").alias("_rows")))
    chosen = F.shiftrightunsigned(F.xxhash64(row), 11) < F.lit(float(1 << 53)) * sample_rows / F.col("_rows")
    fits = df.select(*keys, *used).join(counts, group).where(chosen).select(*group, *used).groupBy(*group).applyInPandas(fit, schema)
    out = df.join(small(fits), group, "left")
    flags = F.lit(0).cast("bigint")
    for bit, cols in columns.items():
        off = F.array(*(F.col(c).cast("double") for c in cols))
        off = F.zip_with(off, F.col(f"_centre{bit}"), lambda v, m: v - m)
        n = len(cols)
        square = sum((off[i] * off[j] * F.col(f"_inverse{bit}")[i * n + j] for i in range(n) for j in range(n)), F.lit(0.0))
        flags = flags.bitwiseOR(F.when(F.coalesce(F.sqrt(square) > limit, F.lit(False)) & ~F.isnan(square), 1 << bit).otherwise(0).cast("bigint"))
    return out.withColumn(name, flags).drop(*(f"_{k}{b}" for k in ("centre", "inverse") for b in columns))


def pose_transforms(pose: Column) -> dict[str, Column]:
    """Centre, angle, centred and orientation-free forms, and limits of a pose."""
    c, angle = G.centroid(pose), G.mean_angle(pose)
    xs, ys = F.transform(pose, lambda p: p["x"]), F.transform(pose, lambda p: p["y"])
    return {"centre": c, "angle": angle, "centred": G.shifted(pose, -c["x"], -c["y"]), "orientation_free": G.to_body_frame(pose, c, angle), "min_x": F.array_min(xs), "max_x": F.array_max(xs), "min_y": F.array_min(ys), "max_y": F.array_max(ys)}


def moved_by_stage(df: DataFrame, stage: DataFrame, keys: Sequence[str], at: str, turn: float = 0.0) -> DataFrame:
    """Adds the stage position at each frame, turned by an angle in radians, to poses and contour sides; NULL where the
    stage moves, widths as well."""
    x, y = G.rotated(F.col("stage_x"), F.col("stage_y"), [[math.cos(turn), -math.sin(turn)], [math.sin(turn), math.cos(turn)]])
    df = df.join(stage.select(*keys, at, x.alias("_dx"), y.alias("_dy")), [*keys, at], "left")
    known = F.col("_dx").isNotNull()
    moved = {c: F.when(known, G.shifted(F.col(c), F.col("_dx"), F.col("_dy"))) for c in ("skeleton", "ventral", "dorsal") if c in df.columns}
    if "widths" in df.columns:
        moved["widths"] = F.when(known, F.col("widths"))
    return df.withColumns(moved).drop("_dx", "_dy")


def smooth_track_positions(df: DataFrame, keys: Sequence[str], frame: str = "frame_number", window: int = 5) -> DataFrame:
    """Tracks on a dense frame axis: positions and sizes interpolated, medians over ``window`` frames, roi_size added.

    All windows run over the rows that are there.  Each stands for its own frame and those up to the next row's, and
    knows the values around these, so that dense rows are made in the end and neither shuffled nor sorted.
    """
    cols, smoothed, half = ("coord_x", "coord_y", "area", "threshold"), ("coord_x", "coord_y", "area"), window // 2
    track = Track(tuple(keys), (frame,))
    w, back, at = track.window(), track.backwards(), F.col(frame)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = {c: F.when(F.col(c).isNotNull() & at.isNotNull(), F.struct(at.alias("t"), F.col(c).alias("v"))) for c in cols}
    rows = df.dropna(subset=list(keys)).select(*keys, frame, *cols, F.greatest("box_length", "box_width").alias("_box"))
    rows = rows.withColumns({f"_b_{c}": F.last(k, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)) for c, k in known.items()})
    rows = rows.withColumns({f"_a_{c}": ffill(k, w) for c, k in known.items()} | {"_upto": F.greatest(at, F.lead(at).over(w) - 1), "roi_size": F.max("_box").over(whole) + 10}).where(at.isNotNull())

    def value(c: str, f: Column) -> Column:
        """Of a frame from this row's up to the next one's: lines between values, the nearest one at a track's ends."""
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        inner = a["v"] + (b["v"] - a["v"]) * (f - a["t"]) / (b["t"] - a["t"])
        return F.when((f == at) & F.col(c).isNotNull(), F.col(c)).when(a.isNotNull() & b.isNotNull(), inner).otherwise(F.coalesce(a["v"], b["v"]))

    if half:
        values = lambda first, last: F.transform(F.sequence(first, last), lambda f: F.struct(*(value(c, f).alias(c) for c in smoothed)))
        rows = rows.withColumns({"_head": values(at, F.least("_upto", at + half - 1)), "_tail": values(F.greatest(at, F.col("_upto") - half + 1), F.col("_upto"))})
        rows = rows.withColumns({"_before": F.flatten(F.collect_list("_tail").over(w.rowsBetween(-half, -1))), "_after": F.flatten(F.collect_list("_head").over(w.rowsBetween(1, half)))})
    dense = rows.withColumn("_f", F.explode(F.sequence(at, F.col("_upto"))))
    f = F.col("_f")
    left, right = f - at, F.col("_upto") - f

    def around(c: str) -> Column:
        """The values of the frames around, sorted; those beyond a track's ends are NULL and come first."""
        out = [value(c, f)]
        for k in range(1, half + 1):
            out.append(F.when(left >= k, value(c, f - k)).otherwise(F.get("_before", (F.size("_before") + left - k).cast("int"))[c]))
            out.append(F.when(right >= k, value(c, f + k)).otherwise(F.get("_after", (k - right - 1).cast("int"))[c]))
        return F.sort_array(F.array(*out))

    n = F.lit(1) + (F.least(F.lit(half), F.size("_before") + left) + F.least(F.lit(half), F.size("_after") + right) if half else 0)
    # Lists and their lengths are columns of their own first, so that each is made once.
    dense = dense.select(*keys, f.alias(frame), *(around(c).alias(f"_{c}") for c in smoothed), value("threshold", f).alias("threshold"), "roi_size", n.cast("int").alias("_n"))
    first = 2 * half + 1 - F.col("_n")
    middle = lambda a: (F.get(a, (first + (F.col("_n") - 1) / 2).cast("int")) + F.get(a, (first + F.col("_n") / 2).cast("int"))) / 2
    return dense.select(*keys, frame, *(middle(F.col(f"_{c}")).alias(c) for c in smoothed), "threshold", "roi_size")
