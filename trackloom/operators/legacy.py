"""Features of the older route: morphology by means, directions, path curvature, foraging, signed turns, mean summaries."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.functions import kernels
from trackloom.functions.timeseries import Track, fir, wrap_degrees
from trackloom.operators.events import Finder, event_list, find_events, merged_in_order
from trackloom.operators.islands import stretch_extremes
from trackloom.operators.summary import random_folds

#: Subsets of body parts.
SUBSETS = {"normal": ("head", "neck", "midbody", "hips", "tail"), "first_third": ("head", "neck"), "second_third": ("midbody",), "last_third": ("hips", "tail"), "all": ("all",)}
DIRECTIONS = {"tail2head": ("head", "tail"), "head": ("head_tip", "head_base"), "tail": ("tail_tip", "tail_base")}
MOTIONS = {"": None, "forward": 1, "paused": 0, "backward": -1}


def morphology(df: DataFrame) -> DataFrame:
    """length, area, mean widths of head, midbody and tail, and area and midbody width by length."""
    out = {"length": G.length(F.col("skeleton")), "area": G.area(F.col("ventral"), F.col("dorsal"))}
    out |= {f"width_{p}": G.mean(G.part(F.col("widths"), p)) for p in ("head", "midbody", "tail")}
    df = df.withColumns(out)
    return df.withColumns({"area_per_length": F.try_divide("area", "length"), "width_per_length": F.try_divide("width_midbody", "length")})


def directions(pose: Column) -> dict[str, Column]:
    """Angles in degrees between the centres of two parts: of the whole body, the head and the tail."""
    out = {}
    for name, (tip, base) in DIRECTIONS.items():
        a, b = G.centroid(G.part(pose, tip)), G.centroid(G.part(pose, base))
        out[f"direction_{name}"] = F.degrees(F.atan2(a["y"] - b["y"], a["x"] - b["x"]))
    return out


def eigen_projections(df: DataFrame, basis: Sequence[Sequence[float]] | None = None, side: Column | None = None) -> DataFrame:
    """Six projections of tangent angles atan2(y, x) along the body on a basis (cosines unless given), signed by the
    ventral side."""
    basis = basis or G.cosine_basis(48, 6)
    raw = F.transform(G.steps(F.col("skeleton")), lambda v: F.struct(v["y"].alias("x"), v["x"].alias("y")))
    path = F.aggregate(raw, F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))), lambda acc, v: F.concat(acc, F.array(F.struct((F.element_at(acc, -1)["x"] + v["x"]).alias("x"), (F.element_at(acc, -1)["y"] + v["y"]).alias("y")))))
    df = df.withColumn("_a", G.tangent_angles(path))
    sign = F.lit(1) if side is None else F.when(side == "anticlockwise", -1).otherwise(1)
    return df.withColumns({f"eigen_projection_{k}": c * sign for k, c in enumerate(G.projections(F.col("_a"), basis[:6]), 1)}).drop("_a")


def coordinates(df: DataFrame) -> DataFrame:
    """coord_x and coord_y: the mean of both contour sides."""
    ring = F.concat("ventral", "dorsal")
    return df.withColumns({"coord_x": G.centroid(ring)["x"], "coord_y": G.centroid(ring)["y"]})


def chain_lengths(pose: Column) -> Column:
    """Arc length from the first point to each point."""
    steps = G.steps(pose)
    return F.aggregate(steps, F.array(F.lit(0.0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + F.hypot(v["x"], v["y"]))))


def frames_per_sample(fps: float, seconds: float) -> int:
    """The odd number of frames nearest to a time; of two the one nearer, or the larger."""
    n = fps * seconds
    low = math.floor(n)
    if low % 2 == 0:
        low -= 1
    return max(1, low if n - low < low + 2 - n else low + 2)


def path_curvature(df: DataFrame, track: Track, speed: str, direction: str, fps: float, seconds: float = 0.5) -> DataFrame:
    """Adds path_curvature: change of motion direction (degrees) over distance, in radians a unit; under a unit there is
    none."""
    w = track.window()
    scale = frames_per_sample(fps, seconds)
    whole, half = max(1, scale - 1), max(1, int(round((scale + 1) / 2)) - 1)
    change = F.lead(direction, whole).over(w) - F.col(direction)
    change = F.when(change >= 180, change - 360).when(change <= -180, change + 360).otherwise(change)
    at, n = F.row_number().over(w) - 1, F.count(F.lit(1)).over(track.whole())
    size = F.abs(speed)
    distance = F.when((at >= half) & (at < n - whole), (size + F.lead(size, whole).over(w)) / 2 * seconds)
    return df.withColumn("path_curvature", change / F.when(distance >= 1, distance) * math.pi / 180)


def foraging(df: DataFrame, track: Track, nose: str, neck: str, fps: float, smooth: int) -> DataFrame:
    """Adds foraging_amplitude and foraging_speed from the angles (radians) of nose and neck.

    Their difference in degrees is smoothed by a Gaussian of 2 * ``smooth`` + 1 rows; the amplitude is the extremum of
    each stretch between sign changes, the speed the mean of the steps before and after.  Rows within ``smooth`` of an
    end, or of a missing angle, have neither, and without a speed there is no amplitude.
    """
    w = track.window()
    bend = F.degrees(F.col(nose) - F.col(neck))
    bend = F.when(bend > 180, bend - 360).when(bend < -180, bend + 360).otherwise(bend)
    df = df.withColumn("_bend", bend)
    if smooth > 0:
        weights = [math.exp(-0.5 * (2.5 * k / smooth) ** 2) / smooth for k in range(-smooth, smooth + 1)]
        df = df.withColumn("_bend", fir(F.col("_bend"), w, weights))
    df = stretch_extremes(df, F.col("_bend"), track, "_amp")
    speed = (F.lead("_bend").over(w) - F.lag("_bend").over(w)) * fps / 2
    speed = F.when(F.col("_bend").isNotNull(), speed)
    return df.withColumn("foraging_speed", speed).withColumn("foraging_amplitude", F.when(F.col("foraging_speed").isNotNull(), F.col("_amp"))).drop("_bend", "_amp")


def signed_turns(df: DataFrame, track: Track, sign: str, at: str, fps: float, distance: str) -> DataFrame:
    """Turns of frames with sign -1 (ventral) and 1 (dorsal): an event list in order, with is_ventral."""
    dorsal = find_events(df, track, sign, at, Finder(low=1))
    ventral = find_events(df, track, sign, at, Finder(high=-1))
    both = merged_in_order({"ventral": ventral, "dorsal": dorsal}, track.keys)
    lists = event_list(both.select(*track.keys, "start", "end"), df, track, at, fps, distance)
    return lists.join(both.select(*track.keys, "start", "end", (F.col("origin") == "ventral").alias("is_ventral")), [*track.keys, "start", "end"])


def mean_statistics(x: Column, motion: Column, name: str, moving: bool = True, signed: bool = True) -> list[Column]:
    """Means of ``x`` by motion state (of time series) and by sign (of signed features), named <name>[_motion][_sign]."""
    out = []
    for state, code in (MOTIONS if moving else {"": None}).items():
        here = x if code is None else F.when(motion == code, x)
        parts = {"": here} | ({"abs": F.abs(here), "pos": F.when(here > 0, here), "neg": F.when(here < 0, here)} if signed else {})
        out += [F.avg(v).alias("_".join(t for t in (name, state, sign) if t)) for sign, v in parts.items()]
    return out


def mean_summary(df: DataFrame, keys: Sequence[str], features: dict[str, bool], motion: str = "motion_modes", events: DataFrame | None = None, event_features: dict[str, bool] | None = None) -> DataFrame:
    """One row for each group: means of time series by motion and sign, and of event features by sign.

    ``features`` and ``event_features`` map names to whether they are signed; ``events`` is long: (keys, feature, value).
    """
    out = df.groupBy(*keys).agg(*(c for f, signed in features.items() for c in mean_statistics(F.col(f), F.col(motion), f, True, signed)))
    if events is not None and event_features:
        pick = lambda f: F.when(F.col("feature") == f, F.col("value"))
        more = events.groupBy(*keys).agg(*(c for f, signed in event_features.items() for c in mean_statistics(pick(f), F.lit(None), f, False, signed)))
        out = out.join(more, list(keys), "left")
    return out


def mean_fold_summary(df: DataFrame, keys: Sequence[str], features: dict[str, bool], fps: float, track: Track, motion: str = "motion_modes", **how) -> DataFrame:
    """:func:`mean_summary` of random intervals and shares of animals; events are left out."""
    folds = random_folds(df, keys, track.keys[-1], track.order[-1], fps=fps, **how)
    return mean_summary(folds, [*keys, "i_fold"], features, motion)


#: Summaries of this route by level.
SUMMARIES: dict[str, Callable] = {"plate": mean_summary, "trajectory": mean_summary, "plate_augmented": mean_fold_summary}


def missing_poses(rows: DataFrame) -> DataFrame:
    """Rows with pose columns that hold nothing yet."""
    kind = "array<struct<x:double,y:double>>"
    return rows.withColumns({c: F.lit(None).cast(kind) for c in ("skeleton", "ventral", "dorsal")} | {"widths": F.lit(None).cast("array<double>")})


def ventral_check(df: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """(keys, agrees): whether most signed areas of the contours turn the way that the ventral side asks for."""
    ring = F.concat("ventral", F.reverse("dorsal"))
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    turn = F.signum(G.shoelace(xs, ys))
    want = F.when(F.col(side) == "clockwise", -1).when(F.col(side) == "anticlockwise", 1)
    return df.withColumn("_t", turn).groupBy(*keys, side).agg((F.sum("_t") * F.first(want) > 0).alias("agrees"))


def normal_form(df: DataFrame) -> DataFrame:
    """Poses as arrays of coordinates: x, y, ventral_x, ventral_y, dorsal_x, dorsal_y, widths."""
    flat = lambda c, a: F.transform(c, lambda p: p[a])
    names = {"skeleton": "", "ventral": "ventral_", "dorsal": "dorsal_"}
    return df.withColumns({f"{p}{a}": flat(c, a) for c, p in names.items() for a in "xy"}).drop(*names)


def from_arrays(x: Column, y: Column) -> Column:
    """A pose of two coordinate arrays; NULL if any coordinate is missing."""
    pose = F.arrays_zip(x.alias("x"), y.alias("y"))
    pose = F.transform(pose, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    return F.when(F.exists(pose, lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"])), None).otherwise(pose)


def direction_of(angle: Column) -> Column:
    """An angle in degrees in [-180, 180)."""
    return wrap_degrees(angle)


def turn_flags(df: DataFrame, track: Track, fps: float, head: str = "head_bend", body: str = "body_bend", tail: str = "tail_bend", direction: str = "direction_tail2head", moving: str | None = None) -> DataFrame:
    """Adds omega_frames and upsilon_frames, 1 or -1 in turns and 0 elsewhere, by :func:`kernels.turn_signs`.

    :func:`signed_turns` makes event lists of them.
    """
    cols = [head, body, tail, direction, *([moving] if moving else [])]

    def run(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        still = np.zeros(len(pdf), bool) if moving is None else pdf[moving].fillna(False).to_numpy(bool)
        omega, upsilon = kernels.turn_signs(*(pdf[c].to_numpy(float) for c in cols[:4]), still, fps)
        return {"omega_frames": omega, "upsilon_frames": upsilon}

    return kernels.with_tracks(df, track.keys, track.order, cols, run, {"omega_frames": "bigint", "upsilon_frames": "bigint"})


def third_bends(pose: Column) -> dict[str, Column]:
    """Mean bend angles in degrees of the head, middle and tail third of a pose."""
    bends = G.bend_angles(pose)
    known = lambda parts: F.filter(F.concat(*(G.part(bends, p) for p in parts)), lambda x: x.isNotNull())
    mean = lambda a: F.when(F.size(a) > 0, G.mean(a))
    return {name: mean(known(SUBSETS[third])) for name, third in (("head_bend", "first_third"), ("body_bend", "second_third"), ("tail_bend", "last_third"))}
