"""Behavioural events: motion state, food region, turns, bends, and a configurable finder."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import kernels, waves
from trackloom.functions.geometry import bend_angles, heading
from trackloom.functions.timeseries import Track, bfill, ffill, fill_both, nearest_valid, rolling_max, rolling_mean, rolling_min, wrap_degrees
from trackloom.operators.islands import drop_near_runs, drop_short_runs, merge_runs, with_run_id

#: What the codes of the event columns mean.
MOTION = {-1: "backward", 0: "paused", 1: "forward"}
FOOD = {-1: "outside", 0: "edge", 1: "inside"}
TURN = {1: "inter", 0: "intra"}


def flag_regions(df: DataFrame, track: Track, x: str, scale: str, low: float, high: float, smooth: int, min_rows: float, out: str, absolute: bool = False) -> DataFrame:
    """Adds a flag -1, 0, 1 with hysteresis; thresholds are shares of the track's median ``scale`` (unless absolute).

    Values are filled and averaged over a centred full window.  Runs of small values (under ``low``) that last over
    ``min_rows`` are cuts.  Between two cuts, from the last row of the one to the row before the other, a stretch takes
    its only extreme label (beyond ``high``) throughout; with both labels its zeros are filled forward, then backward;
    with none it stays 0.  Window functions over the rows of each track, forwards and backwards, do all of it.
    """
    w, whole = track.window(), track.whole()
    by = F.lit(1.0) if absolute else F.median(scale).over(whole)
    df = df.withColumns({"_by": by, "_fill": fill_both(F.col(x), track)})
    df = df.withColumns({"_mean": rolling_mean(F.col("_fill"), w, smooth), "_at": F.row_number().over(w) - 1})
    small = F.coalesce((F.col("_mean") > -low * F.col("_by")) & (F.col("_mean") < low * F.col("_by")), F.lit(False))
    extreme = F.when(F.col("_mean") < -high * F.col("_by"), -1).when(F.col("_mean") > high * F.col("_by"), 1)
    df = with_run_id(df.withColumns({"_small": small, "_extreme": extreme}), F.col("_small"), track, "_run")
    run = Window.partitionBy(*track.keys, "_run")
    df = df.withColumns({"_first": F.min("_at").over(run), "_last": F.max("_at").over(run)})
    df = df.withColumn("_cut", F.col("_small") & (F.col("_last") - F.greatest(F.col("_first") - 1, F.lit(0)) > min_rows))
    ends = F.col("_cut") & (F.col("_at") == F.col("_last"))
    df = df.withColumn("_stretch", F.sum(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*track.keys, "_stretch")
    near = fill_both(F.col("_extreme"), Track((*track.keys, "_stretch"), track.order))
    df = df.withColumns({"_least": F.min("_extreme").over(inside), "_most": F.max("_extreme").over(inside), "_near": near})
    flag = F.when((F.col("_cut") & ~ends) | F.col("_least").isNull(), 0).when(F.col("_least") == F.col("_most"), F.col("_least")).otherwise(F.col("_near"))
    return df.withColumn(out, flag.cast("int")).drop("_by", "_fill", "_mean", "_at", "_small", "_extreme", "_run", "_first", "_last", "_cut", "_stretch", "_least", "_most", "_near")


def _odd(rows: int) -> int:
    return rows if rows % 2 else rows + 1


def motion_mode(df: DataFrame, track: Track, fps: float, speed: str = "speed", length: str = "length") -> DataFrame:
    """Adds motion_mode: paused under 2.5 % of the length a second, moving over 5 %; pauses last over 3 s; means of 0.5 s."""
    return flag_regions(df, track, speed, length, 0.025, 0.05, _odd(round(fps * 0.5)), fps * 3, "motion_mode")


def food_region(df: DataFrame, track: Track, fps: float, distance: str = "dist_from_food_edge", length: str = "length") -> DataFrame:
    """Adds food_region: the edge is within half a length for over 1 s, inside and outside lie beyond a whole length."""
    return flag_regions(df, track, distance, length, 0.5, 1.0, _odd(round(fps * 0.5)), fps, "food_region")


def turns(df: DataFrame, track: Track, fps: float, head_tail: str = "head_tail_distance", axis: str = "major_axis", angle: str = "angular_velocity", bend: tuple[float, float] = (0.15, 0.075), rotation: tuple[float, float] = (0.75, 0.35), seconds: float = 0.5) -> DataFrame:
    """Adds turn, 1 where a bent body turns fast.

    The bend is 1 - head-tail distance / major axis, as the least of the last ``seconds``; the rotation is the largest
    angular velocity of them; gaps of both are filled by cubic splines.  Rows over both first thresholds are seeds.  In
    each of the two series, runs over the second threshold that hold a seed are turns, with the row before them.
    Tracks with gaps and under four values give NULL.
    """
    w, size = track.window(), _odd(int(fps * seconds))
    df = df.withColumns({"_bend": rolling_min(1 - F.try_divide(F.col(head_tail), F.col(axis)), w, size), "_spin": rolling_max(F.abs(angle), w, size)})

    def run(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        (a, ok_a), (b, ok_b) = (kernels.fill_inner_cubic(pdf[c].to_numpy(float)) for c in ("_bend", "_spin"))
        return {"_bent": a, "_spun": b, "_usable": np.full(len(pdf), ok_a and ok_b)}

    df = kernels.with_tracks(df, track.keys, track.order, ["_bend", "_spin"], run, {"_bent": "double", "_spun": "double", "_usable": "boolean"})
    seed = (F.col("_bent") > bend[0]) & (F.col("_spun") > rotation[0])
    df = df.withColumns({"_seed": F.coalesce(seed, F.lit(False)), "_at": F.row_number().over(w)})
    for name, over in (("_one", F.col("_bent") > bend[1]), ("_two", F.col("_spun") > rotation[1])):
        df = with_run_id(df.withColumn("_over", F.coalesce(over, F.lit(False))), F.col("_over"), track, "_run")
        inside = Window.partitionBy(*track.keys, "_run")
        grown = F.col("_over") & (F.max(F.col("_seed").cast("int")).over(inside) == 1) & (F.max("_at").over(inside) > 1)
        df = df.withColumn(name, grown)
    either = F.col("_one") | F.col("_two") | F.coalesce(F.lead("_one").over(w), F.lit(False)) | F.coalesce(F.lead("_two").over(w), F.lit(False))
    return df.withColumn("turn", F.when(F.col("_usable"), either.cast("int"))).drop("_bend", "_spin", "_bent", "_spun", "_usable", "_seed", "_at", "_over", "_run", "_one", "_two")


def behaviour(df: DataFrame, track: Track, fps: float) -> DataFrame:
    """Adds motion_mode, food_region and turn, as far as their inputs are there."""
    if "speed" in df.columns:
        df = motion_mode(df, track, fps)
    if "dist_from_food_edge" in df.columns:
        df = food_region(df, track, fps)
    if {"head_tail_distance", "major_axis", "angular_velocity"} <= set(df.columns):
        df = turns(df, track, fps)
    return df


def durations(df: DataFrame, track: Track, kinds: dict[str, Sequence[int]], min_rows: int = 0) -> DataFrame:
    """(keys, event_type, region, start, end, duration, edge_flag) of all runs of every label of every event column.

    Bounds and durations are those of :func:`islands.mask_runs`.  All event columns are unfolded and take one shuffle.
    """
    if not kinds:
        raise ValueError("no event column")
    cells = F.explode(F.array(*(F.struct(F.lit(kind).alias("event_type"), F.col(kind).cast("int").alias("region")) for kind in kinds))).alias("_c")
    inside = Track((*track.keys, "event_type"), track.order)
    rows = df.select(*track.keys, *track.order, cells).select(*track.keys, *track.order, "_c.*")
    rows = rows.withColumns({"_at": F.row_number().over(inside.window()) - 1, "_n": F.count(F.lit(1)).over(inside.whole())})
    runs = with_run_id(rows, F.col("region"), inside).groupBy(*inside.keys, "run").agg(F.first("region").alias("region"), F.min("_at").alias("_first"), F.max("_at").alias("end"), F.first("_n").alias("_n"))
    wanted = F.lit(False)
    for kind, values in kinds.items():
        wanted |= (F.col("event_type") == kind) & F.col("region").isin([int(v) for v in values])
    runs = runs.where(wanted).withColumn("start", F.greatest(F.col("_first") - 1, F.lit(0))).withColumn("duration", F.col("end") - F.col("start"))
    edge = F.when(F.col("end") >= F.col("_n") - 1, 1).when(F.col("start") <= 0, -1).otherwise(0)
    return runs.where(F.col("duration") > min_rows).select(*track.keys, "start", "end", "duration", edge.alias("edge_flag"), "event_type", "region")


@dataclass(frozen=True)
class Finder:
    """What makes an event: values within bounds, gaps that are bridged, least rows and least summed distance."""

    low: float | None = None
    high: float | None = None
    inclusive: bool = True
    max_gap: int = 0
    min_rows: int = 1
    min_distance: float | None = None


def find_events(df: DataFrame, track: Track, x: str, at: str, how: Finder, distance: str | None = None) -> DataFrame:
    """(keys, start, end) of events in the order threshold, merging, short ones, near ones.

    Missing values before the first or after the last value belong to the event that they touch.
    """
    before, after = ffill(F.col(x), track.window()), bfill(F.col(x), track)
    edge = F.when(F.col(x).isNull() & before.isNull(), after).when(F.col(x).isNull() & after.isNull(), before).otherwise(F.col(x))
    df = df.withColumn("_x", edge)
    on = df.withColumn("_on", F.coalesce(_within(F.col("_x"), how), F.lit(False)))
    runs = on.withColumn("_g", F.col(at) - F.row_number().over(Window.partitionBy(*track.keys, "_on").orderBy(at))).where("_on").groupBy(*track.keys, "_g").agg(F.min(at).alias("start"), F.max(at).alias("end")).drop("_g")
    runs = merge_runs(runs, track.keys, how.max_gap) if how.max_gap else runs
    runs = drop_short_runs(runs.select(*track.keys, "start", "end"), how.min_rows)
    if how.min_distance is not None and distance:
        runs = drop_near_runs(df, runs, track.keys, at, distance, how.min_distance)
    return runs


def _within(x: Column, how: Finder) -> Column:
    ok: Column = F.lit(True)
    if how.low is not None:
        ok = x >= how.low if how.inclusive else x > how.low
    if how.high is not None:
        ok &= x <= how.high if how.inclusive else x < how.high
    return ok


def label_by_events(df: DataFrame, track: Track, at: str, events: dict[int, DataFrame], out: str = "motion_mode") -> DataFrame:
    """Adds the code of the first event list with an event over the row; other rows get NULL."""
    parts = None
    for rank, (code, runs) in enumerate(events.items()):
        runs = runs.select(*track.keys, "start", "end", F.lit(code).alias("_code"), F.lit(rank).alias("_rank"))
        parts = runs if parts is None else parts.unionByName(runs)
    rows = parts.withColumn(at, F.explode(F.sequence("start", "end"))).groupBy(*track.keys, at).agg(F.min_by("_code", "_rank").alias(out))
    return df.join(rows, [*track.keys, at], "left")


def event_list(runs: DataFrame, df: DataFrame, track: Track, at: str, fps: float, distance: str) -> DataFrame:
    """Durations, gaps to the next event and distances of events; is_partial marks those that touch the track's ends."""
    sums = runs.join(df.select(*track.keys, at, distance), list(track.keys)).where(F.col(at).between(F.col("start"), F.col("end"))).groupBy(*track.keys, "start", "end").agg(F.sum(distance).alias("distance"))
    ends = df.groupBy(*track.keys).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    w = Window.partitionBy(*track.keys).orderBy("start")
    out = sums.join(ends, list(track.keys))
    gap = F.lead("start").over(w) - F.col("end") - 1
    gap_distance = df.groupBy(*track.keys).agg(F.sum(distance).alias("_whole"))
    return out.join(gap_distance, list(track.keys)).select(*track.keys, "start", "end", ((F.col("end") - F.col("start") + 1) / fps).alias("event_duration"), (gap / fps).alias("inter_duration"), "distance", ((F.col("start") <= F.col("_a")) | (F.col("end") >= F.col("_b"))).alias("is_partial"), ((F.col("_b") - F.col("_a") + 1) / fps).alias("seconds"), F.col("_whole"))


def event_totals(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """frequency (whole events a second), time_ratio and distance_ratio for each group of an :func:`event_list`."""
    n = F.count(F.when(~F.col("is_partial"), 1))
    return events.groupBy(*keys).agg((n / F.first("seconds")).alias("frequency"), (F.sum("event_duration") / F.first("seconds")).alias("time_ratio"), F.try_divide(F.sum("distance"), F.first("_whole")).alias("distance_ratio"))


def legacy_velocity(df: DataFrame, track: Track, x: str, y: str, body: str, fps: float, seconds: float, part: str) -> DataFrame:
    """Adds <part>_speed and <part>_direction from the nearest known positions half a sample away on both sides.

    Speed is negative where motion and body direction (degrees) differ by more than 90.
    """
    half = max(1, round(fps * seconds) // 2)
    w, point = track.window(), F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.struct(x, y))
    df = df.withColumn("_at", F.row_number().over(w)).withColumn("_p", point)
    a, b = nearest_valid(F.col("_p"), F.col("_at"), w, half)
    df = df.withColumn("_a", a).withColumn("_b", b)
    df = df.withColumns({"_dx": F.col("_b.v")[x] - F.col("_a.v")[x], "_dy": F.col("_b.v")[y] - F.col("_a.v")[y]})
    # Angles come after all windows: rows that come back from Python would be shuffled anew for one.
    df = df.withColumns({"_dx0": F.lag("_dx").over(w), "_dy0": F.lag("_dy").over(w)})
    df = df.withColumns({"_dir": F.degrees(heading(F.col("_dy"), F.col("_dx"))), "_dir0": F.degrees(heading(F.col("_dy0"), F.col("_dx0")))})
    size = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")) / ((F.col("_b.t") - F.col("_a.t")) / fps)
    sign = F.when(F.abs(wrap_degrees(F.col("_dir") - F.col(body))) > 90, -1).otherwise(1)
    df = df.withColumn(f"{part}_speed", size * sign).withColumn(f"{part}_direction", wrap_degrees(F.col("_dir") - F.col("_dir0")) * fps)
    return df.drop("_at", "_p", "_a", "_b", "_dx", "_dy", "_dx0", "_dy0", "_dir", "_dir0")


def kinks(pose: Column, least: float = 10.0) -> Column:
    """Number of bends: runs of equal sign whose largest angle is at least ``least`` degrees."""
    angles = F.filter(bend_angles(pose), lambda a: a.isNotNull())
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("sign"), F.lit(False).alias("hit"))

    def step(s: Column, a: Column) -> Column:
        new = F.signum(a) != s["sign"]
        hit = F.when(new, F.abs(a) >= least).otherwise(s["hit"] | (F.abs(a) >= least))
        first = hit & (new | ~s["hit"])
        return F.struct((s["n"] + first.cast("int")).alias("n"), F.signum(a).alias("sign"), hit.alias("hit"))

    return F.aggregate(angles, start, step)["n"]


def crawling_bends(df: DataFrame, track: Track, bend: str, fps: float, out: str, paused: str | None = None, seconds: tuple[float, float] = (0.5, 15.0), samples: int = waves.SAMPLES) -> DataFrame:
    """Adds <out>_amplitude and <out>_frequency of a bend angle's wave around each frame, signed by the bend's side.

    Missing angles between others are interpolated.  A window that the angle's zero crossings bound is centred on each
    frame, and the peak of its spectrum is taken if its troughs are low and most of the energy lies between them
    (``waves.bend_waves``); else, and where the column ``paused`` holds, both are NULL.  Windows are padded to ``samples``,
    which must be no fewer than twice the longest time.
    """

    def run(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        x = pdf[bend].to_numpy(float)
        x = pd.Series(x).interpolate(limit_area="inside").to_numpy()
        still = None if paused is None else pdf[paused].fillna(False).to_numpy(bool)
        amplitude, frequency = waves.bend_waves(x, fps, still, seconds, samples)
        return {f"{out}_amplitude": amplitude, f"{out}_frequency": frequency}

    return kernels.with_tracks(df, track.keys, track.order, [bend] + ([paused] if paused else []), run, {f"{out}_amplitude": "double", f"{out}_frequency": "double"})


def separated_peaks(df: DataFrame, track: Track, x: str, apart: int, name: str = "is_peak") -> DataFrame:
    """Adds whether a row is a peak of ``x``: highest first, each more than ``apart`` rows from all peaks that are higher."""

    def run(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        flag = np.zeros(len(pdf), bool)
        flag[kernels.greedy_peaks(pdf[x].to_numpy(float), apart)] = True
        return {name: flag}

    return kernels.with_tracks(df, track.keys, track.order, [x], run, {name: "boolean"})


def coils(df: DataFrame, track: Track, code: str, fps: float, codes: Sequence[int] = (105, 106), seconds: float = 0.2) -> DataFrame:
    """(keys, start, end): from a frame coded as a coil to the last before the next segmented one, at least ``seconds`` long.

    Frames with code 1 are segmented; coils of one such stretch are one event.
    """
    w = track.window()
    df = df.withColumn("_at", F.row_number().over(w) - 1).withColumn("_block", F.sum((F.col(code) == 1).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.when(F.col(code).isin(list(codes)), F.col("_at")))
    out = df.groupBy(*track.keys, "_block").agg(first.alias("start"), F.max("_at").alias("end")).where("start is not null")
    return out.where((F.col("end") - F.col("start") + 1) / fps >= seconds).select(*track.keys, "start", "end")


def merged_in_order(lists: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Event lists as one, with their origin and place by start."""
    out = None
    for name, runs in lists.items():
        runs = runs.withColumn("origin", F.lit(name))
        out = runs if out is None else out.unionByName(runs, allowMissingColumns=True)
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "origin")))
