"""Runs of equal labels in ordered tracks, and what is made of them: merging, filtering, sessions, seeded growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions.timeseries import Track


def with_run_id(df: DataFrame, label: Column, track: Track, name: str = "run") -> DataFrame:
    """Adds the number of the run of equal labels, from 0 in each track; NULL labels are equal to each other."""
    w = track.window()
    change = F.when(F.row_number().over(w) == 1, 0).when(label.eqNullSafe(F.lag(label).over(w)), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn(name, F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def label_runs(df: DataFrame, label: str, track: Track, at: str) -> DataFrame:
    """(keys, run, label, start, end, n_rows, edge_flag) of every run of a label over the integer position ``at``.

    edge_flag is -1 for a run at the track's first position, 1 at its last (this one wins), else 0.
    """
    bounds = track.whole()
    df = with_run_id(df, F.col(label), track).withColumn("_first", F.min(at).over(bounds)).withColumn("_last", F.max(at).over(bounds))
    out = df.groupBy(*track.keys, "run").agg(F.first(label).alias(label), F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n_rows"), F.first("_first").alias("_first"), F.first("_last").alias("_last"))
    edge = F.when(F.col("end") >= F.col("_last"), 1).when(F.col("start") <= F.col("_first"), -1).otherwise(0)
    return out.withColumn("edge_flag", edge).drop("_first", "_last")


def mask_runs(df: DataFrame, mask: Column, track: Track, min_duration: int = 0) -> DataFrame:
    """(keys, start, end, duration, edge_flag) of the runs where ``mask`` holds, in row positions from 0.

    A run's start is the row before its first true one, clipped at 0, and its end is its last true row, so that the
    duration is the run's length, one less if it begins the track.  Runs must be longer than ``min_duration``.
    edge_flag is -1 if start is 0, 1 if the run ends the track (this one wins), else 0.
    """
    w = track.window()
    df = df.withColumn("_on", F.coalesce(mask, F.lit(False))).withColumn("_at", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(track.whole()))
    runs = with_run_id(df, F.col("_on"), track).where("_on").groupBy(*track.keys, "run").agg(F.min("_at").alias("_first"), F.max("_at").alias("end"), F.first("_n").alias("_n"))
    runs = runs.withColumn("start", F.greatest(F.col("_first") - 1, F.lit(0))).withColumn("duration", F.col("end") - F.col("start"))
    edge = F.when(F.col("end") >= F.col("_n") - 1, 1).when(F.col("start") <= 0, -1).otherwise(0)
    return runs.where(F.col("duration") > min_duration).select(*track.keys, "start", "end", "duration", edge.alias("edge_flag"))


def merge_runs(runs: DataFrame, keys: tuple[str, ...], max_gap: int, inclusive: bool = True) -> DataFrame:
    """Joins runs whose gap, start - previous end - 1, is at most ``max_gap`` (less than it, unless ``inclusive``).

    Runs may overlap.  Returns (keys, start, end, n_runs).
    """
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("start") - reach - 1
    far = gap > max_gap if inclusive else gap >= max_gap
    runs = runs.withColumn("_new", F.when(far, 1).otherwise(0)).withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_runs")).drop("_group")


def drop_short_runs(runs: DataFrame, min_rows: int) -> DataFrame:
    return runs.where(F.col("end") - F.col("start") + 1 >= min_rows)


def drop_near_runs(df: DataFrame, runs: DataFrame, keys: tuple[str, ...], at: str, distance: str, threshold: float) -> DataFrame:
    """Runs whose rows' distances add up to more than ``threshold``."""
    held = runs.join(df.select(*keys, at, distance), list(keys)).where(F.col(at).between(F.col("start"), F.col("end")))
    sums = held.groupBy(*keys, "start", "end").agg(F.sum(distance).alias("_sum")).where(F.col("_sum") > threshold)
    return runs.join(sums.drop("_sum"), [*keys, "start", "end"], "left_semi")


def sessions(df: DataFrame, at: Column, track: Track, max_gap: float, name: str = "session") -> DataFrame:
    """Adds the number of the session: a new one starts where the step since the row before is at least ``max_gap``."""
    w = track.window()
    new = F.when(at - F.lag(at).over(w) >= max_gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def seeded_growth(df: DataFrame, low: Column, seed: Column, track: Track, name: str = "grown") -> DataFrame:
    """Adds a flag: the row lies in a run of ``low`` rows that holds a seed."""
    df = with_run_id(df.withColumn("_low", F.coalesce(low, F.lit(False))), F.col("_low"), track, "_run")
    inside = Window.partitionBy(*track.keys, "_run")
    grown = F.col("_low") & F.coalesce(F.max(seed.cast("int")).over(inside) == 1, F.lit(False))
    return df.withColumn(name, grown).drop("_low", "_run")


def stretch_extremes(df: DataFrame, x: Column, track: Track, name: str = "extreme") -> DataFrame:
    """Adds, on every stretch between sign changes, the stretch's value of largest size."""
    df = with_run_id(df, F.signum(x), track, "_run")
    inside = Window.partitionBy(*track.keys, "_run")
    return df.withColumn(name, F.when(x >= 0, F.max(x).over(inside)).otherwise(F.min(x).over(inside))).drop("_run")


def run_statistics(runs: DataFrame, by: tuple[str, ...], label: str, labels: list, fps: float, duration: str = "n_rows") -> DataFrame:
    """Median duration, share of time and number of runs that do not touch the left edge, for each label.

    Labels that never occur give zeros; ``by`` groups without any run are absent.
    """
    total = F.sum(duration)
    out = runs.groupBy(*by).agg(*(e for k in labels for e in (
        F.coalesce(F.median(F.when(F.col(label) == k, F.col(duration) / fps)), F.lit(0.0)).alias(f"{label}_{k}_duration_50th"),
        F.coalesce(F.sum(F.when(F.col(label) == k, F.col(duration))) / total, F.lit(0.0)).alias(f"{label}_{k}_fraction"),
        F.count(F.when((F.col(label) == k) & (F.col("edge_flag") != -1), 1)).alias(f"{label}_{k}_n_runs"),
    )))
    return out
