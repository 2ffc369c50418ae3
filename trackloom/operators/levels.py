"""Summary statistics of assembled series by plate, well, trajectory and fold, under their established names.

Every value is shuffled once.  Rows are unfolded to (group, feature, value, labels); one aggregate by group and feature
computes all variants of a feature (plain, absolute, by body length, by behaviour), and the names that a feature really
has are kept.  Results are long: (keys, statistic, value); :func:`wide` turns them into columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions.timeseries import Track
from trackloom.operators import events as E
from trackloom.operators.features import BASE, CURVATURE, PATH, PATH_PARTS, SERIES, SIDED, derivatives
from trackloom.operators.joins import small, spread
from trackloom.operators.summary import event_statistics, grid_coverage, group_median, random_folds, trajectory_info

#: Columns of detected shapes, and names of the labels of events.
BLOB = ["blob_area", "blob_perimeter", "blob_box_length", "blob_box_width", "blob_quirkiness", "blob_compactness", "blob_solidity", *(f"blob_hu{i}" for i in range(7))]
BLOB_SERIES = BLOB + [f"d_{c}" for c in BLOB]
LABELS = {"motion_mode": E.MOTION, "food_region": E.FOOD, "turn": E.TURN}
LINKS = {"motion_mode": "_w_", "food_region": "_in_", "turn": "_"}
QUANTILES = {"10th": 0.1, "50th": 0.5, "90th": 0.9}
_SIZES = ["head_tail_distance", "major_axis", "minor_axis", "dist_from_food_edge", "length", "width_head_base", "width_midbody", "width_tail_base"]


def length_kinds() -> dict[str, str]:
    """How features are freed of body length: "L" by division, "1/L" by multiplication, "L^2" by its square.

    Speeds and radial velocities have no derivatives here.
    """
    moving = [c for c in BASE if "radial_velocity" in c or "speed" in c]
    kinds = {c: "L" for c in [*_SIZES, *(f"d_{c}" for c in _SIZES if c != "head_tail_distance"), *moving]}
    kinds |= {c: "1/L" for b in [*PATH, *CURVATURE] for c in (b, f"d_{b}")}
    return kinds | {"area": "L^2", "d_area": "L^2"}


@dataclass(frozen=True)
class Variant:
    """One way to summarise a feature: freed of length, absolute, or on the rows with a label."""

    feature: str
    name: str
    normal: bool = False
    absolute: bool = False
    label: tuple[str, int] | None = None


def _labelled(feature: str, event: str) -> Iterable[tuple[str, tuple[str, int]]]:
    for code, text in LABELS[event].items():
        yield f"{feature}{LINKS[event]}{text}", (event, code)


def variants(columns: Iterable[str], only_absolute: bool = False) -> list[Variant]:
    """All variants of those features that are among ``columns``, block by block."""
    have = set(columns)
    ts, sided, kinds = [c for c in SERIES if c in have], set(SIDED), length_kinds()
    food, mode = "food_region" in have, "motion_mode" in have
    tag = lambda c, name: name + ("_abs" if c in sided else "")
    out = []
    for c in ts:
        if c != "orientation_food_edge":
            out.append(Variant(c, tag(c, c), absolute=c in sided))
        elif food:
            out += [Variant(c, n, label=x) for n, x in _labelled(c, "food_region")]
    out += [Variant(c, tag(c, f"{c}_norm"), True, c in sided) for c in kinds if c in have]
    if mode:
        out += [Variant(c, tag(c, n), absolute=c in sided, label=x) for c in ts for n, x in _labelled(c, "motion_mode")]
    if not only_absolute:
        out += [Variant(c, c) for c in SIDED if c in have]
        out += [Variant(c, f"{c}_norm", True) for c in kinds if c in have and c in sided]
        if mode:
            out += [Variant(c, n, label=x) for c in SIDED if c in have for n, x in _labelled(c, "motion_mode")]
    blobs = [c for c in BLOB_SERIES if c in have]
    out += [Variant(c, c) for c in blobs]
    if mode:
        out += [Variant(c, n, label=x) for c in blobs for n, x in _labelled(c, "motion_mode")]
    return out


def path_names(normal: bool) -> list[str]:
    tag = "_norm" if normal else ""
    return [n for p in PATH_PARTS for n in (f"path_coverage_{p}{tag}", *(f"path_{k}_{p}{tag}_{q}th" for k in ("density", "transit_time") for q in (50, 95)))]


def event_names() -> list[str]:
    return [f"{e}_{text}_{s}" for e, labels in LABELS.items() for text in labels.values() for s in ("duration_50th", "fraction", "frequency")]


def statistic_names(columns: Iterable[str], only_absolute: bool = False) -> list[str]:
    """Names of all statistics of series with these columns."""
    columns = list(columns)
    out = [f"{v.name}_{q}" for v in variants(columns, only_absolute) for q in (*QUANTILES, "IQR")]
    if "coord_x_body" in columns:
        out += path_names(False) + path_names(True)
    return out + [n for n in event_names() if any(n.startswith(e) for e in LABELS if e in columns)]


def _quantiles(x: Column) -> Column:
    return F.percentile(x, F.array(*(F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9))))


def feature_statistics(df: DataFrame, keys: Sequence[str], worm: str = "worm_index", only_absolute: bool = False) -> DataFrame:
    """(keys, statistic, value): quantiles of all variants of all features; NULL where a feature has no value.

    Lengths are medians of each animal inside its group.  Labels, lengths and sizes are made while rows are unfolded.
    """
    chosen, kinds = variants(df.columns, only_absolute), length_kinds()
    if "length" not in df.columns:
        chosen = [v for v in chosen if not v.normal]
    names = list(dict.fromkeys(v.feature for v in chosen))
    if any(v.normal for v in chosen):
        df = df.withColumn("_m", F.median("length").over(Window.partitionBy(*keys, worm)))
    modes = [e for e in ("motion_mode", "food_region") if e in df.columns]
    factor = {"L": lambda x: x / F.col("_m"), "1/L": lambda x: x * F.col("_m"), "L^2": lambda x: x * F.col("_m") * F.col("_m")}
    normal = {v.feature for v in chosen if v.normal}
    none = F.lit(None).cast("double")
    cell = lambda c: F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"), (factor[kinds[c]](F.col(c).cast("double")) if c in normal else none).alias("norm"))
    rows = df.select(*keys, *(F.col(e).cast("int").alias(f"_{e}") for e in modes), F.explode(F.array(*map(cell, names))).alias("_f")).where("_f.x is not null")
    rows = rows.select(*keys, *(f"_{e}" for e in modes), "_f.*")
    # All ways in which any feature is summarised; a feature that does not need a way gives it nothing to count.
    ways: dict[tuple, set[str]] = {}
    for v in chosen:
        ways.setdefault((v.normal, v.absolute, v.label), set()).add(v.feature)
    out = []
    for i, ((norm, absolute, label), features) in enumerate(ways.items()):
        x = F.col("norm") if norm else F.col("x")
        x = F.abs(x) if absolute else x
        if label is not None:
            x = F.when(F.col(f"_{label[0]}") == label[1], x)
        everywhere = len(features) == len(names)
        out.append(_quantiles(x if everywhere else F.when(F.col("feature").isin(sorted(features)), x)).alias(f"_{i}"))
    sums = rows.groupBy(*keys, "feature").agg(*out)
    at = {way: f"_{i}" for i, way in enumerate(ways)}
    table = df.sparkSession.createDataFrame([(v.feature, v.name, at[(v.normal, v.absolute, v.label)]) for v in chosen], "feature string, name string, way string")
    sums = sums.select(*keys, "feature", F.explode(F.create_map(*(x for w in at.values() for x in (F.lit(w), F.col(w))))).alias("way", "q"))
    sums = sums.join(F.broadcast(table), ["feature", "way"])
    q = F.col("q")
    values = {"10th": q[0], "50th": q[2], "90th": q[4], "IQR": q[3] - q[1]}
    sums = sums.select(*keys, F.explode(F.array(*(F.struct(F.concat("name", F.lit(f"_{k}")).alias("statistic"), v.alias("value")) for k, v in values.items()))).alias("_s")).select(*keys, "_s.*")
    every = F.explode(F.split(F.lit(",".join(f"{v.name}_{k}" for v in chosen for k in values)), ",")).alias("statistic")
    return df.select(*keys).distinct().select(*keys, every).join(sums, [*keys, "statistic"], "left")


def path_statistics(df: DataFrame, keys: Sequence[str], track: Track, fps: float, cell: float = 250.0, lengths: float = 0.25) -> DataFrame:
    """(keys, statistic, value): coverage, density and transit times of four parts, in cells of fixed size and of a
    share of the group's median length, all in one pass."""
    parts = [p for p in PATH_PARTS if f"coord_x_{p}" in df.columns]
    both = [(p, n) for p in parts for n in ((False, True) if "length" in df.columns else (False,))]
    if "length" in df.columns:
        df = df.join(small(group_median(df, keys, "length", "_l")), list(keys))
    unit = lambda p, n: F.struct(F.lit(p).alias("part"), F.lit("_norm" if n else "").alias("tag"), F.col(f"coord_x_{p}").alias("x"), F.col(f"coord_y_{p}").alias("y"), (F.col("_l") * lengths if n else F.lit(float(cell))).alias("cell"), F.lit(1.0 if n else float(cell) ** 2).alias("area"))
    own = list(dict.fromkeys([*keys, *track.keys, *track.order]))
    df = spread(df, list(dict.fromkeys([*track.keys, *keys])), 500_000 // max(1, len(both)))
    rows = df.select(*own, F.explode(F.array(*(unit(p, n) for p, n in both))).alias("_u")).select(*own, "_u.*")
    group, way = [*keys, "part", "tag"], Track((*dict.fromkeys([*track.keys, *keys]), "part", "tag"), track.order)
    cover = grid_coverage(rows, group, "x", "y", F.col("cell"), fps, way, F.col("area"))
    full = {"path_coverage": ("path_coverage_", ""), **{f"path_{k}_{q}th": (f"path_{k}_", f"_{q}th") for k in ("density", "transit_time") for q in (50, 95)}}
    named = [F.struct(F.concat(F.lit(a), "part", "tag", F.lit(b)).alias("statistic"), F.col(c).cast("double").alias("value")) for c, (a, b) in full.items()]
    return cover.select(*keys, F.explode(F.array(*named)).alias("_s")).select(*keys, "_s.*")


def behaviour_statistics(df: DataFrame, keys: Sequence[str], track: Track, fps: float) -> DataFrame:
    """(keys, statistic, value): median duration, share of time and frequency of each label of each event.

    An event whose labels never occur in a group gives nothing there.
    """
    kinds = {e: labels for e, labels in LABELS.items() if e in df.columns}
    inside = Track(tuple(dict.fromkeys([*keys, *track.keys])), track.order)
    runs = E.durations(df, inside, {e: list(labels) for e, labels in kinds.items()})
    out = event_statistics(runs, df, keys, {e: list(labels) for e, labels in kinds.items()}, fps, track.order[-1])
    text = F.create_map(*(F.lit(x) for e, labels in kinds.items() for code, t in labels.items() for x in (f"{e}:{code}", f"{e}_{t}")))
    name = F.element_at(text, F.concat("event_type", F.lit(":"), F.col("region").cast("string")))
    return out.select(*keys, F.explode(F.array(*(F.struct(F.concat(name, F.lit(f"_{c}")).alias("statistic"), F.col(c).alias("value")) for c in ("duration_50th", "fraction", "frequency")))).alias("_s")).select(*keys, "_s.*")


def master_summary(df: DataFrame, keys: Sequence[str], fps: float, track: Track = Track(), delta_time: float = 1 / 3, only_absolute: bool = False) -> DataFrame:  # noqa: B008
    """(keys, statistic, value): all statistics of a series for each group of ``keys``.

    Shapes (columns ``blob_*``), if there are any, get their derivatives inside of each animal of a group first.
    """
    blobs = [c for c in BLOB if c in df.columns]
    inside = Track(tuple(dict.fromkeys([*keys, *track.keys])), track.order)
    if blobs:
        df = derivatives(df, inside, blobs, fps, delta_time)
    out = feature_statistics(df, keys, track.keys[-1], only_absolute)
    if "coord_x_body" in df.columns:
        out = out.unionByName(path_statistics(df, keys, track, fps))
    if any(e in df.columns for e in LABELS):
        out = out.unionByName(behaviour_statistics(df, keys, track, fps))
    return out


def plate_summary(df: DataFrame, keys: Sequence[str], fps: float, **how) -> DataFrame:
    """:func:`master_summary` by plate, or by well where the field of view was split; rows outside of wells are left out
    there."""
    if "well_name" not in df.columns:
        return master_summary(df, keys, fps, **how)
    wells = F.max(F.when(F.col("well_name") != "n/a", 1)).over(Window.partitionBy(*[k for k in keys if k != "window_id"]))
    df = df.withColumn("_split", wells).where(F.col("_split").isNull() | (F.col("well_name") != "n/a")).drop("_split")
    return master_summary(df, [*keys, "well_name"], fps, **how)


def trajectory_summary(df: DataFrame, keys: Sequence[str], fps: float, track: Track = Track(), **how) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """:func:`master_summary` of every animal, and its (ini_time, tot_time, frac_valid[, well_name])."""
    each = list(dict.fromkeys([*keys, *track.keys]))
    return master_summary(df, each, fps, track=track, **how), trajectory_info(df, each, fps, "length", "well_name" if "well_name" in df.columns else None)


def fold_summary(df: DataFrame, keys: Sequence[str], fps: float, track: Track = Track(), n_folds: int = 5, seconds: float = 600.0, share: float = 0.8, seed: int = 0, **how) -> DataFrame:  # noqa: B008
    """:func:`master_summary` of random intervals and shares of animals."""
    folds = random_folds(df, keys, track.keys[-1], track.order[-1], n_folds, seconds, fps, share, seed)
    return master_summary(folds, [*keys, "i_fold"], fps, track=track, **how)


#: Summaries by family of features and level.
SUMMARIES: dict[tuple[str, str], Callable] = {("current", "plate"): plate_summary, ("current", "trajectory"): trajectory_summary, ("current", "plate_augmented"): fold_summary}


def summary_of(family: str, level: str) -> Callable:
    if (family, level) not in SUMMARIES:
        raise ValueError(f"no summary for {family!r} by {level!r}; there are {sorted(SUMMARIES)}")
    return SUMMARIES[family, level]


def wide(summary: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row for each group, a column for each of ``names``, in order."""
    table = summary.where(F.col("statistic").isin(list(names))) if len(names) <= 500 else summary.join(small(summary.sparkSession.createDataFrame([(n,) for n in names], "statistic string")), "statistic")
    values = table.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("statistic", "value"))).alias("_v"))
    return values.select(*keys, *(F.col("_v")[n].alias(n) for n in names))
