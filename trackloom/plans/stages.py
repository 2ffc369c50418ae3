"""Pipelines of named stages: lists by analysis type, parameters, requirements, resumption, file states."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, fields, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    """A named step: tables it reads, the table it writes, and how; ``before`` changes the first table it reads."""

    name: str
    inputs: tuple[str, ...]
    output: str
    run: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    before: Callable[[DataFrame], DataFrame] | None = None


#: Names of the steps of an analysis, in order.
BASE_STEPS = ("COMPRESS", "TRAJ_CREATE", "TRAJ_JOIN", "SKE_INIT", "BLOB_FEATS", "SKE_CREATE", "SKE_FILT", "SKE_ORIENT", "INT_PROFILE", "INT_SKE_ORIENT")
ANALYSES = {
    "BASE": BASE_STEPS,
    "CURRENT": (*BASE_STEPS, "FEAT_INIT", "FEAT_FRAMES"),
    "LEGACY": (*BASE_STEPS, "FEAT_CREATE"),
    "SINGLE": ("COMPRESS", "COMPRESS_ADD_DATA", *BASE_STEPS[1:8], "STAGE_ALIGN", "CONTOUR_ORIENT", *BASE_STEPS[8:]),
}


def steps(analysis: str, start: str = "", end: str = "") -> list[str]:
    """The steps of an analysis from ``start`` to ``end``, both included."""
    names = list(ANALYSES[analysis])
    a = names.index(start) if start else 0
    b = names.index(end) + 1 if end else len(names)
    if a >= b:
        raise ValueError("the last step comes before the first")
    return names[a:b]


def planned_steps(files: DataFrame, analysis: str = "analysis", start: str = "start", end: str = "end") -> DataFrame:
    """(file_id, place, step): the steps of each file's analysis from its ``start`` to its ``end``, from 0.

    NULL or empty bounds are open.  An unknown analysis or bound, or a last step before the first, gives one row without
    a step.
    """
    lists = F.create_map(*(x for name, names in ANALYSES.items() for x in (F.lit(name), F.array(*map(F.lit, names)))))
    names = F.try_element_at(lists, F.col(analysis))
    place = lambda c, none: F.when(F.coalesce(F.col(c), F.lit("")) == "", none).otherwise(F.array_position(names, F.col(c)))
    a, b = place(start, F.lit(1)).cast("int"), place(end, F.size(names)).cast("int")
    some = F.when((a > 0) & (b >= a), F.slice(names, a, b - a + 1))
    return files.select("file_id", F.posexplode_outer(some).alias("place", "step"))


@dataclass(frozen=True)
class Parameters:
    """Parameters with defaults; -1 stands for a default that follows from the frame rate."""

    expected_fps: float = 25.0
    microns_per_pixel: float = 1.0
    threshold: int = 20
    min_area: int = 50
    max_distance: float = 25.0
    area_ratio_low: float = 0.5
    area_ratio_high: float = 2.0
    max_frames_gap: int = 0
    min_track_size: int = 1
    min_displacement: float = 0.0
    min_frames: int = 1
    min_frac_skeletons: float = 0.8
    smooth_window_s: float = -1
    max_gap_s: float = 0.25
    derivative_s: float = 1 / 3
    save_interval_frames: int = -1
    analysis: str = "CURRENT"

    ALIASES = {"fps": "expected_fps", "min_num_skel": "min_frames", "bad_seg_thresh": "min_frac_skeletons", "min_displacement_px": "min_displacement"}

    @classmethod
    def of(cls, text: str) -> Parameters:
        """From JSON; old names count, unknown ones are an error."""
        given = {cls.ALIASES.get(k, k): v for k, v in json.loads(text or "{}").items()}
        known = {f.name: f for f in fields(cls)}
        if bad := sorted(set(given) - set(known)):
            raise ValueError(f"unknown parameters: {', '.join(bad)}")
        return cls(**{k: type(known[k].default)(v) for k, v in given.items()})

    def resolved(self, fps: float) -> Parameters:
        """With what follows from the frame rate filled in."""
        return replace(self, smooth_window_s=self.smooth_window_s if self.smooth_window_s >= 0 else 0.25, save_interval_frames=self.save_interval_frames if self.save_interval_frames >= 0 else int(200 * fps))


def resolved_parameters(files: DataFrame, given: str = "parameters", fps: str = "fps") -> DataFrame:
    """``files`` with every parameter as a column, from JSON objects; what is not given takes its default.

    Old names count, the new one first.  ``fps`` decides what follows from the frame rate.  ``unknown`` lists names that
    are no parameters; such files must not run.
    """
    kinds = {bool: "boolean", int: "int", float: "double", str: "string"}
    known = {f.name: f.default for f in fields(Parameters)}
    old = {a: n for a, n in Parameters.ALIASES.items()}
    schema = ", ".join(f"{n} {kinds[type(known.get(n, known.get(old.get(n))))]}" for n in [*known, *old])
    got = F.from_json(F.coalesce(F.col(given), F.lit("{}")), schema)
    out = {n: F.coalesce(got[n], *(got[a] for a, new in old.items() if new == n), F.lit(v)) for n, v in known.items()}
    out["smooth_window_s"] = F.when(out["smooth_window_s"] >= 0, out["smooth_window_s"]).otherwise(0.25)
    out["save_interval_frames"] = F.when(out["save_interval_frames"] >= 0, out["save_interval_frames"]).otherwise((200 * F.col(fps)).cast("int"))
    names = F.json_object_keys(F.coalesce(F.col(given), F.lit("{}")))
    out["unknown"] = F.filter(names, lambda n: ~n.isin([*known, *old]))
    return files.withColumns(out)


@dataclass
class Plan:
    """Stages over tables by name.  Nothing runs before a table is used or written."""

    stages: Sequence[Stage]
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def run(self, start: str = "", end: str = "") -> dict[str, DataFrame]:
        names = [s.name for s in self.stages]
        a, b = names.index(start) if start else 0, names.index(end) if end else len(names) - 1
        for s in self.stages[a : b + 1]:
            if lacking := [t for t in (*s.inputs, *s.needs) if t not in self.tables]:
                raise ValueError(f"{s.name} needs {', '.join(lacking)}")
            given = [self.tables[t] for t in s.inputs]
            if s.before is not None:
                given[0] = s.before(given[0])
            self.tables[s.output] = s.run(*given)
        return self.tables


def isolated(df: DataFrame, keys: Sequence[str], kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``kernel`` on each group; a group whose kernel fails gives one row of its keys and the column ``error``.

    ``schema`` is that of the kernel's result, keys included.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return kernel(pdf)[names].assign(error=None)
        except Exception as e:  # noqa: BLE001  whatever a group does must not stop the others
            return pd.DataFrame([{**{n: None for n in names}, **{k: pdf[k].iloc[0] for k in keys}, "error": f"{type(e).__name__}: {e}"}])

    return df.groupBy(*keys).applyInPandas(run, f"{schema}, error string")


def next_steps(files: DataFrame, provenance: DataFrame, names: Sequence[str]) -> DataFrame:
    """(file_id, next_step): the first step of each file without provenance; NULL where all are done."""
    grid = files.select("file_id").withColumn("s", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("point")) for i, n in enumerate(names))))).select("file_id", "s.*")
    todo = grid.join(provenance.select("file_id", "point").distinct(), ["file_id", "point"], "left_anti").groupBy("file_id").agg(F.min_by("point", "i").alias("next_step"))
    return files.select("file_id").join(todo, "file_id", "left")


def file_states(files: DataFrame, todo: DataFrame, errors: DataFrame) -> DataFrame:
    """Adds state: FINISHED_GOOD or FINISHED_BAD, SOURCE_GOOD or SOURCE_BAD."""
    bad = errors.select("file_id").distinct().withColumn("_bad", F.lit(True))
    out = files.join(todo, "file_id", "left").join(bad, "file_id", "left")
    kind = F.when(F.col("next_step").isNull(), "FINISHED").otherwise("SOURCE")
    return out.withColumn("state", F.concat_ws("_", kind, F.when(F.col("_bad"), "BAD").otherwise("GOOD"))).drop("_bad")
