"""Track identities: chains of links, gap joining, manual edits, orientation by movement."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trackloom.functions import kernels, stage
from trackloom.functions.timeseries import Track, fill_both, rolling_std, unwrap
from trackloom.operators.islands import sessions
from trackloom.operators.joins import _table, gap_links, nearest_links


def chain_roots(links: DataFrame, keys: Sequence[str], node: str, previous: str = "previous") -> DataFrame:
    """(keys, node, root): where the links of each node end.  Every round doubles the steps taken."""
    up = _table(links.select(*keys, F.col(node).alias("_n"), F.col(previous).alias("_p")), "chain")
    while True:
        nxt = up.select(*keys, F.col("_n").alias("_p"), F.col("_p").alias("_q"))
        up2 = up.join(nxt, [*keys, "_p"], "left").select(*keys, "_n", F.coalesce("_q", "_p").alias("_p"), F.col("_q").isNotNull().alias("_moved"))
        up2 = _table(up2, "chain")
        if up2.where("_moved").isEmpty():
            return up2.select(*keys, F.col("_n").alias(node), F.col("_p").alias("root"))
        up = up2.select(*keys, "_n", "_p")


def link_detections(points: DataFrame, keys: Sequence[str] = ("file_id",), frame: str = "frame_number", row: str = "row_id", max_distance: float = 25.0, ratio: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """Adds worm_index_blob: detections linked from frame to frame; ids count track heads by frame and row, from 1."""
    links = nearest_links(points, keys, frame, row, "coord_x", "coord_y", "area", max_distance, ratio)
    roots = chain_roots(links, keys, row)
    out = points.join(roots, [*keys, row], "left").withColumn("root", F.coalesce("root", F.col(row)))
    heads = out.where(F.col("root") == F.col(row)).select(*keys, F.col(row).alias("root"), F.row_number().over(Window.partitionBy(*keys).orderBy(frame, row)).alias("worm_index_blob"))
    return out.join(heads, [*keys, "root"]).drop("root")


def join_gaps(points: DataFrame, keys: Sequence[str] = ("file_id",), frame: str = "frame_number", track: str = "worm_index_blob", max_gap: int = 0, ratio: tuple[float, float] = (0.5, 2.0), min_rows: int = 1) -> DataFrame:
    """Adds worm_index_joined: tracks joined across gaps take the id of the earliest; tracks under ``min_rows`` get NULL."""
    ends = points.groupBy(*keys, track).agg(
        F.min(frame).alias("start"), F.max(frame).alias("end"), F.count("*").alias("n"),
        F.min_by(F.struct("coord_x", "coord_y", "area"), frame).alias("_a"), F.max_by(F.struct("coord_x", "coord_y", "area", "box_length"), frame).alias("_b"),
    )
    flat = ends.select(*keys, track, "start", "end", "n", *(F.col(f"_{s}.{c}").alias(f"{n}{i}") for s, i in (("a", 0), ("b", 1)) for c, n in (("coord_x", "x"), ("coord_y", "y"), ("area", "size"))), F.col("_b.box_length").alias("reach"))
    roots = chain_roots(gap_links(flat, keys, track, max_gap, ratio, min_rows), keys, track)
    ids = flat.join(roots, [*keys, track], "left").select(*keys, track, F.when(F.col("n") >= min_rows, F.coalesce("root", F.col(track))).alias("worm_index_joined"))
    return points.join(ids, [*keys, track], "left")


def set_label(df: DataFrame, track: str, ids: Column | Sequence[int], label: int) -> DataFrame:
    """Labels tracks by hand; later calls win."""
    hit = F.col(track).isin(list(ids)) if not isinstance(ids, Column) else ids
    return df.withColumn("worm_label", F.when(hit, F.lit(label)).otherwise(F.col("worm_label")))


def merge_tracks(df: DataFrame, track: str, first: int, second: int, frame: str = "frame_number", new: int | None = None, checked: bool = True) -> DataFrame:
    """Joins two tracks by hand into a new id above all; both must exist, differ, and share no frame.

    ``new`` names another id.  With ``checked`` off, tracks that are absent or share frames are joined as they are.
    """
    if first == second:
        raise ValueError("a track cannot be joined with itself")
    both = df.where(F.col(track).isin(first, second))
    if checked:
        found = both.agg(F.count_distinct(track), F.count(frame), F.count_distinct(frame)).first()
        if found[0] != 2:
            raise ValueError("no such track")
        if found[1] != found[2]:
            raise ValueError("the tracks overlap")
    new = df.agg(F.max(track)).first()[0] + 1 if new is None else new
    label = F.when(F.col(track) == second, both.where(F.col(track) == first).agg(F.max("worm_label")).first()[0]).otherwise(F.col("worm_label")) if "worm_label" in df.columns else None
    df = df.withColumn("worm_label", label) if label is not None else df
    return df.withColumn(track, F.when(F.col(track).isin(first, second), F.lit(new)).otherwise(F.col(track)))


def split_track(df: DataFrame, track: str, which: int, at: int, frame: str = "frame_number") -> DataFrame:
    """Splits a track by hand: rows before the frame get the first new id above all, the others the second."""
    top = df.agg(F.max(track)).first()[0]
    return df.withColumn(track, F.when(F.col(track) != which, F.col(track)).when(F.col(frame) < at, F.lit(top + 1)).otherwise(F.lit(top + 2)))


def orient_by_movement(df: DataFrame, track: Track, head: str, tail: str, at: str, max_gap: int, size: int, min_rows: int, wrapped: bool = True) -> DataFrame:
    """Adds is_switched: in most rows of the block of poses, the head's angle varies less than the tail's.

    Blocks are split at gaps of ``max_gap``; blocks with fewer than ``min_rows`` comparisons take the state of the block
    before, or else after.  Angles without jumps (``wrapped`` off) are taken as they are.
    """
    w = track.window()
    df = unwrap(unwrap(df, head, track, "_h"), tail, track, "_t") if wrapped else df.withColumns({"_h": F.col(head), "_t": F.col(tail)})
    df = df.withColumn("_hs", rolling_std(F.col("_h"), w, size, size)).withColumn("_ts", rolling_std(F.col("_t"), w, size, size))
    df = sessions(df, F.col(at), track, max_gap, "_block")
    block = Window.partitionBy(*track.keys, "_block")
    less = F.when(F.col("_hs").isNotNull() & F.col("_ts").isNotNull(), (F.col("_hs") < F.col("_ts")).cast("double"))
    vote = F.when(F.count(less).over(block) >= min_rows, F.avg(less).over(block) > 0.5)
    df = df.withColumn("_vote", vote)
    return df.withColumn("is_switched", F.coalesce(fill_both(F.col("_vote"), track), F.lit(False))).drop("_h", "_t", "_hs", "_ts", "_block", "_vote")


def flip_poses(df: DataFrame, flag: str = "is_switched") -> DataFrame:
    """Reverses poses and swaps contour sides where the flag holds."""
    swap = lambda a, b: F.when(F.col(flag), F.reverse(b)).otherwise(a)
    out = {c: swap(F.col(c), F.col(c)) for c in ("skeleton", "widths") if c in df.columns}
    if {"ventral", "dorsal"} <= set(df.columns):
        out |= {"ventral": swap(F.col("ventral"), F.col("dorsal")), "dorsal": swap(F.col("dorsal"), F.col("ventral"))}
    return df.withColumns(out)


def consistent_flips(df: DataFrame, track: Track, pose: str, name: str = "flip") -> DataFrame:
    """Adds whether a pose must be reversed to follow the last one before it: the parity of the pairwise reversals so far."""
    w = track.window()
    before = F.last(pose, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))

    def distance(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"])), F.lit(0.0), lambda s, d: s + d)

    df = df.withColumn("_turn", F.coalesce((distance(F.reverse(pose), before) < distance(F.col(pose), before)).cast("int"), F.lit(0)))
    return df.withColumn(name, F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1).drop("_turn")


def _followed(batches: Iterator[pd.DataFrame], keys: Sequence[str], frame: str, row: str, centre: tuple[float, float], max_distance: float) -> Iterator[pd.DataFrame]:
    """(keys, row) of one detection a frame, from batches of sorted rows that may end anywhere: only the animal's place
    and the best detection of the frame so far are kept."""
    before, at, limit = None, None, np.inf
    far, place, pick = np.inf, None, None  # of the best detection of the frame; pick is a number in this batch, or its row
    for pdf in batches:
        out, numbers = [], []
        x, y, area = (pdf[c].to_numpy(float) for c in ("coord_x", "coord_y", "area"))
        both = pdf[[*keys, frame]] if before is None else pd.concat([before, pdf[[*keys, frame]]])
        other = (both.ne(both.shift()) & ~(both.isna() & both.shift().isna())).to_numpy()[len(both) - len(pdf) :]
        if before is None and len(pdf):
            other[0] = True
        before = both.iloc[-1:].copy()
        new_file, new_frame = other[:, :-1].any(axis=1), other.any(axis=1)
        cuts = np.unique([0, *np.flatnonzero(new_frame), len(pdf)])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if new_frame[a]:
                if place is not None and far <= limit:
                    (out if isinstance(pick, pd.DataFrame) else numbers).append(pick)
                    at = place
                limit, far, place = max_distance, np.inf, None
                if new_file[a]:
                    at, limit = None, np.inf
            u, v = (x[a:b] - centre[0], y[a:b] - centre[1]) if at is None else (x[a:b] - at[0], y[a:b] - at[1])
            d = np.sqrt(u * u + v * v)
            if at is None:
                d = d / np.sqrt(np.maximum(area[a:b], 1e-9))
            d[np.isnan(d)] = np.inf
            k = int(np.argmin(d))
            if d[k] < far or (at is None and place is None):
                far, place, pick = d[k], (x[a + k], y[a + k]), a + k
        if place is not None and not isinstance(pick, pd.DataFrame):
            pick = pdf[[*keys, row]].iloc[[pick]]
        yield pd.concat([*out, pdf[[*keys, row]].iloc[numbers]])
    if place is not None and far <= limit:
        yield pick


def pick_single_animal(points: DataFrame, keys: Sequence[str] = ("file_id",), frame: str = "frame_number", row: str = "row_id", centre: tuple[float, float] = (0.0, 0.0), max_distance: float = 50.0) -> DataFrame:
    """The detections of one animal in every file: from the one nearest to the centre by its size in the first frame, the
    nearest to the one before; the first row counts where several are.

    Detections farther than ``max_distance`` from it are skipped; frames without one have none.  Each step hangs on the
    one before, so that a file's rows are gone through in order, by batches, in one task: no file is ever in memory.
    """
    kinds = {f.name: f.dataType for f in points.schema}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in (*keys, row)])
    rows = points.select(*keys, frame, row, "coord_x", "coord_y", "area").repartition(*keys).sortWithinPartitions(*keys, F.col(frame).asc_nulls_last(), row)
    picked = rows.mapInPandas(lambda batches: _followed(batches, keys, frame, row, centre, max_distance), schema)
    return points.join(picked, [*keys, row], "left_semi")


def orient_by_intensity(df: DataFrame, track: Track, profile: str, min_rows: int, around: int = 10) -> DataFrame:
    """Adds is_switched: the row lies in a block of at least ``min_rows`` whose intensity profiles are reversed.

    Blocks are runs of profiles that fit the track's median better when reversed; a block counts only if the up to
    ``around`` rows next to it agree (``kernels.confirmed_blocks``), so that a noisy stretch is left as it is.  Rows
    without a profile inside of a block go with it.
    """

    def run(pdf):
        flag = np.zeros(len(pdf), bool)
        good = np.flatnonzero([p is not None for p in pdf[profile]])
        if len(good) > 1:
            profiles = np.stack([np.asarray(p, float) for p in pdf[profile].iloc[good]])
            blocks = kernels.negative_blocks(kernels.orientation_score(profiles), min_rows)
            for a, b in kernels.confirmed_blocks(profiles, blocks, around):
                flag[good[a] : good[b - 1] + 1] = True
        return {"is_switched": flag}

    return kernels.with_tracks(df, track.keys, track.order, [profile], run, {"is_switched": "boolean"})


def orientation_probability(movement: Column, bottom: Column, top: Column) -> Column:
    """Weighted probability that a pose is oriented rightly, from movement and the two ends' evidence."""
    return 0.75 * movement + 0.15 * bottom + 0.10 * top


def align_stage_moves(frames: DataFrame, moves: DataFrame, fps: float, keys: Sequence[str] = ("file_id",), delay: float = 1.0) -> DataFrame:
    """(keys, move, frame, first, last, state, error): frames (keys, frame, variance) in which logged moves (keys, move,
    seconds from the video's start) happen, by ``stage.align``.

    ``frame`` is the peak, ``first`` and ``last`` bound the move; all are NULL unless the state is "matched".  ``error``
    is NULL for files whose log fits their video.  A move that the log does not have is a row with NULL ``move`` and the
    state "not logged".
    """

    def run(_: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("frame"), b.sort_values(["seconds", "move"])
        got = stage.align(a["variance"].to_numpy(float), fps, b["seconds"].to_numpy(float), delay)
        number = a["frame"].to_numpy()
        key = (b if len(b) else a)[list(keys)].iloc[0].to_dict() if len(a) or len(b) else {}
        rows = []
        matched = [(m, s, k) for m, s, k in zip(b["move"], got["state"], got["match"], strict=True)]
        for move, state, k in [*matched, *((None, "not logged", k) for k in got["spurious"])]:
            at = got["moves"][k] if k >= 0 else None
            rows.append({**key, "move": move, **({c: None for c in ("frame", "first", "last")} if at is None else {"frame": number[at.peak], "first": number[at.start], "last": number[at.end]}), "state": state, "error": got["error"]})
        return pd.DataFrame(rows, columns=[*keys, "move", "frame", "first", "last", "state", "error"], dtype=object)

    kinds = {f.name: f.dataType.simpleString() for f in moves.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in (*keys, "move")) + ", frame bigint, first bigint, last bigint, state string, error string"
    return frames.groupBy(*keys).cogroup(moves.groupBy(*keys)).applyInPandas(run, schema)


def track_detections(points: DataFrame, single: bool = False, keys: Sequence[str] = ("file_id",), max_distance: float = 25.0, ratio: float | tuple[float, float] = 2.0, max_gap: int = 0, min_rows: int = 1, centre: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Detections linked and then joined over gaps, or, with ``single``, those of one animal; one ratio r stands for
    (1 / r, r)."""
    ratio = ratio if isinstance(ratio, tuple) else (1 / ratio, ratio)
    if single:
        picked = pick_single_animal(points, keys, centre=centre, max_distance=max_distance)
        return picked.withColumns({"worm_index_blob": F.lit(1), "worm_index_joined": F.lit(1)})
    linked = link_detections(points, keys, max_distance=max_distance, ratio=ratio)
    return join_gaps(linked, keys, max_gap=max_gap, ratio=ratio, min_rows=min_rows)
