"""Incremental forms on Structured Streaming: tumbling, sliding and session windows, deduplication, stateful linking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackloom.functions.kernels import link_frame


def _statistics(value: str) -> list:
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most")]


def tumbling(df: DataFrame, keys: Sequence[str], at: str, value: str, width: str, late: str = "10 minutes") -> DataFrame:
    """Statistics of fixed equal windows."""
    out = df.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(*_statistics(value))
    return out.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean", "least", "most")


def sliding(df: DataFrame, keys: Sequence[str], at: str, value: str, width: str, step: str, late: str = "10 minutes") -> DataFrame:
    """Statistics of overlapping windows."""
    out = df.withWatermark(at, late).groupBy(F.window(at, width, step), *keys).agg(*_statistics(value))
    return out.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean", "least", "most")


def session_blocks(df: DataFrame, keys: Sequence[str], at: str, value: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Statistics of blocks that gaps of at least ``gap`` separate."""
    out = df.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(*_statistics(value))
    return out.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "mean", "least", "most")


def without_repeats(df: DataFrame, keys: Sequence[str], at: str, late: str = "10 minutes") -> DataFrame:
    """Repeated frames of a key dropped within the watermark."""
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


LINKED = "file_id int, frame_number int, row_id bigint, worm_index_blob bigint"
STATE = "frame int, next_id bigint, xs array<double>, ys array<double>, sizes array<double>, ids array<bigint>"


def link_stream(points: DataFrame, max_distance: float = 25.0, ratio: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """Links detections (file_id, frame_number, row_id, coord_x, coord_y, area) frame by frame, with the frame before as state.

    Frames of a file must arrive in order, whole; a frame at or before the last one is left out as late.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(["frame_number", "row_id"])
        frame, next_id, xs, ys, sizes, ids = state.get if state.exists else (-1, 1, [], [], [], [])
        prev, ids = tuple(np.asarray(v, float) for v in (xs, ys, sizes)), np.asarray(ids, np.int64)
        for n, rows in pdf.groupby("frame_number"):
            if n <= frame:
                continue
            cur = tuple(rows[c].to_numpy(float) for c in ("coord_x", "coord_y", "area"))
            pick = link_frame(prev, cur, max_distance, ratio)
            new = np.flatnonzero(pick < 0)
            out = np.where(pick >= 0, ids[pick] if len(ids) else 0, 0)
            out[new] = next_id + np.arange(len(new))
            next_id += len(new)
            prev, ids, frame = cur, out.astype(np.int64), int(n)
            yield pd.DataFrame({"file_id": key[0], "frame_number": rows["frame_number"].to_numpy(), "row_id": rows["row_id"].to_numpy(), "worm_index_blob": ids})
        state.update((frame, int(next_id), *(v.tolist() for v in prev), ids.tolist()))

    return points.groupBy("file_id").applyInPandasWithState(run, LINKED, STATE, "append", GroupStateTimeout.NoTimeout)


BACKGROUND = "file_id int, frame_number int, h int, w int, pixels binary"


def background_stream(frames: DataFrame, gap: int, size: int, dark: bool = True) -> DataFrame:
    """The background after each frame (file_id, frame_number, h, w, pixels): the lightest value of every pixel (darkest
    for light animals) over the last ``size`` frames that count, masked pixels (0) aside.

    A frame counts if it lies at least ``gap`` frames after the last one that did and is not all black.  The frames that
    count are a file's state: a ring in which the newest takes the place of the oldest.  Frames must arrive in order; a
    frame at or before the last one is left out as late.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("frame_number")
        seen, last, at, ring = state.get if state.exists else (-1, None, 0, [])
        ring, back, rows = list(ring), None, []
        for n, h, w, raw in zip(pdf["frame_number"].tolist(), pdf["h"].tolist(), pdf["w"].tolist(), pdf["pixels"], strict=True):
            if n <= seen:
                continue
            seen = n
            if (last is None or n - last >= gap) and any(raw):
                ring[at : at + 1] = [bytes(raw)]
                last, at, back = n, (at + 1) % size, None
            if back is None:
                kept = [np.frombuffer(x, np.uint8) for x in ring]
                kept = kept or [np.zeros(h * w, np.uint8)]
                back = np.max(kept, axis=0) if dark else np.min([np.where(x == 0, 255, x) for x in kept], axis=0)
            rows.append((key[0], n, h, w, back.astype(np.uint8).tobytes()))
        state.update((seen, last, at, ring))
        yield pd.DataFrame(rows, columns=["file_id", "frame_number", "h", "w", "pixels"])

    return frames.groupBy("file_id").applyInPandasWithState(run, BACKGROUND, "seen int, last int, at int, ring array<binary>", "append", GroupStateTimeout.NoTimeout)
