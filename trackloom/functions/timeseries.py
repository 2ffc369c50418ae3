"""Column expressions over ordered tracks: differences, fills, interpolation, rolling statistics, unwrapping, filters.

Every function takes the window of a track (``Track.window``) and returns a column, so that many of them share one
sort; those that look ahead to the next value take the :class:`Track`, since they also sort it backwards.  Missing values
are NULL; NaN is turned into NULL at ingestion.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from trackloom.functions.kernels import savgol_weights


@dataclass(frozen=True)
class Track:
    """Which columns name a track and which order its rows; the order must be total."""

    keys: tuple[str, ...] = ("file_id", "worm_index")
    order: tuple[str, ...] = ("timestamp",)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def backwards(self) -> WindowSpec:
        """The rows from last to first.

        What lies ahead of a row is what this window has seen: Spark would read a frame that reaches to a track's end anew
        for each row.
        """
        return Window.partitionBy(*self.keys).orderBy(*(F.col(c).desc() for c in self.order))

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def delta_frames(fps: float, seconds: float) -> int:
    """Frames in a time step, at least one; halves go to the even number."""
    return max(1, round(fps * seconds))


def central_difference(x: Column, w: WindowSpec, delta: int, fps: float = 1.0) -> Column:
    """(x[i + ceil(delta / 2)] - x[i - floor(delta / 2)]) / (delta / fps); NULL where a side is missing."""
    return (F.lead(x, math.ceil(delta / 2)).over(w) - F.lag(x, delta // 2).over(w)) / F.lit(delta / fps)


def ffill(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(_before(w))


def bfill(x: Column, track: Track) -> Column:
    return F.last(x, ignorenulls=True).over(_before(track.backwards()))


def fill_both(x: Column, track: Track) -> Column:
    """Forward fill, then backward fill of what leads."""
    return F.coalesce(ffill(x, track.window()), bfill(x, track))


def rolling_mean(x: Column, w: WindowSpec, size: int) -> Column:
    """Centred mean over ``size`` (odd) rows; NULL unless all are present and not NULL."""
    h = size // 2
    frame = w.rowsBetween(-h, h)
    return F.when(F.count(x).over(frame) == 2 * h + 1, F.avg(x).over(frame))


def rolling_min(x: Column, w: WindowSpec, size: int, full: bool = True) -> Column:
    """Minimum of this row and the ``size`` - 1 before it."""
    frame = w.rowsBetween(1 - size, 0)
    value = F.min(x).over(frame)
    return F.when(F.count(x).over(frame) == size, value) if full else value


def rolling_max(x: Column, w: WindowSpec, size: int, full: bool = True) -> Column:
    frame = w.rowsBetween(1 - size, 0)
    value = F.max(x).over(frame)
    return F.when(F.count(x).over(frame) == size, value) if full else value


def rolling_std(x: Column, w: WindowSpec, size: int, min_periods: int) -> Column:
    """Sample deviation of this row and the ``size`` - 1 before it, if at least ``min_periods`` have values."""
    frame = w.rowsBetween(1 - size, 0)
    return F.when(F.count(x).over(frame) >= max(2, min_periods), F.stddev_samp(x).over(frame))


def lerp(x: Column, at: Column, track: Track, max_gap: int | None = None, hold_edges: bool = True) -> Column:
    """Linear interpolation of NULLs by position ``at``.

    Ends keep the nearest value if ``hold_edges``.  With ``max_gap`` only runs of at most so many missing positions
    between two values are filled.
    """
    known = F.when(x.isNotNull(), F.struct(at.alias("t"), x.alias("v")))
    a, b = ffill(known, track.window()), bfill(known, track)
    inner = a["v"] + (b["v"] - a["v"]) * (at - a["t"]) / (b["t"] - a["t"])
    inside = a.isNotNull() & b.isNotNull()
    if max_gap is not None:
        inside &= b["t"] - a["t"] - 1 <= max_gap
    out = F.when(x.isNotNull(), x).when(inside, inner)
    return out.when(a.isNull() | b.isNull(), F.coalesce(a["v"], b["v"])) if hold_edges else out


def unwrap_step(x: Column, w: WindowSpec) -> Column:
    """The correction that a row adds to all that follow, for :func:`unwrap`; x must hold no NULL between values."""
    step = x - F.lag(x).over(w)
    turn = F.pmod(step + math.pi, F.lit(2 * math.pi)) - math.pi
    turn = F.when((turn == -math.pi) & (step > 0), F.lit(math.pi)).otherwise(turn)
    return F.when(F.abs(step) < math.pi, F.lit(0.0)).otherwise(F.coalesce(turn - step, F.lit(0.0)))


def unwrap(df, x: str, track: Track, out: str):
    """Adds ``out``: angles in radians without jumps over half a turn; NULLs are bridged and stay NULL.

    Two passes over one sort, since a window function cannot take another as its argument.
    """
    w = track.window()
    df = df.withColumn("_filled", ffill(F.col(x), w)).withColumn("_step", unwrap_step(F.col("_filled"), w))
    total = F.sum("_step").over(_before(w))
    return df.withColumn(out, F.when(F.col(x).isNotNull(), F.col(x) + total)).drop("_filled", "_step")


def fir(x: Column, w: WindowSpec, weights: Sequence[float], zero_pad: bool = False) -> Column:
    """Sum of ``weights[k]`` times the row k - len // 2 ahead; outside the track NULL, or 0 with ``zero_pad``."""
    half = len(weights) // 2
    out = None
    for k, weight in enumerate(weights):
        by = k - half
        v = F.lead(x, by).over(w) if by > 0 else F.lag(x, -by).over(w) if by < 0 else x
        term = (F.coalesce(v, F.lit(0.0)) if zero_pad else v) * F.lit(float(weight))
        out = term if out is None else out + term
    return out


def savgol(x: Column, track: Track, window: int, order: int = 3) -> Column:
    """Savitzky-Golay filter of a track; at its ends the nearest full window's polynomial is evaluated.

    Tracks shorter than the window stay as they are.  Neighbours come by lead and lag, so that no row leaves the JVM.
    """
    w, half, weights = track.window(), window // 2, savgol_weights(window, order)
    at = lambda k: x if k == 0 else F.lead(x, k).over(w) if k > 0 else F.lag(x, -k).over(w)
    term = lambda row, first: sum((at(first + k) * F.lit(float(v)) for k, v in enumerate(weights[row][1:], 1)), at(first) * F.lit(float(weights[row][0])))
    i, n = F.row_number().over(w) - 1, F.count(F.lit(1)).over(track.whole())
    out = F.when(n < window, x)
    for r in range(half):
        out = out.when(i == r, term(r, -r)).when(n - 1 - i == r, term(window - 1 - r, r + 1 - window))
    return out.otherwise(term(half, -half))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    half = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    return [r / sum(raw) for r in raw]


def gaussian_smooth(x: Column, w: WindowSpec, sigma: float) -> Column:
    return fir(x, w, gaussian_weights(sigma), zero_pad=True)


def nearest_valid(x: Column, at: Column, w: WindowSpec, half: int) -> tuple[Column, Column]:
    """The nearest rows (t, v) with values at least ``half`` and at most 2 * ``half`` rows away, on the left and right."""
    known = F.when(x.isNotNull(), F.struct(at.alias("t"), x.alias("v")))
    return F.last(known, ignorenulls=True).over(w.rowsBetween(-2 * half, -half)), F.first(known, ignorenulls=True).over(w.rowsBetween(half, 2 * half))


def timestamp_ticks(seconds: Column, w: WindowSpec, smallest: Column) -> Column:
    """Integer positions on a grid of the smallest positive step, from the first time stamp of the track."""
    return F.rint((seconds - F.first(seconds, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) / smallest).cast("bigint")


def path_range(x: Column, y: Column, w: WindowSpec) -> Column:
    """Distance to the track's centroid."""
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.hypot(x - F.avg(x).over(all_), y - F.avg(y).over(all_))


def wrap_degrees(angle: Column) -> Column:
    """An angle in [-180, 180)."""
    return F.pmod(angle + 180, F.lit(360.0)) - 180
