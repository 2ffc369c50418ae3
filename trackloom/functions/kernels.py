"""Numeric kernels in numpy for what no built-in expression covers, and their grouped application.

Each kernel is a pure function of arrays; :func:`per_track` runs one over every track.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def per_track(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], kernel: Callable[[pd.DataFrame], dict[str, np.ndarray]], out: dict[str, str]) -> DataFrame:
    """Applies ``kernel`` to each track's rows in order; only ``columns`` travel.  Returns keys, order and ``out``."""
    cols = list(dict.fromkeys([*keys, *order, *columns]))
    kinds = {f.name: f.dataType for f in df.schema}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in [*keys, *order]] + [T.StructField(c, T._parse_datatype_string(t)) for c, t in out.items()])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), ignore_index=True)
        return pd.DataFrame({**{c: pdf[c] for c in [*keys, *order]}, **{k: (list(v) if np.ndim(v) > 1 else v) for k, v in kernel(pdf).items()}})

    return df.select(*cols).groupBy(*keys).applyInPandas(run, schema)


def with_tracks(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], kernel: Callable[[pd.DataFrame], dict[str, np.ndarray]], out: dict[str, str]) -> DataFrame:
    """``df`` with the columns that ``kernel`` makes of each track.

    Flat rows travel through the kernel as they are, so that nothing is shuffled twice and rows with equal order stay
    apart.  Rows with arrays or structs are joined with the result by keys and order, which must then be unique.
    """
    others = [c for c in df.columns if c not in out]
    if any(isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) for f in df.schema if f.name in others):
        return df.drop(*out).join(per_track(df, keys, order, columns, kernel, out), [*keys, *order], "left")
    schema = T.StructType([f for f in df.schema if f.name in others] + [T.StructField(c, T._parse_datatype_string(t)) for c, t in out.items()])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        made = kernel(table.select(list(dict.fromkeys([*keys, *order, *columns]))).to_pandas())
        for c in out:
            values = made[c]
            kind = pa.from_numpy_dtype(values.dtype) if isinstance(values, np.ndarray) and values.dtype != object else None
            table = table.append_column(c, pa.array(values, from_pandas=True) if kind is None else pa.array(values, kind, from_pandas=True))
        return table

    return df.select(*others).groupBy(*keys).applyInArrow(run, schema)


def savgol_weights(window: int, order: int, derivative: int = 0) -> np.ndarray:
    """Weights of a Savitzky-Golay filter at every position of its window: row k evaluates the fit at position k."""
    half = window // 2
    t = np.arange(-half, half + 1)
    design = np.vander(t, order + 1, increasing=True).astype(float)
    solve = np.linalg.pinv(design)
    powers = np.zeros((window, order + 1))
    for p in range(derivative, order + 1):
        factor = np.prod(np.arange(p, p - derivative, -1)) if derivative else 1
        powers[:, p] = factor * t.astype(float) ** (p - derivative)
    return powers @ solve


def savgol(x: np.ndarray, window: int, order: int = 3, derivative: int = 0, axis: int = 0) -> np.ndarray:
    """Savitzky-Golay along an axis; at the ends the nearest full window's polynomial is evaluated."""
    x = np.moveaxis(np.asarray(x, float), axis, 0)
    n, half = len(x), window // 2
    if n < window:
        raise ValueError("fewer values than the window")
    weights = savgol_weights(window, order, derivative)
    views = np.moveaxis(np.lib.stride_tricks.sliding_window_view(x, window, axis=0), -1, 1)
    out = np.empty_like(x)
    out[half : n - half] = np.tensordot(views, weights[half], (1, 0))
    out[:half] = np.tensordot(weights[:half], x[:window], (1, 0))
    out[n - half :] = np.tensordot(weights[half + 1 :], x[n - window :], (1, 0))
    return np.moveaxis(out, 0, axis)


def cubic_spline(t: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Not-a-knot cubic spline through (t, y), t ascending; fewer than four points give lower degrees.

    The second derivatives come from a tridiagonal system, whose two end conditions are put into its outer rows.
    """
    t, y, at = (np.asarray(v, float) for v in (t, y, at))
    n = len(t)
    if n < 4:
        return np.polyval(np.polyfit(t, y, n - 1), at) if n else np.full(len(at), np.nan)
    h, d = np.diff(t), np.diff(y) / np.diff(t)
    low, mid, high, rest = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(d)
    mid[0] += h[0] * (h[0] + h[1]) / h[1]
    high[0] -= h[0] ** 2 / h[1]
    mid[-1] += h[-1] * (h[-1] + h[-2]) / h[-2]
    low[-1] -= h[-1] ** 2 / h[-2]
    for i in range(1, n - 2):
        f = low[i] / mid[i - 1]
        mid[i] -= f * high[i - 1]
        rest[i] -= f * rest[i - 1]
    m = np.zeros(n)
    for i in range(n - 3, -1, -1):
        m[i + 1] = (rest[i] - (high[i] * m[i + 2] if i < n - 3 else 0.0)) / mid[i]
    m[0] = ((h[0] + h[1]) * m[1] - h[0] * m[2]) / h[1]
    m[-1] = ((h[-1] + h[-2]) * m[-2] - h[-1] * m[-3]) / h[-2]
    k = np.clip(np.searchsorted(t, at, "right") - 1, 0, n - 2)
    u, v = at - t[k], t[k + 1] - at
    return m[k] * v**3 / (6 * h[k]) + m[k + 1] * u**3 / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * v + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * u


def fill_inner_cubic(x: np.ndarray) -> tuple[np.ndarray, bool]:
    """Gaps between values filled by a cubic spline, ends left missing; and whether that could be done.

    A series with missing values needs four others, unless it has none at all.
    """
    x = np.asarray(x, float).copy()
    good = np.flatnonzero(~np.isnan(x))
    if len(good) in (0, len(x)):
        return x, True
    if len(good) < 4:
        return x, False
    gaps = np.flatnonzero(np.isnan(x))
    gaps = gaps[(gaps > good[0]) & (gaps < good[-1])]
    if len(gaps):
        x[gaps] = cubic_spline(good, x[good], gaps)
    return x, True


def fill_cubic(x: np.ndarray) -> np.ndarray:
    """Fills inner gaps by a cubic spline over the values present; ends keep the nearest value."""
    x = np.asarray(x, float).copy()
    good = np.flatnonzero(~np.isnan(x))
    if len(good):
        inner = np.arange(good[0], good[-1] + 1)
        x[inner] = cubic_spline(good, x[good], inner) if len(good) > 1 else x[good[0]]
        x[: good[0]], x[good[-1] + 1 :] = x[good[0]], x[good[-1]]
    return x


def median_filter(x: np.ndarray, window: int) -> np.ndarray:
    """Running median with reflected ends."""
    half = window // 2
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(np.asarray(x, float), half, "symmetric"), 2 * half + 1), axis=1)


def resample_curve(points: np.ndarray, n: int) -> np.ndarray:
    """``n`` points at equal distances along a curve."""
    points = np.asarray(points, float)
    along = np.concatenate(([0], np.cumsum(np.hypot(*np.diff(points, axis=0).T))))
    at = np.linspace(0, along[-1], n)
    return np.column_stack([np.interp(at, along, c) for c in points.T])


def _turn(d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return (d1[..., 0] * d2[..., 1] - d1[..., 1] * d2[..., 0]) / (d1**2).sum(-1) ** 1.5


def windowed_gradient(x: np.ndarray, width: int, axis: int) -> np.ndarray:
    """Difference over ``width`` samples on both sides, by its span; towards the ends the stencil is cut off."""
    x = np.moveaxis(np.asarray(x, float), axis, 0)
    i = np.arange(len(x))
    span = width + np.minimum(np.minimum(i, len(x) - 1 - i), width)
    out = (x[np.minimum(i + width, len(x) - 1)] - x[np.maximum(i - width, 0)]) / span.reshape(-1, *[1] * (x.ndim - 1))
    return np.moveaxis(out, 0, axis)


def curvature_gradient(pose: np.ndarray, points: int = 1) -> np.ndarray:
    """Signed curvature along poses (frames, vertices, 2) from windowed differences; NaN on 4 * ``points`` outer vertices."""
    d1 = windowed_gradient(pose, 2 * points, -2)
    out = _turn(d1, windowed_gradient(d1, 2 * points, -2))
    out[..., : 4 * points] = np.nan
    out[..., out.shape[-1] - 4 * points :] = np.nan
    return out


def curvature_savgol(pose: np.ndarray, window: int = 7) -> np.ndarray:
    """Signed curvature along poses from the derivatives of a cubic Savitzky-Golay filter."""
    return _turn(savgol(pose, window, 3, 1, axis=-2), savgol(pose, window, 3, 2, axis=-2))


def curvature_angle(pose: np.ndarray, window: int = 7) -> np.ndarray:
    """Turn between the chords over half a window before and after each vertex, by the length that they span.

    The result has as many vertices less as the chords reach over the ends; angles are unwrapped along the body and in time.
    """
    reach = int(round(window / 2))
    mid, left, right = pose[:, reach:-reach], pose[:, : -2 * reach], pose[:, 2 * reach :]
    a, b = left - mid, mid - right
    turn = np.unwrap(np.arctan2(b[..., 1], b[..., 0]) - np.arctan2(a[..., 1], a[..., 0]), axis=1)
    turn = np.unwrap(turn, axis=0)
    length = np.hypot(*np.moveaxis(np.diff(pose, axis=1), -1, 0)).sum(1)
    return turn / (2 * (reach - 1) / (pose.shape[1] - 2) * length)[:, None]


def lowess(x: np.ndarray, y: np.ndarray, share: float, rounds: int = 3) -> np.ndarray:
    """Values at each x (ascending) of lines through the nearest ``share`` of the points, near ones and fitting ones first.

    Weights fall with the distance as (1 - d^3)^3; ``rounds`` further fits also weigh points by (1 - r^2)^2 of their
    residual over six times the median one, so that outliers count for nothing.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    k = min(n, max(2, int(np.ceil(share * n))))
    apart = np.abs(x[:, None] - x[None])
    reach = np.maximum(np.partition(apart, k - 1, axis=1)[:, k - 1 : k], 1e-12)
    near = np.clip(1 - (apart / reach) ** 3, 0, None) ** 3
    trust, out = np.ones(n), y
    for _ in range(rounds + 1):
        w = near * trust
        total = np.maximum(w.sum(1), 1e-12)
        mx, my = (w @ x) / total, (w @ y) / total
        dx = x[None] - mx[:, None]
        slope = (w * dx * (y[None] - my[:, None])).sum(1) / np.maximum((w * dx * dx).sum(1), 1e-12)
        out = my + slope * (x - mx)
        off = np.abs(y - out)
        scale = 6 * np.median(off)
        if scale <= 1e-12:
            break
        trust = np.clip(1 - (off / scale) ** 2, 0, None) ** 2
    return out


def best_circle(points: np.ndarray, within: float, smallest: float, largest: float, tries: int = 600, seed: int = 0) -> tuple[float, float, float] | None:
    """(x, y, radius) of the circle with the most points at most ``within`` from it, among those through three points.

    The winner is fitted once more to the points near it.
    """
    p = np.asarray(points, float)
    if len(p) < 3:
        return None
    trio = p[np.random.default_rng(seed).integers(0, len(p), (tries, 3))]
    a, b, c = trio[:, 0], trio[:, 1], trio[:, 2]
    d = 2 * ((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0])
    sb, sc = ((b - a) ** 2).sum(1), ((c - a) ** 2).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        off = np.column_stack(((c - a)[:, 1] * sb - (b - a)[:, 1] * sc, (b - a)[:, 0] * sc - (c - a)[:, 0] * sb)) / d[:, None]
    radius = np.hypot(*off.T)
    good = np.isfinite(radius) & (radius >= smallest) & (radius <= largest)
    if not good.any():
        return None
    centre, radius = (a + off)[good], radius[good]
    hits = np.array([(np.abs(np.hypot(*(p - m).T) - r) <= within).sum() for m, r in zip(centre, radius, strict=True)])
    m, r = centre[hits.argmax()], radius[hits.argmax()]
    q = p[np.abs(np.hypot(*(p - m).T) - r) <= within]
    if len(q) >= 3:
        x, y, z = np.linalg.lstsq(np.column_stack((2 * q, np.ones(len(q)))), (q**2).sum(1), rcond=None)[0]
        m, r = np.array([x, y]), float(np.sqrt(max(0.0, z + x * x + y * y)))
    return float(m[0]), float(m[1]), float(r)


def smoothing_basis(n: int, order: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(columns, penalties): vectors of ``n`` samples from smooth to rough, and the squares of their differences."""
    step = np.diff(np.eye(n), n=min(order, n - 1), axis=0)
    penalties, columns = np.linalg.eigh(step.T @ step)
    return columns, np.maximum(penalties, 0)


def smoothing_spline(x: np.ndarray, residual: float | None = None) -> np.ndarray:
    """The smoothest series (batch, n) with a sum of squared residuals of at most ``residual`` (n unless given).

    Roughness is the sum of squared third differences, as a spline of fifth degree minimises it.  All series share one
    basis, in which the fit is a product by sample; how strong it must be is found for all of them by bisection.
    """
    x = np.asarray(x, float)
    columns, penalties = smoothing_basis(x.shape[1])
    parts = x @ columns
    allowed = float(x.shape[1]) if residual is None else residual
    low, high = np.full(len(x), -12.0), np.full(len(x), 16.0)
    for _ in range(60):
        mid = (low + high) / 2
        strength = 10.0 ** mid[:, None] * penalties
        left = ((strength / (1 + strength) * parts) ** 2).sum(1)
        low, high = np.where(left <= allowed, mid, low), np.where(left <= allowed, high, mid)
    return parts / (1 + 10.0 ** low[:, None] * penalties) @ columns.T


def curvature_spline(pose: np.ndarray, residual: float | None = None) -> np.ndarray:
    """Signed curvature along poses (frames, vertices, 2) of smoothing splines; NaN for poses with missing vertices."""
    out = np.full(pose.shape[:2], np.nan)
    good = ~np.isnan(pose).any(axis=(1, 2))
    if good.any() and pose.shape[1] > 4:
        smooth = np.stack([smoothing_spline(pose[good][..., k], residual) for k in range(2)], axis=-1)
        d1 = np.gradient(smooth, axis=1, edge_order=2)
        out[good] = _turn(d1, np.gradient(d1, axis=1, edge_order=2))
    return out


CURVATURES: dict[str, Callable[[np.ndarray], np.ndarray]] = {"gradient": curvature_gradient, "angle": curvature_angle, "savgol": curvature_savgol, "spline": curvature_spline}


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise."""
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 3:
        return p

    def half(ps: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    low, up = half(p), half(p[::-1])
    return np.array(low[:-1] + up[:-1])


def min_rectangle(points: np.ndarray) -> tuple[float, float, float]:
    """(longer side, shorter side, quirkiness) of the smallest rectangle around points: quirkiness = sqrt(1 - (b / a)^2)."""
    hull = convex_hull(points)
    if len(hull) < 2:
        return 0.0, 0.0, 0.0
    edges = np.diff(np.vstack((hull, hull[:1])), axis=0)
    angle = np.arctan2(edges[:, 1], edges[:, 0])
    c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
    xs, ys = hull[:, 0] * c + hull[:, 1] * s, -hull[:, 0] * s + hull[:, 1] * c
    w, h = np.ptp(xs, axis=1), np.ptp(ys, axis=1)
    k = int(np.argmin(w * h))
    a, b = max(w[k], h[k]), min(w[k], h[k])
    return float(a), float(b), float(np.sqrt(max(0.0, 1 - (b / a) ** 2))) if a else 0.0


def fft_peak(x: np.ndarray, rate: float, low: float, high: float, min_energy: float = 0.0) -> tuple[float, float]:
    """(frequency, amplitude) of the spectral peak in a band, NaN if it holds less than ``min_energy`` of the power."""
    x = np.asarray(x, float)
    if len(x) < 4 or np.isnan(x).any():
        return np.nan, np.nan
    power = np.abs(np.fft.rfft((x - x.mean()) * np.hanning(len(x)))) ** 2
    freq = np.fft.rfftfreq(len(x), 1 / rate)
    band = np.flatnonzero((freq >= low) & (freq <= high))
    if not len(band) or power.sum() == 0:
        return np.nan, np.nan
    k = band[int(np.argmax(power[band]))]
    around = power[max(0, k - 1) : k + 2].sum()
    if around < min_energy * power.sum():
        return np.nan, np.nan
    return float(freq[k]), float(2 * np.sqrt(power[k]) / np.hanning(len(x)).sum())


def short_time_peak(x: np.ndarray, rate: float, window: int, low: float, high: float, min_energy: float = 0.3, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """:func:`fft_peak` on a centred window of every position, in blocks of windows; NaN where the window does not fit."""
    x = np.asarray(x, float)
    n, half = len(x), window // 2
    freq, amp = np.full(n, np.nan), np.full(n, np.nan)
    size = 2 * half + 1
    if n < size or size < 4:
        return freq, amp
    views, taper, bins = np.lib.stride_tricks.sliding_window_view(x, size), np.hanning(size), np.fft.rfftfreq(size, 1 / rate)
    band = np.flatnonzero((bins >= low) & (bins <= high))
    if not len(band):
        return freq, amp
    for start in range(0, len(views), block):
        part = views[start : start + block]
        power = np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * taper, axis=1)) ** 2
        total = power.sum(axis=1)
        k = band[np.argmax(np.nan_to_num(power[:, band]), axis=1)]
        padded = np.pad(power, ((0, 0), (1, 1)))
        rows = np.arange(len(part))
        around = padded[rows, k] + padded[rows, k + 1] + padded[rows, k + 2]
        good = np.isfinite(total) & (total > 0) & (around >= min_energy * total)
        at = start + half + rows[good]
        freq[at], amp[at] = bins[k[good]], 2 * np.sqrt(power[rows[good], k[good]]) / taper.sum()
    return freq, amp


def greedy_peaks(x: np.ndarray, apart: int) -> np.ndarray:
    """Indices of peaks, highest first, that lie more than ``apart`` from every peak taken before; ascending."""
    x = np.asarray(x, float)
    free, taken = np.isfinite(x), []
    for i in np.argsort(-np.nan_to_num(x, nan=-np.inf), kind="stable").tolist():
        if free[i]:
            taken.append(i)
            free[max(0, i - apart) : i + apart + 1] = False
    return np.array(sorted(taken), int)


def path_curvature(x: np.ndarray, y: np.ndarray, step: float, width: int = 5) -> np.ndarray:
    """Curvature of a path at equal arc lengths of ``step``, read back at the path's own times.

    Missing positions are interpolated, ends hold; a path of up to 4 * ``width`` steps has none.
    """
    out = np.full(len(x), np.nan)
    good = np.flatnonzero(~(np.isnan(x) | np.isnan(y)))
    if not len(good):
        return out
    t = np.arange(len(x))
    p = np.column_stack([np.interp(t, good, np.asarray(c, float)[good]) for c in (x, y)])
    along = np.concatenate(([0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))))
    at = np.arange(0, along[-1], step)
    if len(at) <= 4 * width:
        return out
    even = np.column_stack([np.interp(at, along, c) for c in p.T])
    d1 = windowed_gradient(even, 2 * width, 0)
    k = _turn(d1, windowed_gradient(d1, 2 * width, 0))
    return np.interp(t, np.interp(at, along, t), k)


def robust_covariance(x: np.ndarray, share: float = 0.75, starts: int = 30, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of the ``share`` of rows with the least determinant (concentration steps from many starts)."""
    x = np.asarray(x, float)
    n, d = x.shape
    h = min(n, max(d + 1, int(np.ceil(share * n))))
    rng, best = np.random.default_rng(seed), (np.inf, None)
    for _ in range(starts):
        rows = rng.choice(n, min(n, d + 1), replace=False)
        for _ in range(20):
            centre, cov = x[rows].mean(0), np.atleast_2d(np.cov(x[rows].T, bias=True)) + 1e-9 * np.eye(d)
            far = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            new = np.sort(np.argsort(far, kind="stable")[:h])
            if np.array_equal(new, np.sort(rows)):
                break
            rows = new
        centre, cov = x[rows].mean(0), np.atleast_2d(np.cov(x[rows].T, bias=True)) + 1e-9 * np.eye(d)
        det = float(np.linalg.det(cov))
        if det < best[0]:
            best = (det, (centre, cov))
    return best[1]


def mahalanobis(x: np.ndarray, centre: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = np.asarray(x, float) - centre
    return np.sqrt(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))


def three_regions(x: np.ndarray, low: float, high: float, smooth: int, min_rows: int) -> np.ndarray:
    """Flags -1, 0, 1 with hysteresis.

    Values are filled, averaged over a centred full window, and called extreme beyond ``high``.  Between two runs of
    small values (under ``low``, longer than ``min_rows``) a stretch, boundary frames included, takes its only extreme
    label throughout; with both labels its zeros are filled forward, then backward; with none it stays 0.
    """
    s = pd.Series(np.asarray(x, float)).ffill().bfill().rolling(smooth, center=True, min_periods=smooth).mean().to_numpy()
    with np.errstate(invalid="ignore"):
        flag = np.where(s < -high, -1, np.where(s > high, 1, 0))
        centre = np.concatenate(([0], (np.abs(s) < low).astype(int), [0]))
    first, last = np.flatnonzero(np.diff(centre) == 1), np.flatnonzero(np.diff(centre) == -1) - 1
    start = np.maximum(first - 1, 0)
    keep = last - start > min_rows
    cuts = list(zip(start[keep], last[keep], strict=True))
    ends = [(-1, 0), *cuts, (len(flag) - 1, len(flag))]
    for (_, a), (b, _) in zip(ends[:-1], ends[1:], strict=True):
        piece = flag[a : b + 1]
        kinds = set(piece[piece != 0].tolist())
        if len(kinds) == 1:
            flag[a : b + 1] = kinds.pop()
        elif len(kinds) == 2:
            flag[a : b + 1] = pd.Series(piece).replace(0, np.nan).ffill().bfill().to_numpy()
    return flag


def wide_gradient(x: np.ndarray, width: int) -> np.ndarray:
    """Difference over ``width`` samples on both sides; the stencil narrows towards the ends, which are one-sided."""
    x = np.asarray(x, float)
    n, i = len(x), np.arange(len(x))
    if n < 2:
        return np.zeros(n)
    reach = np.minimum(np.minimum(i, n - 1 - i), width)
    left, right = np.where(reach > 0, i - reach, np.maximum(i - 1, 0)), np.where(reach > 0, i + reach, np.minimum(i + 1, n - 1))
    return (x[right] - x[left]) / (right - left)


def zero_crossings(x: np.ndarray, apart: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each sample the nearest sign change at least ``apart`` samples before and after it; -1 where there is none."""
    x = np.asarray(x, float)
    s = np.sign(x)
    at = np.flatnonzero((s[1:] != s[:-1]) & (s[1:] != 0)) + 1
    i = np.arange(len(x))
    a, b = np.searchsorted(at, i - apart, "right") - 1, np.searchsorted(at, i + apart, "left")
    padded = np.concatenate((at, [-1]))
    return np.where(a >= 0, padded[a], -1), np.where(b < len(at), padded[np.minimum(b, len(at))], -1)


def straighten(image: np.ndarray, skeleton: np.ndarray, half_width: float, across: int = 15) -> np.ndarray:
    """Intensities along normals of a skeleton (points, across), bilinear, 0 outside of the image."""
    step = np.gradient(np.asarray(skeleton, float), axis=0)
    normal = np.column_stack((-step[:, 1], step[:, 0])) / np.maximum(np.hypot(*step.T), 1e-12)[:, None]
    at = skeleton[:, None, :] + np.linspace(-half_width, half_width, across)[None, :, None] * normal[:, None, :]
    x, y = at[..., 0], at[..., 1]
    p = np.pad(np.asarray(image, float), 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    get = lambda yy, xx: p[np.clip(yy + 1, 0, p.shape[0] - 1), np.clip(xx + 1, 0, p.shape[1] - 1)]
    fx, fy = x - x0, y - y0
    return (get(y0, x0) * (1 - fx) + get(y0, x0 + 1) * fx) * (1 - fy) + (get(y0 + 1, x0) * (1 - fx) + get(y0 + 1, x0 + 1) * fx) * fy


def orientation_score(profiles: np.ndarray) -> np.ndarray:
    """How much nearer each intensity profile (rows) is to the median profile than its reverse is; negative: reversed."""
    p = np.asarray(profiles, float)
    p = p - np.nanmedian(p, axis=1, keepdims=True)
    middle = np.nanmedian(p, axis=0)
    return np.nanmean(np.abs(p[:, ::-1] - middle), axis=1) - np.nanmean(np.abs(p - middle), axis=1)


def negative_blocks(score: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs of negative scores of at least ``least`` rows, as (first, past last); missing scores take the one before."""
    s = pd.Series(np.asarray(score, float)).ffill().bfill().to_numpy()
    edge = np.diff(np.concatenate(([0], (s < 0).astype(int), [0])))
    return [(a, b) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True) if b - a >= least]


def confirmed_blocks(profiles: np.ndarray, blocks: list[tuple[int, int]], around: int) -> list[tuple[int, int]]:
    """The blocks (first, past last) whose reversal brings their profiles nearer to what lies next to them.

    On each side the block's median profile is compared with the median of up to ``around`` rows, none of them in another
    block, as it stands and reversed.  A side with under half as many rows decides nothing; neither side may speak
    against the reversal.
    """
    p = np.asarray(profiles, float)
    p = p - np.nanmedian(p, axis=1, keepdims=True)
    out = []
    for k, (a, b) in enumerate(blocks):
        before = blocks[k - 1][1] if k else 0
        after = blocks[k + 1][0] if k + 1 < len(blocks) else len(p)
        inside = np.nanmedian(p[a:b], axis=0)
        fits = True
        for lo, hi in ((max(a - around, before), a), (b, min(b + around, after))):
            if hi - lo >= max(1, around // 2):
                outside = np.nanmedian(p[lo:hi], axis=0)
                fits &= bool(np.nansum(np.abs(inside[::-1] - outside)) <= np.nansum(np.abs(inside - outside)))
        if fits:
            out.append((a, b))
    return out


def smooth_polygon(points: np.ndarray, n: int = 1000, window: int | None = None) -> np.ndarray:
    """A closed polygon resampled to ``n`` points and smoothed by a cubic Savitzky-Golay filter that wraps around."""
    points = np.asarray(points, float)
    if points.ndim != 2 or points.shape[1] != 2 or len(points) < 2:
        return points
    window = n // 20 if window is None else window
    window += window % 2 == 0
    even, half = resample_curve(points, n), window // 2
    weights = savgol_weights(window, 3)[half]
    around = np.vstack((even[-half:], even, even[:half]))
    return np.tensordot(np.lib.stride_tricks.sliding_window_view(around, window, axis=0), weights, (2, 0))


def wavelengths(pose: np.ndarray, n: int = 512) -> tuple[float, float]:
    """(primary, secondary) wavelength of a body: of the highest and second highest peak of its spectrum along the body
    axis, at most two lengths; NaN where there is no such peak."""
    pose = np.asarray(pose, float)
    v = pose[0] - pose[-1]
    c, s = v / max(np.hypot(*v), 1e-12)
    q = pose - pose.mean(0)
    along, across = q[:, 0] * c + q[:, 1] * s, -q[:, 0] * s + q[:, 1] * c
    length = float(np.hypot(*np.diff(pose, axis=0).T).sum())
    order = np.argsort(along)
    if np.ptp(along) == 0 or not np.isfinite(length):
        return np.nan, np.nan
    even = np.interp(np.linspace(along.min(), along.max(), len(pose)), along[order], across[order])
    power = np.abs(np.fft.rfft(even, n))
    inner = np.flatnonzero((power[1:-1] > power[:-2]) & (power[1:-1] >= power[2:])) + 1
    inner = inner[np.argsort(-power[inner], kind="stable")][:2]
    step = np.ptp(along) / (len(pose) - 1)
    out = [min(n * step / k, 2 * length) for k in inner.tolist()] + [np.nan] * (2 - len(inner))
    return float(out[0]), float(out[1])


def is_coil(widths: np.ndarray, ventral: np.ndarray, dorsal: np.ndarray, width_ratio: float = 2.25, area_ratio: float = 6.0) -> bool:
    """Whether a pose may be a coil: the midbody is too wide against the head or tail base, or the body's area too large
    against the head's and tail's."""
    def area(a: int, b: int) -> float:
        ring = np.vstack((ventral[a:b], dorsal[a:b][::-1]))
        x, y = ring.T
        return abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2

    n = len(widths)
    part = lambda a, b: widths[round(a * n / 49) : round(b * n / 49)]
    mid = float(np.median(part(16, 33)))
    ends = [float(np.median(part(5, 8))), float(np.median(part(41, 44)))]
    if any(e <= 0 or mid / e > width_ratio for e in ends):
        return True
    parts = [area(round(a * n / 49), round(b * n / 49)) for a, b in ((0, 8), (41, 49))]
    body = area(round(8 * n / 49), round(41 * n / 49))
    return any(p <= 0 or body / p > area_ratio for p in parts)


def link_frame(prev: tuple[np.ndarray, ...], cur: tuple[np.ndarray, ...], max_distance: float, ratio: tuple[float, float], block: int = 1 << 22) -> np.ndarray:
    """For each current (x, y, size) the index of the previous one it continues, or -1.

    A pair is forbidden if previous size / size is outside ``ratio`` or unknown.  Each point picks its nearest previous
    one (ties: the first); the pick falls if it is farther than ``max_distance`` or if several points picked the same.
    Previous points pick likewise, and a point whose pick lost its own is unlinked.  Costs are made in blocks, as roots of
    sums of squares: ``hypot`` rounds otherwise, and splits ties or makes some.
    """
    (px, py, ps), (cx, cy, cs) = prev, cur
    n, m = len(cx), len(px)
    if not n or not m:
        return np.full(n, -1)
    pick, near = np.zeros(n, np.int64), np.zeros(n)
    back, least = np.zeros(m, np.int64), np.full(m, np.inf)
    step = max(1, block // m)
    for a in range(0, n, step):
        part = slice(a, a + step)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = ps[None, :] / cs[part, None]
            dx, dy = cx[part, None] - px[None, :], cy[part, None] - py[None, :]
            cost = np.sqrt(dx * dx + dy * dy)
            cost = np.where((share >= ratio[0]) & (share <= ratio[1]) & np.isfinite(cost), cost, 1e20)
        pick[part] = cost.argmin(1)
        near[part] = cost.min(1)
        k, c = cost.argmin(0), cost.min(0)
        better = c < least
        back[better], least[better] = a + k[better], c[better]
    good = (near <= max_distance) & (np.bincount(pick, minlength=m)[pick] == 1)
    held = (least <= max_distance) & (np.bincount(back, minlength=n)[back] == 1)
    return np.where(good & held[pick], pick, -1)


def fill_short(x: np.ndarray, most: int | None = None) -> np.ndarray:
    """Gaps of at most ``most`` values (all, if None) between two values filled linearly; ends stay missing."""
    x = np.asarray(x, float).copy()
    bad = np.isnan(x)
    good = np.flatnonzero(~bad)
    if not len(good) or not bad.any():
        return x
    edge = np.diff(np.concatenate(([0], bad.astype(int), [0])))
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        if a > 0 and b < len(x) and (most is None or b - a <= most):
            x[a:b] = np.interp(np.arange(a, b), good, x[good])
    return x


#: Fixed values, in degrees: head, most of the tail, at a turn's start; most of the head, tail, at its end; the middle.
TURN_ANGLES = {"omega": (20, 30, 40, 20, 20), "upsilon": (15, 30, 30, 15, 15)}


def _turn_stretches(head: np.ndarray, body: np.ndarray, tail: np.ndarray, far: np.ndarray, moving: np.ndarray, limits: tuple) -> list[tuple[int, int]]:
    """Stretches [first, last] in which the middle bends between a bent head and a bent tail, all to the positive side."""
    start_head, start_tail, end_head, end_tail, middle = limits
    with np.errstate(invalid="ignore"):
        start = (head > start_head) & (np.abs(tail) < start_tail)
        mid = (body > middle) | far
        end = (tail > end_tail) & (np.abs(head) < end_head)
    rises = lambda f: np.flatnonzero(f[1:] & ~f[:-1]) + 1
    falls = lambda f: np.flatnonzero(f[:-1] & ~f[1:])
    starts, ends, mid_ends, out = rises(start), falls(end), falls(mid), []
    for a in rises(mid):
        later = mid_ends[mid_ends > a]
        if not len(later):
            continue
        b = later[0]
        before, after = starts[starts < a], ends[ends > b]
        if not moving[a : b + 1].all() and start[a - 1] and end[b + 1] and len(before) and len(after):
            out.append((int(before[-1]), int(after[0])))
    return out


def head_tail_swings(direction: np.ndarray, fps: float) -> np.ndarray:
    """Frames around which the direction from tail to head (degrees) changes by over 3 degrees a frame, over half a second.

    Directions are unwrapped over gaps of up to half a second, and gaps of up to 120 frames are filled.
    """
    x = np.asarray(direction, float).copy()
    good = np.flatnonzero(~np.isnan(x))
    n, half = len(x), round(fps / 4)
    if len(good) > 1:
        step = np.diff(x[good])
        step[np.diff(good) - 1 > round(fps / 2)] = np.nan
        with np.errstate(invalid="ignore"):
            turns = np.cumsum((step < -180).astype(int) - (step > 180).astype(int))
        x[good[1:]] += 360.0 * turns
    x = fill_short(x, 120)
    i = np.arange(n)
    inside = (i - half > 1) & (i + half < n)
    out = np.zeros(n, bool)
    with np.errstate(invalid="ignore"):
        out[inside] = np.abs(x[i[inside] + half] - x[i[inside] - half]) / max(1, 2 * half) > 3
    return out


def signed_runs(flag: np.ndarray, angle: np.ndarray, least: int) -> np.ndarray:
    """1 or -1 on runs of at least ``least`` rows, by the sign of the mean angle in them; 0 elsewhere."""
    out = np.zeros(len(flag), np.int64)
    edge = np.diff(np.concatenate(([0], np.asarray(flag).astype(int), [0])))
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        if b - a >= max(1, least):
            out[a:b] = 1 if np.mean(angle[a:b]) > 0 else -1
    return out


def turn_signs(head: np.ndarray, body: np.ndarray, tail: np.ndarray, direction: np.ndarray, moving: np.ndarray, fps: float, gap: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """(omega, upsilon) sign of each frame, from mean bends of the three thirds in degrees.

    Omegas come from the order of bends, or from swings of head and tail, and last a quarter of a second; upsilons from
    smaller bends where no omega is.
    """
    n = len(body)
    if min((~np.isnan(np.asarray(v, float))).sum() for v in (head, body, tail)) < 2:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    far = np.isnan(fill_short(body, gap + 1))
    h, b, t = (fill_short(v) for v in (head, body, tail))
    moving = np.asarray(moving, bool)
    omega, upsilon = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for sign in (1, -1):
        for a, z in _turn_stretches(sign * h, sign * b, sign * t, far, moving, TURN_ANGLES["omega"]):
            omega[a : z + 1] = sign
    for sign in (1, -1):
        for a, z in _turn_stretches(sign * h, sign * b, sign * t, far, moving, TURN_ANGLES["upsilon"]):
            if not omega[a : z + 1].any():
                upsilon[a : z + 1] = sign
    least = round(fps / 4)
    swings = signed_runs(head_tail_swings(direction, fps), b, least)
    return signed_runs((omega != 0) | (swings != 0), b, least), upsilon
