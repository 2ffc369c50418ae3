"""Oscillation of a bend angle around each frame: windows bounded by zero crossings, and the peak of each one's spectrum."""

from __future__ import annotations

import numpy as np

#: Fixed values of the older route: length of the padded transform, and the limits on a peak's troughs and energy.
SAMPLES, TROUGH, ENERGY = 1 << 14, 0.5, 0.5


def crossing_windows(x: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each sample the (first, last) rows of a window centred on it, or -1 where there is none.

    The window reaches from the last sample before a sign change to the first one after another.  While these two hold
    fewer than ``least`` samples, the nearer one moves on to the next sign change (the right one if both are as near).
    The farther one then decides how far the window goes to both sides: at most ``most`` samples, and within the series.
    A missing sample is a sign change to both sides.
    """
    n = len(x)
    sign = np.sign(x)
    change = np.flatnonzero(~(sign[:-1] == sign[1:]))
    first, last = np.full(n, -1), np.full(n, -1)
    if not len(change):
        return first, last
    at = np.arange(n)
    left, right = np.searchsorted(change, at, "left") - 1, np.searchsorted(change, at, "left")
    live = (left >= 0) & (right < len(change)) & ~np.isnan(x)
    while True:
        a, b = change[np.maximum(left, 0)], change[np.minimum(right, len(change) - 1)] + 1
        short = live & (b - a + 1 < least)
        if not short.any():
            break
        grow_left = at - a < b - at
        left = left - (short & grow_left)
        right = right + (short & ~grow_left)
        live &= (left >= 0) & (right < len(change))
    half = np.maximum(at - a, b - at)
    live &= (half <= most) & (at - half >= 0) & (at + half < n)
    return np.where(live, at - half, -1), np.where(live, at + half, -1)


def spectrum_peak(size: np.ndarray, window: int, low: int, high: int) -> int:
    """The place of the largest of ``size`` if it is a clear peak between ``low`` and ``high``, else -1.

    Troughs are the lowest places, each over sqrt(``window``) from all lower ones: the first of them and the first beyond
    the peak.  Neither may exceed half the peak, and between them lies at least half of the energy.
    """
    top = int(np.argmax(size))
    if top == 0 or not low <= top <= high:
        return -1
    inner = np.concatenate(([True], size[1:] < size[:-1])) & np.concatenate((size[:-1] < size[1:], [True]))
    places = np.flatnonzero(inner)
    troughs = places[greedy_apart(-size[places], places, round(np.sqrt(window)))]
    before, after = troughs[troughs < top], troughs[troughs > top]
    if not len(before) or not len(after):
        return -1
    a, b = before[0], after[0]
    energy = size * size
    clear = max(size[a], size[b]) <= TROUGH * size[top] and energy[a:b].sum() >= ENERGY * energy.sum()
    return top if clear else -1


def greedy_apart(height: np.ndarray, at: np.ndarray, apart: int) -> np.ndarray:
    """Which of the places ``at`` (ascending) stay, highest first, each more than ``apart`` from those taken; ascending."""
    free, taken = np.ones(len(at), bool), []
    for i in np.argsort(-height, kind="stable").tolist():
        if free[i]:
            taken.append(i)
            free[np.searchsorted(at, at[i] - apart) : np.searchsorted(at, at[i] + apart, "right")] = False
    return np.sort(np.array(taken, np.int64))


def side(view: np.ndarray) -> float:
    """The sign of a window's mean, added up value by value: numpy's own order of sums gives another one to means near 0."""
    return float(np.sign(np.cumsum(np.nan_to_num(view))[-1]))


def bend_waves(x: np.ndarray, fps: float, paused: np.ndarray | None = None, seconds: tuple[float, float] = (0.5, 15.0), samples: int = SAMPLES, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(amplitude, frequency) of the wave around each sample, with the sign of the window's mean; NaN where it is unclear.

    Windows come from :func:`crossing_windows`; those of one length are transformed together, in blocks.  Frequencies lie
    between 1 / (4 * longest time) and a quarter of the frame rate.  Paused frames have none.  A series without any sign
    change has none either.
    """
    rate = int(fps)
    first, last = crossing_windows(x, round(seconds[0] * fps), round(seconds[1] * fps))
    good = first >= 0 if paused is None else (first >= 0) & ~paused
    amplitude, frequency = np.full(len(x), np.nan), np.full(len(x), np.nan)
    step = rate / 2 / (samples // 2 - 1)
    low, high = int(np.ceil(1 / (4 * seconds[1]) / step)), int(np.floor(rate / 4 / step))
    sizes = last - first + 1
    for size in np.unique(sizes[good]).tolist():
        rows = np.flatnonzero(good & (sizes == size))
        for start in range(0, len(rows), block):
            some = rows[start : start + block]
            views = x[first[some][:, None] + np.arange(size)]
            spectra = np.abs(np.fft.rfft(views, samples, axis=1))
            for row, view, spectrum in zip(some.tolist(), views, spectra, strict=True):
                top = spectrum_peak(spectrum, size, low, high)
                if top > 0:
                    sign = side(view)
                    amplitude[row], frequency[row] = 2 * spectrum[top] / size * sign, step * top * sign
    return amplitude, frequency


