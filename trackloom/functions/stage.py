"""Moves of a camera stage: found as peaks in the differences of frames, and matched with the times of a log."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: States of a logged move.
MATCHED, NO_PEAK, BEFORE, AFTER = "matched", "no peak", "before the video", "after the video"


def otsu(x: np.ndarray, bins: int = 256) -> float:
    """The threshold, from 0 to 1, that parts values from 0 to 1 into two classes with the largest variance between them."""
    counts = np.bincount(np.rint(np.clip(np.nan_to_num(np.ravel(x)), 0, 1) * (bins - 1)).astype(int), minlength=bins)
    share = np.cumsum(counts) / max(1, counts.sum())
    mean = np.cumsum(counts * np.arange(bins)) / max(1, counts.sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean[-1] * share - mean) ** 2 / (share * (1 - share))
    if np.isnan(between).all():
        return 0.0
    best = np.nanmax(between)
    return float(np.mean(np.flatnonzero(between == best))) / (bins - 1)


def thresholds(v: np.ndarray) -> tuple[float, float] | None:
    """(large, small): what only a move exceeds, and what still frames stay under; None if they cannot be told apart.

    The small one is three deviations over the median of what the large one leaves.  Where Otsu's threshold only splits
    the still frames, half of the maximum takes its place.
    """
    for large in (otsu(v), 0.5):
        still = v[v < large]
        if len(still) and np.isfinite(still).any():
            spread = np.nanstd(still, ddof=1) if np.isfinite(still).sum() > 1 else 0.0
            small = float(np.nanmedian(still) + 3 * spread)
            if large > small:
                return large, small
    return None


@dataclass(frozen=True)
class Move:
    """A stretch of moving frames and its highest one."""

    start: int
    end: int
    peak: int


def find_moves(v: np.ndarray, longest: int) -> list[Move]:
    """Stretches around the peaks of ``v`` (0 to 1, NaN: dropped frames), which end where it falls to the small threshold.

    A state machine walks over the frames: still, until one exceeds the large threshold; moving, until one is not over the
    small threshold or ``longest`` frames lie behind the peak.  A move begins with the frames before its peak that are
    over the small threshold.
    """
    limits = thresholds(v)
    if limits is None:
        return []
    large, small = limits
    over = np.where(np.isnan(v), False, v > large)
    moving = np.isnan(v) | (v > small)
    out: list[Move] = []
    i, free = 0, 0
    while i < len(v):
        if not over[i]:
            i += 1
            continue
        start = i
        while start > free and moving[start - 1] and i - start < longest:
            start -= 1
        end, peak = i, i
        while end + 1 < len(v) and moving[end + 1] and end + 1 - peak <= longest:
            end += 1
            if not np.isnan(v[end]) and v[end] > v[peak]:
                peak = end
        out.append(Move(start, end, peak))
        i = free = end + 1
    return out


def match_moves(peaks: np.ndarray, times: np.ndarray, longest: int, skips: int = 3) -> tuple[np.ndarray, float]:
    """For each logged time (in frames) the number of its peak, or -1; and the mean misfit of the matched ones in frames.

    Both go forward in time.  What counts is how well the way from one matched time to the next agrees with the way
    between their peaks, since the delay of a log drifts; the first match, which may leave out times and peaks before it, is
    searched among all that lie within twice ``longest`` frames.  A time or a peak that is left out costs
    as much as a misfit of ``longest`` frames; up to ``skips`` in a row of each.
    """
    m, n = len(times), len(peaks)
    best, back = np.full((m, n), np.inf), np.full((m, n, 2), -1)
    for i in range(m):
        # A first match: all times and peaks before it are left out.
        delay = np.abs(peaks - times[i])
        best[i] = np.where((delay <= 2 * longest) & (i <= skips), delay + longest * (i + np.arange(n)), np.inf)
        for di in range(1, min(i, skips + 1) + 1):
            for dj in range(1, min(n - 1, skips + 1) + 1):
                gap = np.abs((peaks[dj:] - peaks[:-dj]) - (times[i] - times[i - di]))
                cost = best[i - di, :-dj] + gap + longest * (di - 1 + dj - 1)
                cost = np.where(gap <= 2 * longest, cost, np.inf)
                better = cost < best[i, dj:]
                rows = np.flatnonzero(better) + dj
                best[i, rows] = cost[better]
                back[i, rows] = np.column_stack((np.full(len(rows), i - di), rows - dj))
    out = np.full(m, -1)
    if not n or not np.isfinite(best).any():
        return out, float("inf")
    end = best + longest * (m - 1 - np.arange(m)[:, None] + n - 1 - np.arange(n)[None])
    i, j = np.unravel_index(int(np.argmin(end)), end.shape)
    while i >= 0:
        out[i] = j
        i, j = back[i, j]
    hit = np.flatnonzero(out >= 0)
    lag = peaks[out[hit]] - times[hit]
    return out, float(np.abs(np.diff(lag)).mean()) if len(hit) > 1 else 0.0


def align(variance: np.ndarray, fps: float, times: np.ndarray, delay: float, tolerance: float = 0.25) -> dict:
    """Which frames the stage moved in, and which logged time each move belongs to.

    ``variance`` holds the difference of each frame to the one before (NaN or 0: a dropped frame), ``times`` the log's
    seconds, from 0 at the start; ``delay`` is the longest time that a move takes.  Returns ``moving`` (a flag for each
    frame), ``moves``, ``match`` and ``state`` (of each time), ``spurious`` (moves that no time claims) and ``error``:
    null, or why the result must not be used: "no peaks", "too many unmatched moves" (over ``tolerance`` of the times
    that lie within the video) or "unlogged moves".  Moves after the last matched one mark all frames that follow, since
    a log may end before its video.
    """
    v = np.asarray(variance, float).copy()
    n = len(v)
    v[v == 0] = np.nan
    times = np.asarray(times, float)
    state = np.full(len(times), NO_PEAK, object)
    moving = np.zeros(n, bool)
    out = {"moving": moving, "moves": [], "match": np.full(len(times), -1), "state": state, "spurious": [], "error": None}
    # The first time is the start; further zeros are moves that ended before the video.
    state[times <= 0] = BEFORE
    real = np.flatnonzero(times > 0)
    if np.isfinite(v).sum() < 2:
        out["error"] = "no peaks" if len(real) else None
        return out
    longest = int(round(delay * fps)) + 1
    moves = find_moves(v / np.nanmax(v), longest)
    out["moves"] = moves
    if not len(real):
        # A stage that never moves: what looks like a peak is the animal.
        out["spurious"] = list(range(len(moves)))
        return out
    peaks = np.array([m.peak for m in moves], float)
    match, _ = match_moves(peaks, times[real] * fps, longest)
    out["match"][real] = match
    hit = match >= 0
    lag = np.median(peaks[match[hit]] - times[real][hit] * fps) if hit.any() else longest
    late = times[real] * fps + lag + longest >= n
    state[real] = np.where(hit, MATCHED, np.where(late, AFTER, NO_PEAK))
    for k in match[hit].tolist():
        moving[moves[k].start : moves[k].end + 1] = True
    claimed = set(match[hit].tolist())
    out["spurious"] = [k for k in range(len(moves)) if k not in claimed]
    tail = [k for k in out["spurious"] if claimed and k > max(claimed)]
    if tail:
        moving[moves[tail[0]].start :] = True
    within = real[~late | hit]
    missing = (state[within] == NO_PEAK).sum()
    if not hit.any():
        out["error"] = "no peaks"
    elif missing > tolerance * len(within):
        out["error"] = "too many unmatched moves"
    elif len(out["spurious"]) - len(tail) > max(1, tolerance * len(moves)):
        out["error"] = "unlogged moves"
    return out
