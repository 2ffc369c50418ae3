"""The wells of a plate in an image: a turned square lattice of light cells between dark walls (or dark cells between light)."""

from __future__ import annotations

import numpy as np


def shrunk(a: np.ndarray, largest: int = 512) -> tuple[np.ndarray, int]:
    """Means over square blocks, so that no side is longer than ``largest``; and the blocks' side."""
    k = max(1, -(-max(a.shape) // largest))
    h, w = a.shape[0] // k * k, a.shape[1] // k * k
    return a[:h, :w].astype(float).reshape(h // k, k, w // k, k).mean((1, 3)), k


def turned_axes(shape: tuple[int, int], turn: float) -> tuple[np.ndarray, np.ndarray]:
    """The coordinates of all pixels, turned by ``turn`` radians around the image's middle."""
    y, x = np.indices(shape)
    x, y = x - (shape[1] - 1) / 2, y - (shape[0] - 1) / 2
    return x * np.cos(turn) + y * np.sin(turn), -x * np.sin(turn) + y * np.cos(turn)


def profile(a: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, int]:
    """The mean of ``a`` along a turned axis, by whole coordinate, without its slow drift; and the first coordinate."""
    place = np.rint(at).astype(int).ravel()
    first = int(place.min())
    n = np.bincount(place - first)
    mean = np.bincount(place - first, a.ravel()) / np.maximum(n, 1)
    mean[n < 0.2 * n.max()] = np.nan
    return mean - np.nanmean(mean), first


def wall_depth(values: np.ndarray, first: int, spacing: float, wall: float = 0.12) -> tuple[float, float]:
    """How much darker the darkest place of a profile that is folded by ``spacing`` is, and where (0 to ``spacing``).

    A place is a window of ``wall`` of the spacing.
    """
    bins = max(8, int(round(spacing)))
    at = np.arange(first, first + len(values))
    good = np.isfinite(values)
    where = np.floor((at[good] % spacing) / spacing * bins).astype(int) % bins
    n = np.bincount(where, minlength=bins)
    mean = np.bincount(where, values[good], bins) / np.maximum(n, 1)
    half = max(0, int(round(wall * bins / 2)))
    around = np.convolve(np.concatenate((mean[-half:], mean, mean[:half])) if half else mean, np.ones(2 * half + 1) / (2 * half + 1), "valid")
    k = int(np.argmin(around))
    return float(mean.mean() - around[k]), (k + 0.5) * spacing / bins


def fit_lattice(a: np.ndarray, smallest: float, largest: float, most_turn: float = 0.1, dark_walls: bool = True) -> tuple[float, float, float, float]:
    """(turn, spacing, first u, first v) of the lattice with the deepest walls along both turned axes.

    A global search over turns and spacings, then finer ones around the best.  Twice the spacing is as deep as the spacing
    itself, so that of all that come within a tenth of the deepest the smallest spacing is taken.
    """
    a = a if dark_walls else -a
    turns, spacings = np.linspace(-most_turn, most_turn, 21), np.arange(smallest, largest + 0.5, 0.5)
    best = (0.0, smallest, 0.0, 0.0)
    for step in range(3):
        found = []
        for turn in turns:
            profiles = [profile(a, at) for at in turned_axes(a.shape, turn)]
            for s in spacings:
                (du, u), (dv, v) = (wall_depth(*p, s) for p in profiles)
                found.append((min(du, dv), float(s), float(turn), u, v))
        deepest = max(found)[0]
        limit = 0.9 * deepest if step == 0 else deepest
        least = min(f[1] for f in found if f[0] >= limit)
        _, s, turn, u, v = max(f for f in found if f[0] >= limit and f[1] <= 1.2 * least)
        best = (turn, s, u, v)
        gap, wide = (turns[1] - turns[0]), (spacings[1] - spacings[0])
        turns, spacings = turn + np.linspace(-gap, gap, 9), np.maximum(2.0, s + np.linspace(-wide, wide, 9))
    return best


def find_cells(a: np.ndarray, smallest: float, largest: float, most_turn: float = 0.1, dark_walls: bool = True, share: float = 0.4) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(centres (row, column, x, y), goodness, spacing, turn) of the cells that lie inside of an image.

    A template is laid over each cell: the mean of its middle less that of its border, both from sums over rectangles of
    the turned image.  Cells whose contrast is under ``share`` of the median one are none.  The lattice is then fitted to
    the middles of the cells' light parts.
    """
    small, k = shrunk(a)
    turn, s, u0, v0 = fit_lattice(small, smallest / k, largest / k, most_turn, dark_walls)
    h, w = small.shape
    us, vs = turned_axes(small.shape, turn)
    lo_u, lo_v = int(np.floor(us.min())), int(np.floor(vs.min()))
    grid_v, grid_u = np.mgrid[lo_v : int(np.ceil(vs.max())) + 1, lo_u : int(np.ceil(us.max())) + 1]
    x = grid_u * np.cos(turn) - grid_v * np.sin(turn) + (w - 1) / 2
    y = grid_u * np.sin(turn) + grid_v * np.cos(turn) + (h - 1) / 2
    inside = (x > -0.5) & (x < w - 0.5) & (y > -0.5) & (y < h - 0.5)
    values = np.where(inside, small[np.clip(np.rint(y).astype(int), 0, h - 1), np.clip(np.rint(x).astype(int), 0, w - 1)], 0)
    sums = [np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (values if dark_walls else -values, inside.astype(float))]

    def box(v: np.ndarray, u: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """Sum and number of pixels in squares around places; sums between whole coordinates are interpolated."""
        out = []
        for m in sums:
            corner = []
            for dv in (half, -half):
                for du in (half, -half):
                    r, c = np.clip(v + dv + 0.5 - lo_v, 0, m.shape[0] - 1.001), np.clip(u + du + 0.5 - lo_u, 0, m.shape[1] - 1.001)
                    r0, c0 = r.astype(int), c.astype(int)
                    fr, fc = r - r0, c - c0
                    corner.append((m[r0, c0] * (1 - fc) + m[r0, c0 + 1] * fc) * (1 - fr) + (m[r0 + 1, c0] * (1 - fc) + m[r0 + 1, c0 + 1] * fc) * fr)
            out.append(corner[0] - corner[1] - corner[2] + corner[3])
        return out[0], out[1]

    def contrasts(i: np.ndarray, j: np.ndarray, s: float, u0: float, v0: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each cell the middle's mean less the border's, and the share of it inside of the image."""
        v, u = v0 + (i + 0.5) * s, u0 + (j + 0.5) * s
        (whole, n), (middle, m) = box(v, u, s / 2), box(v, u, 0.4 * s)
        return middle / np.maximum(m, 1e-9) - (whole - middle) / np.maximum(n - m, 1e-9), n / s**2

    rows, cols = (np.arange(int((lo - o) // s) - 1, int((hi - o) // s) + 2) for lo, hi, o in ((lo_v, vs.max(), v0), (lo_u, us.max(), u0)))
    i, j = (g.ravel() for g in np.meshgrid(rows, cols, indexing="ij"))
    found, held = contrasts(i, j, s, u0, v0)
    some = held > 0.9
    some &= found >= share * np.median(found[some]) if some.any() else False
    i, j = i[some], j[some]
    found = found[some]
    v, u = v0 + (i + 0.5) * s, u0 + (j + 0.5) * s
    lattice = np.column_stack((np.ones(len(i)), i, j))
    for _ in range(3 if len(i) > 3 and len(set(i.tolist())) > 1 and len(set(j.tolist())) > 1 else 0):
        # The middle of each cell's light part; all of them lie on one lattice, which may be turned a little more.
        middles = []
        for cv, cu in zip(v.tolist(), u.tolist(), strict=True):
            r, c = max(0, int(round(cv - s / 2 - lo_v))), max(0, int(round(cu - s / 2 - lo_u)))
            part = values[r : r + int(round(s)) + 1, c : c + int(round(s)) + 1]
            light = part > (np.percentile(part, 90) + np.percentile(part, 5)) / 2
            py, px = np.nonzero(light)
            middles.append((py.mean() + r + lo_v, px.mean() + c + lo_u))
        fit = np.linalg.lstsq(lattice, np.array(middles), rcond=None)[0]
        v, u = (lattice @ fit).T
        s = float(np.hypot(*fit[1:].T).mean())
    cx, cy = u * np.cos(turn) - v * np.sin(turn) + (w - 1) / 2, u * np.sin(turn) + v * np.cos(turn) + (h - 1) / 2
    table = np.column_stack((i, j, (cx + 0.5) * k - 0.5, (cy + 0.5) * k - 0.5, found)).astype(float)
    good = table[:, 4] >= share * np.median(table[:, 4]) if len(table) else np.zeros(0, bool)
    good &= table[:, 4] > 0
    table = table[good]
    if len(table):
        table[:, 0] -= table[:, 0].min()
        table[:, 1] -= table[:, 1].min()
    return table[:, :4], table[:, 4], s * k, turn
