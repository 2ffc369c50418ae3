"""Image kernels over frame tables (file_id, frame_number, h, w, pixels): masks, blobs, backgrounds, contours."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions.bodies import body_pose
from trackloom.functions.kernels import best_circle, convex_hull, lowess, min_rectangle, resample_curve, straighten
from trackloom.functions.stage import otsu
from trackloom.functions.timeseries import Track
from trackloom.operators.tracking import consistent_flips, flip_poses

DETECTIONS = "file_id int, frame_number int, blob int, coord_x double, coord_y double, area double, box_length double, box_width double, angle double, bounding_box_xmin int, bounding_box_xmax int, bounding_box_ymin int, bounding_box_ymax int, intensity_mean double"


def image(pixels: bytes, h: int, w: int) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(h, w)


def box_mean(a: np.ndarray, size: int) -> np.ndarray:
    """Mean over a square around each pixel, with repeated borders."""
    half = size // 2
    p = np.pad(a.astype(float), half + 1, "edge").cumsum(0).cumsum(1)
    n = 2 * half + 1
    return ((p[n:, n:] - p[:-n, n:] - p[n:, :-n] + p[:-n, :-n]) / n**2)[: a.shape[0], : a.shape[1]]


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """Grows a mask by a square of ``radius``."""
    return box_mean(mask, 2 * radius + 1) > 1e-9 if radius else mask


def label_components(mask: np.ndarray) -> np.ndarray:
    """Numbers 8-connected components from 1: every pixel takes its neighbourhood's smallest number until none changes."""
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    while True:
        p = np.pad(np.where(mask, labels, big), 1, constant_values=big)
        least = np.minimum.reduce([p[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(3) for j in range(3)])
        new = np.where(mask, least, 0)
        if np.array_equal(new, labels):
            break
        flat = np.concatenate(([0], np.arange(1, mask.size + 1)))
        flat[1:] = np.where(mask.ravel(), new.ravel(), 0)
        labels = np.where(mask, flat[new], 0)  # a number also takes the number of the pixel it names
    found, numbers = np.unique(labels[mask], return_inverse=True)
    out = np.zeros(mask.shape, np.int64)
    out[mask] = numbers + 1
    del found
    return out


def adaptive_mask(a: np.ndarray, block: int = 61, offset: int = 15, min_area: int = 50, grow: int = 5, dark: bool = True) -> np.ndarray:
    """Pixels that differ from their neighbourhood's mean by more than ``offset``, without small blobs, grown."""
    diff = box_mean(a, block) - a if dark else a - box_mean(a, block)
    labels = label_components(diff > offset)
    sizes = np.bincount(labels.ravel())
    sizes[0] = 0
    return dilate((sizes >= min_area)[labels], grow)


def blobs(a: np.ndarray, mask: np.ndarray, min_area: int) -> list[dict]:
    """Moments and boxes of the components of a mask."""
    out = []
    labels = label_components(mask)
    flat = labels.ravel()
    order = np.argsort(flat, kind="stable")
    cuts = np.searchsorted(flat[order], np.arange(1, (labels.max() if labels.size else 0) + 2))
    for a_, b_ in zip(cuts[:-1], cuts[1:], strict=True):
        if b_ - a_ < min_area:
            continue
        ys, xs = np.divmod(order[a_:b_], a.shape[1])
        cov = np.cov(np.vstack((xs, ys)), bias=True) if len(xs) > 1 else np.zeros((2, 2))
        values, vectors = np.linalg.eigh(cov + np.eye(2) / 12)
        long = vectors[:, 1]
        along, across = xs * long[0] + ys * long[1], -xs * long[1] + ys * long[0]
        out.append({"blob": len(out), "coord_x": xs.mean(), "coord_y": ys.mean(), "area": float(len(xs)), "box_length": np.ptp(along) + 1, "box_width": np.ptp(across) + 1, "angle": float(np.degrees(np.arctan2(long[1], long[0]))), "bounding_box_xmin": xs.min(), "bounding_box_xmax": xs.max() + 1, "bounding_box_ymin": ys.min(), "bounding_box_ymax": ys.max() + 1, "intensity_mean": a[ys, xs].mean()})
    return out


def mask_frames(frames: DataFrame, **how) -> DataFrame:
    """Frames with everything outside of the regions of interest set to 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for p, h, w in zip(pdf["pixels"], pdf["h"], pdf["w"], strict=True):
                a = image(p, h, w)
                made.append(np.where(adaptive_mask(a, **how), a, 0).astype(np.uint8).tobytes())
            yield pdf.assign(pixels=made)

    return frames.mapInPandas(run, frames.schema)


def mask_buffers(frames: DataFrame, size: int, keys: tuple[str, ...] = ("file_id",), dark: bool = True, **how) -> DataFrame:
    """Frames masked in runs of ``size``: one mask, of the darkest (or lightest) value of each pixel, holds for all of a run."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stack = np.stack([image(p, h, w) for p, h, w in zip(pdf["pixels"], pdf["h"], pdf["w"], strict=True)])
        mask = adaptive_mask(stack.min(0) if dark else stack.max(0), dark=dark, **how)
        return pdf.drop(columns="_run").assign(pixels=[np.where(mask, a, 0).astype(np.uint8).tobytes() for a in stack])

    return frames.withColumn("_run", F.floor(F.col("frame_number") / size)).groupBy(*keys, "_run").applyInPandas(run, frames.schema)


def detect_blobs(frames: DataFrame, threshold: int, min_area: int = 50, dark: bool = True) -> DataFrame:
    """A row for each blob of each masked frame; masked pixels (0) are background."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for f, n, h, w, p in zip(pdf["file_id"], pdf["frame_number"], pdf["h"], pdf["w"], pdf["pixels"], strict=True):
                a = image(p, h, w)
                mask = (a > 0) & ((a < threshold) if dark else (a > threshold))
                rows += [{"file_id": f, "frame_number": n, **b} for b in blobs(a, mask, min_area)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DETECTIONS.split(", ")])

    return frames.select("file_id", "frame_number", "h", "w", "pixels").mapInPandas(run, DETECTIONS)


def background(frames: DataFrame, keys: tuple[str, ...] = ("file_id",), dark: bool = True, parts: int = 32) -> DataFrame:
    """(keys, h, w, pixels): the lightest value of every pixel (darkest for light animals), masked pixels aside.

    Each task folds its frames as they come, one image for each file; these are folded in up to ``parts`` groups of tasks
    and then once more, so that no task holds more than a few frames of a file.
    """
    cols, better = [*keys, "h", "w"], np.maximum if dark else np.minimum

    def plain(raw: bytes) -> np.ndarray:
        a = np.frombuffer(raw, np.uint8)
        return a if dark else np.where(a == 0, 255, a).astype(np.uint8)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, raw in zip(pdf[cols].itertuples(index=False, name=None), pdf["pixels"], strict=True):
                totals[key] = better(totals[key], plain(raw)) if key in totals else plain(raw)
        yield pd.DataFrame([(*k, v.tobytes()) for k, v in totals.items()], columns=[*cols, "pixels"])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for raw in pdf["pixels"]:
            total = plain(raw) if total is None else better(total, plain(raw))
        return pdf.iloc[:1].assign(pixels=[total.tobytes()])[[*cols, "pixels"]]

    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in cols) + ", pixels binary"
    made = frames.select(*cols, "pixels").mapInPandas(stream, schema)
    some = made.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(parts)))
    return some.groupBy(*keys, "_part").applyInPandas(fold, schema).groupBy(*keys).applyInPandas(fold, schema)


def subtract_background(frames: DataFrame, back: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Absolute difference to the file's background."""

    @F.pandas_udf("binary")
    def minus(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([np.abs(np.frombuffer(x, np.uint8).astype(int) - np.frombuffer(y, np.uint8)).astype(np.uint8).tobytes() for x, y in zip(a, b, strict=True)])

    joined = frames.join(back.select(*keys, F.col("pixels").alias("_back")), list(keys))
    return joined.withColumn("pixels", minus("pixels", "_back")).drop("_back")


def mean_intensity(frames: DataFrame) -> DataFrame:
    """(file_id, frame_number, intensity): mean of the pixels that are not masked."""

    @F.pandas_udf("double")
    def mean(p: pd.Series) -> pd.Series:
        arrays = [np.frombuffer(x, np.uint8) for x in p]
        return pd.Series([float(a[a > 0].mean()) if (a > 0).any() else None for a in arrays], dtype=float)

    return frames.select("file_id", "frame_number", mean("pixels").alias("intensity"))


def normalise(frames: DataFrame) -> DataFrame:
    """Frames stretched to 0..255."""

    @F.pandas_udf("binary")
    def stretch(p: pd.Series) -> pd.Series:
        out = []
        for x in p:
            a = np.frombuffer(x, np.uint8).astype(float)
            span = np.ptp(a)
            out.append((np.zeros(len(a)) if span == 0 else (a - a.min()) * 255 / span).astype(np.uint8).tobytes())
        return pd.Series(out)

    return frames.withColumn("pixels", stretch("pixels"))


def crop(frames: DataFrame, tracks: DataFrame, size: str = "roi_size") -> DataFrame:
    """(file_id, frame_number, worm_index_joined, h, w, pixels, roi_x, roi_y): a square region for each tracked animal, 0
    outside, and the place of its corner in the frame."""
    joined = frames.join(tracks.select("file_id", "frame_number", "worm_index_joined", "coord_x", "coord_y", F.col(size).cast("int").alias("_s")), ["file_id", "frame_number"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made, corners = [], []
            for r in pdf.itertuples():
                s, pad = int(r.s_), int(r.s_)
                a = np.pad(image(r.pixels, r.h, r.w), pad)
                x, y = int(round(r.coord_x)) - s // 2 + pad, int(round(r.coord_y)) - s // 2 + pad
                x, y = min(max(x, 0), a.shape[1] - s), min(max(y, 0), a.shape[0] - s)
                made.append(np.ascontiguousarray(a[y : y + s, x : x + s]).tobytes())
                corners.append((float(x - pad), float(y - pad)))
            xs, ys = zip(*corners, strict=True) if corners else ((), ())
            yield pdf.assign(h=pdf["s_"], w=pdf["s_"], pixels=made, roi_x=xs, roi_y=ys)[["file_id", "frame_number", "worm_index_joined", "h", "w", "pixels", "roi_x", "roi_y"]]

    return joined.withColumnRenamed("_s", "s_").mapInPandas(run, "file_id int, frame_number int, worm_index_joined int, h int, w int, pixels binary, roi_x double, roi_y double")


def difference_variance(frames: DataFrame, keys: tuple[str, ...] = ("file_id",), order: str = "frame_number") -> DataFrame:
    """(keys, frame_number, variance) of pixel differences to the frame before, over pixels that neither frame masks;
    NULL if there are none, and no row for a file's first frame."""
    w = Window.partitionBy(*keys).orderBy(order)

    @F.pandas_udf("double")
    def variance(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            f, g = np.frombuffer(x, np.uint8).astype(float), np.frombuffer(y, np.uint8).astype(float)
            d = (f - g)[(f > 0) & (g > 0)]
            out.append(float(d.var()) if len(d) else None)
        return pd.Series(out, dtype=float)

    both = frames.select(*keys, order, "pixels", F.lag("pixels").over(w).alias("_before")).where("_before is not null")
    return both.select(*keys, order, F.nanvl(variance("pixels", "_before"), F.lit(None).cast("double")).alias("variance"))


def refined_background(masked: DataFrame, full: DataFrame, dark: bool = True) -> DataFrame:
    """The background of masked frames, refined by that of the frames that were kept whole."""
    return background(background(masked, dark=dark).withColumn("frame_number", F.lit(0)).unionByName(background(full, dark=dark).withColumn("frame_number", F.lit(1))), dark=dark)


# ---- contours -------------------------------------------------------------------------------------------------------


#: The eight neighbours (y, x), clockwise from the right.
_AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def trace_contour(mask: np.ndarray) -> np.ndarray:
    """The outer border (points x, y) of the largest component of a mask, walked from its topmost pixel.

    A pixel where two parts of a body meet is passed once for each part.  So the walk ends only when it is back at its
    start and is about to take its first step again.
    """
    labels = label_components(mask)
    if not labels.any():
        return np.zeros((0, 2))
    sizes = np.bincount(labels.ravel())
    sizes[0] = 0
    inside = np.pad(labels == sizes.argmax(), 1)
    at, came, out, first = tuple(int(v) for v in np.argwhere(inside)[0]), 6, [], None
    while True:
        step = next((d for d in ((came + k) % 8 for k in range(1, 9)) if inside[at[0] + _AROUND[d][0], at[1] + _AROUND[d][1]]), None)
        if (at, step) == first:
            break
        out.append(at)
        if step is None:
            break
        first = first or (at, step)
        at, came = (at[0] + _AROUND[step][0], at[1] + _AROUND[step][1]), (step + 4) % 8
    return np.array(out, float)[:, ::-1] - 1


def polygon_moment(p: np.ndarray, i: int, j: int) -> float:
    """The moment x^i y^j of a polygon's area, signed by its direction (Steger's sum over edges)."""
    x0, y0 = np.roll(p, 1, axis=0).T
    x1, y1 = p.T
    total = np.zeros(len(p))
    for k in range(i + 1):
        for m in range(j + 1):
            total += comb(k + m, m) * comb(i + j - k - m, j - m) * x1**k * x0 ** (i - k) * y1**m * y0 ** (j - m)
    return float(((x0 * y1 - x1 * y0) * total).sum() / ((i + j + 2) * (i + j + 1) * comb(i + j, i)))


def hu_moments(p: np.ndarray) -> list[float]:
    """Hu's seven invariants of a polygon."""
    area = polygon_moment(p, 0, 0)
    q = p - [polygon_moment(p, 1, 0) / area, polygon_moment(p, 0, 1) / area]
    n = {(i, j): np.sign(area) * polygon_moment(q, i, j) / abs(area) ** (1 + (i + j) / 2) for i in range(4) for j in range(4) if 2 <= i + j <= 3}
    a, b, c, d = n[3, 0] + n[1, 2], n[2, 1] + n[0, 3], n[3, 0] - 3 * n[1, 2], 3 * n[2, 1] - n[0, 3]
    e = n[2, 0] - n[0, 2]
    return [
        n[2, 0] + n[0, 2], e**2 + 4 * n[1, 1] ** 2, c**2 + d**2, a**2 + b**2,
        c * a * (a**2 - 3 * b**2) + d * b * (3 * a**2 - b**2), e * (a**2 - b**2) + 4 * n[1, 1] * a * b,
        d * a * (a**2 - 3 * b**2) - c * b * (3 * a**2 - b**2),
    ]


def shape(contour: np.ndarray) -> dict[str, float]:
    """area, perimeter, box_length, box_width, quirkiness, compactness, solidity and hu0 to hu6 of a closed contour."""
    area = abs(polygon_moment(contour, 0, 0)) if len(contour) > 2 else 0.0
    long, short, quirkiness = min_rectangle(contour)
    if not area or not short:
        return {}
    perimeter = float(np.hypot(*(contour - np.roll(contour, 1, axis=0)).T).sum())
    hull = abs(polygon_moment(convex_hull(contour), 0, 0))
    out = {"area": area, "perimeter": perimeter, "box_length": long, "box_width": short, "quirkiness": quirkiness, "compactness": 4 * np.pi * area / perimeter**2, "solidity": area / hull}
    return out | {f"hu{k}": v for k, v in enumerate(hu_moments(contour))}


SHAPES = ["area", "perimeter", "box_length", "box_width", "quirkiness", "compactness", "solidity", *(f"hu{k}" for k in range(7))]


def blob_shapes(rois: DataFrame, keys: tuple[str, ...], threshold: int, dark: bool = True) -> DataFrame:
    """(keys, shapes): the shape of the largest component of each region of interest; NULL where there is none."""
    kinds = {f.name: f.dataType.simpleString() for f in rois.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{c} double" for c in SHAPES)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for h, w, p in zip(pdf["h"], pdf["w"], pdf["pixels"], strict=True):
                a = image(p, h, w)
                rows.append(shape(trace_contour((a > 0) & ((a < threshold) if dark else (a > threshold)))))
            yield pd.concat([pdf[list(keys)].reset_index(drop=True), pd.DataFrame(rows, columns=SHAPES, index=range(len(pdf)))], axis=1)

    return rois.select(*keys, "h", "w", "pixels").mapInPandas(run, schema)


def patch_contour(a: np.ndarray, bins: int = 180, blur: int = 9, smooth: int = 9, offset: int = 5, dark: bool = True) -> np.ndarray:
    """The border (points x, y by angle) of the largest patch that is darker (lighter) than the image's median.

    Of the border's points in each angle bin the one nearest to the circle of equal area stays; radii are averaged over
    a circular window of bins that have any.
    """
    flat = box_mean(a, blur)
    flat = flat if dark else -flat
    level = np.median(flat)
    if not (flat < level - offset).any():
        return np.zeros((0, 2))
    # Half way from the background to what stands out.
    labels = label_components(flat < (level + np.median(flat[flat < level - offset])) / 2)
    if not labels.any():
        return np.zeros((0, 2))
    sizes = np.bincount(labels.ravel())
    sizes[0] = 0
    mask = labels == sizes.argmax()
    p = np.pad(mask, 1)
    inner = p[1:-1, :-2] & p[1:-1, 2:] & p[:-2, 1:-1] & p[2:, 1:-1]
    ys, xs = np.nonzero(mask)
    centre, radius = np.array([xs.mean(), ys.mean()]), np.sqrt(mask.sum() / np.pi)
    by, bx = np.nonzero(mask & ~inner)
    away = np.hypot(bx - centre[0], by - centre[1]) - radius
    place = np.rint(np.arctan2(by - centre[1], bx - centre[0]) / np.pi * bins).astype(int)
    order = np.lexsort((np.abs(away), place))
    first = np.concatenate(([True], np.diff(place[order]) > 0))
    angle, away = place[order][first] * np.pi / bins, away[order][first]
    half = min(smooth // 2, max(0, (len(away) - 1) // 2))
    around = np.concatenate((away[-half:], away, away[:half])) if half else away
    r = radius + np.convolve(around, np.ones(2 * half + 1) / (2 * half + 1), "valid")
    return centre + np.column_stack((np.cos(angle), np.sin(angle))) * r[:, None]


def _erode(mask: np.ndarray, radius: int) -> np.ndarray:
    return ~dilate(~mask, radius)


def thinned(mask: np.ndarray) -> np.ndarray:
    """The middle lines of a mask: at every size of erosion what an opening would take away."""
    cross = lambda m, pad: np.logical_and.reduce([np.pad(m, 1, constant_values=pad)[1 + dy : m.shape[0] + 1 + dy, 1 + dx : m.shape[1] + 1 + dx] for dy, dx in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))])
    out, left = np.zeros_like(mask), mask.copy()
    while left.any():
        less = cross(left, False)
        out |= left & cross(~less, True)
        left = less
    return out


def ring_contour(a: np.ndarray, bins: int = 180, share: float = 0.1, offset: float = 3.0, points: int = 480, dark: bool = True) -> np.ndarray:
    """The border (points x, y by angle) of a patch whose rim stands out, also where the rim is broken; empty without one.

    What is darker (lighter) than its surroundings is thinned to lines.  The circle that most of their points lie on gives
    the centre; of the points in each angle bin the one nearest to the circle stays, and a robust local fit over the
    angles, which go around, smooths their radii and bridges what is missing.
    """
    block = int(min(a.shape) / 8) | 1
    mask = adaptive_mask(a, block, offset, max(1, min(a.shape) // 200) ** 2, 0, dark)
    mask = _erode(dilate(mask, 1), 1)
    labels = label_components(mask)
    sizes = np.bincount(labels.ravel())
    sizes[0] = 0
    mask = (sizes >= max(4, sizes.max(initial=0) // 50))[labels]
    y, x = np.nonzero(thinned(mask))
    found = best_circle(np.column_stack((x, y)), max(2.0, min(a.shape) / 40), min(a.shape) / 8, max(a.shape) / 2)
    if found is None:
        return np.zeros((0, 2))
    cx, cy, radius = found
    away = np.hypot(x - cx, y - cy) - radius
    place = np.rint(np.arctan2(y - cy, x - cx) / np.pi * bins).astype(int)
    order = np.lexsort((np.abs(away), place))
    first = np.concatenate(([True], np.diff(place[order]) > 0))
    angle, away = place[order][first] * np.pi / bins, away[order][first]
    near = np.abs(away) <= radius / 2
    angle, away = angle[near], away[near]
    if len(angle) < 8:
        return np.zeros((0, 2))
    around = np.concatenate((angle - 2 * np.pi, angle, angle + 2 * np.pi))
    smooth = lowess(around, np.tile(away, 3), share / 3)
    at = np.linspace(-np.pi, np.pi, points, endpoint=False)
    r = radius + np.interp(at, around, smooth)
    return np.column_stack((cx + r * np.cos(at), cy + r * np.sin(at)))


#: Ways to find a food contour.
CONTOURS = {"patch": patch_contour, "ring": ring_contour}


def food_contours(backgrounds: DataFrame, keys: tuple[str, ...] = ("file_id",), scale: float = 1.0, method: str = "patch", **how) -> DataFrame:
    """(keys, seq, x, y): the patch's border in each background image, times ``scale``, as ``features.food_features`` takes
    it; by ``CONTOURS``: of a patch that is darker as a whole, or of one of which only the rim stands out."""
    contour = CONTOURS[method]
    kinds = {f.name: f.dataType.simpleString() for f in backgrounds.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                c = contour(image(r["pixels"], r["h"], r["w"]), **how) * scale
                yield pd.DataFrame({**{k: [r[k]] * len(c) for k in keys}, "seq": range(len(c)), "x": c[:, 0], "y": c[:, 1]})

    return backgrounds.select(*keys, "h", "w", "pixels").mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", seq int, x double, y double")


# ---- from contours to poses -----------------------------------------------------------------------------------------


POSE = "code int, skeleton array<struct<x:double,y:double>>, widths array<double>, ventral array<struct<x:double,y:double>>, dorsal array<struct<x:double,y:double>>"


def poses_of_rois(rois: DataFrame, keys: tuple[str, ...] = ("file_id", "worm_index_joined"), frame: str = "frame_number", threshold: int = 100, dark: bool = True, n: int = 49) -> DataFrame:
    """(keys, frame, code, skeleton, widths, ventral, dorsal) of each animal's regions of interest (h, w, pixels, and their
    corner roi_x, roi_y).

    Poses are made image by image; a frame without one has NULLs and a code that says why (``bodies.body_pose``).  Then
    each pose runs as the last one before it, by window functions over the track.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rois.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in (*keys, frame)) + ", " + POSE
    points = lambda a: [{"x": float(x), "y": float(y)} for x, y in a]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for h, w, p, x, y in zip(pdf["h"], pdf["w"], pdf["pixels"], pdf["roi_x"], pdf["roi_y"], strict=True):
                a = image(p, h, w)
                pose, code = body_pose(trace_contour((a > 0) & ((a < threshold) if dark else (a > threshold))), n)
                rows.append((code, *(None if pose is None else pose[k].tolist() if k == "widths" else points(pose[k] + [x, y]) for k in ("skeleton", "widths", "ventral", "dorsal"))))
            made = pd.DataFrame(rows, columns=["code", "skeleton", "widths", "ventral", "dorsal"], dtype=object)
            yield pd.concat([pdf[[*keys, frame]].reset_index(drop=True), made], axis=1)

    made = rois.select(*keys, frame, "h", "w", "pixels", "roi_x", "roi_y").mapInPandas(run, schema)
    return flip_poses(consistent_flips(made, Track(keys, (frame,)), "skeleton"), "flip").drop("flip")


def intensity_profiles(rois: DataFrame, poses: DataFrame, keys: tuple[str, ...] = ("file_id", "worm_index_joined", "frame_number"), half_width: float = 5.0, across: int = 15, points: int | None = None) -> DataFrame:
    """(keys, profile, intensity_map): intensities of each animal along its body, as ``tracking.orient_by_intensity`` takes
    them, and its straightened image (``points`` rows of ``across`` doubles).

    ``rois`` (keys, h, w, pixels, roi_x, roi_y) meet the poses (keys, skeleton, in the frame's pixels).  The image is read
    along normals of the skeleton, between pixels by their distance; the profile holds the median of each normal.  Frames
    without a pose have NULLs; with ``points`` the skeleton is drawn anew first.
    """
    joined = rois.select(*keys, "h", "w", "pixels", "roi_x", "roi_y").join(poses.select(*keys, "skeleton"), list(keys))
    joined = joined.withColumns({"_xs": F.transform("skeleton", lambda p: p["x"]), "_ys": F.transform("skeleton", lambda p: p["y"])}).drop("skeleton")
    kinds = {f.name: f.dataType.simpleString() for f in rois.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            profiles, maps = [], []
            for r in pdf.itertuples(index=False, name=None):
                h, w, pixels, x, y, xs, ys = r[len(keys) :]
                if xs is None or len(xs) < 2 or pixels is None:
                    profiles.append(None)
                    maps.append(None)
                    continue
                line = np.column_stack((xs, ys)) - [x, y]
                line = line if points is None else resample_curve(line, points)
                flat = straighten(image(pixels, h, w), line, half_width, across)
                profiles.append(np.median(flat, axis=1).tolist())
                maps.append(np.ascontiguousarray(flat).tobytes())
            yield pdf[list(keys)].assign(profile=profiles, intensity_map=maps)

    return joined.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", profile array<double>, intensity_map binary")


def two_peaks(a: np.ndarray, min_area: float = 0.0) -> np.ndarray | None:
    """The two intensity peaks (points x, y) of a bright body, that of the larger part first; None unless there are two.

    The blurred image is parted from its background by Otsu's threshold.  Inside of the largest component every pixel
    belongs to the peak that the steepest way up leads to; peaks whose surroundings touch are one.
    """
    kernel = np.array([1, 4, 6, 4, 1]) / 16
    p = np.pad(a.astype(float), 2, "reflect")
    rows = sum(k * p[i : i + a.shape[0]] for i, k in enumerate(kernel))
    blur = sum(k * rows[:, i : i + a.shape[1]] for i, k in enumerate(kernel))
    labels = label_components(blur > otsu(blur / 255) * 255)
    sizes = np.bincount(labels.ravel())
    sizes[0] = 0
    if not labels.any() or sizes.max() < max(2, min_area):
        return None
    mask = labels == sizes.argmax()
    # Equal heights go by place, so that every way ends.
    height = np.where(mask, blur * mask.size - np.arange(mask.size).reshape(mask.shape) / mask.size, -np.inf)
    q = np.pad(height, 1, constant_values=-np.inf)
    around = np.stack([q[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3)])
    best = around.argmax(0)
    y, x = np.indices(mask.shape)
    up = np.where(mask, (y + best // 3 - 1) * a.shape[1] + x + best % 3 - 1, 0).ravel()
    while not np.array_equal(up[up], up):
        up = up[up]
    tops = np.unique(up[mask.ravel()])
    marks = np.zeros(mask.size, bool)
    marks[tops] = True
    near = label_components(dilate(marks.reshape(mask.shape), 1)).ravel()
    found, area = np.unique(near[up[mask.ravel()]], return_counts=True)
    if len(found) != 2:
        return None
    peaks = [max(tops[near[tops] == k], key=lambda t: blur.ravel()[t]) for k in found[np.argsort(-area, kind="stable")]]
    return np.array([divmod(int(t), a.shape[1])[::-1] for t in peaks], float)


def two_point_axes(rois: DataFrame, keys: tuple[str, ...] = ("file_id", "worm_index_joined", "frame_number")) -> DataFrame:
    """(keys, skeleton): the two-point axis of each region of interest (h, w, pixels, roi_x, roi_y and area), by
    :func:`two_peaks` of components of at least half the animal's area; NULL where there are not two peaks."""
    kinds = {f.name: f.dataType.simpleString() for f in rois.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for r in pdf.itertuples():
                peaks = two_peaks(image(r.pixels, r.h, r.w), r.area / 2)
                made.append(None if peaks is None else [{"x": x + r.roi_x, "y": y + r.roi_y} for x, y in peaks.tolist()])
            yield pdf[list(keys)].assign(skeleton=made)

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", skeleton array<struct<x:double,y:double>>"
    return rois.select(*keys, "h", "w", "pixels", "roi_x", "roi_y", "area").mapInPandas(run, schema)


def tiles(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """(file_id, frame_number, well_name, h, w, pixels): the frames' wells, by boxes (file_id, well_name, x_min, ...)."""
    joined = frames.join(boxes.select("file_id", "well_name", "x_min", "x_max", "y_min", "y_max"), "file_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cut = [image(r.pixels, r.h, r.w)[max(0, int(r.y_min)) : int(r.y_max) + 1, max(0, int(r.x_min)) : int(r.x_max) + 1] for r in pdf.itertuples()]
            yield pdf.assign(h=[c.shape[0] for c in cut], w=[c.shape[1] for c in cut], pixels=[np.ascontiguousarray(c).tobytes() for c in cut])[["file_id", "frame_number", "well_name", "h", "w", "pixels"]]

    return joined.mapInPandas(run, "file_id int, frame_number int, well_name string, h int, w int, pixels binary")
