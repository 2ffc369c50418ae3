"""Column expressions over pose arrays: points are structs (x, y), a pose has 49 of them from head to tail."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named body parts as [first, past last) of 49 points.
PARTS = {
    "head": (0, 8), "neck": (8, 16), "midbody": (16, 33), "hips": (33, 41), "tail": (41, 49),
    "head_tip": (0, 3), "head_base": (5, 8), "tail_base": (41, 44), "tail_tip": (46, 49), "all": (0, 49), "body": (8, 41),
    "old_midbody_velocity": (20, 29),
}


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def part(pose: Column, name: str, n: int = 49) -> Column:
    """Points of a body part; ranges are scaled if a pose has ``n`` points."""
    a, b = PARTS[name]
    a, b = (a, b) if n == 49 else (round(a * n / 49), round(b * n / 49))
    return F.slice(pose, a + 1, b - a)


def steps(pose: Column) -> Column:
    """Vectors between neighbouring points."""
    n = F.size(pose)
    return F.zip_with(F.slice(pose, 1, n - 1), F.slice(pose, 2, n - 1), lambda a, b: F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y")))


def length(pose: Column) -> Column:
    return F.aggregate(steps(pose), F.lit(0.0), lambda s, v: s + F.hypot(v["x"], v["y"]))


def area(ventral: Column, dorsal: Column) -> Column:
    """Size of the area between two contour sides, head to tail: a shoelace sum that leaves out the closing edge."""
    ring = F.concat(ventral, F.reverse(dorsal))
    n = F.size(ring)
    turns = F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(_sum(turns)) / 2


def shoelace(xs: Column, ys: Column) -> Column:
    """Signed area of the polygon with coordinates in two arrays."""
    turn = lambda a: F.concat(F.slice(a, 2, F.size(a) - 1), F.slice(a, 1, 1))
    return (_sum(F.zip_with(xs, turn(ys), lambda a, b: a * b)) - _sum(F.zip_with(turn(xs), ys, lambda a, b: a * b))) / 2


def mean(a: Column) -> Column:
    return _sum(a) / F.size(a)


def median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return (F.element_at(s, ((n + 1) / 2).cast("int")) + F.element_at(s, (n / 2 + 1).cast("int"))) / 2


def width_of(widths: Column, name: str) -> Column:
    return median(part(widths, name))


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def head_tail_distance(pose: Column) -> Column:
    return distance(F.element_at(pose, 1), F.element_at(pose, -1))


def centroid(pose: Column) -> Column:
    n = F.size(pose)
    return F.struct((F.aggregate(pose, F.lit(0.0), lambda s, p: s + p["x"]) / n).alias("x"), (F.aggregate(pose, F.lit(0.0), lambda s, p: s + p["y"]) / n).alias("y"))


def orientation(pose: Column) -> Column:
    """The vector from the last to the first point."""
    a, b = F.element_at(pose, 1), F.element_at(pose, -1)
    return F.struct((a["x"] - b["x"]).alias("x"), (a["y"] - b["y"]).alias("y"))


def angle_of(v: Column) -> Column:
    """atan2(x, y): the angle of a vector from the y axis."""
    return F.atan2(v["x"], v["y"])


def heading(y: Column, x: Column) -> Column:
    """atan2(y, x) as the C library has it, like SQL, for angles that are compared with each other to the last bit.

    Java's differs in that bit for one angle in seven.
    """

    @F.arrow_udf("double")
    def angles(ys: pa.Array, xs: pa.Array) -> pa.Array:
        return pa.array([None if b is None or a is None else math.atan2(b, a) for b, a in zip(ys.to_pylist(), xs.to_pylist(), strict=True)], pa.float64())

    return angles(y, x)


def tangent_angles(pose: Column) -> Column:
    """Unwrapped tangent angles atan2(x, y) along a pose, less their mean."""
    raw = F.transform(steps(pose), lambda v: F.atan2(v["x"], v["y"]))

    def add(acc: Column, a: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.lit(-1)), a)
        turn = F.pmod(a - last + math.pi, F.lit(2 * math.pi)) - math.pi
        return F.concat(acc, F.array(last + turn))

    angles = F.aggregate(raw, F.array().cast("array<double>"), add)
    # One mean for the whole array: inside of a lambda it would be computed for each element.
    return F.zip_with(angles, F.array_repeat(mean(angles), F.size(pose) - 1), lambda a, m: a - m)


def gradient(values: Column, width: int) -> Column:
    """Difference over ``width`` values on both sides, by its span; towards the ends the stencil is cut off.

    ``values`` must be a column of its own, since it is looked up for each element.
    """
    n = F.size(values)

    def at(_: Column, i: Column) -> Column:
        low, high = F.greatest(i - width, F.lit(0)), F.least(i + width, n - 1)
        return (F.element_at(values, high + 1) - F.element_at(values, low + 1)) / (F.lit(width) + F.least(i, n - 1 - i, F.lit(width)))

    return F.transform(values, at)


def mean_angle(pose: Column) -> Column:
    return mean(F.transform(steps(pose), lambda v: F.atan2(v["y"], v["x"])))


def projections(angles: Column, basis: Sequence[Sequence[float]]) -> list[Column]:
    """Dot products with every row of a basis."""
    return [_sum(F.zip_with(angles, F.array(*(F.lit(float(b)) for b in row)), lambda a, b: a * b)) for row in basis]


def cosine_basis(n: int, k: int) -> list[list[float]]:
    """The first ``k`` non-constant orthonormal cosines on ``n`` points."""
    return [[math.sqrt(2 / n) * math.cos(math.pi * (i + 0.5) * j / n) for i in range(n)] for j in range(1, k + 1)]


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def to_body_frame(pose: Column, origin: Column, angle: Column) -> Column:
    """Moves ``origin`` to zero and turns by -``angle``."""
    c, s = F.cos(angle), F.sin(angle)
    return F.transform(pose, lambda p: F.struct(((p["x"] - origin["x"]) * c + (p["y"] - origin["y"]) * s).alias("x"), (-(p["x"] - origin["x"]) * s + (p["y"] - origin["y"]) * c).alias("y")))


def shifted(pose: Column, dx: Column, dy: Column) -> Column:
    return F.transform(pose, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def rotated(dx: Column, dy: Column, m: Sequence[Sequence[float]]) -> tuple[Column, Column]:
    """A 2 x 2 matrix times a vector."""
    return dx * m[0][0] + dy * m[0][1], dx * m[1][0] + dy * m[1][1]


def deviation(a: Column) -> Column:
    """Population standard deviation of an array."""
    m = mean(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a))


def signed_deviation(a: Column) -> Column:
    """The deviation with the sign of the mean."""
    return deviation(a) * F.signum(mean(a))


def bend_angles(pose: Column, edge: int = 4) -> Column:
    """Turn in degrees at each point between the points ``edge`` before and after; NULL near the ends."""
    n = F.size(pose)

    def at(i: Column) -> Column:
        p, a, b = F.element_at(pose, i), F.element_at(pose, F.greatest(i - edge, F.lit(1))), F.element_at(pose, F.least(i + edge, n))
        turn = F.atan2(b["y"] - p["y"], b["x"] - p["x"]) - F.atan2(p["y"] - a["y"], p["x"] - a["x"])
        return F.when((i > edge) & (i <= n - edge), F.degrees(F.pmod(turn + math.pi, F.lit(2 * math.pi)) - math.pi))

    return F.transform(F.sequence(F.lit(1), n), at)


def eccentricity(pose: Column) -> tuple[Column, Column]:
    """Eccentricity and orientation in degrees of the points' covariance ellipse."""
    c, n = centroid(pose), F.size(pose)
    moment = lambda f: F.aggregate(pose, F.lit(0.0), lambda s, p: s + f(p)) / n
    xx, yy = moment(lambda p: (p["x"] - c["x"]) * (p["x"] - c["x"])), moment(lambda p: (p["y"] - c["y"]) * (p["y"] - c["y"]))
    xy = moment(lambda p: (p["x"] - c["x"]) * (p["y"] - c["y"]))
    root = F.sqrt(4 * xy * xy + (xx - yy) * (xx - yy))
    return F.sqrt(F.try_divide(2 * root, xx + yy + root)), F.degrees(F.atan2(2 * xy, xx - yy + root))


def amplitude(pose: Column) -> tuple[Column, Column]:
    """Range and ratio of the two sides of a pose in its own frame (head to tail along x)."""
    v = orientation(pose)
    ys = F.transform(to_body_frame(pose, F.element_at(pose, -1), F.atan2(v["y"], v["x"])), lambda p: p["y"])
    top, low = F.array_max(ys), F.array_min(ys)
    return top - low, F.try_divide(F.least(F.abs(top), F.abs(low)), F.greatest(F.abs(top), F.abs(low)))


def food_orientation(v: Column, px: Column, py: Column) -> Column:
    """Cosine between a body vector and the direction (px, py) to the food."""
    return F.try_divide(v["x"] * px + v["y"] * py, F.hypot(v["x"], v["y"]) * F.hypot(px, py))


def angle_difference(a: Column, b: Column) -> Column:
    return F.pmod(a - b + math.pi, F.lit(2 * math.pi)) - math.pi
