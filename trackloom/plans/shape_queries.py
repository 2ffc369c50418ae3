"""Registered queries of images with known shapes, of whole poses, and of peaks and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import geometry as G
from trackloom.functions.kernels import savgol_weights
from trackloom.functions.timeseries import Track
from trackloom.operators import events as E
from trackloom.operators import features as X
from trackloom.operators import images as P
from trackloom.operators import summary as A
from trackloom.operators import tracking as K
from trackloom.plans.registry import FRAMES, frames, query, rounded
from trackloom.plans.route_queries import _P, POSES, TRACK, _poses, _rounded, _take
from trackloom.sources import images as I
from trackloom.sources.export import shared_folder

# ---- images: a dark rectangle in a light frame, its place and size taken from a vector -----------------------------

_H, _W = 24, 32
_RECT = f"""r AS (SELECT vec_id, label AS file_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS frame_number, 2 + (vec_id % 7)::INT AS x0, 3 + (vec_id % 5)::INT AS y0,
  4 + CASE WHEN embedding[1] > 0 THEN 6 ELSE 1 END + (vec_id % 3)::INT AS w, 4 + CASE WHEN embedding[2] > 0 THEN 4 ELSE 0 END + (vec_id % 4)::INT AS h, 50 + label::INT AS dark FROM embeddings),
px AS (SELECT *, list_transform(range({_H * _W}), lambda k: CASE WHEN k % {_W} BETWEEN x0 AND x0 + w - 1 AND k // {_W} BETWEEN y0 AND y0 + h - 1 THEN dark ELSE 200 END) AS px FROM r)"""


def _rectangles(t) -> DataFrame:
    up = lambda i: F.element_at("embedding", i) > 0
    e = t("embeddings").select(
        "vec_id", F.col("label").alias("file_id"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("frame_number"),
        (2 + F.col("vec_id") % 7).cast("int").alias("x0"), (3 + F.col("vec_id") % 5).cast("int").alias("y0"),
        (4 + F.when(up(1), 6).otherwise(1) + F.col("vec_id") % 3).cast("int").alias("rw"), (4 + F.when(up(2), 4).otherwise(0) + F.col("vec_id") % 4).cast("int").alias("rh"), (50 + F.col("label")).alias("dark"),
    )
    inside = lambda k: (k % _W).between(F.col("x0"), F.col("x0") + F.col("rw") - 1) & F.floor(k / _W).between(F.col("y0"), F.col("y0") + F.col("rh") - 1)
    shades = F.transform(F.sequence(F.lit(0), F.lit(_H * _W - 1)), lambda k: F.lpad(F.hex(F.when(inside(k), F.col("dark")).otherwise(200)), 2, "0"))
    return e.select("vec_id", "file_id", "frame_number", "x0", "y0", F.lit(_H).alias("h"), F.lit(_W).alias("w"), F.unhex(F.array_join(shades, "")).alias("pixels"))


@query(f"""WITH {_RECT}, s AS (SELECT vec_id, (w - 1)::DOUBLE AS a, (h - 1)::DOUBLE AS b FROM r)
SELECT vec_id, a * b AS area, 2 * (a + b) AS perimeter, greatest(a, b) AS box_length, least(a, b) AS box_width, round(sqrt(1 - (least(a, b) / greatest(a, b)) ** 2), 6) AS quirkiness,
       round(4 * pi() * a * b / (2 * (a + b)) ** 2, 6) AS compactness, 1.0::DOUBLE AS solidity, round(a / (12 * b) + b / (12 * a), 8) AS hu0, round((a / (12 * b) - b / (12 * a)) ** 2, 8) AS hu1 FROM s""")
def blob_shapes(t):
    """SCA-27, IMG-08, IMG-23: shapes of contours of rectangles."""
    out = P.blob_shapes(_rectangles(t), ("vec_id",), 100)
    keep = {"area": 6, "perimeter": 6, "box_length": 6, "box_width": 6, "quirkiness": 6, "compactness": 6, "solidity": 6, "hu0": 8, "hu1": 8}
    return out.select("vec_id", *(rounded(F.col(c), n).alias(c) for c, n in keep.items()))


@query(f"WITH {_RECT} SELECT file_id, frame_number::INT AS frame_number, 0 AS blob, x0 + (w - 1) / 2::DOUBLE AS coord_x, y0 + (h - 1) / 2::DOUBLE AS coord_y, (w * h)::DOUBLE AS area, greatest(w, h)::DOUBLE AS box_length, least(w, h)::DOUBLE AS box_width, x0 AS bounding_box_xmin, x0 + w AS bounding_box_xmax, y0 AS bounding_box_ymin, y0 + h AS bounding_box_ymax, dark::DOUBLE AS intensity_mean FROM r WHERE w * h >= 40")
def detected_blobs(t):
    """SEL-11, IMG-05, IMG-06: a row for each blob that is large enough."""
    out = P.detect_blobs(_rectangles(t), 100, min_area=40)
    return out.select("file_id", "frame_number", "blob", *(rounded(F.col(c)).alias(c) for c in ("coord_x", "coord_y", "area", "box_length", "box_width")), "bounding_box_xmin", "bounding_box_xmax", "bounding_box_ymin", "bounding_box_ymax", "intensity_mean")


@query(f"""WITH {_RECT}, k AS (SELECT *, unnest(range(64)) AS k FROM px), q AS (SELECT vec_id, file_id, frame_number, k, x0 - 4 + k % 8 AS x, y0 - 4 + k // 8 AS y, px FROM k)
SELECT file_id, frame_number::INT AS frame_number, string_agg(CASE WHEN x < 0 OR y < 0 THEN '00' ELSE printf('%02X', px[y * {_W} + x + 1]) END, '' ORDER BY k) AS pixels FROM q GROUP BY ALL""")
def cropped_rois(t):
    """IMG-07, UDF-7: a square region around each animal, 0 beyond the frame."""
    f = _rectangles(t)
    tracks = f.select("file_id", "frame_number", F.lit(1).alias("worm_index_joined"), F.col("x0").cast("double").alias("coord_x"), F.col("y0").cast("double").alias("coord_y"), F.lit(8).alias("roi_size"))
    return P.crop(f.select("file_id", "frame_number", "h", "w", "pixels"), tracks).select("file_id", "frame_number", F.hex("pixels").alias("pixels"))


_AROUND = f"""list_transform(range({_H * _W}), lambda k: list_sum(list_transform(range(25), lambda j: dk[greatest(0, least({_H - 1}, k // {_W} + j // 5 - 2)) * {_W} + greatest(0, least({_W - 1}, k % {_W} + j % 5 - 2)) + 1])) / 25::DOUBLE - dk[k + 1] > 15.5)"""


@query(f"""WITH {_RECT}, u AS (SELECT file_id, frame_number // 2 AS run, unnest(range({_H * _W})) AS k, unnest(px) AS v FROM px), m AS (SELECT file_id, run, list(v ORDER BY k) AS dk FROM (SELECT file_id, run, k, min(v) AS v FROM u GROUP BY ALL) GROUP BY ALL),
d AS (SELECT file_id, run, {_AROUND} AS hit FROM m),
g AS (SELECT file_id, run, list_transform(range({_H * _W}), lambda k: list_bool_or(list_transform(range(9), lambda j: hit[greatest(0, least({_H - 1}, k // {_W} + j // 3 - 1)) * {_W} + greatest(0, least({_W - 1}, k % {_W} + j % 3 - 1)) + 1]))) AS mask FROM d)
SELECT px.file_id, frame_number::INT AS frame_number, len(list_filter(mask, lambda b: b))::INT AS n_kept, list_sum(list_transform(range({_H * _W}), lambda k: CASE WHEN mask[k + 1] THEN px[k + 1] ELSE 0 END))::BIGINT AS total FROM px JOIN g ON g.file_id = px.file_id AND g.run = frame_number // 2""")
def masked_buffers(t):
    """IMG-01, IMG-02: pixels darker than around them in any frame of a run, grown by one; the rest is 0."""
    out = P.mask_buffers(_rectangles(t).select("file_id", "frame_number", "h", "w", "pixels"), 2, block=5, offset=15.5, min_area=1, grow=1)
    values = F.transform(F.sequence(F.lit(1), F.lit(_H * _W)), lambda k: F.conv(F.hex(F.substring("pixels", k, F.lit(1))), 16, 10).cast("int"))
    return out.select("file_id", "frame_number", F.size(F.filter(values, lambda v: v > 0)).alias("n_kept"), F.aggregate(values, F.lit(0).cast("bigint"), lambda s, v: s + v).alias("total"))


@query(f"WITH {_RECT} SELECT vec_id, CASE WHEN vec_id % 7 > 0 THEN list_transform(range(13), lambda k: list_median(list_transform(range(5), lambda o: px[(8 + o) * {_W} + 3 + 2 * k + 1]))::DOUBLE) END AS profile FROM px")
def intensity_profiles(t):
    """IMG-16: intensities along bodies, medians of each normal."""
    f = _rectangles(t).withColumns({"roi_x": F.lit(100.0), "roi_y": F.lit(50.0)})
    line = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda k: F.struct((103.0 + 2 * k).alias("x"), F.lit(60.0).alias("y")))
    poses = f.select("vec_id", F.when(F.col("vec_id") % 7 > 0, line).alias("skeleton"))
    return P.intensity_profiles(f, poses, ("vec_id",), 2.0, 5).select("vec_id", "profile")


# ---- poses ----------------------------------------------------------------------------------------------------------

_COORDS = {p: G.PARTS[p] for p in X.PATH_PARTS}


@query(f"WITH {_P} SELECT vec_id, " + ", ".join(f"CASE WHEN NOT lost THEN round(list_avg({a}[{lo + 1}:{hi}]), 6) END AS coord_{a}_{p}" for p, (lo, hi) in _COORDS.items() for a in "xy") + " FROM p")
def part_coordinates(t):
    """FEA-09: centres of parts; NULL without a pose."""
    return _take(X.part_coordinates(_poses(t, gaps=True)), ["vec_id"], [f"coord_{a}_{p}" for p in _COORDS for a in "xy"])


def _interp(at: str, xp: str, fp: str) -> str:
    """Linear interpolation of lists, with the end values beyond the ends."""
    j = f"greatest(1, least(len({xp}) - 1, len(list_filter({xp}, lambda z: z <= {at}))))"
    return f"CASE WHEN {at} < {xp}[1] THEN {fp}[1] WHEN {at} >= {xp}[len({xp})] THEN {fp}[len({fp})] ELSE {fp}[{j}] + ({fp}[{j} + 1] - {fp}[{j}]) * ({at} - {xp}[{j}]) / ({xp}[{j} + 1] - {xp}[{j}]) END"


def _wide(a: str, w: int) -> str:
    return f"list_transform(range(len({a})), lambda i: ({a}[least(i + {w}, len({a}) - 1) + 1] - {a}[greatest(i - {w}, 0) + 1]) / ({w} + least(i, len({a}) - 1 - i, {w})))"


@query(f"""WITH {FRAMES}, s AS (SELECT user_id, list(frame - 1 ORDER BY frame) AS t, list(event_id ORDER BY frame) AS ids, list((frame - 1)::DOUBLE ORDER BY frame) FILTER (WHERE event_id % 9 > 0) AS good, list(frame * 4 + value / 5 ORDER BY frame) FILTER (WHERE event_id % 9 > 0) AS gx, list(value / 2 ORDER BY frame) FILTER (WHERE event_id % 9 > 0) AS gy FROM f GROUP BY user_id),
p AS (SELECT *, list_transform(t, lambda q: {_interp('q', 'good', 'gx')}) AS x, list_transform(t, lambda q: {_interp('q', 'good', 'gy')}) AS y FROM s),
a AS (SELECT *, list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i = 1 THEN 0.0::DOUBLE ELSE sqrt((x[i] - x[i - 1]) ** 2 + (y[i] - y[i - 1]) ** 2) END) AS d FROM p),
b AS (SELECT *, list_transform(range(1, len(d) + 1), lambda i: list_sum(d[1:i])) AS along FROM a),
e AS (SELECT *, list_transform(range(ceil(along[len(along)] / 11)::INT), lambda i: i * 11::DOUBLE) AS at_ FROM b),
v AS (SELECT *, list_transform(at_, lambda q: {_interp('q', 'along', 'x')}) AS ex, list_transform(at_, lambda q: {_interp('q', 'along', 'y')}) AS ey, list_transform(at_, lambda q: {_interp('q', 'along', 't')}) AS et FROM e),
g AS (SELECT *, {_wide('ex', 10)} AS dx, {_wide('ey', 10)} AS dy FROM v), h AS (SELECT *, {_wide('dx', 10)} AS ddx, {_wide('dy', 10)} AS ddy FROM g),
k AS (SELECT *, list_transform(range(1, len(dx) + 1), lambda i: (dx[i] * ddy[i] - dy[i] * ddx[i]) / pow(dx[i] ** 2 + dy[i] ** 2, 1.5)) AS k FROM h)
SELECT unnest(ids) AS event_id, round(unnest(CASE WHEN len(at_) > 20 THEN list_transform(t, lambda q: {_interp('q', 'et', 'k')}) ELSE list_transform(t, lambda q: NULL::DOUBLE) END), 7) AS path_curvature_body FROM k""")
def path_curvature(t):
    """FEA-09, WIN-31: curvature of a path drawn anew at equal steps, read back at its own times; gaps are bridged."""
    seen = F.col("event_id") % 9 > 0
    df = frames(t).select("user_id", "frame", "event_id", F.when(seen, F.col("frame") * 4 + F.col("value") / 5).alias("coord_x_body"), F.when(seen, F.col("value") / 2).alias("coord_y_body"))
    return X.path_features(df, TRACK, ("body",)).select("event_id", rounded(F.col("path_curvature_body"), 7).alias("path_curvature_body"))


@query(f"""WITH {_P}, c AS (SELECT *, list_concat([0.0::DOUBLE], list_transform(range(1, 49), lambda i: sqrt((x[i + 1] - x[i]) ** 2 + (y[i + 1] - y[i]) ** 2))) AS d FROM p WHERE NOT lost),
m AS (SELECT *, list_transform(range(1, 50), lambda i: list_sum(d[1:i])) AS s FROM c),
k AS (SELECT *, unnest(range(12)) AS k FROM m), a AS (SELECT *, s[49] * k / 11 AS g FROM k), j AS (SELECT *, greatest(1, least(48, len(list_filter(s, lambda v: v <= g)))) AS j FROM a)
SELECT vec_id, k::INT AS k, round(x[j] + (x[j + 1] - x[j]) * (g - s[j]) / (s[j + 1] - s[j]), 6) AS x, round(y[j] + (y[j + 1] - y[j]) * (g - s[j]) / (s[j + 1] - s[j]), 6) AS y FROM j UNION ALL SELECT vec_id, NULL, NULL, NULL FROM p WHERE lost""")
def resampled_curves(t):
    """SCA-22: curves drawn anew with points at equal distances."""
    out = X.resampled(_poses(t, gaps=True), "skeleton", 12).select("vec_id", F.posexplode_outer("skeleton").alias("k", "p"))
    return out.select("vec_id", "k", rounded(F.col("p.x")).alias("x"), rounded(F.col("p.y")).alias("y"))


@query(f"""WITH {_P}, one AS (SELECT vec_id, x, y, unnest(range(1, 50)) AS i FROM p), f AS (SELECT *, unnest(range(1, 50)) AS j FROM one),
n AS (SELECT vec_id, x, y, (x[j] - x[i]) / sqrt((x[j] - x[i]) ** 2 + (y[j] - y[i]) ** 2) AS c, (y[j] - y[i]) / sqrt((x[j] - x[i]) ** 2 + (y[j] - y[i]) ** 2) AS s, x[i] AS x0, y[i] AS y0 FROM f WHERE i <> j),
h AS (SELECT vec_id, list_transform(range(1, 50), lambda k: x[k] * c + y[k] * s) AS u, list_transform(range(1, 50), lambda k: y[k] * c - x[k] * s) AS v FROM n WHERE list_min(list_transform(range(1, 50), lambda k: c * (y[k] - y0) - s * (x[k] - x0))) >= -1e-9),
b AS (SELECT vec_id, list_max(u) - list_min(u) AS w, list_max(v) - list_min(v) AS h FROM h), r AS (SELECT vec_id, arg_min(greatest(w, h), w * h) AS a, arg_min(least(w, h), w * h) AS b FROM b GROUP BY vec_id)
SELECT vec_id, round(a, 5) AS major_axis, round(b, 5) AS minor_axis, round(sqrt(1 - (b / a) ** 2), 5) AS quirkiness FROM r""")
def pose_rectangles(t):
    """SCA-05: sides of the smallest rectangle around a pose."""
    return _take(X.posture(_poses(t)), ["vec_id"], ["major_axis", "minor_axis", "quirkiness"], 5)


_THIN = "NOT lost AND frame % 5 <> 2"


@query(f"""WITH {_P}, q AS (SELECT *, 1 + label * 0.25::DOUBLE AS m FROM p WHERE frame % 5 <> 2), a AS (SELECT label, unnest(generate_series(min(frame), max(frame))) AS frame FROM q GROUP BY label)
SELECT a.label, a.frame::INT AS frame, q.vec_id, CASE WHEN NOT lost THEN round(list_sum(x) * m, 5) END AS sum_x, CASE WHEN NOT lost THEN round((y[1] + 3) * m, 6) END AS ventral_y, CASE WHEN NOT lost THEN round(list_sum(list_transform(y, lambda z: abs(z))) * m, 5) END AS sum_w FROM a LEFT JOIN q ON q.label = a.label AND q.frame = a.frame""")
def extracted_tracks(t):
    """FEA-14: poses on a dense frame axis, in microns."""
    p = _sided(_poses(t, gaps=True).where("frame % 5 <> 2")).withColumnRenamed("label", "file_id")
    meta = p.select("file_id").distinct().withColumn("microns_per_pixel", 1 + F.col("file_id") * 0.25)
    out = X.extract_tracks(p, meta, Track(("file_id",), ("frame",)))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    return out.select(F.col("file_id").alias("label"), "frame", "vec_id", rounded(total(F.transform("skeleton", lambda v: v["x"])), 5).alias("sum_x"), rounded(F.element_at("ventral", 1)["y"]).alias("ventral_y"), rounded(total(F.col("widths")), 5).alias("sum_w"))


def _sided(p: DataFrame) -> DataFrame:
    side = lambda d: F.transform("skeleton", lambda q: F.struct(q["x"].alias("x"), (q["y"] + d).alias("y")))
    return p.withColumns({"ventral": side(3), "dorsal": side(-4), "widths": F.transform("skeleton", lambda q: F.abs(q["y"]))})


def _fit(weights: str, n: int) -> str:
    """A filter of ``n`` rows over a list v, the nearest full window's polynomial at the ends."""
    start = f"greatest(1, least(i - {n // 2}, len(v) - {n - 1}))"
    return f"CASE WHEN len(v) < {n} THEN v ELSE list_transform(range(1, len(v) + 1), lambda i: list_sum(list_transform(range({n}), lambda k: {weights}[i - {start} + 1][k + 1] * v[{start} + k]))) END"


def _matrix(n: int, derivative: int = 0) -> str:
    return "[" + ", ".join("[" + ", ".join(repr(float(v)) for v in row) + "]" for row in savgol_weights(n, 3, derivative)) + "]"


def _smooth_sql(window: int, along: int, lost: str = "lost") -> str:
    """Points of poses one by one: gaps filled, then one filter over the frames of a point and one over a frame's points."""
    before, after = "(PARTITION BY label, c, j ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "(PARTITION BY label, c, j ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"""WITH {_P}, o AS (SELECT label, frame, {lost} AS lost, unnest(['x', 'y', 'w']) AS c, unnest([x, y, list_transform(y, lambda z: abs(z))]) AS s FROM p), u AS (SELECT label, frame, c, unnest(range(1, 50)) AS j, unnest(s) AS s, lost FROM o),
z AS (SELECT label, frame, c, j, CASE WHEN NOT lost THEN s END AS s, CASE WHEN NOT lost THEN frame END AS t FROM u),
g AS (SELECT *, last_value(s IGNORE NULLS) OVER {before} AS a, first_value(s IGNORE NULLS) OVER {after} AS b, max(t) OVER {before} AS ta, min(t) OVER {after} AS tb FROM z),
l AS (SELECT label, c, j, list(CASE WHEN s IS NOT NULL THEN s WHEN a IS NULL OR b IS NULL THEN coalesce(a, b) ELSE a + (b - a) * (frame - ta) / (tb - ta) END ORDER BY frame) AS v, list(frame ORDER BY frame) AS f FROM g GROUP BY ALL),
m AS (SELECT label, c, j, unnest(f) AS frame, unnest({_fit(_matrix(window), window)}) AS s FROM l), n AS (SELECT label, c, frame, list(s ORDER BY j) AS v FROM m GROUP BY ALL),
r AS (SELECT label, c, frame, {_fit(_matrix(along), along)} AS v FROM n)
SELECT vec_id, round(max(r.v[1]) FILTER (WHERE c = 'x'), 5) AS first_x, round(max(r.v[25]) FILTER (WHERE c = 'y'), 5) AS middle_y, round(max(list_sum(r.v)) FILTER (WHERE c = 'w'), 4) AS sum_w, round(max(r.v[49]) FILTER (WHERE c = 'y') + 3, 5) AS last_ventral_y FROM r JOIN p ON p.label = r.label AND p.frame = r.frame GROUP BY vec_id"""


@query(_smooth_sql(7, 5))
def smoothed_poses(t):
    """FEA-12: skeletons, contour sides and widths with gaps filled, smoothed in time and along the body."""
    out = X.smooth_poses(_sided(_poses(t, gaps=True)), POSES, 7, 5)
    total = F.aggregate("widths", F.lit(0.0), lambda s, v: s + v)
    cols = {"first_x": F.element_at("skeleton", 1)["x"], "middle_y": F.element_at("skeleton", 25)["y"], "sum_w": total, "last_ventral_y": F.element_at("ventral", -1)["y"]}
    return out.select("vec_id", *(rounded(v, 4 if c == "sum_w" else 5).alias(c) for c, v in cols.items()))


_MOVED = _smooth_sql(7, 5, "lost OR frame % 9 = 4").replace(", 5) AS", ", 12) AS").replace(", 4) AS sum_w", ", 12) AS sum_w").replace("SELECT vec_id, round(max", "SELECT vec_id, any_value(p.label) AS label, round(max")


@query(f"WITH q AS ({_MOVED}) SELECT vec_id, round(first_x * (1 + label * 0.25) + label * 3, 3) AS first_x, round(middle_y * (1 + label * 0.25) - label, 3) AS middle_y, round(sum_w * (1 + label * 0.25), 2) AS sum_w FROM q")
def moved_pose_table(t):
    """FEA-13: poses in microns, moved by the stage, without those of a moving stage, smoothed."""
    p = _sided(_poses(t, gaps=True)).withColumnRenamed("label", "file_id")
    meta = p.select("file_id").distinct().withColumn("microns_per_pixel", 1 + F.col("file_id") * 0.25)
    stage = p.where("frame % 9 <> 4").select("file_id", "frame", (F.col("file_id") * 3.0).alias("stage_x"), (F.col("file_id") * -1.0).alias("stage_y"))
    out = X.smoothed_pose_table(p, meta, Track(("file_id",), ("frame",)), 7, stage)
    total = F.aggregate("widths", F.lit(0.0), lambda s, v: s + v)
    return out.select("vec_id", rounded(F.element_at("skeleton", 1)["x"], 3).alias("first_x"), rounded(F.element_at("skeleton", 25)["y"], 3).alias("middle_y"), rounded(total, 2).alias("sum_w"))


_SG = {d: {a: _fit(_matrix(7, d), 7).replace("v[", f"{a}[").replace("len(v)", f"len({a})").replace("THEN v", f"THEN {a}") for a in "xy"} for d in (1, 2)}


@query(f"WITH {_P}, d AS (SELECT vec_id, {_SG[1]['x']} AS a, {_SG[1]['y']} AS b, {_SG[2]['x']} AS c, {_SG[2]['y']} AS d FROM p), k AS (SELECT vec_id, list_transform(range(1, 50), lambda i: (a[i] * d[i] - b[i] * c[i]) / pow(a[i] ** 2 + b[i] ** 2, 1.5)) AS k FROM d) SELECT vec_id, " + ", ".join(f"round(k[{i + 1}], 8) AS curvature_{p}" for p, i in X.CURVATURE_POINTS.items()) + " FROM k")
def savgol_curvature(t):
    """SCA-10, UDF-5: curvature by another method, that of a filter's derivatives."""
    return _take(X.curvature(_poses(t), "savgol"), ["vec_id"], [f"curvature_{p}" for p in X.CURVATURE_POINTS], 8)


_RINGS = {"head": (1, 8), "tail": (42, 49), "body": (9, 41)}
_RING_AREA = "abs(list_sum(list_transform(range(1, len({0}x) + 1), lambda i: {0}x[i] * {0}y[i % len({0}x) + 1] - {0}x[i % len({0}x) + 1] * {0}y[i]))) / 2"


@query(f"WITH {_P}, r AS (SELECT vec_id, lost, list_transform(y, lambda z: abs(z) + 0.5) AS w, " + ", ".join(f"list_concat(x[{a}:{b}], list_reverse(x[{a}:{b}])) AS {n}x, list_concat(list_transform(y[{a}:{b}], lambda z: z + 3), list_reverse(list_transform(y[{a}:{b}], lambda z: z - 4))) AS {n}y" for n, (a, b) in _RINGS.items()) + " FROM p), "
       + "m AS (SELECT vec_id, lost, list_median(w[17:33]) AS mid, list_median(w[6:8]) AS head, list_median(w[42:44]) AS tail, " + ", ".join(f"{_RING_AREA.format(n)} AS {n}_area" for n in _RINGS) + " FROM r) SELECT vec_id, CASE WHEN NOT lost THEN mid / head > 2.25 OR mid / tail > 2.25 OR body_area / head_area > 6 OR body_area / tail_area > 6 END AS may_coil FROM m")
def coil_test(t):
    """SCA-29: poses whose widths or areas look like a coil's."""
    p = _sided(_poses(t, gaps=True)).withColumn("widths", F.transform("skeleton", lambda q: F.abs(q["y"]) + 0.5))
    return X.coil_test(p).select("vec_id", "may_coil")


@query(f"WITH {_P}, w AS (SELECT vec_id, frame, label, x FROM p) SELECT label AS file_id, frame::INT AS timestamp, vec_id, round(list_sum(x), 5) AS total FROM w")
def saved_series(t):
    """FEA-11: series saved by file and read back."""
    where = shared_folder(t.spark, "series")
    total = F.aggregate(F.transform("skeleton", lambda p: p["x"]), F.lit(0.0), lambda s, v: s + v)
    X.save_series(_poses(t).select(F.col("label").alias("file_id"), F.col("frame").cast("int").alias("timestamp"), "vec_id", rounded(total, 5).alias("total")), where)
    return t.spark.read.parquet(where).select("file_id", "timestamp", "vec_id", "total")


@query(f"WITH {_P} SELECT vec_id, " + ", ".join(f"round(list_avg({a}[{lo + 1}:{hi}]), 6) AS coord_{a}_{p}" for p, (lo, hi) in _COORDS.items() for a in "xy") + " FROM p")
def features_by_name(t):
    """UDF-6: a family of features by its name."""
    return _take(X.feature_family("coordinates")(_poses(t)), ["vec_id"], [f"coord_{a}_{p}" for p in _COORDS for a in "xy"])


def _even(x: str, y: str, s: str, n: int, of: str) -> str:
    """A list drawn anew at ``n`` equal steps of the arc length ``s``."""
    return f"list_transform(range({n}), lambda q: {_interp(f'({s}[len({s})] * q / {n - 1}::DOUBLE)', s, of)})"


def _arc(x: str, y: str) -> str:
    d = f"list_transform(range(1, len({x}) + 1), lambda i: CASE WHEN i = 1 THEN 0.0::DOUBLE ELSE sqrt(({x}[i] - {x}[i - 1]) ** 2 + ({y}[i] - {y}[i - 1]) ** 2) END)"
    return f"list_transform(range(1, len({x}) + 1), lambda j: list_sum(({d})[1:j]))"


#: Points of a side; few, since the SQL goes through them one by one.
_N = 80


def _way(name: str, a: str, b: str) -> str:
    """CTEs of one direction: normals of side ``a``, the places that they meet on side ``b``, and the line of middles."""
    step = lambda c: f"list_transform(range(1, {_N + 1}), lambda i: ({a}{c}[least(i + 1, {_N})] - {a}{c}[greatest(i - 1, 1)]) / (least(i + 1, {_N}) - greatest(i - 1, 1)))"
    to = lambda j, i, c: f"({b}{c}[least({j}, {_N - 1}) + 1] - {a}{c}[{i} + 1])"
    size = f"sqrt({to('j', 'e[1]', 'x')} ** 2 + {to('j', 'e[1]', 'y')} ** 2)"
    fit = f"CASE WHEN {size} < 1e-9 THEN 1.0::DOUBLE ELSE ({to('j', 'e[1]', 'x')} * nx[e[1] + 1] + {to('j', 'e[1]', 'y')} * ny[e[1] + 1]) * flip / {size} END"
    fits = f"list_transform(range(got[len(got)], got[len(got)] + {_N // 10 + 1}), lambda j: {fit})"
    return f"""{name}s AS (SELECT vec_id, {a}x, {a}y, {b}x, {b}y, {step('x')} AS sx, {step('y')} AS sy FROM u),
{name}n AS (SELECT *, list_transform(range(1, {_N + 1}), lambda i: -sy[i] / sqrt(sx[i] ** 2 + sy[i] ** 2)) AS nx, list_transform(range(1, {_N + 1}), lambda i: sx[i] / sqrt(sx[i] ** 2 + sy[i] ** 2)) AS ny FROM {name}s),
{name}f AS (SELECT *, CASE WHEN list_sum(list_transform(range(1, {_N + 1}), lambda i: ({b}x[i] - {a}x[i]) * nx[i] + ({b}y[i] - {a}y[i]) * ny[i])) < 0 THEN -1 ELSE 1 END AS flip FROM {name}n),
{name}m AS (SELECT *, list_reduce(list_prepend([0::BIGINT], list_transform(range({_N}), lambda i: [i])), lambda got, e: list_append(got, least({_N - 1}, got[len(got)] + list_position({fits}, list_max({fits})) - 1))) AS got FROM {name}f),
{name}p AS (SELECT vec_id, {a}x, {a}y, {b}x, {b}y, list_transform(range(1, {_N + 1}), lambda i: CASE WHEN i = {_N} THEN {_N} ELSE got[i + 1] + 1 END) AS at_ FROM {name}m),
{name}l AS (SELECT vec_id, list_transform(range(1, {_N + 1}), lambda i: ({a}x[i] + {b}x[at_[i]]) / 2) AS mx, list_transform(range(1, {_N + 1}), lambda i: ({a}y[i] + {b}y[at_[i]]) / 2) AS my, list_transform(range(1, {_N + 1}), lambda i: sqrt(({a}x[i] - {b}x[at_[i]]) ** 2 + ({a}y[i] - {b}y[at_[i]]) ** 2)) AS w FROM {name}p),
{name} AS (SELECT vec_id, {_even('mx', 'my', 's', 49, 'mx')} AS mx, {_even('mx', 'my', 's', 49, 'my')} AS my, {_even('mx', 'my', 's', 49, 'w')} AS w FROM (SELECT *, {_arc('mx', 'my')} AS s FROM {name}l))"""


_AROUND_IT = "list_transform(range(40), lambda i: list_sum(list_transform(range(7), lambda k: {w}[k + 1] * {c}[(i + k - 3 + 40) % 40 + 1])))"
_MIDDLE = "[" + ", ".join(repr(float(v)) for v in savgol_weights(7, 3)[3]) + "]"


@query(f"""WITH {_P}, a AS (SELECT *, {_arc('x', 'y')} AS s FROM p WHERE NOT lost), ev AS (SELECT vec_id, {_even('x', 'y', 's', 40, 'x')} AS ex, {_even('x', 'y', 's', 40, 'y')} AS ey FROM a), k AS (SELECT vec_id, {_AROUND_IT.format(w=_MIDDLE, c='ex')} AS sx, {_AROUND_IT.format(w=_MIDDLE, c='ey')} AS sy FROM ev)
SELECT p.vec_id, round(sx[1], 5) AS first_x, round(sy[20], 5) AS middle_y, round(list_sum(list_transform(range(1, 41), lambda i: sx[i] * sy[i % 40 + 1] - sx[i % 40 + 1] * sy[i])) / 2, 3) AS area FROM p LEFT JOIN k USING (vec_id)""")
def smoothed_polygons(t):
    """SCA-26: polygons drawn anew and smoothed around their whole length."""
    out = X.smoothed_polygons(_poses(t, gaps=True).select("vec_id", "skeleton"), "skeleton", 40, 7)
    nxt = F.concat(F.slice("skeleton", 2, 39), F.slice("skeleton", 1, 1))
    area = F.aggregate(F.zip_with("skeleton", nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v) / 2
    return out.select("vec_id", rounded(F.element_at("skeleton", 1)["x"], 5).alias("first_x"), rounded(F.element_at("skeleton", 20)["y"], 5).alias("middle_y"), rounded(area, 3).alias("area"))


_TOTAL = "round((list_sum(one.{0}) + list_sum(two.{0})) / 2, 3) AS {1}"


@query(f"""WITH {_P}, sides AS (SELECT vec_id, x, list_transform(y, lambda v: v + 3 + v * v / 50) AS y1, list_transform(y, lambda v: v - 4) AS y2 FROM p WHERE NOT lost), arcs AS (SELECT *, {_arc('x', 'y1')} AS s1, {_arc('x', 'y2')} AS s2 FROM sides),
u AS (SELECT vec_id, {_even('x', 'y1', 's1', _N, 'x')} AS lx, {_even('x', 'y1', 's1', _N, 'y1')} AS ly, {_even('x', 'y2', 's2', _N, 'x')} AS rx, {_even('x', 'y2', 's2', _N, 'y2')} AS ry FROM arcs),
{_way('one', 'l', 'r')}, {_way('two', 'r', 'l')}
SELECT p.vec_id, CASE WHEN NOT lost THEN 49 END AS n, {_TOTAL.format('mx', 'sum_x')}, {_TOTAL.format('my', 'sum_y')}, {_TOTAL.format('w', 'sum_w')} FROM p LEFT JOIN one ON one.vec_id = p.vec_id LEFT JOIN two ON two.vec_id = p.vec_id""")
def skeletons_from_sides(t):
    """SCA-32: middle lines and widths of poses from their sides alone, by normals that move towards the tail."""
    side = lambda f: F.transform("skeleton", lambda q: F.struct(q["x"].alias("x"), f(q["y"]).alias("y")))
    p = _poses(t, gaps=True).select("vec_id", side(lambda v: v + 3 + v * v / 50).alias("ventral"), side(lambda v: v - 4).alias("dorsal"))
    out = X.skeletons(p, points=_N)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    axis = lambda a: F.transform("skeleton", lambda q: q[a])
    return _rounded(out.select("vec_id", F.size("skeleton").alias("n"), total(axis("x")).alias("sum_x"), total(axis("y")).alias("sum_y"), total(F.col("widths")).alias("sum_w")), ["vec_id", "n"], 3)


# ---- series ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {FRAMES}, s AS (SELECT user_id, list(frame ORDER BY value DESC, frame) AS l FROM f GROUP BY user_id),
k AS (SELECT user_id, list_reduce(list_transform(l, lambda p: [p]), lambda a, b: CASE WHEN len(list_filter(a, lambda t: abs(t - b[1]) <= 6)) = 0 THEN list_concat(a, b) ELSE a END) AS taken FROM s)
SELECT event_id, list_contains(taken, frame) AS is_peak FROM f JOIN k USING (user_id)""")
def separated_peaks(t):
    """WIN-23: peaks, highest first, apart from all that are higher."""
    df = frames(t).select("user_id", "frame", "event_id", "value")
    return E.separated_peaks(df, TRACK, "value", 6).select("event_id", "is_peak")


_SHARES = ", ".join(f"count(*) FILTER (WHERE p >= {c}) / count(*) / (1 - {c}::DOUBLE) AS s{k}, count(*) FILTER (WHERE p > {c})::DOUBLE / count(*) AS o{k}" for k, c in enumerate(A.CUTS))
_LOW = "least(" + ", ".join(f"s{k}" for k in range(len(A.CUTS))) + ")"


@query(f"""WITH p AS (SELECT event_type, (value / 100) ** 2 AS p FROM events), c AS (SELECT event_type, count(*) AS m, {_SHARES} FROM p GROUP BY event_type), l AS (SELECT *, {_LOW} AS low FROM c),
e AS (SELECT event_type, unnest([{', '.join(f"o{k} * (1 - o{k}) / (m * (1 - {c}::DOUBLE) ** 2) + (o{k} / (1 - {c}::DOUBLE) - low) ** 2" for k, c in enumerate(A.CUTS))}]) AS err, unnest([{', '.join(f's{k}' for k in range(len(A.CUTS)))}]) AS s FROM l)
SELECT event_type, round(least(1.0, arg_min(s, err)), 6) AS pi0 FROM e GROUP BY event_type""")
def null_shares(t):
    """AGG-30: the share of true nulls by the estimate with the least error over resamples."""
    e = t("events").select("event_type", F.pow(F.col("value") / 100, F.lit(2)).alias("p"))
    return A.null_share(e, "p", ["event_type"], "bootstrap").select("event_type", rounded(F.col("pi0")).alias("pi0"))


_LONG = "quantile_cont({0}, 0.1) AS value_10th, quantile_cont({0}, 0.5) AS value_50th, quantile_cont({0}, 0.9) AS value_90th, quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25) AS value_IQR"


@query("WITH s AS (SELECT user_id, " + _LONG.format("value") + ", max(value) - min(value) AS span FROM events GROUP BY user_id) SELECT user_id, " + ", ".join(f"round(value_{q}, 6) AS value_{q}" for q in ("10th", "50th", "90th", "IQR")) + ", round(span, 6) AS value_span FROM s")
def extra_statistics(t):
    """UDF-3, SET-09: quantiles with a statistic of one's own, under names that must differ."""
    span = (F.max("value") - F.min("value")).alias("value_span")
    out = A.summarise(t("events").select("user_id", "value"), ["user_id"], ["value"], extra=[span])
    return _rounded(out, ["user_id"])


@query("WITH s AS (" + " UNION ALL ".join(f"SELECT o_custkey AS id, '{f}' AS feature, {_LONG.format(c)} FROM orders GROUP BY o_custkey" for f, c in (("price", "o_totalprice"), ("key", "o_orderkey"))) + f" UNION ALL SELECT l_suppkey, 'quantity', {_LONG.format('l_quantity')} FROM lineitem GROUP BY l_suppkey) SELECT id, feature, " + ", ".join(f"round(value_{q}, 4) AS value_{q}" for q in ("10th", "50th", "90th", "IQR")) + " FROM s")
def concatenated_summaries(t):
    """SET-02: feature vectors of two tables as one."""
    o = A.summarise_long(t("orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("key")), ["id"], ["price", "key"])
    li = A.summarise_long(t("lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_quantity").alias("quantity")), ["id"], ["quantity"])
    return _rounded(o.unionByName(li), ["id", "feature"], 4)


_BODY = "[1, 2, 3, 5, 9, 9, 5, 4, 6, 2]"


def _side(name: str, rows: str) -> str:
    """Medians by position of the rows next to each block, and whether they speak against its reversal."""
    return (f"{name}_m AS (SELECT k.label, k.a, k.b, pos, median(c.p[pos]) AS v, count(*) AS n FROM k JOIN c ON c.label = k.label AND {rows}, range(1, 11) r(pos) GROUP BY ALL), "
            f"{name} AS (SELECT label, a, b, list(v ORDER BY pos) AS v, max(n) AS n FROM {name}_m GROUP BY ALL)")  # fmt: skip


_AGAINST = "coalesce({0}.n >= 5 AND list_sum(list_transform(range(1, 11), lambda i: abs(inner_.v[11 - i] - {0}.v[i]))) > list_sum(list_transform(range(1, 11), lambda i: abs(inner_.v[i] - {0}.v[i]))), false)"


@query(f"""WITH {_P}, f AS (SELECT vec_id, label, frame, CASE WHEN (frame - 1) // 9 % 3 = 1 THEN list_reverse(l) ELSE l END AS l FROM (SELECT p.vec_id, p.label, p.frame, CASE WHEN NOT lost THEN list_transform(range(1, 11), lambda i: {_BODY}[i] + 6::DOUBLE * embedding[i]::DOUBLE) END AS l FROM p JOIN embeddings USING (vec_id))),
c AS (SELECT label, frame, row_number() OVER (PARTITION BY label ORDER BY frame) AS g, list_transform(l, lambda x: x - list_median(l)) AS p FROM f WHERE l IS NOT NULL),
md AS (SELECT label, list(v ORDER BY pos) AS m FROM (SELECT label, pos, median(p[pos]) AS v FROM c, range(1, 11) r(pos) GROUP BY ALL) GROUP BY label),
sc AS (SELECT c.label, g, list_avg(list_transform(range(1, 11), lambda i: abs(p[11 - i] - m[i]))) - list_avg(list_transform(range(1, 11), lambda i: abs(p[i] - m[i]))) < 0 AS neg FROM c JOIN md USING (label)),
bl AS (SELECT label, min(g) AS a, max(g) + 1 AS b FROM (SELECT *, g - row_number() OVER (PARTITION BY label, neg ORDER BY g) AS run FROM sc) WHERE neg GROUP BY label, run HAVING count(*) >= 3),
k AS (SELECT *, coalesce(lag(b) OVER w, 1) AS before, coalesce(lead(a) OVER w, (SELECT max(g) + 1 FROM c WHERE c.label = bl.label)) AS after FROM bl WINDOW w AS (PARTITION BY label ORDER BY a)),
{_side('inner_', 'c.g >= k.a AND c.g < k.b')}, {_side('left_', 'c.g >= greatest(k.a - 10, k.before) AND c.g < k.a')}, {_side('right_', 'c.g >= k.b AND c.g < least(k.b + 10, k.after)')},
ok AS (SELECT inner_.label, inner_.a, inner_.b FROM inner_ LEFT JOIN left_ USING (label, a, b) LEFT JOIN right_ USING (label, a, b) WHERE NOT {_AGAINST.format('left_')} AND NOT {_AGAINST.format('right_')}),
fr AS (SELECT ok.label, x.frame AS first, y.frame AS last FROM ok JOIN c x ON x.label = ok.label AND x.g = ok.a JOIN c y ON y.label = ok.label AND y.g = ok.b - 1)
SELECT vec_id, EXISTS (SELECT 1 FROM fr WHERE fr.label = f.label AND f.frame BETWEEN fr.first AND fr.last) AS is_switched FROM f""")
def orientation_by_intensity(t):
    """TRK-10: blocks of reversed profiles that what lies next to them confirms."""
    base = F.array(*(F.lit(float(v)) for v in (1, 2, 3, 5, 9, 9, 5, 4, 6, 2)))
    e = t("embeddings").withColumn("frame", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    own = F.zip_with(base, F.slice("embedding", 1, 10), lambda a, b: a + 6.0 * b.cast("double"))
    own = F.when(F.floor((F.col("frame") - 1) / 9) % 3 == 1, F.reverse(own)).otherwise(own)
    rows = e.select("vec_id", "label", "frame", F.when(F.col("vec_id") % 11 != 3, own).alias("profile"))
    return K.orient_by_intensity(rows, POSES, "profile", 3).select("vec_id", "is_switched")


_GROW = "list_reduce(list_prepend([l, r], [[0::BIGINT], [0], [0], [0], [0], [0]]), lambda s, e: CASE WHEN s[1] < 0 OR s[2] >= len(chg) OR chg[s[2] + 1] - chg[s[1] + 1] + 2 >= 5 THEN s WHEN i - chg[s[1] + 1] < chg[s[2] + 1] + 1 - i THEN [s[1] - 1, s[2]] ELSE [s[1], s[2] + 1] END)"
_POWER = "list_transform(range(33), lambda k: sqrt(list_sum(list_transform(range(len(v)), lambda j: v[j + 1] * cos(2 * pi() * k * j / 64))) ** 2 + list_sum(list_transform(range(len(v)), lambda j: v[j + 1] * sin(2 * pi() * k * j / 64))) ** 2))"
_TROUGHS = "list_filter(range(33), lambda k: (k = 0 OR z[k + 1] < z[k]) AND (k = 32 OR z[k + 1] < z[k + 2]))"


@query(f"""WITH {FRAMES}, u AS (SELECT user_id, list(value - 50 ORDER BY frame) AS x FROM f GROUP BY user_id),
c AS (SELECT *, list_filter(range(len(x) - 1), lambda k: sign(x[k + 1]) <> sign(x[k + 2])) AS chg FROM u),
w AS (SELECT event_id, frame - 1 AS i, x, chg, len(list_filter(chg, lambda k: k < frame - 1)) AS r, r - 1 AS l FROM f JOIN c USING (user_id)),
g AS (SELECT event_id, i, x, chg, {_GROW} AS s FROM w WHERE l >= 0 AND r < len(chg)),
h AS (SELECT event_id, i, x, greatest(i - chg[s[1] + 1], chg[s[2] + 1] + 1 - i) AS half FROM g WHERE s[1] >= 0 AND s[2] < len(chg)),
v AS (SELECT event_id, x[i - half + 1:i + half + 1] AS v FROM h WHERE half <= 25 AND i - half >= 0 AND i + half < len(x)),
z AS (SELECT event_id, v, {_POWER} AS z FROM v), p AS (SELECT *, list_position(z, list_max(z)) - 1 AS top, list_transform(list_sort(list_transform({_TROUGHS}, lambda k: {{'h': z[k + 1], 'k': k}})), lambda t: [t.k]) AS low FROM z),
q AS (SELECT *, list_reduce(low, lambda a, b: CASE WHEN len(list_filter(a, lambda t: abs(t - b[1]) <= round(sqrt(len(v))))) = 0 THEN list_concat(a, b) ELSE a END) AS kept FROM p WHERE top BETWEEN 1 AND 15 AND len(low) > 0),
e AS (SELECT *, list_min(list_filter(kept, lambda t: t < top)) AS a, list_min(list_filter(kept, lambda t: t > top)) AS b FROM q),
o AS (SELECT event_id, sign(list_avg(v)) AS side, top, 2 * z[top + 1] / len(v) AS amp FROM e WHERE a IS NOT NULL AND b IS NOT NULL AND greatest(z[a + 1], z[b + 1]) <= 0.5 * z[top + 1] AND list_sum(list_transform(z[a + 1:b], lambda y: y * y)) >= 0.5 * list_sum(list_transform(z, lambda y: y * y)))
SELECT f.event_id, round(amp * side, 5) AS amplitude, round(25 / 2::DOUBLE / 31 * top * side, 6) AS frequency FROM f LEFT JOIN o USING (event_id)""")
def crawling_bends(t):
    """WIN-29, EVT-14: waves in windows that zero crossings bound, by peaks between low troughs of their spectra."""
    df = frames(t).select("user_id", "frame", "event_id", (F.col("value") - 50).alias("bend"))
    out = E.crawling_bends(df, TRACK, "bend", 25.0, "bend", seconds=(0.2, 1.0), samples=64)
    return out.select("event_id", rounded(F.col("bend_amplitude"), 5).alias("amplitude"), rounded(F.col("bend_frequency"), 6).alias("frequency"))


# ---- files of images ------------------------------------------------------------------------------------------------

_TIFF = "49492A0008000000" + "0800" + "".join(f"{tag:04X}"[2:] + f"{tag:04X}"[:2] + f"{kind:02X}00" + "01000000" + "".join(f"{v:08X}"[i : i + 2] for i in (6, 4, 2, 0)) for tag, kind, v in ((256, 4, 8), (257, 4, 8), (258, 3, 8), (259, 3, 1), (273, 4, 110), (277, 3, 1), (278, 4, 8), (279, 4, 64))) + "00000000"
_PX = "i AS (SELECT vec_id, list_transform(embedding, lambda x: least(255, greatest(0, floor(128 + x::DOUBLE * 200)))::INT) AS px FROM embeddings)"


@query(f"""WITH {_PX}, k AS (SELECT *, CASE vec_id % 3 WHEN 0 THEN 'pgm' WHEN 1 THEN 'tif' ELSE 'dat' END AS kind FROM i)
SELECT '/in/frame_' || vec_id || '.' || kind AS path, vec_id % 17 > 0 AS is_good, CASE WHEN vec_id % 17 > 0 THEN row_number() OVER (ORDER BY vec_id) - 1 END AS frame_number,
       CASE WHEN vec_id % 17 > 0 THEN array_to_string(list_transform(px, lambda v: CASE kind WHEN 'dat' THEN printf('%02X%02X', v * 16 % 256, v // 16) ELSE printf('%02X', v) END), '') END AS pixels FROM k""")
def image_files(t):
    """SRC-10, SRC-11, SRC-12, SRC-13: images of three kinds read from their bytes, in order of the numbers in their names;
    cut files are told apart."""
    e = t("embeddings")
    e = e.withColumn("px", F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + x.cast("double") * 200))).cast("int")))
    two = lambda v: F.lpad(F.hex(v), 2, "0")
    plain = F.array_join(F.transform("px", two), "")
    # Twelve bits a pixel, rows from below and pixels from the right, three bytes for two pixels; the size is at the end.
    at = lambda k, back: F.element_at("px", (8 * (7 - F.floor(k / 4)) + 7 - 2 * (k % 4) - back + 1).cast("int"))
    packed = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.concat(two(at(k, 0)), F.lit("00"), two(at(k, 1)))), "")
    size = "00" * 28 + "0800" + "0800" + "00" * 8
    body = F.when(F.col("vec_id") % 3 == 0, F.concat(F.hex(F.lit("P5\n8 8\n255\n")), plain)).when(F.col("vec_id") % 3 == 1, F.concat(F.lit(_TIFF), plain)).otherwise(F.concat(packed, F.lit(size)))
    cut = F.when(F.col("vec_id") % 17 == 0, F.substring(body, 1, 60)).otherwise(body)
    kind = F.when(F.col("vec_id") % 3 == 0, "pgm").when(F.col("vec_id") % 3 == 1, "tif").otherwise("dat")
    files = e.select(F.concat(F.lit("/in/frame_"), F.col("vec_id").cast("string"), F.lit("."), kind).alias("path"), F.unhex(cut).alias("content"))
    made = I.numbered(I.decoded(files))
    good = F.col("error").isNull()
    return made.join(I.readable(made), "path").select("path", "is_good", F.when(good, F.col("frame_number")).cast("bigint").alias("frame_number"), F.hex("pixels").alias("pixels"))
