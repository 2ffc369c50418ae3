"""Registered queries of selection, positional joins, the legacy route, images and streams."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import geometry as G
from trackloom.functions.timeseries import Track
from trackloom.operators import features as X
from trackloom.operators import images as P
from trackloom.operators import joins as J
from trackloom.operators import legacy as Y
from trackloom.operators import levels as V
from trackloom.operators import selection as L
from trackloom.operators import summary as A
from trackloom.operators import tracking as K
from trackloom.plans.registry import FRAMES, ORACLE, frames, query, rounded
from trackloom.plans.route_queries import _D, _P, BY_FRAME, TRACK, _poses, _rounded, _take, _tracks
from trackloom.sources import ingest
from trackloom.sources.export import shared_folder
from trackloom.streaming import stream as T

# ---- selection ------------------------------------------------------------------------------------------------------


@query(f"WITH {_D} SELECT row_id FROM d WHERE worm_label IN (1, 2) AND row_id % 4 > 0")
def labelled_animals(t):
    """SEL-06: rows labelled as animals that have a pose."""
    d = _tracks(t).withColumn("skeleton_id", F.when(F.col("row_id") % 4 > 0, F.col("row_id")).otherwise(-1))
    return L.labelled_animals(d).select("row_id")


@query(f"WITH {_D} SELECT file_id, worm_index_blob AS track FROM d WHERE worm_label = 1 AND row_id % 3 > 0 GROUP BY ALL HAVING sum((row_id % 2 = 0)::INT) > 2")
def good_tracks(t):
    """SEL-08: tracks of hand-labelled rows with enough good poses."""
    d = _tracks(t).withColumns({"is_good_skel": (F.col("row_id") % 3 > 0).cast("int"), "has_skeleton": F.col("row_id") % 2 == 0, "worm_index_manual": F.col("worm_index_blob")})
    return L.good_tracks(d, 2, by_hand=True)


@query("SELECT event_id, value FROM events WHERE user_id > 0 AND user_id % 3 > 0")
def joined_detections(t):
    """SEL-10: columns of the rows that belong to a joined track."""
    e = t("events").withColumn("worm_index_joined", F.when(F.col("user_id") % 3 > 0, F.col("user_id")).otherwise(-1))
    return L.joined_detections(e, ["event_id", "value"])


@query("WITH c AS (SELECT *, avg(s_acctbal / 100) OVER (PARTITION BY s_nationkey) * 0.5 AS room FROM supplier) SELECT s_suppkey FROM c WHERE s_suppkey * 7 % 400 - room >= 0 AND s_suppkey * 7 % 400 + room < 400 AND s_suppkey * 3 % 300 - room >= 0 AND s_suppkey * 3 % 300 + room < 300")
def whole_circles(t):
    """SEL-22: circles that the image's border does not cut."""
    s = t("supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") * 7 % 400).alias("x"), (F.col("s_suppkey") * 3 % 300).alias("y"), (F.col("s_acctbal") / 100).alias("r"), F.lit(300).alias("h"), F.lit(400).alias("w"))
    return L.whole_circles(s, ["s_nationkey"], "h", "w").select("s_suppkey")


@query(f"WITH {FRAMES} SELECT event_id FROM f WHERE frame < 10")
def first_frames(t):
    """SRT-09; the limit is the feature."""
    return L.first_frames(frames(t), 10, "frame").select("event_id")


@query("SELECT p_brand, p_partkey, place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS place FROM part) WHERE place <= 2")
def largest_regions(t):
    """SRT-08: the two largest of each group; the limit is the feature."""
    return L.largest(t("part"), ["p_brand"], "p_size", "p_partkey").select("p_brand", "p_partkey", "place")


@query("WITH a AS (SELECT user_id, round_even((value / 50 - 1) * 12, 0)::BIGINT AS bin, value - 50 AS d FROM events) SELECT user_id, bin, round(arg_min(d, (abs(d), d)), 6) AS d FROM a GROUP BY ALL")
def nearest_in_angle_bins(t):
    """SRT-07: of each angle bin the distance of least size."""
    e = t("events").select("user_id", ((F.col("value") / 50 - 1) * math.pi).alias("angle"), (F.col("value") - 50).alias("d"))
    return L.nearest_to_zero(e, ["user_id"], "angle", "d", 12).select("user_id", "bin", rounded(F.col("d")).alias("d"))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS speed, l_partkey AS length FROM lineitem")
def column_lists(t):
    """SEL-04, SEL-05, SEL-16, SEL-21, SET-04, SET-05: columns of a wide table that are paired, in no section that is left
    out, named by one list and not by another."""
    names = {"l_quantity": "speed", "l_extendedprice": "d_speed", "l_partkey": "length", "l_suppkey": "d_length", "l_tax": "area", "l_discount": "quirkiness"}
    wide = t("lineitem").select("l_orderkey", "l_linenumber", *(F.col(c).alias(n) for c, n in names.items()))
    # Derivatives that are there already go; the quirkiness is posture; the area is not wanted.
    features = [c for c in wide.columns if not c.startswith("l_")]
    kept = L.paired_derivatives(features)
    kept = L.select_features(L.without_sections(kept, ["posture"]), include="speed, length", exclude="area")
    return wide.select("l_orderkey", "l_linenumber", *L.present(wide, kept))


# ---- joins by position, small aggregates ----------------------------------------------------------------------------


@query("WITH a AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY s_suppkey) AS k FROM (SELECT s_nationkey AS n, s_suppkey FROM supplier)), b AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY c_custkey) AS k FROM (SELECT c_nationkey AS n, c_custkey FROM customer)) SELECT coalesce(a.n, b.n) AS n, s_suppkey, c_custkey FROM a FULL JOIN b ON a.n = b.n AND a.k = b.k")
def positional_join(t):
    """JOI-01, JOI-16: rows of two tables by their place in a group."""
    a = t("supplier").select(F.col("s_nationkey").alias("n"), "s_suppkey")
    b = t("customer").select(F.col("c_nationkey").alias("n"), "c_custkey")
    return J.by_position(a, b, ["n"], ["s_suppkey"], ["c_custkey"])


@query(f"WITH {_D}, x AS (SELECT worm_index_blob AS w, unnest(generate_series(min(frame_number), max(frame_number))) AS f FROM d GROUP BY 1) SELECT w AS worm_index_blob, count(*) AS n_rows, count(area) AS n_known, round(sum(area), 4) AS area FROM x LEFT JOIN d ON d.worm_index_blob = x.w AND d.frame_number = x.f GROUP BY w")
def filled_shapes(t):
    """JOI-02, JOI-17, SRT-02: shapes by old row id on tracks with their dropped frames filled."""
    d = _tracks(t)
    dense = J.dense_fill(d.select("worm_index_blob", "frame_number", F.col("row_id").alias("old_row")), ["worm_index_blob"], "frame_number")
    out = J.with_shapes(dense, d.select("worm_index_blob", "row_id", "area"), ["worm_index_blob"], "row_id", "old_row")
    return out.groupBy("worm_index_blob").agg(F.count("*").alias("n_rows"), F.count("area").alias("n_known"), rounded(F.sum("area"), 4).alias("area"))


@query(f"WITH {_D} SELECT row_id, CASE WHEN row_id % 3 = 0 THEN row_id * 2 END AS id FROM d")
def row_order(t):
    """SRT-02: assignments put back to their rows."""
    d = _tracks(t).select("file_id", "row_id")
    made = d.where("row_id % 3 = 0").select("file_id", "row_id", (F.col("row_id") * 2).alias("id"))
    return J.in_row_order(made, d, ["file_id"], "row_id").select("row_id", "id")


@query(f"WITH {_D} SELECT file_id, sum(n)::BIGINT AS n_rows FROM (SELECT file_id, max(frame_number) - min(frame_number) + 1 AS n FROM d GROUP BY file_id, worm_index_blob HAVING count(*) >= 55) GROUP BY file_id")
def track_lengths(t):
    """AGG-21: frames spanned by long tracks, summed."""
    return A.track_lengths(_tracks(t), ["file_id"], "worm_index_blob", min_rows=55).select("file_id", F.col("n_rows").cast("bigint").alias("n_rows"))


@query(f"WITH {FRAMES} SELECT event_type, round_even(frame / 5.0, 0)::BIGINT AS bin, round(median(value), 6) AS value FROM f GROUP BY ALL")
def binned_medians(t):
    """AGG-25: medians by time bin over all animals."""
    out = A.binned_medians(frames(t), ["event_type"], "frame", "value", 5.0)
    return out.select("event_type", "bin", rounded(F.col("value")).alias("value"))


@query("SELECT event_type, round(quantile_cont(value, 0.02), 6) AS low, round(quantile_cont(value, 0.98), 6) AS high FROM events GROUP BY event_type")
def colour_limits(t):
    """AGG-27: robust limits."""
    return _rounded(A.colour_limits(t("events"), ["event_type"], "value"), ["event_type"])


@query("WITH p AS (SELECT event_type, event_id, value / 100 AS p FROM events), s AS (SELECT event_type, least(1.0, count(*) FILTER (WHERE p > 0.5) / count(*)::DOUBLE / 0.5) AS pi0 FROM p GROUP BY event_type), r AS (SELECT p.*, pi0, count(*) OVER (PARTITION BY event_type) AS n, rank() OVER (PARTITION BY event_type ORDER BY p DESC) AS r FROM p JOIN s USING (event_type)), q AS (SELECT *, least(pi0 * p * n / (n - r + 1), 1.0) AS q FROM r) SELECT event_id, round(min(q) OVER (PARTITION BY event_type ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS q_value FROM q")
def q_values_by_group(t):
    """AGG-30: q-values with an estimated share of true null hypotheses."""
    e = t("events").select("event_type", "event_id", (F.col("value") / 100).alias("p"))
    e = e.join(J.small(A.null_share(e, "p", ["event_type"])), "event_type")
    return A.q_values(e, "p", "pi0", ["event_type"]).select("event_id", rounded(F.col("q_value")).alias("q_value"))


# ---- legacy route ---------------------------------------------------------------------------------------------------


@query(f"WITH {_P}, q AS (SELECT *, list_concat(x, list_reverse(x)) AS px, list_concat(list_transform(y, lambda z: z + 3), list_reverse(list_transform(y, lambda z: z - 4))) AS py, list_transform(y, lambda z: abs(z) + 1) AS w, list_sum(list_transform(range(1, 49), lambda i: sqrt((x[i + 1] - x[i]) ** 2 + (y[i + 1] - y[i]) ** 2))) AS len FROM p), "
       "a AS (SELECT *, abs(list_sum(list_transform(range(1, 98), lambda i: px[i] * py[i + 1] - px[i + 1] * py[i]))) / 2 AS area FROM q) SELECT vec_id, round(list_avg(w[1:8]), 6) AS width_head, round(list_avg(w[17:33]), 6) AS width_midbody, round(list_avg(w[42:49]), 6) AS width_tail, round(area / len, 6) AS area_per_length, round(list_avg(w[17:33]) / len, 6) AS width_per_length FROM a")  # fmt: skip
def legacy_morphology(t):
    """FEA-16, SEL-19: mean widths of parts, and ratios to length."""
    side = lambda d: F.transform("skeleton", lambda q: F.struct(q["x"].alias("x"), (q["y"] + d).alias("y")))
    p = _poses(t).withColumns({"ventral": side(3), "dorsal": side(-4), "widths": F.transform("skeleton", lambda q: F.abs(q["y"]) + 1)})
    return _take(Y.morphology(p), ["vec_id"], ["width_head", "width_midbody", "width_tail", "area_per_length", "width_per_length"])


_PARTS = {k: (a + 1, b) for k, (a, b) in G.PARTS.items()}
@query(f"WITH {_P} SELECT vec_id, " + ", ".join(f"round(degrees(atan2(list_avg(y[{_PARTS[a][0]}:{_PARTS[a][1]}]) - list_avg(y[{_PARTS[b][0]}:{_PARTS[b][1]}]), list_avg(x[{_PARTS[a][0]}:{_PARTS[a][1]}]) - list_avg(x[{_PARTS[b][0]}:{_PARTS[b][1]}]))), 6) AS direction_{k}" for k, (a, b) in Y.DIRECTIONS.items()) + " FROM p")
def legacy_directions(t):
    """SCA-19: directions of body, head and tail."""
    return _rounded(_poses(t).select("vec_id", *(c.alias(k) for k, c in Y.directions(F.col("skeleton")).items())), ["vec_id"])


_BASIS = G.cosine_basis(48, 6)
@query(f"WITH {_P}, a AS (SELECT *, list_transform(range(1, 49), lambda i: atan2(y[i + 1] - y[i], x[i + 1] - x[i])) AS a FROM p), c AS (SELECT vec_id, list_transform(a, lambda z: z - list_avg(a)) AS c FROM a) SELECT vec_id, " + ", ".join(f"round(-list_dot_product(c, {row!r}::DOUBLE[]), 6) AS eigen_projection_{k + 1}" for k, row in enumerate(_BASIS)) + " FROM c")
def legacy_projections(t):
    """SCA-08: six projections, signed by the ventral side."""
    return _take(Y.eigen_projections(_poses(t), side=F.lit("anticlockwise")), ["vec_id"], [f"eigen_projection_{k}" for k in range(1, 7)])


@query(f"WITH {_P}, c AS (SELECT vec_id, list_transform(range(1, 49), lambda i: sqrt((x[i + 1] - x[i]) ** 2 + (y[i + 1] - y[i]) ** 2)) AS s, x, y FROM p) SELECT vec_id, round(list_sum(s[1:24]), 6) AS middle, round(list_sum(s), 6) AS whole, round(list_avg(x), 6) AS coord_x, round(list_avg(y) - 0.5, 6) AS coord_y FROM c")
def legacy_coordinates(t):
    """SCA-23, SCA-33: arc lengths along a pose, and the centre of its contour."""
    side = lambda d: F.transform("skeleton", lambda q: F.struct(q["x"].alias("x"), (q["y"] + d).alias("y")))
    p = Y.coordinates(_poses(t).withColumns({"ventral": side(3), "dorsal": side(-4)})).withColumn("c", Y.chain_lengths(F.col("skeleton")))
    return _rounded(p.select("vec_id", F.element_at("c", 25).alias("middle"), F.element_at("c", 49).alias("whole"), "coord_x", "coord_y"), ["vec_id"])


@query(f"""WITH {FRAMES}, a AS (SELECT *, value - 50 AS speed, value * 3.5 - 175 AS dir, frame - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM f),
d AS (SELECT *, lead(dir, 4) OVER w - dir AS c, CASE WHEN pos >= 2 AND pos < n - 4 THEN (abs(speed) + lead(abs(speed), 4) OVER w) / 2 * 0.5 END AS dist FROM a WINDOW w AS ({BY_FRAME}))
SELECT event_id, round((CASE WHEN c >= 180 THEN c - 360 WHEN c <= -180 THEN c + 360 ELSE c END) / CASE WHEN dist >= 1 THEN dist END * pi() / 180, 6) AS path_curvature FROM d""")
def legacy_path_curvature(t):
    """SCA-21: change of motion direction over distance."""
    e = frames(t).withColumns({"speed": F.col("value") - 50, "dir": F.col("value") * 3.5 - 175})
    return Y.path_curvature(e, TRACK, "speed", "dir", 10.0).select("event_id", rounded(F.col("path_curvature")).alias("path_curvature"))


_W = [math.exp(-0.5 * (2.5 * k / 2) ** 2) / 2 for k in range(-2, 3)]
@query(f"""WITH {FRAMES}, a AS (SELECT *, degrees(sin(frame / 3.0 + user_id) * 2 - value / 100) AS b FROM f), w AS (SELECT *, CASE WHEN b > 180 THEN b - 360 WHEN b < -180 THEN b + 360 ELSE b END AS c FROM a),
s AS (SELECT *, {' + '.join(f"{w!r}::DOUBLE * {'c' if k == 2 else ('lead' if k > 2 else 'lag') + f'(c, {abs(k - 2)}) OVER ({BY_FRAME})'}" for k, w in enumerate(_W))} AS z FROM w),
g AS (SELECT *, sum(CASE WHEN frame > 1 AND sign(z) IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER ({BY_FRAME}) AS k FROM (SELECT *, lag(sign(z)) OVER ({BY_FRAME}) AS p FROM s)),
v AS (SELECT *, CASE WHEN z IS NOT NULL THEN (lead(z) OVER ({BY_FRAME}) - lag(z) OVER ({BY_FRAME})) * 10.0 / 2 END AS speed, CASE WHEN z >= 0 THEN max(z) OVER (PARTITION BY user_id, k) ELSE min(z) OVER (PARTITION BY user_id, k) END AS amp FROM g)
SELECT event_id, round(CASE WHEN speed IS NOT NULL THEN amp END, 5) AS foraging_amplitude, round(speed, 4) AS foraging_speed FROM v""")
def foraging(t):
    """EVT-15: smoothed bends of the nose, their extremum per stretch and their speed."""
    e = frames(t).withColumns({"nose": F.sin(F.col("frame") / 3.0 + F.col("user_id")) * 2, "neck": F.col("value") / 100})
    out = Y.foraging(e, TRACK, "nose", "neck", 10.0, 2)
    return out.select("event_id", rounded(F.col("foraging_amplitude"), 5).alias("foraging_amplitude"), rounded(F.col("foraging_speed"), 4).alias("foraging_speed"))


@query(f"""WITH {FRAMES}, s AS (SELECT *, (event_id // 2 % 3 - 1)::INT AS sgn FROM f), g AS (SELECT *, frame - row_number() OVER (PARTITION BY user_id, sgn ORDER BY frame) AS k FROM s),
r AS (SELECT user_id, min(frame) AS start, max(frame) AS "end", sum(value) AS distance, any_value(sgn) = -1 AS is_ventral FROM g WHERE sgn <> 0 GROUP BY user_id, sgn, k), b AS (SELECT user_id, min(frame) AS a, max(frame) AS b FROM f GROUP BY user_id)
SELECT user_id, start, "end", round(("end" - start + 1) / 10.0, 6) AS event_duration, round((lead(start) OVER (PARTITION BY user_id ORDER BY start) - "end" - 1) / 10.0, 6) AS inter_duration, round(distance, 4) AS distance, start <= a OR "end" >= b AS is_partial, is_ventral FROM r JOIN b USING (user_id)""")
def signed_turns(t):
    """EVT-11: ventral and dorsal turns of signed frames, as one event list."""
    e = frames(t).withColumn("sgn", (F.pmod(F.floor(F.col("event_id") / 2), F.lit(3)) - 1).cast("int"))
    out = Y.signed_turns(e, TRACK, "sgn", "frame", 10.0, "value")
    return out.select("user_id", *(F.col(c).cast("bigint").alias(c) for c in ("start", "end")), *(rounded(F.col(c), n).alias(c) for c, n in (("event_duration", 6), ("inter_duration", 6), ("distance", 4))), "is_partial", "is_ventral")


def _mean_sql() -> str:
    out = []
    for state, code in Y.MOTIONS.items():
        for sign, (x, cond) in {"": ("x", ""), "abs": ("abs(x)", ""), "pos": ("x", "x > 0"), "neg": ("x", "x < 0")}.items():
            where = " AND ".join(c for c in ("" if code is None else f"m = {code}", cond) if c)
            name = "_".join(p for p in ("speed", state, sign) if p)
            out.append(f"round(avg({x}){f' FILTER (WHERE {where})' if where else ''}, 9) AS {name}")
    return f"WITH {FRAMES}, s AS (SELECT user_id % 4 AS plate, value - 50 AS x, value AS l, (event_id // 3 % 3 - 1)::INT AS m FROM f), g AS (SELECT plate, {', '.join(out)}, round(avg(l), 9) AS length, {', '.join(f'round(avg(l) FILTER (WHERE m = {c}), 9) AS length_{n}' for n, c in Y.MOTIONS.items() if n)} FROM s GROUP BY plate), e AS (SELECT user_id % 4 AS plate, round(avg(value) FILTER (WHERE event_type = 'click'), 9) AS click, round(avg(value) FILTER (WHERE event_type = 'view'), 9) AS view FROM events GROUP BY 1) SELECT * FROM g LEFT JOIN e USING (plate)"


@query(_mean_sql())
def mean_summary(t):
    """AGG-18, AGG-15, FEA-17: means by motion and sign, with those of event features."""
    s = frames(t).select((F.col("user_id") % 4).alias("plate"), (F.col("value") - 50).alias("speed"), F.col("value").alias("length"), (F.pmod(F.floor(F.col("event_id") / 3), F.lit(3)) - 1).cast("int").alias("motion_modes"))
    events = t("events").select((F.col("user_id") % 4).alias("plate"), F.col("event_type").alias("feature"), "value")
    return _rounded(Y.mean_summary(s, ["plate"], {"speed": True, "length": False}, events=events, event_features={"click": False, "view": False}), ["plate"], 9)


@query(f"WITH {_P} SELECT vec_id, round(list_sum(x), 4) AS sum_x, round(list_sum(list_transform(y, lambda z: z + 3)), 4) AS sum_ventral_y, 98 AS n_widths FROM p")
def normal_form(t):
    """FEA-18, FEA-19, SNK-12: poses as arrays of coordinates and back."""
    side = lambda d: F.transform("skeleton", lambda q: F.struct(q["x"].alias("x"), (q["y"] + d).alias("y")))
    p = Y.normal_form(_poses(t).withColumns({"ventral": side(3), "dorsal": side(-4), "widths": F.transform("skeleton", lambda q: F.abs(q["y"]) + 1)}))
    p = p.withColumn("skeleton", Y.from_arrays(F.col("x"), F.col("y")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    blank = Y.missing_poses(p.select("vec_id"))
    p = p.join(blank.select("vec_id", F.col("widths").alias("none")), "vec_id")
    return p.select("vec_id", rounded(total(F.transform("skeleton", lambda q: q["x"])), 4).alias("sum_x"), rounded(total(F.col("ventral_y")), 4).alias("sum_ventral_y"), (F.size("widths") + F.when(F.col("none").isNull(), 49).otherwise(0)).alias("n_widths"))


# ---- blobs and images -----------------------------------------------------------------------------------------------


def _blob_sql() -> str:
    q = lambda x, p, cond: f"quantile_cont({x}, {p}){cond}"
    rows = []
    for v in V.variants(["blob_area", "d_blob_area", "motion_mode"]):
        cond = "" if v.label is None else f" FILTER (WHERE motion_mode = {v.label[1]})"
        rows += [f"{{'k': '{v.name}_{n}', 'v': {q(v.feature, p, cond)}}}" for n, p in (("10th", 0.1), ("50th", 0.5), ("90th", 0.9))]
        rows.append(f"{{'k': '{v.name}_IQR', 'v': {q(v.feature, 0.75, cond)} - {q(v.feature, 0.25, cond)}}}")
    return f"WITH {FRAMES}, b AS (SELECT user_id % 4 AS plate, user_id, frame, value * 2 AS blob_area, (event_id // 3 % 3 - 1)::INT AS motion_mode, (lead(value * 2, 1) OVER w - lag(value * 2, 1) OVER w) / (2 / 6.0::DOUBLE) AS d_blob_area FROM f WINDOW w AS ({BY_FRAME})), a AS (SELECT plate, unnest([{', '.join(rows)}]) AS u FROM b GROUP BY plate) SELECT plate, u.k AS statistic, round(u.v, 9) AS value FROM a"


@query(_blob_sql())
def blob_statistics(t):
    """AGG-06: shapes with derivatives, as a whole and by motion."""
    f = frames(t).select((F.col("user_id") % 4).alias("plate"), "user_id", "frame", (F.col("value") * 2).alias("blob_area"), (F.pmod(F.floor(F.col("event_id") / 3), F.lit(3)) - 1).cast("int").alias("motion_mode"))
    f = X.derivatives(f, Track(("plate", "user_id"), ("frame",)), ["blob_area"], 6.0)
    return V.feature_statistics(f, ["plate"], "user_id").select("plate", "statistic", rounded(F.col("value"), 9).alias("value"))


_IMG = "i AS (SELECT label AS file_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS frame_number, list_transform(embedding, lambda x: CASE WHEN x < -0.1 THEN 0 ELSE least(255, greatest(0, floor(128 + x::DOUBLE * 200)))::INT END) AS px FROM embeddings)"


def _images(t) -> DataFrame:
    e = t("embeddings")
    px = F.transform("embedding", lambda x: F.when(x < F.lit(-0.1).cast("float"), 0).otherwise(F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + x.cast("double") * 200)))).cast("int"))
    data = F.unhex(F.array_join(F.transform(px, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return e.select(F.col("label").alias("file_id"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("frame_number"), F.lit(8).alias("h"), F.lit(8).alias("w"), data.alias("pixels"))


@query(f"WITH {_IMG} SELECT file_id, frame_number::INT AS frame_number, round(list_avg(list_filter(px, lambda v: v > 0)), 6) AS intensity FROM i")
def mean_intensity(t):
    """AGG-35: mean of the pixels that are not masked."""
    return P.mean_intensity(_images(t)).select("file_id", "frame_number", rounded(F.col("intensity")).alias("intensity"))


@query(f"WITH {_IMG}, u AS (SELECT file_id, unnest(range(1, 65)) AS k, unnest(px) AS v FROM i), m AS (SELECT file_id, k, max(v) AS v FROM u GROUP BY ALL) SELECT file_id, string_agg(printf('%02X', v), '' ORDER BY k) AS pixels FROM m GROUP BY file_id")
def image_background(t):
    """AGG-33, AGG-34: the lightest value of each pixel; refined by itself."""
    i = _images(t)
    return P.refined_background(i, i).select("file_id", F.hex("pixels").alias("pixels"))


@query(f"WITH {_IMG}, p AS (SELECT *, lag(px) OVER (PARTITION BY file_id ORDER BY frame_number) AS b FROM i), d AS (SELECT file_id, frame_number, list_filter(list_transform(range(1, 65), lambda k: CASE WHEN px[k] > 0 AND b[k] > 0 THEN px[k] - b[k] END), lambda v: v IS NOT NULL) AS d FROM p WHERE b IS NOT NULL) SELECT file_id, frame_number::INT AS frame_number, round(list_var_pop(d), 6) AS variance FROM d")
def difference_variance(t):
    """AGG-36: variance of the difference to the frame before."""
    return P.difference_variance(_images(t)).select("file_id", "frame_number", rounded(F.col("variance")).alias("variance"))


@query(f"WITH {_IMG}, m AS (SELECT *, list_min(px) AS a, list_max(px) AS b FROM i) SELECT file_id, frame_number::INT AS frame_number, array_to_string(list_transform(px, lambda v: printf('%02X', floor((v - a) * 255::DOUBLE / (b - a))::INT)), '') AS pixels FROM m")
def stretched_images(t):
    """IMG-03: intensities stretched to a byte."""
    return P.normalise(_images(t)).select("file_id", "frame_number", F.hex("pixels").alias("pixels"))


@query(f"WITH {_IMG}, u AS (SELECT file_id, unnest(range(1, 65)) AS k, unnest(px) AS v FROM i), m AS (SELECT file_id, list(v ORDER BY k) AS g FROM (SELECT file_id, k, max(v) AS v FROM u GROUP BY ALL) GROUP BY file_id) SELECT file_id, frame_number::INT AS frame_number, array_to_string(list_transform(range(1, 65), lambda k: printf('%02X', abs(px[k] - g[k]))), '') AS pixels FROM i JOIN m USING (file_id)")
def subtracted_background(t):
    """IMG-04: absolute difference to the background."""
    i = _images(t)
    return P.subtract_background(i, P.background(i)).select("file_id", "frame_number", F.hex("pixels").alias("pixels"))


@query(f"WITH {_IMG} SELECT file_id, frame_number::INT AS frame_number, well_name, array_to_string(list_transform(CASE well_name WHEN 'A1' THEN list_concat(px[1:3], px[9:11]) ELSE px[44:48] END, lambda v: printf('%02X', v)), '') AS pixels FROM i, (VALUES ('A1'), ('B2')) w(well_name)")
def well_tiles(t):
    """IMG-21: frames cut into their wells."""
    i = _images(t)
    boxes = i.select("file_id").distinct().withColumn("b", F.explode(F.array(*(F.struct(F.lit(n).alias("well_name"), *(F.lit(v).alias(k) for k, v in zip(("x_min", "x_max", "y_min", "y_max"), box, strict=True))) for n, box in (("A1", (0, 2, 0, 1)), ("B2", (3, 9, 5, 5))))))).select("file_id", "b.*")
    return P.tiles(i, boxes).select("file_id", "frame_number", "well_name", F.hex("pixels").alias("pixels"))


# ---- streams --------------------------------------------------------------------------------------------------------


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp")).alias(f"{c}_us")


def _events_stream(t) -> DataFrame:
    return t.stream("events").withColumn("ts", F.col("ts").cast("timestamp"))


def _stats(*more: str) -> list:
    return [*more, _micros("start"), _micros("end"), "n", rounded(F.col("mean")).alias("mean"), "least", "most"]


_AGG = "count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most"


@query(f"SELECT event_type, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) + 86400000000 AS end_us, {_AGG} FROM events GROUP BY ALL")
def stream_tumbling(t):
    """STR-1: fixed windows over a stream."""
    return t.drained(T.tumbling(_events_stream(t), ["event_type"], "ts", "value", "1 day"), "complete").select(*_stats("event_type"))


@query(f"WITH w AS (SELECT event_type, value, unnest([epoch_us(time_bucket(INTERVAL 1 DAY, ts)), epoch_us(time_bucket(INTERVAL 1 DAY, ts)) - 86400000000]) AS start_us FROM events) SELECT event_type, start_us, start_us + 172800000000 AS end_us, {_AGG} FROM w GROUP BY ALL")
def stream_sliding(t):
    """STR-2: overlapping windows over a stream."""
    return t.drained(T.sliding(_events_stream(t), ["event_type"], "ts", "value", "2 days", "1 day"), "complete").select(*_stats("event_type"))


@query(f"WITH g AS (SELECT *, sum(CASE WHEN epoch_us(ts) - epoch_us(p) > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, {_AGG} FROM g GROUP BY user_id, k")
def stream_sessions(t):
    """STR-3: blocks between gaps over a stream."""
    return t.drained(T.session_blocks(_events_stream(t), ["user_id"], "ts", "value", "6 hours"), "complete").select(*_stats("user_id"))


@query("SELECT event_id, value FROM events")
def stream_without_repeats(t):
    """STR-4: rows that come twice are kept once."""
    e = _events_stream(t)
    return t.drained(T.without_repeats(e.unionByName(e), ["event_id"], "ts", "400 days"), "append").select("event_id", "value")


@query(ORACLE["linked_tracks"])
def stream_linking(t):
    """STR-5: frames linked one by one, with the frame before as state."""
    e = t.stream("events")
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3600 * 1_000_000)).cast("int")
    d = e.select((F.col("user_id") % 5).cast("int").alias("file_id"), hour.alias("frame_number"), F.col("event_id").alias("row_id"), F.col("value").alias("coord_x"), (F.col("user_id") % 17).cast("double").alias("coord_y"), (F.col("value") + 50).alias("area"))
    return t.drained(T.link_stream(d, max_distance=10.0), "append").select("file_id", "row_id", "worm_index_blob")


@query(f"WITH {_IMG}, u AS (SELECT file_id, frame_number, unnest(range(1, 65)) AS k, unnest(px) AS v FROM i), p AS (SELECT a.file_id, a.frame_number, b.k, max(b.v) AS v FROM (SELECT DISTINCT file_id, frame_number FROM i) a JOIN u b ON a.file_id = b.file_id AND b.frame_number <= a.frame_number AND (b.frame_number - 1) % 3 = 0 AND b.frame_number > a.frame_number - (a.frame_number - 1) % 3 - 12 GROUP BY ALL) SELECT file_id, frame_number::INT AS frame_number, string_agg(printf('%02X', v), '' ORDER BY k) AS pixels FROM p GROUP BY file_id, frame_number")
def stream_background(t):
    """STR-6: the background of the last four of every third frame, kept as a ring in a stream's state."""
    # A stream cannot number frames, so that they come from a table of their own.
    where = shared_folder(t.spark, "frames")
    _images(t).select("file_id", F.col("frame_number").cast("int").alias("frame_number"), "h", "w", "pixels").write.parquet(where)
    s = t.spark.readStream.schema("file_id int, frame_number int, h int, w int, pixels binary").parquet(where)
    return t.drained(T.background_stream(s, 3, 4), "append").select("file_id", "frame_number", F.hex("pixels").alias("pixels"))


# ---- files ----------------------------------------------------------------------------------------------------------

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("SELECT unnest([" + ", ".join(f"'{n}.parquet'" for n in sorted(_TABLES)) + "]) AS name, unnest(range(14)) AS file_id")
def table_files(t):
    """SRC-01, SRT-10, ORC-10: files under a folder, numbered by path."""
    # A table may be a folder of files, which then stands in the list once, under its own path.
    found = ingest.find_files(t.spark, t.folder, "*.parquet").select(F.regexp_replace("path", r"(/[^/]+\.parquet)/.*$", "$1").alias("path")).distinct()
    found = found.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).where(F.regexp_replace("name", r"\.parquet$", "").isin(_TABLES))
    return ingest.manifest(found).select("name", F.col("file_id").cast("bigint").alias("file_id"))


@query(f"""WITH RECURSIVE {_D}, g AS (SELECT file_id, frame_number, list({{'row': row_id, 'x': coord_x, 'y': coord_y, 'a': area}} ORDER BY row_id) AS c, row_number() OVER (PARTITION BY file_id ORDER BY frame_number) AS k FROM d GROUP BY file_id, frame_number),
z AS (SELECT file_id, k, list_sort(list_transform(c, lambda p: {{'far': CASE WHEN k = 1 THEN sqrt((p.x - 50) ** 2 + (p.y - 8) ** 2) / sqrt(p.a) END, 'row': p.row, 'x': p.x, 'y': p.y}})) AS c FROM g),
w AS (SELECT file_id, k, c[1].row AS row, c[1].x AS x, c[1].y AS y, true AS hit FROM z WHERE k = 1 UNION ALL
      SELECT file_id, k, CASE WHEN best.far <= 20 THEN best.row END, CASE WHEN best.far <= 20 THEN best.x ELSE x END, CASE WHEN best.far <= 20 THEN best.y ELSE y END, best.far <= 20
      FROM (SELECT w.file_id, z.k, w.x AS x, w.y AS y, list_sort(list_transform(z.c, lambda p: {{'far': sqrt((p.x - w.x) ** 2 + (p.y - w.y) ** 2), 'row': p.row, 'x': p.x, 'y': p.y}}))[1] AS best
            FROM w JOIN z ON z.file_id = w.file_id AND z.k = w.k + 1))
SELECT file_id, row AS row_id, 1 AS worm_index_joined FROM w WHERE hit""")
def single_animals(t):
    """TRK-03, TRK-04: of each frame's detections the nearest to the one before, from the nearest to a centre on."""
    one = K.track_detections(_tracks(t), single=True, centre=(50.0, 8.0), max_distance=20.0)
    return one.select("file_id", "row_id", "worm_index_joined")
