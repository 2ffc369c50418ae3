"""Registered queries of the relational operators: runs, windows, joins, selection, aggregates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import geometry as G
from trackloom.functions import kernels
from trackloom.functions import timeseries as S
from trackloom.functions.timeseries import Track
from trackloom.operators import events as E
from trackloom.operators import islands as I
from trackloom.operators import joins as J
from trackloom.operators import selection as L
from trackloom.operators import summary as A
from trackloom.plans.registry import BY_EVENT, EVENTS, FRAMES, ORACLE, QUERIES, query
from trackloom.plans.registry import frames as _frames
from trackloom.plans.registry import rounded as _r

@query("""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events),
w(window_id, a, b) AS (VALUES (0, 0, 30), (1, 30, 60), (2, 60, 1000000000)),
s AS (SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m,
             count(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS c FROM e),
j AS (SELECT s.*, window_id, CASE WHEN c = 5 THEN CASE WHEN m > 60 THEN 1 WHEN m < 40 THEN -1 ELSE 0 END ELSE 0 END AS mode FROM s JOIN w ON frame >= a AND frame < b),
g AS (SELECT *, CASE WHEN lag(mode) OVER (PARTITION BY user_id, window_id ORDER BY frame) IS DISTINCT FROM mode THEN 1 ELSE 0 END AS new FROM j)
SELECT user_id, window_id, round(quantile_cont(value, 0.1), 6) AS value_10th, round(quantile_cont(value, 0.5), 6) AS value_50th, round(quantile_cont(value, 0.9), 6) AS value_90th,
       round(avg(CASE WHEN mode = 0 THEN 1.0 ELSE 0.0 END), 6) AS paused_fraction, count(*) FILTER (WHERE mode = 0 AND new = 1)::BIGINT AS n_pauses
FROM g GROUP BY user_id, window_id""")
def behaviour_summary(t):
    """Per track and time window: median and spread of the signal, share of time paused, number of pauses."""
    e = t("events").withColumn("frame", F.row_number().over(EVENTS.window()) - 1)
    m = S.rolling_mean(F.col("value"), EVENTS.window(), 5)
    e = e.withColumn("mode", F.when(m > 60, 1).when(m < 40, -1).otherwise(0))
    w = L.windows_table(e.sparkSession, "0:60:30,60:end")
    track = Track(("user_id", "window_id"), ("frame",))
    e = L.in_windows(e.select("user_id", "frame", "value", "mode"), w, "frame")
    e = I.with_run_id(e, F.col("mode"), track)
    first = F.row_number().over(Window.partitionBy("user_id", "window_id", "run").orderBy("frame")) == 1
    e = e.withColumn("new", first)
    q = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return e.groupBy("user_id", "window_id").agg(_r(q[0]).alias("value_10th"), _r(q[1]).alias("value_50th"), _r(q[2]).alias("value_90th"), _r(F.avg((F.col("mode") == 0).cast("double"))).alias("paused_fraction"), F.count(F.when((F.col("mode") == 0) & F.col("new"), 1)).alias("n_pauses"))


@query("SELECT user_id, round(quantile_cont(value, 0.1), 6) AS value_10th, round(quantile_cont(value, 0.5), 6) AS value_50th, round(quantile_cont(value, 0.9), 6) AS value_90th, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS \"value_IQR\" FROM events GROUP BY user_id")
def quantile_block(t):
    """AGG-01."""
    out = A.summarise(t("events"), ["user_id"], ["value"])
    return out.select("user_id", *(_r(F.col(c)).alias(c) for c in out.columns if c != "user_id"))


@query("SELECT user_id, " + ", ".join(f"round(quantile_cont(value, {p}) FILTER (WHERE event_type = '{v}'), 6) AS value_{v}_{n}" for v in ("click", "view") for n, p in (("10th", 0.1), ("50th", 0.5), ("90th", 0.9))) + " FROM events GROUP BY user_id")
def quantile_by_label(t):
    """AGG-02."""
    out = A.summarise(t("events"), ["user_id"], ["value"], {"value": ("event_type", {"click": "click", "view": "view"})})
    return out.select("user_id", *(_r(F.col(c)).alias(c) for c in out.columns if c != "user_id" and not c.endswith("IQR")))


@query("SELECT event_id, round(value / m, 6) AS value_norm FROM (SELECT *, median(value) OVER (PARTITION BY user_id) AS m FROM events)")
def norm_by_track_median(t):
    """AGG-03, JOI-03."""
    return A.normalised(t("events").withColumn("length", F.col("value")), {"value": "L"}, "length", ["user_id"]).select("event_id", _r(F.col("value_norm")).alias("value_norm"))


@query("SELECT user_id, round(quantile_cont(abs(value - 50), 0.5), 6) AS x_abs_50th FROM events GROUP BY user_id")
def abs_variant(t):
    """AGG-04."""
    return A.summarise(t("events").withColumn("x", F.col("value") - 50), ["user_id"], ["x"], absolute=["x"]).select("user_id", _r(F.col("x_abs_50th")).alias("x_abs_50th"))


@query(f"WITH {FRAMES} SELECT user_id, round(min(frame) / 25.0, 6) AS ini_time, round(count(*) / 25.0, 6) AS tot_time, round(avg(CASE WHEN gappy IS NULL THEN 0.0 ELSE 1.0 END), 6) AS frac_valid FROM f GROUP BY user_id")
def trajectory_info(t):
    """AGG-09."""
    out = A.trajectory_info(_frames(t).withColumnRenamed("frame", "timestamp"), ["user_id"], 25.0, "gappy")
    return out.select("user_id", *(_r(F.col(c)).alias(c) for c in ("ini_time", "tot_time", "frac_valid")))


@query("SELECT event_type, round(quantile_cont(n, 0.99), 6) AS n_estimate FROM (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY event_type")
def n_entities_p99(t):
    """AGG-12."""
    e = t("events").withColumn("day", F.to_date("ts"))
    return A.entity_estimate(e, ["event_type"], "day").select("event_type", _r(F.col("n_estimate")).alias("n_estimate"))


_RUNS = """
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY frame) AS run FROM (
  SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY frame) = event_type THEN 0 ELSE CASE WHEN frame = 1 THEN 0 ELSE 1 END END AS new FROM f)),
g AS (SELECT user_id, run, any_value(event_type) AS event_type, min(frame) AS start, max(frame) AS "end", count(*) AS n_rows FROM r GROUP BY user_id, run),
h AS (SELECT *, CASE WHEN "end" >= max("end") OVER (PARTITION BY user_id) THEN 1 WHEN start <= 1 THEN -1 ELSE 0 END AS edge_flag FROM g)"""


@query(f"WITH {FRAMES}, {_RUNS} SELECT user_id, run::BIGINT AS run, event_type, start, \"end\", n_rows, edge_flag FROM h")
def event_runs(t):
    """WIN-15, WIN-16."""
    track = Track(("user_id",), ("frame",))
    out = I.label_runs(_frames(t), "event_type", track, "frame")
    return out.select("user_id", "run", "event_type", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "n_rows", "edge_flag")


@query(f"WITH {FRAMES}, {_RUNS} SELECT user_id, " + ", ".join(f"round(coalesce(median(n_rows / 25.0) FILTER (WHERE event_type = '{k}'), 0), 6) AS event_type_{k}_duration_50th, round(coalesce(sum(n_rows) FILTER (WHERE event_type = '{k}'), 0) / sum(n_rows)::DOUBLE, 6) AS event_type_{k}_fraction, count(*) FILTER (WHERE event_type = '{k}' AND edge_flag <> -1) AS event_type_{k}_n_runs" for k in ("click", "view")) + " FROM h GROUP BY user_id")
def run_stats(t):
    """AGG-13."""
    track = Track(("user_id",), ("frame",))
    runs = I.label_runs(_frames(t), "event_type", track, "frame")
    out = I.run_statistics(runs, ("user_id",), "event_type", ["click", "view"], 25.0)
    return out.select("user_id", *(_r(F.col(c)).alias(c) if not c.endswith("n_runs") else F.col(c) for c in out.columns if c != "user_id"))


_MASK = f"""WITH {FRAMES}, m AS (SELECT *, frame - row_number() OVER (PARTITION BY user_id, value > 60 ORDER BY frame) AS g, value > 60 AS hit FROM f),
s AS (SELECT user_id, min(frame) AS start, max(frame) AS "end" FROM m WHERE hit GROUP BY user_id, g)"""
_MERGED = """, b AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s),
c AS (SELECT *, sum(CASE WHEN start - p - 1 > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start) AS grp FROM b),
z AS (SELECT user_id, min(start) AS start, max("end") AS "end", count(*) AS n_runs FROM c GROUP BY user_id, grp)"""


def _above(t) -> DataFrame:
    track = Track(("user_id",), ("frame",))
    return E.find_events(_frames(t), track, "value", "frame", E.Finder(low=60, inclusive=False))


@query(_MASK + _MERGED + ' SELECT user_id, start, "end", n_runs FROM z')
def merge_short_gaps(t):
    """WIN-18."""
    return I.merge_runs(_above(t), ("user_id",), 2).select("user_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "n_runs")


@query(_MASK + ' SELECT user_id, start, "end" FROM s WHERE "end" - start + 1 >= 3')
def drop_short_runs(t):
    """WIN-19."""
    return I.drop_short_runs(_above(t), 3).select("user_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


@query(f"WITH {FRAMES}, o AS (SELECT user_id, frame, value > 60 AS x, count(*) OVER (PARTITION BY user_id) AS n FROM f), g AS (SELECT *, frame - row_number() OVER (PARTITION BY user_id, x ORDER BY frame) AS k FROM o), r AS (SELECT user_id, min(frame) - 1 AS a, max(frame) - 1 AS b, any_value(n) AS n FROM g WHERE x GROUP BY user_id, k), q AS (SELECT user_id, greatest(a - 1, 0) AS start, b AS \"end\", n FROM r) SELECT user_id, start, \"end\", \"end\" - start AS duration, CASE WHEN \"end\" >= n - 1 THEN 1 WHEN start <= 0 THEN -1 ELSE 0 END AS edge_flag FROM q WHERE \"end\" - start > 0")
def padded_mask_runs(t):
    """WIN-15 with the start shift."""
    track = Track(("user_id",), ("frame",))
    out = I.mask_runs(_frames(t), F.col("value") > 60, track)
    return out.select("user_id", *(F.col(c).cast("bigint").alias(c) for c in ("start", "end", "duration")), "edge_flag")


@query(f"SELECT event_id, sum(new) OVER ({BY_EVENT})::BIGINT AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER ({BY_EVENT})) >= 21600000000 THEN 1 ELSE 0 END AS new FROM events)")
def session_blocks(t):
    """WIN-22."""
    return I.sessions(t("events"), F.unix_micros(F.col("ts").cast("timestamp")), EVENTS, 6 * 3600 * 1_000_000).select("event_id", "session")


@query(f"SELECT event_id, round((lead(value, 3) OVER ({BY_EVENT}) - lag(value, 2) OVER ({BY_EVENT})) / (5 / 25.0), 6) AS d_value FROM events")
def central_difference(t):
    """WIN-01, WIN-03."""
    return t("events").select("event_id", _r(S.central_difference(F.col("value"), EVENTS.window(), 5, 25.0)).alias("d_value"))


@query(f"WITH {FRAMES} SELECT event_id, last_value(gappy IGNORE NULLS) OVER ({BY_EVENT} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM f")
def ffill(t):
    """WIN-04."""
    return _frames(t).select("event_id", S.ffill(F.col("gappy"), EVENTS.window()).alias("filled"))


@query(f"WITH {FRAMES} SELECT event_id, first_value(gappy IGNORE NULLS) OVER ({BY_EVENT} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled FROM f")
def bfill(t):
    """WIN-04."""
    return _frames(t).select("event_id", S.bfill(F.col("gappy"), EVENTS).alias("filled"))


_LERP = f"""WITH {FRAMES}, k AS (SELECT *,
  last_value(gappy IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0,
  first_value(gappy IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1,
  max(CASE WHEN gappy IS NOT NULL THEN frame END) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t0,
  min(CASE WHEN gappy IS NOT NULL THEN frame END) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1 FROM f)"""


@query(_LERP + " SELECT event_id, round(CASE WHEN gappy IS NOT NULL THEN gappy WHEN t0 IS NULL OR t1 IS NULL THEN coalesce(v0, v1) ELSE v0 + (v1 - v0) * (frame - t0) / (t1 - t0) END, 6) AS filled FROM k")
def lerp_gaps(t):
    """WIN-09."""
    return _frames(t).select("event_id", _r(S.lerp(F.col("gappy"), F.col("frame"), EVENTS)).alias("filled"))


@query(_LERP + " SELECT event_id, round(CASE WHEN gappy IS NOT NULL THEN gappy WHEN t1 - t0 - 1 <= 1 THEN v0 + (v1 - v0) * (frame - t0) / (t1 - t0) END, 6) AS filled FROM k")
def lerp_short_gaps(t):
    """WIN-10, WIN-11."""
    return _frames(t).select("event_id", _r(S.lerp(F.col("gappy"), F.col("frame"), EVENTS, max_gap=1, hold_edges=False)).alias("filled"))


@query(f"""WITH a AS (SELECT event_id, user_id, ts, value / 16 - 3 AS x FROM events),
d AS (SELECT *, x - lag(x) OVER ({BY_EVENT}) AS s FROM a),
m AS (SELECT *, (s + pi()) - 2 * pi() * floor((s + pi()) / (2 * pi())) - pi() AS u FROM d)
SELECT event_id, round(x + sum(CASE WHEN abs(s) < pi() THEN 0 ELSE coalesce(CASE WHEN u = -pi() AND s > 0 THEN pi() ELSE u END - s, 0) END) OVER ({BY_EVENT} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS unwrapped FROM m""")
def unwrap_phase(t):
    """WIN-05."""
    e = t("events").select("event_id", "user_id", "ts", (F.col("value") / 16 - 3).alias("x"))
    # The SQL adds up in an order of its own, on which the sign of a zero hangs: there is one zero.
    return S.unwrap(e, "x", EVENTS, "unwrapped").select("event_id", (_r(F.col("unwrapped"), 9) + F.lit(0.0)).alias("unwrapped"))


@query(f"SELECT event_id, CASE WHEN count(value) OVER w = 5 THEN round(avg(value) OVER w, 6) END AS m FROM events WINDOW w AS ({BY_EVENT} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def rolling_mean_full(t):
    """WIN-06."""
    return t("events").select("event_id", _r(S.rolling_mean(F.col("value"), EVENTS.window(), 5)).alias("m"))


@query(f"SELECT event_id, CASE WHEN count(value) OVER w = 4 THEN min(value) OVER w END AS lo, CASE WHEN count(value) OVER w = 4 THEN max(value) OVER w END AS hi FROM events WINDOW w AS ({BY_EVENT} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def rolling_min_max(t):
    """WIN-07 (extremes), WIN-14."""
    w = EVENTS.window()
    return t("events").select("event_id", S.rolling_min(F.col("value"), w, 4).alias("lo"), S.rolling_max(F.col("value"), w, 4).alias("hi"))


@query(f"WITH {FRAMES} SELECT event_id, CASE WHEN count(gappy) OVER w >= 3 THEN round(stddev_samp(gappy) OVER w, 5) END AS s FROM f WINDOW w AS ({BY_EVENT} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)")
def rolling_std_minperiods(t):
    """WIN-08."""
    return _frames(t).select("event_id", _r(S.rolling_std(F.col("gappy"), EVENTS.window(), 6, 3), 5).alias("s"))


@query(f"WITH {FRAMES}, g AS (SELECT *, frame - row_number() OVER (PARTITION BY user_id, value > 30 ORDER BY frame) AS k FROM f) SELECT event_id, value > 30 AND bool_or(value > 80) OVER (PARTITION BY user_id, value > 30, k) AS grown FROM g")
def seeded_growth(t):
    """EVT-04."""
    return I.seeded_growth(t("events"), F.col("value") > 30, F.col("value") > 80, EVENTS).select("event_id", "grown")


@query(f"""WITH {FRAMES}, q AS (SELECT *, sum(CASE WHEN frame > 1 AND sign(value - 50) IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY frame) AS k FROM (SELECT *, lag(sign(value - 50)) OVER (PARTITION BY user_id ORDER BY frame) AS p FROM f))
SELECT event_id, round(CASE WHEN value >= 50 THEN max(value - 50) OVER (PARTITION BY user_id, k) ELSE min(value - 50) OVER (PARTITION BY user_id, k) END, 6) AS extreme FROM q""")
def stretch_extremes(t):
    """WIN-27."""
    return I.stretch_extremes(t("events"), F.col("value") - 50, EVENTS).select("event_id", _r(F.col("extreme")).alias("extreme"))


_G = S.gaussian_weights(1.0)
@query("SELECT event_id, round(" + " + ".join(f"{w!r} * coalesce({'value' if k == len(_G) // 2 else ('lead' if k > len(_G) // 2 else 'lag') + f'(value, {abs(k - len(_G) // 2)}) OVER (' + BY_EVENT + ')'}, 0)" for k, w in enumerate(_G)) + ", 6) AS s FROM events")
def gaussian_smooth(t):
    """WIN-28."""
    return t("events").select("event_id", _r(S.gaussian_smooth(F.col("value"), EVENTS.window(), 1.0)).alias("s"))


@query("WITH w(window_id, a, b) AS (VALUES (0, DATE '1995-01-01', DATE '1995-04-01'), (1, DATE '1995-03-01', DATE '1996-01-01'), (2, DATE '1997-01-01', NULL)) SELECT window_id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN w ON o_orderdate >= a AND (b IS NULL OR o_orderdate < b) GROUP BY window_id")
def range_window_join(t):
    """SEL-01."""
    o = t("orders")
    w = o.sparkSession.createDataFrame([(0, "1995-01-01", "1995-04-01"), (1, "1995-03-01", "1996-01-01"), (2, "1997-01-01", None)], "window_id int, a string, b string")
    w = w.select("window_id", F.to_timestamp("a").alias("start"), F.to_timestamp("b").alias("end"))
    return J.window_join(o, w, "o_orderdate").groupBy("window_id").agg(F.count("*").alias("n"), _r(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def tumbling_windows(t):
    """SNK-04, windows of equal width."""
    out = t("events").groupBy("event_type", F.window("ts", "1 day")).agg(F.count("*").alias("n"), _r(F.avg("value")).alias("mean"))
    return out.select("event_type", F.unix_micros(F.col("window.start").cast("timestamp")).alias("start_us"), "n", "mean")


def _detections(t) -> DataFrame:
    e = t("events")
    return e.select((F.col("user_id") % 5).cast("int").alias("file_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3600 * 1_000_000)).cast("bigint").alias("frame_number"), F.col("event_id").alias("row_id"), F.col("value").alias("coord_x"), (F.col("user_id") % 17).cast("double").alias("coord_y"), (F.col("value") + 50).alias("area"), F.lit(20.0).alias("box_length"))


_DET = "d AS (SELECT (user_id % 5)::INT AS file_id, floor(epoch_us(ts) / 3600000000.0)::BIGINT AS frame_number, event_id AS row_id, value AS coord_x, (user_id % 17)::DOUBLE AS coord_y, value + 50 AS area FROM events)"


@query(f"""WITH {_DET}, r AS (SELECT *, dense_rank() OVER (PARTITION BY file_id ORDER BY frame_number) AS f FROM d),
p AS (SELECT c.file_id, c.f, c.row_id, q.row_id AS prev, CASE WHEN q.area / c.area BETWEEN 0.5 AND 2 THEN sqrt((c.coord_x - q.coord_x) ** 2 + (c.coord_y - q.coord_y) ** 2) ELSE 1e20 END AS cost FROM r c JOIN r q ON c.file_id = q.file_id AND c.f = q.f + 1),
a AS (SELECT *, count(*) OVER (PARTITION BY file_id, f, prev) AS same FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY file_id, f, row_id ORDER BY cost, prev) = 1)),
b AS (SELECT *, count(*) OVER (PARTITION BY file_id, f, row_id) AS same FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY file_id, f, prev ORDER BY cost, row_id) = 1))
SELECT a.file_id, a.row_id, a.prev AS previous FROM a WHERE a.cost <= 10 AND a.same = 1 AND NOT EXISTS (SELECT 1 FROM b WHERE b.file_id = a.file_id AND b.f = a.f AND b.prev = a.prev AND NOT (b.cost <= 10 AND b.same = 1))""")
def nearest_prev_next(t):
    """JOI-06."""
    return J.nearest_links(_detections(t), ["file_id"], "frame_number", "row_id", "coord_x", "coord_y", "area", 10.0, (0.5, 2.0))


_TRACKS = "k AS (SELECT user_id % 3 AS g, user_id, min(epoch_us(ts) // 3600000000) AS s, min(epoch_us(ts) // 3600000000) + 40 + user_id % 30 AS e, avg(value) AS x, count(*) + 50.0 AS size FROM events GROUP BY user_id)"


@query(f"""WITH {_TRACKS}, p AS (SELECT a.g, a.user_id AS previous, b.user_id AS track, abs(a.x - b.x) AS d FROM k a JOIN k b ON a.g = b.g AND a.e < b.s AND b.s <= a.e + 48 AND a.size / b.size > 0.5 AND a.size / b.size < 2),
n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY g, previous ORDER BY d, track) = 1)
SELECT g, track, max(previous) AS previous FROM n WHERE d <= 20 GROUP BY g, track""")
def gap_join(t):
    """JOI-07."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3600 * 1_000_000)).cast("bigint")
    # Equal animals must get equal means, or the nearest of them hangs on the order of their values.
    e = t("events").withColumns({"g": F.col("user_id") % 3, "track": F.col("user_id")})
    means = A.group_mean(e, ["g", "track"], ["value"], Track(("track",), ("event_id",)))
    k = e.groupBy("g", "track").agg(F.min(hour).alias("start"), (F.count("*") + 50.0).alias("size0"), F.count("*").alias("n")).join(means.withColumnRenamed("value_mean", "x0"), ["g", "track"])
    k = k.withColumn("end", F.col("start") + 40 + F.col("track") % 30).withColumns({"x1": F.col("x0"), "size1": F.col("size0"), "y0": F.lit(0.0), "y1": F.lit(0.0), "reach": F.lit(20.0)})
    return J.gap_links(k, ["g"], "track", 48, (0.5, 2.0))


@query("SELECT event_id, w AS well_name FROM events LEFT JOIN (SELECT chr(65 + (i // 4)::INT) || (i % 4 + 1) AS w, (i % 4) * 25 AS x0, (i % 4) * 25 + 24 AS x1, (i // 4) * 30 AS y0, (i // 4) * 30 + 29 AS y1 FROM range(16) r(i)) ON floor(value) BETWEEN x0 AND x1 AND user_id % 120 BETWEEN y0 AND y1")
def point_in_rect(t):
    """JOI-08."""
    e = t("events").select("event_id", F.floor("value").alias("x"), (F.col("user_id") % 120).alias("y"))
    box = e.sparkSession.range(16).select(F.concat(F.chr((F.lit(65) + F.floor(F.col("id") / 4)).cast("bigint")), (F.col("id") % 4 + 1).cast("string")).alias("well_name"), (F.col("id") % 4 * 25).alias("x_min"), (F.col("id") % 4 * 25 + 24).alias("x_max"), (F.floor(F.col("id") / 4) * 30).alias("y_min"), (F.floor(F.col("id") / 4) * 30 + 29).alias("y_max"))
    return J.point_in_rectangle(e, box, ["event_id"], "x", "y").select("event_id", "well_name")


@query("WITH s AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1) SELECT e.event_id, s.value AS last_value FROM events e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.ts >= s.ts")
def asof_position(t):
    """JOI-13, JOI-14."""
    e = t("events")
    facts = L.dedupe_first(e.where("event_type = 'purchase'"), ["user_id", "ts"], ["event_id"]).select("user_id", "ts", F.col("value").alias("last_value"))
    return J.as_of(e.select("event_id", "user_id", "ts"), facts, ["user_id"], "ts", "ts", ["last_value"]).select("event_id", "last_value")


@query("SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING avg(CASE WHEN value >= 20 THEN 1.0 ELSE 0.0 END) >= 0.7 AND count(*) FILTER (WHERE value >= 20) >= 40 AND sqrt((max(value) - min(value)) ** 2 + (max(value / 2) - min(value / 2)) ** 2) > 60)")
def semi_valid_tracks(t):
    """JOI-04, SEL-07."""
    e = t("events").select("event_id", "user_id", "value", (F.col("value") / 2).alias("half"), (F.col("value") >= 20).alias("valid"))
    return L.valid_tracks(e, [], "user_id", "valid", "value", "half", 0.7, 40, 60.0).select("event_id")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_tracks(t):
    """JOI-05."""
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("WITH c AS (SELECT DISTINCT c_nationkey AS r, date_part('year', o_orderdate)::INT * 12 + date_part('month', o_orderdate)::INT AS k, c_mktsegment AS g FROM orders JOIN customer ON c_custkey = o_custkey) SELECT r, k FROM (SELECT DISTINCT r || '/' || g AS r FROM c) CROSS JOIN (SELECT DISTINCT k FROM c) EXCEPT SELECT r || '/' || g, k FROM c")
def lattice_missing(t):
    """JOI-11, SET-06: months without an order, by nation and market segment."""
    c = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("r"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("k"))
    return J.missing_cells(c, "r", "k")


@query("WITH p AS (SELECT user_id, median(value) AS m FROM events GROUP BY user_id), c AS (SELECT median(m) AS c FROM p), d AS (SELECT user_id, abs(m - c) AS d FROM p, c), x AS (SELECT median(d) AS x FROM d) SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM d, x WHERE d <= 2 * x)")
def median_mad_filter(t):
    """SEL-15, AGG-32."""
    return A.median_mad_filter(t("events"), ["user_id"], "value", width=2.0).select("event_id")


_CELLS = "c AS (SELECT user_id, event_id, ts, round_even((value - avg(value) OVER (PARTITION BY user_id)) / 10.0, 0)::BIGINT AS cx, round_even((value / 2 - avg(value / 2) OVER (PARTITION BY user_id)) / 10.0, 0)::BIGINT AS cy FROM events), v AS (SELECT user_id, cx, cy, count(*) AS n FROM c GROUP BY ALL)"


@query(f"WITH {_CELLS}, k AS (SELECT *, sum(CASE WHEN px = cx AND py = cy THEN 0 ELSE 1 END) OVER ({BY_EVENT}) AS run FROM (SELECT *, lag(cx) OVER ({BY_EVENT}) AS px, lag(cy) OVER ({BY_EVENT}) AS py FROM c)), r AS (SELECT user_id, count(*) AS n FROM k GROUP BY user_id, run), s AS (SELECT user_id, quantile_cont(n, 0.5) / 25.0 AS a, quantile_cont(n, 0.95) / 25.0 AS b FROM r GROUP BY user_id), g AS (SELECT user_id, count(*) * 100.0 AS c, quantile_cont(n, 0.5) / sum(n)::DOUBLE AS d, quantile_cont(n, 0.95) / sum(n)::DOUBLE AS e FROM v GROUP BY user_id) SELECT user_id, c::DOUBLE AS path_coverage, round(d, 6) AS path_density_50th, round(e, 6) AS path_density_95th, round(a, 6) AS path_transit_time_50th, round(b, 6) AS path_transit_time_95th FROM g JOIN s USING (user_id)")
def grid_coverage(t):
    """AGG-14."""
    out = A.grid_coverage(t("events").withColumn("half", F.col("value") / 2), ["user_id"], "value", "half", 10.0, 25.0, EVENTS)
    return out.select("user_id", "path_coverage", *(_r(F.col(c)).alias(c) for c in out.columns if c.startswith("path_") and c != "path_coverage"))


@query("WITH l AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT least(floor((value - lo) / ((hi - lo) / 20)), 19)::INT AS bin, count(*) AS n FROM events, l GROUP BY 1")
def histogram_equal_width(t):
    """AGG-26."""
    return A.histogram(t("events"), "value", 20).select("bin", "n")


@query("""WITH h AS (SELECT least(floor(value), 255)::INT AS v, count(*) AS n FROM events GROUP BY 1),
c AS (SELECT v, sum(n) OVER (ORDER BY v) AS w, sum(v * n) OVER (ORDER BY v) AS m, sum(n) OVER () AS ww, sum(v * n) OVER () AS mm FROM h)
SELECT v AS threshold FROM c WHERE ww > w ORDER BY round(w::DOUBLE * (ww - w) * (m::DOUBLE / w - (mm - m)::DOUBLE / (ww - w)) ** 2, 3) DESC, v LIMIT 1""")
def otsu_threshold(t):
    """AGG-29."""
    h = t("events").select(F.least(F.floor("value"), F.lit(255)).cast("int").alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    return A.otsu_threshold(h, "v", "n")


@query(f"SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY user_id")
def first_last_row(t):
    """SRT-03."""
    return t("events").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def dedupe_first(t):
    """SRT-05."""
    return L.dedupe_first(t("events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3")
def topk_per_group(t):
    """SRT-04; the limit is the feature."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return t("events").select("user_id", "event_id", rank.alias("rank")).where("rank <= 3")


@query("SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL BY NAME SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def union_align(t):
    """SET-01."""
    s = t("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = t("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query("SELECT p_partkey, motion, sign FROM part CROSS JOIN (VALUES ('all'), ('forward'), ('paused'), ('backward')) m(motion) CROSS JOIN (VALUES ('all'), ('absolute'), ('positive'), ('negative')) s(sign) WHERE (p_size % 2 = 0 OR motion = 'all') AND (p_size % 3 = 0 OR sign = 'all')")
def spec_expand(t):
    """JOI-12, AGG-19."""
    p = t("part").select("p_partkey", (F.col("p_size") % 2 == 0).alias("is_time_series"), (F.col("p_size") % 3 == 0).alias("is_signed"))
    return A.expand_specs(p).select("p_partkey", "motion", "sign")


@query("SELECT user_id, " + ", ".join(f"round({fn}, 10) AS {n}" for n, fn in {"x_mean": "avg(x)", "x_median": "quantile_cont(x, 0.5)", "x_positive_mean": "avg(x) FILTER (WHERE x > 0)", "x_forward_absolute_90th": "quantile_cont(abs(x), 0.9) FILTER (WHERE m = 1)", "x_backward_negative_10th": "quantile_cont(x, 0.1) FILTER (WHERE m = -1 AND x < 0)"}.items()) + " FROM (SELECT user_id, value - 50 AS x, event_id % 3 - 1 AS m FROM events) GROUP BY user_id")
def motion_sign_stats(t):
    """AGG-15."""
    e = t("events").select("user_id", (F.col("value") - 50).alias("x"), (F.col("event_id") % 3 - 1).alias("m"))
    out = e.groupBy("user_id").agg(*A.motion_sign_statistics(F.col("x"), F.col("m"), "x", {"all": None, "forward": 1, "paused": 0, "backward": -1}))
    return out.select("user_id", *(_r(F.col(c), 10).alias(c) for c in ("x_mean", "x_median", "x_positive_mean", "x_forward_absolute_90th", "x_backward_negative_10th")))


def _vectors(t) -> DataFrame:
    return t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


_V = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


@query(_V + " SELECT vec_id, round(list_sum(list_transform(range(1, len(v)), lambda i: sqrt(1 + (v[i + 1] - v[i]) ** 2))), 5) AS len FROM e")
def vec_length(t):
    """SCA-01."""
    pose = F.transform("v", lambda x, i: F.struct(i.cast("double").alias("x"), x.alias("y")))
    return _vectors(t).select("vec_id", _r(G.length(pose), 5).alias("len"))


@query(_V + " SELECT vec_id, round(list_avg(v[9:16]), 6) AS mean FROM e")
def vec_slice_mean(t):
    """SEL-18, SCA-12."""
    return _vectors(t).select("vec_id", _r(G.mean(G.part(F.col("v"), "neck")), 6).alias("mean"))


@query(_V + " SELECT vec_id, round(list_dot_product(v, list_reverse(v)), 5) AS d, round(sqrt(list_dot_product(v, v)), 5) AS n FROM e")
def vec_dot(t):
    """SCA-07, SCA-24."""
    return _vectors(t).select("vec_id", _r(G.dot(F.col("v"), F.reverse("v")), 5).alias("d"), _r(G.norm(F.col("v")), 5).alias("n"))


@query("SELECT vec_id, CASE WHEN label % 2 = 0 THEN list_reverse(embedding) ELSE embedding END[1]::DOUBLE AS first FROM embeddings")
def vec_reverse(t):
    """SCA-30."""
    e = t("embeddings")
    return e.select("vec_id", F.element_at(F.when(F.col("label") % 2 == 0, F.reverse("embedding")).otherwise(F.col("embedding")), 1).cast("double").alias("first"))


@query(_V + ", h AS (SELECT vec_id, v[1:len(v) // 2] AS x, v[len(v) // 2 + 1:len(v) // 2 * 2] AS y FROM e) SELECT vec_id, round((list_dot_product(x, list_concat(y[2:], y[1:1])) - list_dot_product(list_concat(x[2:], x[1:1]), y)) / 2, 5) AS area FROM h")
def shoelace(t):
    """SCA-02."""
    half = F.floor(F.size("v") / 2).cast("int")
    return _vectors(t).select("vec_id", _r(G.shoelace(F.slice("v", F.lit(1), half), F.slice("v", half + 1, half)), 5).alias("area"))


@query(_V + " SELECT vec_id, round(median(x), 6) AS mid, round(stddev_pop(x), 6) AS dev FROM (SELECT vec_id, unnest(v[17:33]) AS x FROM e) GROUP BY vec_id")
def vec_part_spread(t):
    """SCA-03, SCA-11, SCA-31."""
    piece = G.part(F.col("v"), "midbody")
    return _vectors(t).select("vec_id", _r(G.median(piece)).alias("mid"), _r(G.deviation(piece)).alias("dev"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_props(t):
    """SRC-14, JSON values."""
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query(f"WITH d AS (SELECT user_id, ts::DATE AS day, sum(value) AS v FROM events GROUP BY 1, 2), b AS (SELECT user_id, min(day) AS a, max(day) AS z FROM d GROUP BY user_id), x AS (SELECT user_id, unnest(generate_series(a, z, INTERVAL 1 DAY))::DATE AS day FROM b) SELECT user_id, (day - DATE '2024-01-01')::BIGINT AS day, round(v, 4) AS v FROM x LEFT JOIN d USING (user_id, day)")
def dense_fill(t):
    """JOI-17."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint")
    d = t("events").groupBy("user_id", day.alias("day")).agg(_r(F.sum("value"), 4).alias("v"))
    return J.dense_fill(d, ["user_id"], "day")


@query(f"""WITH {FRAMES}, n AS (SELECT quantile_cont(c, 0.99) AS est FROM (SELECT count(*) AS c FROM f GROUP BY frame)),
b AS (SELECT min(frame) AS lo, max(frame) AS hi FROM f), k AS (SELECT unnest(range(5))::INT AS i_fold),
o AS (SELECT i_fold, lo + ('0x' || substr(md5('0:' || i_fold || ':0'), 1, 15))::BIGINT % (greatest(lo, hi - 30) - lo + 1) AS start, CASE WHEN 1 - 1 / est > 0 THEN least(0.8, 1 - 1 / est) ELSE 1 END AS share FROM k, b, n),
h AS (SELECT f.*, i_fold, share FROM f JOIN o ON frame BETWEEN start AND start + 30),
t AS (SELECT DISTINCT i_fold, share, user_id FROM h),
c AS (SELECT *, row_number() OVER (PARTITION BY i_fold ORDER BY ('0x' || substr(md5('1:' || i_fold || ':' || user_id), 1, 15))::BIGINT, user_id) AS r, count(*) OVER (PARTITION BY i_fold) AS n FROM t)
SELECT 0 AS file_id, i_fold, count(*) AS n_rows, count(DISTINCT user_id) AS n_tracks, round(quantile_cont(value, 0.5), 6) AS value_50th FROM h JOIN c USING (i_fold, user_id) WHERE r <= ceil(n * c.share) GROUP BY i_fold""")
def fold_sample(t):
    """AGG-10, AGG-11."""
    e = _frames(t).withColumn("file_id", F.lit(0))
    folds = A.random_folds(e.select("file_id", "user_id", "frame", "value"), ["file_id"], "user_id", "frame", 5, 30.0, 1.0, 0.8)
    return folds.groupBy("file_id", "i_fold").agg(F.count("*").alias("n_rows"), F.count_distinct("user_id").alias("n_tracks"), _r(F.median("value")).alias("value_50th"))


@query("WITH p AS (SELECT event_id, value / 100.0 AS p, count(*) OVER () AS n, rank() OVER (ORDER BY value DESC) AS r FROM events), q AS (SELECT event_id, p, least(p * n / (n - r + 1), 1.0) AS q FROM p) SELECT event_id, round(min(q) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS q_value FROM q")
def qvalues_fixed_pi0(t):
    """AGG-30."""
    return A.q_values(t("events").select("event_id", (F.col("value") / 100).alias("p")), "p").select("event_id", _r(F.col("q_value")).alias("q_value"))


@query("SELECT l_orderkey, CASE WHEN n <= 3 THEN 0 WHEN i >= floor((n % 3) / 2) AND floor((i - floor((n % 3) / 2)) / 3) < floor(n / 3) THEN floor((i - floor((n % 3) / 2)) / 3) END::BIGINT AS chunk, count(*) AS n_rows, round(sum(l_quantity), 2) AS total FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) GROUP BY 1, 2")
def split_chunks(t):
    """AGG-17."""
    track = Track(("l_orderkey",), ("l_linenumber", "l_partkey", "l_suppkey"))
    return A.split_chunks(t("lineitem"), track, 3).groupBy("l_orderkey", "chunk").agg(F.count("*").alias("n_rows"), _r(F.sum("l_quantity"), 2).alias("total"))


@query("WITH d AS (SELECT *, dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate) - 1 AS r FROM lineitem) SELECT l_returnflag, count(*) AS n FROM d WHERE r % 10 = 0 GROUP BY l_returnflag")
def every_kth_frame(t):
    """SEL-13; the step is the feature."""
    return L.every_kth_frame(t("lineitem"), ["l_returnflag"], "l_shipdate", 10).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT event_type, round(corr(x, y), 6) AS r, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS n, count(*) FILTER (WHERE x IS NOT NULL AND y IS NULL) AS only_x, count(*) FILTER (WHERE x IS NULL AND y IS NOT NULL) AS only_y FROM (SELECT event_type, CASE WHEN value > 10 THEN value END AS x, CASE WHEN user_id % 4 > 0 THEN value + user_id % 7 END AS y FROM events) GROUP BY event_type")
def agreement(t):
    """AGG-31."""
    e = t("events").select("event_type", F.when(F.col("value") > 10, F.col("value")).alias("x"), F.when(F.col("user_id") % 4 > 0, F.col("value") + F.col("user_id") % 7).alias("y"))
    out = A.agreement(e, "x", "y", ["event_type"])
    return out.withColumn("r", _r(F.col("r")))


@query("SELECT s_nationkey, n_name, r_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def lookup_dimensions(t):
    """JOI-10, JOI-18."""
    n = t("nation").join(J.small(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return t("supplier").join(J.small(n), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("s_nationkey", "n_name", "r_name").agg(F.count("*").alias("n"))


@query("SELECT user_id, string_agg(v::VARCHAR, chr(9) ORDER BY v) AS frames FROM (SELECT DISTINCT user_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS v FROM events) GROUP BY user_id")
def event_frames_list(t):
    """SNK-10."""
    from trackloom.sources.export import egg_events

    return egg_events(t("events").withColumn("k", F.get_json_object("props", "$.k")), ["user_id"], "k")


def _savgol_sql(window: int) -> str:
    half, w = window // 2, kernels.savgol_weights(window, 3)
    at = lambda k: "value" if k == 0 else f"{'lead' if k > 0 else 'lag'}(value, {abs(k)}) OVER ({BY_EVENT})"
    term = lambda row, first: " + ".join(f"({float(x)!r})::DOUBLE * {at(first + k)}" for k, x in enumerate(w[row]))
    cases = [f"WHEN i = {r} THEN {term(r, -r)}" for r in range(half)] + [f"WHEN n - 1 - i = {r} THEN {term(window - 1 - r, r + 1 - window)}" for r in range(half)]
    return f"WITH e AS (SELECT *, row_number() OVER ({BY_EVENT}) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT event_id, round(CASE WHEN n < {window} THEN value {' '.join(cases)} ELSE {term(half, -half)} END, 6) AS smooth FROM e"


@query(_savgol_sql(7))
def savgol_smooth(t):
    """WIN-12."""
    return t("events").select("event_id", _r(S.savgol(F.col("value"), EVENTS, 7)).alias("smooth"))


@query()
def cubic_fill(t):
    """WIN-07 (tier A)."""
    track = Track(("user_id",), ("frame",))
    return kernels.per_track(_frames(t), track.keys, track.order, ["gappy"], lambda p: {"filled": kernels.fill_cubic(p["gappy"].to_numpy(float))}, {"filled": "double"})


_HANN = "[" + ", ".join(repr(0.5 - 0.5 * math.cos(2 * math.pi * k / 14)) for k in range(15)) + "]"


@query(f"""WITH {FRAMES}, w AS (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS v FROM f), m AS (SELECT event_id, v, list_avg(v) AS a FROM w WHERE len(v) = 15),
t AS (SELECT event_id, list_transform(range(1, 16), lambda i: (v[i] - a) * {_HANN}[i]) AS x FROM m), k AS (SELECT event_id, x, unnest(range(1, 8)) AS k FROM t),
p AS (SELECT event_id, k, list_sum(list_transform(range(1, 16), lambda i: x[i] * cos(2 * pi() * k * (i - 1) / 15))) ** 2 + list_sum(list_transform(range(1, 16), lambda i: x[i] * sin(2 * pi() * k * (i - 1) / 15))) ** 2 AS power FROM k)
SELECT f.event_id, round(arg_max(k, power) * 25 / 15::DOUBLE, 6) AS frequency, round(2 * sqrt(max(power)) / list_sum({_HANN}), 5) AS amplitude FROM f LEFT JOIN p USING (event_id) GROUP BY f.event_id""")
def short_time_spectrum(t):
    """WIN-29: the highest frequency of a fixed window."""
    track = Track(("user_id",), ("frame",))

    def run(pdf):
        f, a = kernels.short_time_peak(pdf["value"].to_numpy(float), 25.0, 15, 1.0, 12.0, 0.0)
        return {"frequency": f, "amplitude": a}

    out = kernels.with_tracks(_frames(t).select("user_id", "frame", "event_id", "value"), track.keys, track.order, ["value"], run, {"frequency": "double", "amplitude": "double"})
    return out.select("event_id", _r(F.col("frequency")).alias("frequency"), _r(F.col("amplitude"), 5).alias("amplitude"))


@query()
def robust_outliers(t):
    """AGG-28 (tier A)."""
    from trackloom.operators.features import robust_outliers as flags

    d = t("part").select((F.col("p_partkey") % 4).cast("int").alias("file_id"), F.col("p_partkey").alias("row_id"), F.col("p_size").cast("double").alias("a"), "p_retailprice")
    return flags(d, ["file_id", "row_id"], {0: ["a", "p_retailprice"]}, limit=2.5).select("file_id", "row_id", "skel_outliers_flag")


_LINKS_SQL = ORACLE["nearest_prev_next"]


@query(f"""WITH RECURSIVE l AS ({_LINKS_SQL}), {_DET},
c AS (SELECT d.file_id, d.row_id, d.row_id AS root, frame_number FROM d LEFT JOIN l USING (file_id, row_id) WHERE previous IS NULL
      UNION ALL SELECT l.file_id, l.row_id, c.root, c.frame_number FROM l JOIN c ON l.file_id = c.file_id AND l.previous = c.row_id),
h AS (SELECT file_id, root, row_number() OVER (PARTITION BY file_id ORDER BY frame_number, root) AS worm_index_blob FROM c WHERE root = row_id)
SELECT file_id, row_id, worm_index_blob FROM c JOIN h USING (file_id, root)""")
def linked_tracks(t):
    """TRK-01: ids by pointer doubling over nearest links."""
    from trackloom.operators.tracking import link_detections

    return link_detections(_detections(t), max_distance=10.0).select("file_id", "row_id", "worm_index_blob")


__all__ = ["ORACLE", "QUERIES"]

from trackloom.plans import file_queries, route_queries, shape_queries, table_queries  # noqa: E402, F401  register more queries
