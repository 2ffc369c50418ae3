"""Registered queries of readers and writers: what is written to the shared folder is read back by the operator."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from trackloom.functions import kernels
from trackloom.operators import tracking as K
from trackloom.plans import stages
from trackloom.plans.registry import FRAMES, frames, query, rounded
from trackloom.plans.route_queries import BY_FRAME, TRACK
from trackloom.sources import export, ingest


def _folder(t) -> str:
    return export.shared_folder(t.spark, "files")


@query("SELECT lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':00' AS real_time, (o_custkey % 3 * 3600 + o_orderkey % 60 * 60 + o_custkey % 60)::DOUBLE AS stage_time, round(o_totalprice, 1) AS stage_x, o_custkey::DOUBLE AS stage_y FROM orders WHERE o_orderkey % 10 > 0")
def stage_logs(t):
    """SRC-16: logs with their header on the second line; every tenth line lacks fields."""
    o = t("orders")
    clock = F.concat_ws(":", *((F.col(c) % n).cast("string") for c, n in (("o_custkey", 3), ("o_orderkey", 60), ("o_custkey", 60))))
    head = F.concat(F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":00,"), clock)
    line = F.when(F.col("o_orderkey") % 10 == 0, head).otherwise(F.concat(head, F.lit(","), rounded(F.col("o_totalprice"), 1).cast("decimal(20,1)").cast("string"), F.lit(","), F.col("o_custkey").cast("string")))
    # A log holds some ten thousand lines, so that more orders make more logs, not longer ones.
    logs = o.groupBy(F.floor(F.col("o_orderkey") / 20_000).alias("part")).agg(F.array_join(F.collect_list(line), "\n").alias("rows"))
    text = F.concat(F.lit("made by hand\nReal Time,Media Time,Stage Position X,Stage Position Y\n"), "rows")
    where = _folder(t)
    logs.select("part", text.alias("value")).write.partitionBy("part").text(where)
    return ingest.stage_log(t.spark, f"{where}/*").select("real_time", "stage_time", "stage_x", "stage_y")


@query("SELECT '/data/' || p_partkey || '.avi' AS path FROM part")
def file_lists(t):
    """SRC-03: paths of a text file, without blank lines."""
    where = _folder(t)
    t("part").select(F.concat(F.lit(" /data/"), F.col("p_partkey").cast("string"), F.lit(".avi \n")).alias("value")).write.text(where)
    return ingest.file_list(t.spark, where)


@query("SELECT n_name AS name FROM nation")
def feature_lists(t):
    """SRC-22: names of a headerless list with a byte order mark."""
    where = _folder(t)
    t("nation").select(F.concat(F.lit("﻿"), "n_name").alias("value")).write.text(where)
    return ingest.feature_names(t.spark, where)


@query("SELECT 'f' || p_partkey AS feat_name_table, p_name AS feat_name_obj, (p_size % 2)::INT AS is_time_series, (p_size % 3 = 0)::INT AS is_signed, p_type AS units FROM part")
def feature_catalogue(t):
    """SRC-23: the typed catalogue of features."""
    where = _folder(t)
    rows = t("part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("feat_name_table"), F.col("p_name").alias("feat_name_obj"), (F.col("p_size") % 2).alias("is_time_series"), (F.col("p_size") % 3 == 0).cast("int").alias("is_signed"), F.col("p_type").alias("units"))
    export.write_csv(rows, where)
    return ingest.read_catalogue(t.spark, where)


@query("SELECT event_id, CASE WHEN event_id % 4 > 0 THEN value END AS value FROM events")
def tables_by_path(t):
    """SRC-20: a table with NaN as NULL; where there is none, an empty one."""
    where = _folder(t)
    t("events").select("event_id", "ts", F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value")).write.parquet(f"{where}/there")
    both = [ingest.read_table(t.spark, f"{where}/{n}", ["event_id", "value"] if n == "there" else None, missing="event_id bigint, value double") for n in ("there", "gone")]
    return both[0].unionByName(both[1])


@query("SELECT s_nationkey AS file_id, s_suppkey, s_acctbal FROM supplier UNION ALL SELECT s_nationkey, s_suppkey, -s_acctbal FROM supplier WHERE s_suppkey % 2 = 0")
def appended_tables(t):
    """SNK-01: rows added to a table by file."""
    where = _folder(t)
    s = t("supplier").select(F.col("s_nationkey").alias("file_id"), "s_suppkey", "s_acctbal")
    export.append(s, where)
    export.append(s.where("s_suppkey % 2 = 0").withColumn("s_acctbal", -F.col("s_acctbal")), where)
    return t.spark.read.parquet(where).select("file_id", "s_suppkey", "s_acctbal")


@query("SELECT c_custkey, c_acctbal * 2 AS c_acctbal, 25 AS fps FROM customer")
def replaced_tables(t):
    """SNK-02: a table replaced as a whole, with its attributes."""
    where = _folder(t)
    c = t("customer").select("c_custkey", "c_acctbal")
    export.replace(c, f"{where}/table", attributes={"fps": 25})
    old = t.spark.read.parquet(f"{where}/table")
    export.replace(old.withMetadata("c_custkey", old.schema["c_custkey"].metadata).withColumn("c_acctbal", F.col("c_acctbal") * 2), f"{where}/next")
    new = t.spark.read.parquet(f"{where}/next")
    return new.withColumn("fps", F.lit(int(export.attributes(new)["fps"])))


@query("SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def csv_pairs(t):
    """SNK-04, SNK-09: a pair of CSVs, whose names carry what was selected, read back and joined."""
    where = _folder(t)
    a, b = export.write_csv_pair(t("nation").select("n_nationkey", "n_name", "n_regionkey"), t("region").select("r_regionkey", "r_name"), where, "current", "plate", 3)
    if not (a.endswith("features_summary_current_plate_window_3") and b.endswith("filenames_summary_current_plate_window_3")):
        raise ValueError("the names do not carry the selection")
    n = t.spark.read.csv(a, header=True, schema="n_nationkey int, n_name string, n_regionkey int")
    return n.join(t.spark.read.csv(b, header=True, schema="r_regionkey int, r_name string"), F.col("n_regionkey") == F.col("r_regionkey")).drop("r_regionkey")


@query("SELECT s_suppkey::INT AS file_id, 'TRAJ_' || CASE WHEN s_nationkey % 2 = 0 THEN 'CREATE' ELSE 'JOIN' END AS point, 'link' AS func, '{\"area\":' || s_nationkey || ',\"name\":\"' || s_name || '\"}' AS args_json, '1.0' AS version FROM supplier")
def provenance_records(t):
    """SNK-11: a record of a step, with its arguments, for every file."""
    s = t("supplier").withColumn("file_id", F.col("s_suppkey"))
    point = F.concat(F.lit("TRAJ_"), F.when(F.col("s_nationkey") % 2 == 0, "CREATE").otherwise("JOIN"))
    rows = export.provenance_rows(s, point, "link", {"name": F.col("s_name"), "area": F.col("s_nationkey")}, {"x": "1.0"})
    return rows.select("file_id", "point", "func", "args_json", F.try_element_at("versions", F.lit("x")).alias("version"))


@query("SELECT c_custkey, '{' || CASE WHEN c_custkey % 3 > 0 THEN '\"@OMG\":{\"fps\":' || c_nationkey || '},' ELSE '' END || '\"lab\":\"' || c_mktsegment || '\"' || CASE WHEN c_custkey % 5 > 0 THEN ',\"who\":\"' || c_name || '\"' ELSE '' END || '}' AS metadata FROM customer")
def document_metadata(t):
    """SNK-06: metadata in standard fields, others under a key of their own, without what is missing."""
    c = t("customer")
    text = export.wcon_metadata_column({"who": F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")), "lab": F.col("c_mktsegment"), "fps": F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey"))})
    return c.select("c_custkey", text.alias("metadata"))


@query("SELECT event_id, round(0.75::DOUBLE * value / 100 + 0.15::DOUBLE * (user_id % 10) / 10 + 0.10::DOUBLE * (event_id % 7) / 7, 9) AS p FROM events")
def orientation_scores(t):
    """TRK-11: evidence of head and tail, weighted."""
    p = K.orientation_probability(F.col("value") / 100, F.col("user_id") % 10 / 10, F.col("event_id") % 7 / 7)
    return t("events").select("event_id", rounded(p, 9).alias("p"))


def _gradient_sql(width: int) -> str:
    w = f"({BY_FRAME})"
    inner = " ".join(f"WHEN r = {k} THEN (lead(value, {k}) OVER {w} - lag(value, {k}) OVER {w}) / {2 * k}" for k in range(1, width + 1))
    return f"WITH {FRAMES}, e AS (SELECT *, least(frame - 1, count(*) OVER (PARTITION BY user_id) - frame, {width}) AS r FROM f) SELECT event_id, round(CASE WHEN r = 0 AND frame = 1 THEN lead(value) OVER {w} - value WHEN r = 0 THEN value - lag(value) OVER {w} {inner} END, 6) AS g FROM e"


@query(_gradient_sql(4))
def wide_gradient(t):
    """WIN-26: differences over a wide stencil that narrows at the ends."""
    out = kernels.with_tracks(frames(t).select("user_id", "frame", "event_id", "value"), TRACK.keys, TRACK.order, ["value"], lambda p: {"g": kernels.wide_gradient(p["value"].to_numpy(float), 4)}, {"g": "double"})
    return out.select("event_id", rounded(F.col("g")).alias("g"))


@query(f"""WITH {FRAMES}, s AS (SELECT *, sign(value - 50) AS s, lag(sign(value - 50)) OVER ({BY_FRAME}) AS p FROM f), c AS (SELECT *, CASE WHEN p IS NOT NULL AND s <> p AND s <> 0 THEN frame - 1 END AS pos FROM s)
SELECT event_id, coalesce(max(pos) OVER ({BY_FRAME} ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), -1)::BIGINT AS before, coalesce(min(pos) OVER ({BY_FRAME} ROWS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING), -1)::BIGINT AS after FROM c""")
def zero_crossings(t):
    """WIN-25: sign changes around each sample, a distance away."""

    def run(pdf: pd.DataFrame) -> dict:
        a, b = kernels.zero_crossings(pdf["value"].to_numpy(float) - 50, 2)
        return {"before": a, "after": b}

    return kernels.with_tracks(frames(t).select("user_id", "frame", "event_id", "value"), TRACK.keys, TRACK.order, ["value"], run, {"before": "bigint", "after": "bigint"}).select("event_id", "before", "after")


_STEPS = "s(analysis, names) AS (VALUES " + ", ".join(f"('{a}', [" + ", ".join(f"'{n}'" for n in names) + "])" for a, names in stages.ANALYSES.items()) + ")"


@query(f"""WITH {_STEPS}, f AS (SELECT o_orderkey AS file_id, CASE o_orderstatus WHEN 'F' THEN 'CURRENT' WHEN 'O' THEN 'LEGACY' WHEN 'P' THEN 'SINGLE' ELSE 'NONE' END AS analysis, CASE WHEN o_custkey % 3 = 0 THEN 'SKE_INIT' WHEN o_custkey % 3 = 1 THEN '' ELSE 'SKE_FILT' END AS a, CASE WHEN o_custkey % 5 = 0 THEN 'BLOB_FEATS' WHEN o_custkey % 5 = 1 THEN 'INT_PROFILE' END AS b FROM orders),
p AS (SELECT f.*, names, CASE WHEN a = '' THEN 1 ELSE list_position(names, a) END AS i, CASE WHEN b IS NULL THEN len(names) ELSE list_position(names, b) END AS j FROM f LEFT JOIN s USING (analysis)),
x AS (SELECT file_id, unnest(range(i, j + 1)) AS k, i, names FROM p WHERE i > 0 AND j >= i)
SELECT file_id, (k - i)::INT AS place, names[k] AS step FROM x UNION ALL SELECT file_id, NULL, NULL FROM p WHERE NOT coalesce(i > 0 AND j >= i, false)""")
def step_lists(t):
    """ORC-01, SEL-20: the steps of every file's analysis between two of them."""
    kind = F.when(F.col("o_orderstatus") == "F", "CURRENT").when(F.col("o_orderstatus") == "O", "LEGACY").when(F.col("o_orderstatus") == "P", "SINGLE").otherwise("NONE")
    a = F.when(F.col("o_custkey") % 3 == 0, "SKE_INIT").when(F.col("o_custkey") % 3 == 1, "").otherwise("SKE_FILT")
    b = F.when(F.col("o_custkey") % 5 == 0, "BLOB_FEATS").when(F.col("o_custkey") % 5 == 1, "INT_PROFILE")
    return stages.planned_steps(t("orders").select(F.col("o_orderkey").alias("file_id"), kind.alias("analysis"), a.alias("start"), b.alias("end")))


@query("""SELECT p_partkey, (p_size + 10)::DOUBLE AS expected_fps, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 50 END::INT AS min_area, CASE WHEN p_size % 3 = 0 THEN p_size ELSE 1 END::INT AS min_frames,
0.25::DOUBLE AS smooth_window_s, CASE WHEN p_size % 7 = 0 THEN 11 ELSE 200 * (p_size + 10) END::INT AS save_interval_frames, CASE WHEN p_size % 5 = 0 THEN 'speed' ELSE '' END AS unknown FROM part""")
def resolved_parameters(t):
    """ORC-02, ORC-03: parameters of every file from JSON with old names, and what follows from the frame rate."""
    size = F.col("p_size")
    given = {"fps": size + 10, "min_area": F.when(size % 2 == 0, size), "min_num_skel": F.when(size % 3 == 0, size), "save_interval_frames": F.when(size % 7 == 0, 11), "speed": F.when(size % 5 == 0, 1)}
    files = t("part").select("p_partkey", F.to_json(F.struct(*(v.alias(k) for k, v in given.items()))).alias("parameters"), (size + 10).alias("fps"))
    out = stages.resolved_parameters(files)
    return out.select("p_partkey", "expected_fps", "min_area", "min_frames", "smooth_window_s", "save_interval_frames", F.array_join("unknown", ",").alias("unknown"))


@query("SELECT user_id, CASE WHEN min(value) >= 0.5 THEN round(sum(value), 4) END AS total, CASE WHEN min(value) < 0.5 THEN 'ValueError: too small' END AS error FROM events GROUP BY user_id")
def isolated_groups(t):
    """ORC-11: groups whose kernel fails give an error, and stop no other."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["value"].min() < 0.5:
            raise ValueError("too small")
        return pd.DataFrame({"user_id": [pdf["user_id"].iloc[0]], "total": [pdf["value"].sum()]})

    out = stages.isolated(t("events").select("user_id", "value"), ["user_id"], kernel, "user_id bigint, total double")
    return out.select("user_id", rounded(F.col("total"), 4).alias("total"), "error")


@query("SELECT p_partkey, p_size + 1 AS size FROM part WHERE p_size > 10")
def staged_plan(t):
    """UDF-1, UDF-9, ORC-05: stages over named tables, one with a step before it."""
    plan = stages.Plan([stages.Stage("LARGE", ("parts",), "large", lambda p: p.where("p_size > 10")), stages.Stage("SIZE", ("large",), "sizes", lambda p: p.select("p_partkey", (F.col("p_size") + 1).alias("size")), before=lambda p: p.select("p_partkey", "p_size"))], {"parts": t("part")})
    return plan.run()["sizes"]
