"""Readers: file discovery, text logs, metadata, event tables; NaN becomes NULL here."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: File name endings of intermediate results, which discovery leaves out.
RESERVED = ("_skeletons", "_features", "_featuresN", "_intensities", "_feat_manual", "_subsample", "_trajectories", "_wcon")


def find_files(spark: SparkSession, root: str, include: str = "*", exclude: Sequence[str] = RESERVED) -> DataFrame:
    """(path, name, bytes) of the files under ``root`` whose name matches ``include``, without reserved endings.

    Of a folder of numbered images only the first of each extension stands for all.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", include).load(root).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    files = files.withColumn("name", name).withColumn("_stem", F.regexp_replace("name", r"\.[^.]*$", ""))
    if exclude:
        files = files.where(~F.col("_stem").rlike("(" + "|".join(exclude) + ")$"))
    image = F.lower("name").rlike(r"\d+\.(png|jpe?g|tiff?|bmp)$")
    group = F.when(image, F.concat_ws("|", F.regexp_replace("path", r"[^/]*$", ""), F.regexp_extract(F.lower("name"), r"\.([^.]*)$", 1))).otherwise(F.col("path"))
    return files.groupBy(group.alias("_g")).agg(F.min_by(F.struct("path", "name", F.col("length").alias("bytes")), "path").alias("f")).select("f.*")


def manifest(files: DataFrame) -> DataFrame:
    """Adds file_id: the rank of the path, from 0."""
    return files.withColumn("file_id", F.row_number().over(Window.orderBy("path")) - 1)


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """Paths from a text file, one a line; blank lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, missing: str | None = None) -> DataFrame:
    """A Parquet table with NaN as NULL; only ``columns`` are read.

    Where there is no table at ``path``, an empty one of schema ``missing`` stands for it, if that is given.
    """
    if missing is not None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return spark.createDataFrame([], missing)
    df = spark.read.parquet(path)
    return nan_to_null(df.select(*columns) if columns else df)


#: Endings of the files that summaries of a family of features are made of.
SUMMARY_INPUTS = {"current": "_featuresN", "legacy": "_features"}


def summary_inputs(spark: SparkSession, root: str, family: str, extension: str = "*") -> DataFrame:
    """(path, name, bytes) of the files under ``root`` that hold a family's features, numbered by path."""
    return manifest(find_files(spark, root, f"*{SUMMARY_INPUTS[family]}.{extension}", ()))


def nan_to_null(df: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema}
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast(t)) for c, t in kinds.items() if isinstance(t, (T.DoubleType, T.FloatType))})


def frame_metadata(lines: DataFrame, keys: Sequence[str], line: str = "line") -> DataFrame:
    """``a=1|b=2`` lines as (keys, name, value); N/A becomes NULL."""
    pairs = F.explode(F.str_to_map(F.col(line), F.lit(r"\|"), F.lit("=")))
    return lines.select(*keys, pairs.alias("name", "value")).withColumn("value", F.expr("try_cast(value AS double)"))


def timestamps(frames: DataFrame, keys: Sequence[str], order: str, seconds: str) -> DataFrame:
    """Adds timestamp_raw: whole ticks of the smallest positive step since the first frame; NULL where unknown."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.col(seconds) - F.lag(seconds).over(w)
    least = frames.withColumn("_d", step).where("_d > 0").groupBy(*keys).agg(F.min("_d").alias("_tick"))
    first = F.first(seconds, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return frames.withColumn("_t0", first).join(least, list(keys), "left").withColumn("timestamp_raw", F.rint((F.col(seconds) - F.col("_t0")) / F.col("_tick")).cast("bigint")).drop("_t0", "_tick")


def frame_rate(frames: DataFrame, keys: Sequence[str], order: str, seconds: str) -> DataFrame:
    """(keys, fps): 1 over the median step between frames; NULL if that is under 1 or unknown."""
    w = Window.partitionBy(*keys).orderBy(order)
    fps = F.try_divide(F.lit(1.0), F.median("_d"))
    return frames.withColumn("_d", F.col(seconds) - F.lag(seconds).over(w)).groupBy(*keys).agg(F.when(fps >= 1, fps).alias("fps"))


def resolved_rate(meta: DataFrame) -> DataFrame:
    """fps from measured, then stored, then expected rates, else 1; at 1 the unit of time is frames."""
    fps = F.coalesce(*(F.when(F.col(c) >= 1, F.col(c)) for c in ("measured_fps", "fps", "expected_fps")), F.lit(1.0))
    return meta.withColumn("fps", fps).withColumn("time_units", F.when(fps == 1, "frames").otherwise("seconds"))


def clock_seconds(text: Column) -> Column:
    """``H:M:S`` in seconds."""
    return F.aggregate(F.split(text, ":"), F.lit(0.0), lambda s, x: s * 60 + x.cast("double"))


def stage_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, real_time, stage_time, stage_x, stage_y) of comma separated logs; the header may be on any line.

    Lines before it, and lines with fewer fields than it, are left out.
    """
    lines = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.split("value", "\r?\n").alias("lines"))
    fields = F.transform("lines", lambda x: F.transform(F.split(x, ","), lambda f: F.trim(f)))
    lines = lines.select("file", F.posexplode(fields).alias("at", "f"))
    head = F.array_contains(F.transform("f", lambda x: F.lower(x)), "stage position x")
    w = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("_head", F.last(F.when(head, F.transform("f", lambda x: F.lower(x))), ignorenulls=True).over(w))
    lines = lines.where("_head is not null and size(f) >= size(_head)")
    get = lambda name: F.try_element_at("f", F.array_position("_head", name).cast("int"))
    return lines.select("file", get("real time").alias("real_time"), clock_seconds(get("media time")).alias("stage_time"), get("stage position x").cast("double").alias("stage_x"), get("stage position y").cast("double").alias("stage_y"))


#: The unit and axis of each number of a calibration document.
CALIBRATION = {"microns_x": ("microns-per-unit", "x"), "microns_y": ("microns-per-unit", "y"), "pixels_x": ("pixels-per-unit", "x"), "pixels_y": ("pixels-per-unit", "y")}


def calibration_numbers(xml: str) -> list[float]:
    """The numbers that the paths ``//unit/axis/text()`` of ``CALIBRATION`` have in XPath, all in one pass: those of the
    first text that each path finds, NaN where there is none or it is no number.  Prefixes of names do not count."""
    names = {v: k for k, v in enumerate(CALIBRATION.values())}
    stack, found, text = [], {}, []

    def text_ends() -> None:
        if text:
            found.setdefault(tuple(stack[-2:]), "".join(text))
            text.clear()

    def start(name: str, _: dict) -> None:
        text_ends()
        stack.append(name.rpartition(":")[2])

    def end(_: str) -> None:
        text_ends()
        stack.pop()

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text.append
    parser.CommentHandler = parser.ProcessingInstructionHandler = lambda *_: text_ends()
    parser.Parse(xml, True)
    out = [math.nan] * len(names)
    for path, k in names.items():
        value = found.get(path, "").strip(" \t\r\n")
        if re.fullmatch(r"-?([0-9]+\.?[0-9]*|\.[0-9]+)", value):
            out[k] = float(value)
    return out


def calibration(xml: Column) -> dict[str, Column]:
    """Microns per step and pixel from a calibration document; NaN where it has none."""

    @F.arrow_udf(", ".join(f"{c} double" for c in CALIBRATION))
    def numbers(documents: pa.Array) -> pa.Array:
        rows = [calibration_numbers(d) if d else None for d in documents.to_pylist()]
        columns = zip(*(r or [None] * len(CALIBRATION) for r in rows), strict=True) if rows else [()] * len(CALIBRATION)
        return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns], list(CALIBRATION))

    all_ = numbers(xml)
    return {c: all_[c] for c in CALIBRATION}


def sidecars(files: DataFrame, others: DataFrame, suffix: str) -> DataFrame:
    """Adds the path of ``<stem><suffix>`` next to a file or in its ``.data`` folder."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    in_data = F.regexp_replace(stem, r"/([^/]*)$", "/.data/$1")
    a, b = (others.select(F.col("path").alias(f"_{n}"), F.col("path").alias(f"{n}_found")) for n in ("near", "data"))
    out = files.withColumn("_near", F.concat(stem, F.lit(suffix))).withColumn("_data", F.concat(in_data, F.lit(suffix)))
    return out.join(a, "_near", "left").join(b, "_data", "left").withColumn("sidecar", F.coalesce("near_found", "data_found")).drop("_near", "_data", "near_found", "data_found")


def ini_values(text: Column) -> Column:
    """``key = value`` lines as a map; sections and comments are left out."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: x.rlike(r"^\s*[^\[#;=\s][^=]*="))
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)), F.trim(F.substring(x, F.instr(x, "=") + 1, F.length(x))))))


def feature_names(spark: SparkSession, path: str) -> DataFrame:
    """(name) from a headerless list, one a line; a byte order mark is left out."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "^﻿", "")).alias("name")).where("name <> ''")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="feat_name_table string, feat_name_obj string, is_time_series int, is_signed int, units string")


def event_values(df: DataFrame, name: str = "feature", renames: dict[str, str] | None = None) -> DataFrame:
    """Ragged events (keys, feature, pos, value) with old feature names (patterns of ``renames``) in their present form."""
    out = F.col(name)
    for pattern, new in (renames or {}).items():
        out = F.regexp_replace(out, pattern, new)
    return nan_to_null(df.withColumn(name, out))
