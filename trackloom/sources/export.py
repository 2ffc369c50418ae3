"""Writers: CSV pairs, WCON documents, provenance, tables that are replaced as a whole."""

from __future__ import annotations

import json
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that ``spark.checkpoint.dir`` names; only a local session may leave the setting out."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = f"file://{tempfile.gettempdir()}/trackloom-scratch"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def append(df: DataFrame, path: str, partition: Sequence[str] = ("file_id",)) -> None:
    """Adds rows to a table that is partitioned by file."""
    df.write.mode("append").partitionBy(*partition).parquet(path)


def replace(df: DataFrame, path: str, partition: Sequence[str] = (), attributes: dict[str, object] | None = None) -> None:
    """Replaces a table; with ``partition`` only the partitions that occur in ``df``.

    A whole table is written next to the old one and then takes its name, so that readers see the one or the other.
    Its attributes go along in columns' metadata: those of ``df`` stay, and ``attributes`` are added to the first column.
    """
    if attributes:
        first = df.columns[0]
        df = df.withMetadata(first, {**df.schema[first].metadata, **attributes})
    if partition:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)
        return
    new = f"{path.rstrip('/')}.new-{uuid.uuid4().hex[:8]}"
    df.write.parquet(new)
    jvm = df.sparkSession.sparkContext._jvm
    to, source = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(new)
    fs = to.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(to):
        fs.delete(to, True)
    fs.rename(source, to)


def attributes(df: DataFrame) -> dict[str, object]:
    """Attributes that :func:`replace` keeps with a table."""
    return dict(df.schema[0].metadata)


def write_csv_pair(summary: DataFrame, files: DataFrame, folder: str, family: str, level: str, window: int | None = None) -> tuple[str, str]:
    """Writes features_* and filenames_* with names that carry the selection; returns both paths.

    A summary has a row for each file or track, so that one CSV part holds it.
    """
    tag = f"{family}_{level}" + ("" if window is None else f"_window_{window}")
    paths = (f"{folder}/features_summary_{tag}", f"{folder}/filenames_summary_{tag}")
    for df, path in zip((summary, files), paths, strict=True):
        df.coalesce(1).write.mode("overwrite").csv(path, header=True)
    return paths


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """What is plotted, as CSV with a header."""
    (df.select(*columns) if columns else df).write.mode("overwrite").csv(path, header=True)


def significant(x: Column, digits: int) -> Column:
    """``x`` with so many significant digits."""
    size = F.when(x == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(x))))
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - size)
    return F.rint(x * scale) / scale


def wcon_data(df: DataFrame, keys: Sequence[str], time: Column, points: str = "skeleton", ventral: str | None = None, dorsal: str | None = None) -> DataFrame:
    """One WCON data record of JSON for each track: id, t, x and y in the order of time; missing poses are null.

    With contours, px and py run along the ventral side and back along the dorsal one.
    """
    row = {"t": time, "x": F.transform(points, lambda p: p["x"]), "y": F.transform(points, lambda p: p["y"])}
    if ventral and dorsal:
        ring = F.concat(F.col(ventral), F.reverse(F.col(dorsal)))
        row |= {"px": F.transform(ring, lambda p: p["x"]), "py": F.transform(ring, lambda p: p["y"])}
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*(v.alias(k) for k, v in row.items())))).alias("r"))
    pick = lambda k: F.transform("r", lambda r: r[k]).alias(k)
    fields = [F.array_join(F.array(*(F.col(k).cast("string") for k in keys)), "/").alias("id"), *(pick(k) for k in row)]
    return rows.select(*keys, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"))


#: Fields that the standard names.
WCON_STANDARD = ("id", "lab", "who", "timestamp", "temperature", "humidity", "arena", "food", "media", "sex", "stage", "age", "strain", "protocol", "interpolate", "software", "settings")


def wcon_metadata(meta: dict[str, object], standard: Sequence[str] = WCON_STANDARD) -> str:
    """Metadata with what the standard does not name under ``@OMG``."""
    out: dict[str, object] = {k: v for k, v in meta.items() if k in standard and v is not None}
    if other := {k: v for k, v in meta.items() if k not in standard and v is not None}:
        out["@OMG"] = other
    return json.dumps(out, sort_keys=True)


def wcon_metadata_column(columns: dict[str, Column], standard: Sequence[str] = WCON_STANDARD) -> Column:
    """The metadata of each row as JSON: standard fields, and others under ``@OMG``; NULLs are left out."""
    other = {k: v for k, v in sorted(columns.items()) if k not in standard}
    fields = [v.alias(k) for k, v in sorted(columns.items()) if k in standard]
    if other:
        some = F.coalesce(*(v.cast("string") for v in other.values())).isNotNull()
        fields.insert(0, F.when(some, F.struct(*(v.alias(k) for k, v in other.items()))).alias("@OMG"))
    return F.to_json(F.struct(*fields))


#: Units of the WCON columns.
WCON_UNITS = {"t": "seconds", "x": "micrometers", "y": "micrometers", "px": "micrometers", "py": "micrometers"}


def write_wcon(records: DataFrame, metadata: dict[str, object], path: str) -> None:
    """A WCON document (records of :func:`wcon_data`) of one file, zipped.

    The records of a file are one document, which one task writes; files are exported one by one.
    """
    parts = (r[0] for r in records.select("record").toLocalIterator())
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, z.open(path.rsplit("/", 1)[-1].removesuffix(".zip"), "w", force_zip64=True) as out:
        out.write(f'{{"units": {json.dumps(WCON_UNITS)}, "metadata": {wcon_metadata(metadata)}, "data": ['.encode())
        for k, part in enumerate(parts):
            out.write((", " if k else "").encode() + part.encode())
        out.write(b"]}")


def provenance(spark, file_id: int, point: str, func: str, args: dict, versions: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(file_id, point, func, json.dumps(args, sort_keys=True), versions)], "file_id int, point string, func string, args_json string, versions map<string,string>")


def provenance_rows(files: DataFrame, point: Column | str, func: Column | str, args: dict[str, Column], versions: dict[str, str]) -> DataFrame:
    """Records of a step for every row of ``files`` (file_id): its arguments are columns, kept as JSON in order of name."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    given = F.to_json(F.struct(*(v.alias(k) for k, v in sorted(args.items())))) if args else F.lit("{}")
    noted = F.create_map(*(F.lit(x) for kv in sorted(versions.items()) for x in kv)).cast("map<string,string>")
    return files.select(F.col("file_id").cast("int").alias("file_id"), lit(point).alias("point"), lit(func).alias("func"), given.alias("args_json"), noted.alias("versions"))


def egg_events(df: DataFrame, keys: Sequence[str], frame: str) -> DataFrame:
    """(keys, frames): distinct frames in ascending order, joined by tabs; what is no number is left out."""
    value = F.expr(f"try_cast({frame} AS bigint)")
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_set(value)), lambda x: x.cast("string")), "\t").alias("frames"))
