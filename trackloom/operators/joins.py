"""Joins by range, nearness and position, as equi-joins on buckets or windows wherever the plan allows it."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trackloom.functions.kernels import link_frame
from trackloom.sources.export import shared_folder

#: Largest side that is sent to all tasks; beyond it a join goes by bucket or shuffle.
BROADCAST_ROWS = 100_000
#: Most windows with which every row is compared; more meet the rows in buckets.
FEW_WINDOWS = 100


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, which is counted."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) <= rows else df


def spread(df: DataFrame, keys: Sequence[str], rows: int = 500_000) -> DataFrame:
    """``df`` by ``keys`` in as many partitions as hold about ``rows`` rows each, which are counted, so that a task does not
    grow with its input."""
    parts = -(-df.count() // rows)
    return df.repartition(parts, *keys) if parts > 1 else df


def window_join(df: DataFrame, windows: DataFrame, at: str, start: str = "start", end: str = "end") -> DataFrame:
    """Rows with every half-open window [start, end) they lie in; a NULL end is open.

    Up to ``FEW_WINDOWS`` windows are broadcast.  More meet the rows in buckets as wide as the next power of two over a
    window's own width, so that each window lies in two buckets at most, however unlike the widths are; a row is looked up
    once for each power that occurs.
    """
    inside = (F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    few = windows.limit(FEW_WINDOWS + 1).count() <= FEW_WINDOWS
    if few:
        return df.join(F.broadcast(windows), inside)
    # Time stamps and dates are counted in seconds.
    number = lambda df, c: F.col(c).cast("timestamp").cast("double") if isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.col(c).cast("double")
    bounds = windows.agg(F.max(number(windows, end)), F.max(number(windows, start))).first()
    last = max(float(b or 0) for b in bounds)
    # Beyond the last bound there are only open windows, which end just after it for the buckets.
    first, stop = number(windows, start), F.coalesce(number(windows, end), F.lit(last + 1.0))
    windows = windows.withColumn("_power", F.ceil(F.log2(F.greatest(stop - first, F.lit(1e-6)))).cast("int")).where(stop > first)
    size = F.pow(F.lit(2.0), F.col("_power"))
    windows = windows.withColumn("_bucket", F.explode(F.array_distinct(F.array(F.floor(first / size), F.floor(stop / size)))))
    powers = [r[0] for r in windows.select("_power").distinct().collect()]
    if not powers:
        return df.limit(0).join(windows.drop("_power", "_bucket"))
    held = F.least(number(df, at), F.lit(last + 0.5))
    rows = df.withColumn("_power", F.explode(F.array(*map(F.lit, powers)))).withColumn("_bucket", F.floor(held / F.pow(F.lit(2.0), F.col("_power"))))
    return rows.join(windows, ["_power", "_bucket"]).where(inside).drop("_power", "_bucket")


def nearest_links(points: DataFrame, keys: Sequence[str], frame: str, row: str, x: str, y: str, size: str, max_distance: float, ratio: tuple[float, float]) -> DataFrame:
    """(keys, row, previous): which point of the frame before each point continues, by :func:`kernels.link_frame`.

    Frames are compared with the one before that exists.  A frame is one row of arrays next to the frame before, and
    numpy compares the two, so that pairs of points are never rows.  Points without a link are absent.
    """
    point = F.struct(F.col(row).alias("r"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(size).cast("double").alias("s"))
    whole = points.groupBy(*keys, frame).agg(F.sort_array(F.collect_list(point)).alias("cur"))
    whole = whole.withColumn("prev", F.lag("cur").over(Window.partitionBy(*keys).orderBy(frame))).where("prev is not null").select(*keys, "cur", "prev")
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("cur", "prev"):
                lists = batch.column(name)
                values = lists.values
                numbers = [pc.fill_null(values.field(k), np.nan).to_numpy(zero_copy_only=False) for k in ("x", "y", "s")]
                sides.append((lists.offsets.to_numpy(), numbers, values.field("r")))
            (c, cur, rows), (p, prev, before) = sides
            at, found = [], []
            for i in range(batch.num_rows):
                pick = link_frame(tuple(v[p[i] : p[i + 1]] for v in prev), tuple(v[c[i] : c[i + 1]] for v in cur), max_distance, ratio)
                good = np.flatnonzero(pick >= 0)
                at.append(np.column_stack((np.full(len(good), i), c[i] + good, p[i] + pick[good])))
            found = np.concatenate(at) if at else np.zeros((0, 3), np.int64)
            take = lambda a, k: a.take(pa.array(found[:, k]))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([*(take(batch.column(k), 0) for k in keys), take(rows, 1), take(before, 2)], [*keys, row, "previous"])

    return whole.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{row} {kinds[row]}", f"previous {kinds[row]}"]))


def _table(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage of an iteration by a reliable checkpoint, where the session names a folder for it."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession, name))
    return df.checkpoint()


def _first_cell(n: float, wide: float, high: float, most: float) -> float:
    """The width of square cells of which ``n`` cover a rectangle, at most ``most``."""
    if n <= 1 or wide + high <= 0:
        return most
    per = (math.sqrt((wide + high) ** 2 + 4 * wide * high * (n - 1)) - wide - high) / (2 * wide * high) if wide * high > 0 else (n - 1) / (wide + high)
    return min(most, 1 / per) if per > 0 else most


def gap_links(tracks: DataFrame, keys: Sequence[str], track: str, max_gap: int, ratio: tuple[float, float], min_rows: int = 1) -> DataFrame:
    """(keys, track, previous): the earlier track that each later one continues across a gap.

    ``tracks`` has start, end, n, and x, y, size at both ends (x0.. and x1..), and reach, the largest distance.  A start
    counts if end < start <= end + ``max_gap`` and lo < size1 / size0 < hi.  Each track takes the nearest (ties:
    smallest id) if within its reach; of several that take one successor the largest id stays.  Unknown places link with
    nothing.

    Starts meet ends in buckets of ``max_gap`` frames and in square cells of about eight starts.  An end looks into the
    four cells around it, which hold all that lies within half a cell; those that find nothing there look into cells four
    times as wide, until these exceed their reach.  Equal ends, and equal starts, are one row.
    """
    width = max(1, max_gap)
    long = tracks.where(F.col("n") >= min_rows)
    known = lambda *cols: reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in cols))
    ends = long.where(known("x1", "y1", "size1", "reach")).groupBy(*keys, F.col("end").alias("_end"), "x1", "y1", "size1", "reach").agg(F.max(track).alias("previous"))
    starts = long.where(known("x0", "y0", "size0")).groupBy(*keys, F.col("start").alias("_start"), "x0", "y0", "size0").agg(F.min(track).alias(track))
    starts = _table(starts.withColumn("_b", F.floor(F.col("_start") / width)), "gaps")
    # Ends that no start follows in time would look into all cells for nothing.
    times = ends.select(*keys, F.col("_end").alias("_t"), F.lit(False).alias("_new")).unionByName(starts.select(*keys, F.col("_start").alias("_t"), F.lit(True).alias("_new")))
    times = times.groupBy(*keys, "_t").agg(F.max("_new").alias("_new"))
    later = Window.partitionBy(*keys).orderBy(F.col("_t").desc()).rowsBetween(Window.unboundedPreceding, -1)
    times = times.withColumn("_next", F.last(F.when(F.col("_new"), F.col("_t")), ignorenulls=True).over(later)).where(F.col("_next") <= F.col("_t") + max_gap)
    ends = _table(ends.join(times.select(*keys, F.col("_t").alias("_end")), [*keys, "_end"], "left_semi"), "gaps")

    span = starts.agg(F.count("*"), F.max("x0") - F.min("x0"), F.max("y0") - F.min("y0")).first()
    far, buckets = ends.agg(F.max("reach")).first()[0], starts.select(*keys, "_b").distinct().count()
    share = F.col("size1") / F.nullif(F.col("size0"), F.lit(0))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    ok = (F.col("_end") < F.col("_start")) & (F.col("_start") <= F.col("_end") + max_gap) & (share > ratio[0]) & (share < ratio[1])
    whole = max(4.0 * float(far or 0), 1e-9)
    cell, found = _first_cell(span[0] / (8 * max(1, buckets)), float(span[1] or 0), float(span[2] or 0), whole), None
    while True:
        # A little less than half, so that rounding loses nothing at the cells' borders.
        within = 0.499 * cell
        at = lambda c: F.explode(F.array(*(F.floor(F.col(c) / cell - 0.5) + k for k in (0, 1))))  # noqa: E731, B023
        bucket = F.explode(F.array_distinct(F.array(F.floor(F.col("_end") / width), F.floor(F.col("_end") / width) + 1)))
        looks = ends.withColumn("_b", bucket).withColumn("_cx", at("x1")).withColumn("_cy", at("y1"))
        cells = starts.withColumns({"_cx": F.floor(F.col("x0") / cell), "_cy": F.floor(F.col("y0") / cell)})
        pairs = looks.join(cells, [*keys, "_b", "_cx", "_cy"]).where(ok).withColumn("_d", F.sqrt(dx * dx + dy * dy)).where((F.col("_d") <= within) & (F.col("_d") <= F.col("reach")))
        best = _table(pairs.groupBy(*keys, "previous").agg(F.min_by(track, F.struct("_d", track)).alias(track)), "gaps")
        found = best if found is None else found.unionByName(best)
        ends = _table(ends.where(F.col("reach") > within).join(best, [*keys, "previous"], "left_anti"), "gaps")
        if ends.isEmpty():
            return found.groupBy(*keys, track).agg(F.max("previous").alias("previous"))
        cell = min(4 * cell, whole)


def point_in_rectangle(points: DataFrame, boxes: DataFrame, keys: Sequence[str], x: str, y: str, name: str = "well_name") -> DataFrame:
    """Adds the name of the box (x_min, x_max, y_min, y_max, inclusive) a point is in, or NULL; two boxes are an error.

    ``keys`` must identify a row of ``points`` and include the columns shared with ``boxes``.
    """
    shared = [c for c in keys if c in boxes.columns]
    inside = F.col(x).between(F.col("x_min"), F.col("x_max")) & F.col(y).between(F.col("y_min"), F.col("y_max"))
    box = small(boxes.select(*shared, name, "x_min", "x_max", "y_min", "y_max"))
    on = inside
    if shared:
        box = box.withColumnsRenamed({c: f"_{c}" for c in shared})
        for c in shared:
            on = (F.col(c) == F.col(f"_{c}")) & on
    hits = points.select(*keys, x, y).join(box, on).groupBy(*keys).agg(F.max(name).alias(name), F.count("*").alias("_n"))
    one = F.when(F.col("_n") > 1, F.raise_error(F.lit("a point lies in two boxes"))).otherwise(F.col(name)).cast("string")
    return points.join(hits.select(*keys, one.alias(name)), list(keys), "left")


def as_of(df: DataFrame, facts: DataFrame, keys: Sequence[str], at: str, facts_at: str, values: Sequence[str]) -> DataFrame:
    """Adds, to each row, the values of the last fact at or before it, by one sort of the union of both sides."""
    names = [c for c in df.columns if c not in values]
    left = df.select(*(F.col(c) for c in names), F.lit(1).alias("_side"), F.col(at).alias("_t"), F.lit(None).alias("_fact"))
    fact = F.struct(*(F.col(v) for v in values))
    right = facts.select(*keys, F.lit(0).alias("_side"), F.col(facts_at).alias("_t"), fact.alias("_fact"))
    both = right.unionByName(left, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_fact", F.last("_fact", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(*names, *(F.col("_fact")[v].alias(v) for v in values))


def dense_fill(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """A row for every position between a track's first and last; new rows have NULLs.

    Each row also makes those up to the next one's, so that only rows that are there are shuffled and sorted.
    """
    upto = F.greatest(F.col(at), F.lead(at).over(Window.partitionBy(*keys).orderBy(at)) - 1)
    rows = df.where(F.col(at).isNotNull()).withColumn("_upto", upto).withColumn("_at", F.explode(F.sequence(at, "_upto")))
    own = F.col("_at") == F.col(at)
    for k in keys:
        own &= F.col(k).isNotNull()
    return rows.select(*keys, F.col("_at").alias(at), *(F.when(own, F.col(c)).alias(c) for c in df.columns if c not in (*keys, at)))


def missing_cells(cells: DataFrame, row: str, col: str) -> DataFrame:
    """Lattice cells (row, col) that do not occur although their row and their column do.

    Each row's columns are taken from the list of all columns, so that only missing cells are made.
    """
    have = cells.groupBy(row).agg(F.collect_set(col).alias("_have"))
    every = cells.agg(F.collect_set(col).alias("_all"))
    return have.join(F.broadcast(every), F.lit(True)).select(row, F.explode(F.array_except("_all", "_have")).alias(col))


def in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Whether (x, y) is inside the closed polygon, an array of (x, y): an even-odd fold over its edges."""
    edges = F.zip_with(polygon, F.concat(F.slice(polygon, 2, F.size(polygon) - 1), F.slice(polygon, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(odd: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        left = F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"]
        return odd != F.coalesce(spans & (x < left), F.lit(False))

    return F.aggregate(edges, F.lit(False), crosses)


def edge_distance(x: Column, y: Column, polygon: Column) -> Column:
    """Distance to the nearest vertex of the polygon, negative outside it."""
    nearest = F.array_min(F.transform(polygon, lambda p: F.hypot(p["x"] - x, p["y"] - y)))
    return F.when(in_polygon(x, y, polygon), nearest).otherwise(-nearest)


def with_metadata(df: DataFrame, tables: Sequence[DataFrame], key: str, columns: Sequence[str]) -> DataFrame:
    """Adds ``columns`` from the first of the tables that has a value for the key."""
    for i, t in enumerate(tables):
        df = df.join(small(t.select(F.col(key), *(F.col(c).alias(f"_{i}_{c}") for c in columns if c in t.columns))), key, "left")
    for c in columns:
        df = df.withColumn(c, F.coalesce(*(F.col(f"_{i}_{c}") for i, t in enumerate(tables) if c in t.columns)))
    return df.drop(*(f"_{i}_{c}" for i, t in enumerate(tables) for c in columns if c in t.columns))


def by_position(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str], right_order: Sequence[str] | None = None) -> DataFrame:
    """Rows of two tables with one place in their orders, place by place; the longer side's rest has NULLs."""
    at = lambda cols: F.row_number().over(Window.partitionBy(*keys).orderBy(*cols))
    other = right_order or order
    a, b = left.withColumn("_at", at(order)), right.withColumn("_at", at(other))
    shared = [c for c in right.columns if c in left.columns and c not in keys]
    return a.join(b.drop(*shared), [*keys, "_at"], "full").drop("_at")


def with_shapes(tracks: DataFrame, shapes: DataFrame, keys: Sequence[str], row: str, old_row: str) -> DataFrame:
    """Shapes by the old row id of tracks whose dropped frames were filled; filled rows have NULLs."""
    named = shapes.withColumnRenamed(row, old_row)
    return tracks.join(named, [*keys, old_row], "left")


def in_row_order(assigned: DataFrame, rows: DataFrame, keys: Sequence[str], row: str) -> DataFrame:
    """Assignments of frames put back to their rows; rows without one have NULLs."""
    return rows.join(assigned, [*keys, row], "left")
