"""Near duplicates among vectors: spherical k-means cells, blocked cosine products inside of cells, one kept for each group.

1. Equal vectors become one class with a count, so that exact copies never meet.
2. Spherical k-means on a bounded sample gives unit centres; sums are exact integers, so that reruns agree.
3. Every class is an owner in its nearest cell and a visitor in each cell whose border is near it.  Two linked vectors
   are at most ``sqrt(2 - 2 * threshold)`` apart, so one of them lies within half of that of the border between their
   cells; ``reach`` is the part of this half that is searched.
4. The rows of a cell are dealt to blocks of bounded size, and blocks meet two by two; a meeting is one matrix product.
   It returns the number of links and one link to a common root for each vector, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm._graph import components
from trackloom.llm._shared import Scratch

_STRIP = 512
_UNIT = float(1 << 32)


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column as unit rows in double precision, padded with zeros to ``dim``, and their lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), dim))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    if out.size:
        # The largest component first, so that squares neither overflow nor vanish.
        out /= np.abs(out).max(axis=1, keepdims=True)
        out /= np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out, lengths


def spread_out(centres: np.ndarray, threshold: float) -> np.ndarray:
    """The centres without those that link with an earlier one, so that a crowd of near copies does not hold many cells."""
    kept = np.zeros((0, centres.shape[1]))
    for at in range(0, len(centres), _STRIP):
        some = centres[at : at + _STRIP]
        some = some[~(some @ kept.T >= threshold).any(axis=1)] if len(kept) else some
        near = np.triu(some @ some.T >= threshold, 1)
        stay = np.ones(len(some), bool)
        for i in range(len(some)):
            if stay[i]:
                stay &= ~near[i]
        kept = np.concatenate((kept, some[stay]))
    return kept


def fit_cells(sample: DataFrame, dim: int, cells: int, rounds: int, threshold: float) -> np.ndarray:
    """Unit centres by spherical k-means over ``sample`` (d1, d2, vector); at most ``cells`` rows come to the driver at once."""
    spark = sample.sparkSession
    first = sample.orderBy("d1", "d2").limit(cells).select("vector").toArrow()
    if not first.num_rows:
        return np.zeros((0, dim))
    centres = spread_out(unit_rows(first["vector"], dim)[0], threshold)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = held.value
        sums, counts = np.zeros(now.shape, np.int64), np.zeros(len(now), np.int64)
        for batch in batches:
            rows, _ = unit_rows(batch.column("vector"), dim)
            for at in range(0, len(rows), _STRIP):
                own = np.argmax(rows[at : at + _STRIP] @ now.T, axis=1)
                np.add.at(sums, own, np.rint(rows[at : at + _STRIP] * _UNIT).astype(np.int64))
                counts += np.bincount(own, minlength=len(now))
        has = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array([sums[c].tobytes() for c in has], pa.binary())], ["cell", "total"])

    def total(table: pa.Table) -> pa.Table:
        parts = np.stack([np.frombuffer(x.as_py(), np.int64) for x in table["total"]])
        return pa.table({"cell": table["cell"][:1], "total": pa.array([parts.sum(axis=0).tobytes()], pa.binary())})

    for _ in range(rounds if len(centres) > 1 else 0):
        held = spark.sparkContext.broadcast(centres)
        parts = sample.select("vector").mapInArrow(add, "cell bigint, total binary")
        moved = centres.copy()
        for cell, raw in parts.groupBy("cell").applyInArrow(total, "cell bigint, total binary").collect():
            new = np.frombuffer(raw, np.int64).astype(np.float64)
            if new.any():
                moved[cell] = new / np.linalg.norm(new)
        centres = moved
        held.unpersist()
    return spread_out(centres, threshold)


def _local_roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest row that the links (x, y) reach from each of ``n`` rows."""
    root = np.arange(n)
    while True:
        new = root.copy()
        least = np.minimum(root[x], root[y])
        for at in (x, y, root[x], root[y]):
            np.minimum.at(new, at, least)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _meet(table: pa.Table, dim: int, threshold: float) -> pa.Table:
    """(id, n, root) of the rows that link in this meeting of two blocks of a cell, or of one block with itself."""
    cell, alone = table["cell"][0].as_py(), table["i"][0].as_py() == table["j"][0].as_py()
    ids, home, copies, side = (table[c].to_numpy() for c in ("id", "home", "copies", "side"))
    rows, lengths = unit_rows(table["vector"], dim)
    owner = home == cell
    # A pair of an owner and a visitor that also meets in the visitor's cell counts in the lower of the two.
    lower, code = np.unique(home[home < cell], return_inverse=True)
    codes = np.full(len(ids), len(lower))
    codes[home < cell] = code
    also = table["also"].combine_chunks()
    also = also.chunk(0) if isinstance(also, pa.ChunkedArray) else also
    flat, of = also.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(ids)), np.diff(also.offsets.to_numpy()))
    meets_there = np.zeros((len(ids), len(lower) + 1), bool)
    at = np.minimum(np.searchsorted(lower, flat), max(0, len(lower) - 1))
    hit = (lower[at] == flat) & owner[of] if len(lower) else np.zeros(len(flat), bool)
    meets_there[of[hit], at[hit]] = True
    xs, ys = [], []
    first = np.arange(len(ids)) if alone else np.flatnonzero(side == 0)
    second = first if alone else np.flatnonzero(side == 1)
    for one, two in ((first[owner[first]], second), (first[~owner[first]], second[owner[second]])):
        for start in range(0, len(one), _STRIP):
            p = one[start : start + _STRIP]
            linked = (rows[p] @ rows[two].T >= threshold) & (lengths[p][:, None] == lengths[two][None, :])
            a, b = np.nonzero(linked)
            a, b = p[a], two[b]
            if alone:
                # Owners with owners from one side only; owners with visitors once.
                keep = owner[a] & (~owner[b] | (a < b))
                a, b = a[keep], b[keep]
            own, other = np.where(owner[a], a, b), np.where(owner[a], b, a)
            keep = owner[other] | ~meets_there[own, codes[other]]
            xs.append(a[keep])
            ys.append(b[keep])
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys))
    n = np.bincount(x, copies[y], len(ids)) + np.bincount(y, copies[x], len(ids))
    hit = np.flatnonzero(n)
    root = ids[_local_roots(len(ids), x, y)[hit]]
    return pa.table({"id": ids[hit], "n": n[hit].astype(np.int64), "root": root})


def embedding_dedup(
    vectors: DataFrame, threshold: float = 0.95, id_column: str = "vec_id", column: str = "embedding", cell_rows: int = 1024, max_cells: int = 16384, sample_rows: int = 32, rounds: int = 5,
    reach: float = 0.5, block_rows: int = 2048, broadcast_rows: int = 100_000,
) -> DataFrame:
    """Links, groups and representatives of vectors with cosine >= ``threshold`` (above 0), in double precision.

    Returns one row for each row: vec_id, n_links (other rows linked with it directly, copies included), component_id
    (smallest id that links reach, itself included) and kept (vec_id = component_id).  No pair below the threshold links.
    ``reach`` = 1 finds every link; less looks less far beyond a cell's border, so that a link is lost only if it crosses
    a border with both ends farther from it than ``reach`` times the most that a link allows.

    A vector that is null, empty or zero, or holds nulls or components that are not finite, links with nothing.  Vectors
    of other lengths do not link with each other; -0.0 equals 0.0.  Rows of one id are vectors of their own; a null id is
    never a group's smallest unless all are null.  Ties are links.  Other columns are ignored, whatever their names.  An
    empty table gives an empty result.  Centres are fitted on about ``sample_rows`` distinct vectors for each of at most
    ``max_cells`` cells (and at most 32 MB of centres); all vectors are searched.
    """
    if not 0 < threshold <= 1 or not 0 < reach <= 1:
        raise ValueError("threshold and reach must be above 0 and at most 1")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    raw = F.col("vector")
    valid = raw.isNotNull() & (F.size(raw) > 0) & ~F.exists(raw, bad) & F.exists(raw, lambda x: x != 0)
    kind = vectors.schema[column].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(column).cast(f"array<{kind}>").alias("vector"))
    plain = F.transform(raw, lambda x: x + F.lit(0.0).cast(kind))
    rows = rows.withColumn("vector", F.when(valid, plain))
    rows = rows.withColumns({"d1": F.when(raw.isNotNull(), F.xxhash64(raw)), "d2": F.when(raw.isNotNull(), F.xxhash64(F.lit(7), raw))})
    classes = rows.where("d1 is not null").groupBy("d1", "d2").agg(F.first("vector").alias("vector"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # Numbers are written once and read from then on.
    classes = scratch.save(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    n, dim = classes.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    cells = max(1, min(max_cells, (32 << 20) // (8 * dim), math.ceil(n / cell_rows)))
    part = min(1.0, cells * sample_rows / max(1, n))
    sample = scratch.save(classes.where(F.shiftrightunsigned("d1", 11) < int(part * (1 << 53))).select("d1", "d2", "vector"), "sample")
    held = spark.sparkContext.broadcast(fit_cells(sample, dim, cells, rounds, threshold))
    near = reach * math.sqrt(2 - 2 * threshold) / 2 + 1e-9

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each class in its own cell, with the list of others it visits, and once in each of those."""
        centres = held.value
        centres = centres if len(centres) else np.eye(1, dim)
        for whole in batches:
            for start in range(0, whole.num_rows, _STRIP):
                batch = whole.slice(start, _STRIP)
                x, _ = unit_rows(batch.column("vector"), dim)
                dots = x @ centres.T
                home = np.argmax(dots, axis=1)
                best = dots[np.arange(len(x)), home]
                # Two unit centres are at most 2 apart.
                r, c = np.nonzero(best[:, None] - dots <= 2 * near)
                apart = np.sqrt(np.maximum(0, ((centres[home[r]] - centres[c]) ** 2).sum(axis=1)))
                ok = (c != home[r]) & (best[r] - dots[r, c] <= near * apart)
                r, c = r[ok], c[ok]
                bounds = np.searchsorted(r, np.arange(len(x) + 1))
                also = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(c, pa.int32()))
                none = pa.ListArray.from_arrays(pa.array(np.zeros(len(r) + 1), pa.int32()), pa.array([], pa.int32()))
                for at, cell, also_ in ((np.arange(len(x)), home, also), (r, c, none)):
                    if len(at):
                        some = batch.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), some.column("id"), pa.array(home[at], pa.int32()), some.column("copies"), some.column("vector"), also_], ["cell", "id", "home", "copies", "vector", "also"])

    placed = classes.select("id", "copies", "vector").mapInArrow(place, f"cell int, id bigint, home int, copies bigint, vector array<{kind}>, also array<int>")
    placed = scratch.save(placed, "placed")
    blocks = placed.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    # At most max_cells rows.
    dealt = placed.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"), (F.col("block") > j).cast("int").alias("side")))
    dealt = dealt.withColumn("at", F.explode(pair)).select("cell", "id", "home", "copies", "vector", "also", "at.*")
    met = dealt.groupBy("cell", "i", "j").applyInArrow(lambda t: _meet(t, dim, threshold), "id bigint, n bigint, root bigint")
    met = scratch.save(met, "met")
    groups = components(met.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct(), scratch)
    links = met.groupBy("id").agg(F.sum("n").alias("n"))
    known = classes.select("id", "d1", "d2", "least", "copies").join(links, "id", "left").join(groups.select(F.col("node").alias("id"), "root"), "id", "left")
    least = known.where("root is not null").groupBy("root").agg(F.min("least").alias("low"))
    few = least.count() <= broadcast_rows
    known = known.join(F.broadcast(least) if few else least, "root", "left")
    known = known.select("d1", "d2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("low", "least").alias("low"))
    out = rows.select("vec_id", "d1", "d2").join(known, ["d1", "d2"], "left")
    group = F.when(F.col("d1").isNull(), F.col("vec_id")).otherwise(F.col("low"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), group.alias("component_id"), F.col("vec_id").eqNullSafe(group).alias("kept"))
