"""Mixing sources to target weights by hash thresholds, without sorting documents.

Every document has a 60-bit hash of its id and text.  Sizes are summed by source and hash bucket; the bucket in which a source's
budget ends is found from running sums, and only that bucket is split further, until it holds a single hash.  What is
left is one threshold for each source, so that a document is chosen by a comparison, and how many of the rows with the
threshold's own hash are taken too: rows equal in id and text share a hash, and are numbered where only some of them fit.
Budgets nest: a source that needs more than all its documents takes all once, and those under its threshold once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.llm._shared import Scratch

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, STEP = 60, 12


def n_words(text: Column) -> Column:
    """Runs of characters other than 0x20 and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def id_hash(doc_id: Column, text: Column, seed: str) -> Column:
    """60 bits of an MD5 digest of id and text, so that any engine finds the same numbers."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(key, source_size, target) for each source of (source, size).

    Sources, by code point and null last, get the weights in turn.  Together they get ``share`` of all sizes by weight;
    no target exceeds ``cap`` times its source, and what is above is shared out again among the others.  The result is
    least(cap * size, level * weight); level is found from running sums over the sources by cap * size / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(rank, F.lit(len(weights))).cast("int") + 1)
    per = per.withColumn("weight", weight).withColumn("limit", cap * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (share * F.sum("source_size").over(everything) - before) / onward)
    # Past the first source that stays under its limit the levels only fall.
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    target = F.least(F.col("limit"), F.coalesce(level * F.col("weight"), F.col("limit")))
    return per.select(_key(F.col("source")).alias("key"), "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame, scratch: Scratch, broadcast_rows: int = 100_000) -> DataFrame:
    """(key, source_size, target, epochs, below, some, of) from (source, size, hash): every document is taken ``epochs``
    times, and once more if its hash is under ``below``, or if it is among ``some`` of the ``of`` rows whose hash is
    ``below``.

    The document at the boundary is taken if at least half of it is within the budget.
    """
    targets = targets.withColumn("epochs", F.when(F.col("target") >= F.col("source_size"), 1).otherwise(0))
    targets = scratch.save(targets.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")
    small = targets.count() <= broadcast_rows
    hint = F.broadcast if small else (lambda x: x)
    rows = sizes.select(_key(F.col("source")).alias("key"), "size", "hash")
    open_ = targets.where("budget < source_size").select("key", F.lit(0).cast("bigint").alias("prefix"), "budget")
    done = targets.where("budget >= source_size").select("key", F.lit(1 << HASH_BITS).cast("bigint").alias("below"), F.lit(0).cast("bigint").alias("some"), F.lit(0).cast("bigint").alias("of"))
    bits, k = HASH_BITS, 0
    while bits:
        bits -= STEP
        bucket = F.shiftright("hash", bits)
        inside = rows.join(hint(open_), "key").where(F.shiftright("hash", bits + STEP) == F.col("prefix"))
        sums = inside.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("size"), F.min("hash").alias("low"), F.max("hash").alias("high"), F.count("*").alias("of"), F.first("budget").alias("budget"))
        before = F.coalesce(F.sum("size").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        edge = sums.withColumn("left", F.col("budget") - before).where("left >= 0 and left < size")
        edge = scratch.save(edge, f"edge-{k}")
        # Rows of one hash are of one size: the j-th is taken if (j - 1/2) of that size is left.
        some = F.floor(F.col("left") * F.col("of") / F.col("size") + 0.5).cast("bigint")
        alone = edge.where("low = high").select("key", F.col("low").alias("below"), some.alias("some"), "of")
        done = done.unionByName(alone)
        open_ = edge.where("low < high").select("key", F.col("bucket").alias("prefix"), F.col("left").alias("budget"))
        k += 1
        if open_.isEmpty():
            break
    found = targets.join(done, "key", "left").select("key", "source_size", "target", "epochs", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("below", "some", "of")))
    return hint(scratch.save(found, "thresholds"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix", rows: bool = False) -> DataFrame:
    """How often the mix takes each document, or the mix itself.

    Returns doc_id, size (words), source_size, target and taken (size times the number of times the document is taken,
    at most 2 with the default cap).  With ``rows`` it returns the taken documents with their own columns, a document
    taken twice as two rows.  Null texts have size 0, null sources are a source of their own, rows equal in id and text
    share their hash, and at a boundary any of them are taken, as many as fit; long texts count like others, an empty
    table gives an empty result.  Columns of other names are only passed on.  ``cap`` must be at most 2.
    """
    if not 0 < cap <= 2:
        raise ValueError("cap must be above 0 and at most 2")
    scratch = Scratch(docs.sparkSession, "mixing")
    hashed = id_hash(F.col("doc_id"), F.col("text"), seed)
    sizes = scratch.save(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), hashed.alias("hash")), "sizes")
    found = thresholds(sizes, source_targets(sizes, weights, share, cap), scratch)
    if not rows:
        out = _times(sizes.withColumn("key", _key(F.col("source"))).join(found, "key"), F.col("hash"), scratch, "_times")
        return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("_times")).cast("bigint").alias("taken"))
    names = [f"_mix{k}" if k else "_mix" for k in range(len(docs.columns) + 1)]
    name = next(n for n in names if n not in docs.columns)
    found = found.select(F.struct("key", "epochs", "below", "some", "of").alias(name))
    out = docs.join(found, _key(docs["source"].cast("string")) == F.col(f"{name}.key"))
    out = _times(out, hashed, scratch, name, f"{name}.")
    return out.withColumn(name, F.explode(F.array_repeat(F.lit(1), F.col(name)))).drop(name)


def _times(rows: DataFrame, hashed: Column, scratch: Scratch, name: str, of: str = "") -> DataFrame:
    """Adds how often each row is taken, from the columns of :func:`thresholds`; they stand below the prefix ``of``.

    Where only some of the rows of a hash are taken, these rows are written once with their places.  They are counted by
    the task that wrote them and numbered inside of it, so that no task needs all of them.
    """
    col = lambda c: F.col(f"{of}{c}")
    at, split = hashed == col("below"), (hashed == col("below")) & (col("some") > 0) & (col("some") < col("of"))
    times = col("epochs") + F.when((hashed < col("below")) | (at & (col("some") >= col("of")) & (col("of") > 0)), 1).otherwise(0)
    plain = rows.where(~split).withColumn(name, times.cast("int"))
    part = rows.where(split)
    if part.isEmpty():
        return plain
    need = {"_key": col("key"), "_some": col("some"), "_epochs": col("epochs"), "_place": F.monotonically_increasing_id()}
    part = scratch.save(part.select(F.struct(*(rows[c] for c in rows.columns)).alias("row"), *(e.alias(c) for c, e in need.items())), "some-of-a-hash")
    task = F.shiftright("_place", 33)
    counts = part.groupBy("_key", task.alias("_task")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = part.withColumn("_task", task).join(counts.withColumn("_before", before).drop("_n"), ["_key", "_task"])
    number = F.col("_before") + F.row_number().over(Window.partitionBy("_key", "_task").orderBy("_place"))
    part = part.withColumn("_t", (F.col("_epochs") + (number <= F.col("_some")).cast("int")).cast("int"))
    part = part.select(*(F.col("row")[c].alias(c) for c in rows.columns if c != name), F.col("_t").alias(name))
    return plain.select(*(c for c in rows.columns if c != name), name).unionByName(part)
