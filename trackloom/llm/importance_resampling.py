"""Resampling of documents towards a target's distribution of hashed word runs, by an external sort-count.

1. One pass over the texts writes, for each batch of documents, a packed stream of their features' buckets as uint16 and
   the documents' offsets in it.
2. A pass over the streams sorts each and run-length encodes it; the runs' lengths are added up to one count for each
   bucket, which bounds what leaves a task and what reaches the driver.
3. From the counts of documents and target comes one integer gain for each bucket.  Another pass gathers the gains of a
   stream and adds them up by document with ``np.add.reduceat``.
4. Documents are drawn by weight plus a Gumbel number of their id.  The lowest score that is drawn is found by two
   histograms of scores; those at or above it are ranked by a range partitioning.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm._shared import Scratch
from trackloom.llm._text import Texts, slices

_STEPS = 32
_WIDTH = 256
_ROW_BITS = 33  # of monotonically_increasing_id, below the partition's number


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_TABLE = _crc_table()
#: Bytes of words, A-Z already lowered: digits, a-z and all of multi-byte characters.
_IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def crc_states(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """The CRC-32 register after each span of bytes, from ``state`` or the initial one; its complement is the checksum."""
    lengths = end - start
    order = np.argsort(-lengths, kind="stable")
    at, lengths = start[order], lengths[order]
    c = np.full(len(at), 0xFFFFFFFF, np.uint32) if state is None else state[order]
    active = np.searchsorted(-lengths, -np.arange(_STEPS), "left")
    for k in range(_STEPS):
        n = active[k]
        if not n:
            break
        c[:n] = _TABLE[(c[:n] ^ data[at[:n] + k]) & 0xFF] ^ (c[:n] >> np.uint32(8))
    for i in np.flatnonzero(lengths > _STEPS):
        rest = data[at[i] + _STEPS : at[i] + lengths[i]].tobytes()
        c[i] = zlib.crc32(rest, int(~c[i])) ^ 0xFFFFFFFF
    out = np.empty_like(c)
    out[order] = c
    return out


def feature_buckets(texts: Texts, max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to ``max_n`` words of lowered ``texts``, document by document; features and words of each."""
    words = texts._runs(_IN_WORD[texts.data])
    counts = words.counts()
    state, keys, rows = None, [], []
    for k in range(max_n):
        at = np.flatnonzero(words.row[: len(words.row) - k] == words.row[k:]) if len(words.row) > k else np.zeros(0, np.int64)
        if k:
            state = state[np.isin(had, at)]
            state = _TABLE[(state ^ np.uint32(32)) & 0xFF] ^ (state >> np.uint32(8))
        state, had = crc_states(texts.data, words.start[at + k], words.end[at + k], state), at
        keys.append((~state).astype(np.int64) % buckets)
        rows.append(words.row[at])
    keys, rows = np.concatenate(keys).astype(np.uint16), np.concatenate(rows)
    if max_n > 1:
        keys, rows = keys[order := np.argsort(rows, kind="stable")], rows[order]
    return keys, np.bincount(rows, minlength=len(texts)), counts


def bucket_streams(docs: DataFrame, max_n: int, buckets: int) -> DataFrame:
    """(doc_ids, n_words, bounds, stream): uint16 buckets of some documents' features, and where each document's end."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                keys, features, words = feature_buckets(Texts.of(batch.column("text"), lower=True), max_n, buckets)
                ids = batch.column("doc_id").cast(pa.int64())
                one = pa.array([0, batch.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(one, x) for x in (ids, pa.array(words, pa.int64()), pa.array(np.cumsum(features), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([keys.astype("<u2").tobytes()], pa.binary())], ["doc_ids", "n_words", "bounds", "stream"])

    return docs.select("doc_id", "text").mapInArrow(pack, "doc_ids array<bigint>, n_words array<bigint>, bounds array<bigint>, stream binary")


def stream_counts(streams: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all streams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column("stream"):
                run = np.sort(np.frombuffer(raw.as_buffer(), "<u2"), kind="stable")
                first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))) if len(run) else np.zeros(0, np.int64)
                total[run[first]] += np.diff(np.append(first, len(run)))
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in streams.select("stream").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of the target's share to the raw share) for each bucket."""
    n, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    ratio = (target + 1).astype(float) * float(s_all + n) / ((raw + 1).astype(float) * float(t_all + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def importance_scores(streams: DataFrame, gains: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each document in ``streams``."""
    held = streams.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, ends, raw in zip(*(batch.column(c) for c in ("doc_ids", "n_words", "bounds", "stream")), strict=True):
                ends = ends.values.to_numpy()
                features = np.diff(ends, prepend=0)
                sums, has = np.zeros(len(ends), np.int64), np.flatnonzero(features)
                if len(has):
                    # Offsets of documents with features only: reduceat adds nothing up for an empty one.
                    sums[has] = np.add.reduceat(held.value[np.frombuffer(raw.as_buffer(), "<u2")], (ends - features)[has])
                weight = sums // np.maximum(features, 1)
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(features, pa.int64()), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    out = streams.mapInArrow(weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    gumbel = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    return out.withColumn("score", (F.col("weight") + gumbel).cast("bigint"))


def lowest_drawn(scores: DataFrame, k: int) -> int:
    """The score of the k-th highest row of (score), from counts by ranges of scores and then inside of one range."""
    above, low = 0, None
    for width in (_WIDTH, 1):
        inside = scores if low is None else scores.where(F.col("score").between(low * _WIDTH, low * _WIDTH + _WIDTH - 1))
        steps = inside.groupBy(F.floor(F.col("score") / width).alias("step")).count().collect()
        for step, n in sorted(steps, reverse=True):
            if above + n >= k:
                low = step
                break
            above += n
    return low


def rank_rows(rows: DataFrame, order: list, scratch: Scratch) -> DataFrame:
    """Adds ``rank`` 1, 2, ... in the total order of ``order``; ties, which a range cannot split, by a hash of nothing but place.

    Rows are dealt to ranges of the order and sorted there; a row's number in its range plus what lies in the ranges
    before gives its rank, so that no task sees all rows.
    """
    spark = rows.sparkSession
    rows = scratch.save(rows.withColumn("_place", F.monotonically_increasing_id()), "unranked")
    order = [*order, F.col("_place").asc()]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = scratch.save(ranged.drop("_place"), "ranged")
    part = F.shiftright("_at", _ROW_BITS)
    counts = dict(ranged.groupBy(part.cast("int").alias("p")).count().collect())
    if not counts:
        return ranged.drop("_at").withColumn("rank", F.lit(None).cast("bigint"))
    before = accumulate((counts.get(p, 0) for p in range(max(counts))), initial=0)
    offset = F.element_at(F.array(*(F.lit(n).cast("bigint") for n in before)), part.cast("int") + 1)
    return ranged.withColumn("rank", (offset + F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1) + 1).cast("bigint")).drop("_at")


def resample(docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = 10000, percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """Documents drawn towards the distribution of ``target`` (text), without replacement.

    Words are runs of digits, letters a-z (A-Z lowered) and characters beyond ASCII; features are the runs of 1 to
    ``max_n`` words joined by a space.  Of the N documents with at least ``min_words`` words the ``percent`` * N / 100
    (rounded down) with the highest scores are drawn, ties to the smaller doc_id.  Returns one row for each row: doc_id,
    n_features, weight, score and rank (null if not drawn).

    Null and empty texts have no features and weight 0.  A null doc_id is hashed as an empty one and comes last among
    ties.  Rows of one doc_id are documents of their own with one Gumbel number; equal rows are ranked in any order.  Long
    texts are read whole, each as a stream of its own.  Empty tables give empty results, an empty target gains from an
    even distribution.  Columns of other names are ignored.  ``buckets`` must be at most 65536.
    """
    if not 1 <= buckets <= 1 << 16 or max_n < 1:
        raise ValueError("buckets must be from 1 to 65536, and max_n at least 1")
    scratch = Scratch(docs.sparkSession, "resampling")
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    streams = scratch.save(bucket_streams(ids, max_n, buckets), "streams")
    wanted = bucket_streams(target.select(F.lit(0).cast("bigint").alias("doc_id"), "text"), max_n, buckets)
    gains = bucket_gains(stream_counts(streams, buckets), stream_counts(wanted, buckets))
    scores = scratch.save(importance_scores(streams, gains, seed), "scores")
    fit = scores.where(F.col("n_words") >= min_words)
    k = percent * fit.count() // 100
    if not k:
        return scores.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))
    low = lowest_drawn(fit, k)
    chosen = (F.col("n_words") >= min_words) & (F.col("score") >= low)
    ranked = rank_rows(scores.where(chosen), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()], scratch)
    rank = F.when(F.col("rank") <= k, F.col("rank"))
    out = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*out, rank.alias("rank")).unionByName(scores.where(~chosen).select(*out, F.lit(None).cast("bigint").alias("rank")))
