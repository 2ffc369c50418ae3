"""Line deduplication with a sharded minimal perfect hash.

Distinct line hashes are counted with map-side aggregation and dealt to shards of bounded size.  Each shard becomes a
minimal perfect hash with a fingerprint, a count and a last-holder array; the documents' line hashes are dealt to the
same shards and probe the arrays.  Only hashes and positions move, never lines.  A shard that holds a very common
line gets several copies, among which its probes are dealt, so that no task gets all of them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm._shared import Scratch
from trackloom.llm._text import mix

_NO_ID = -(1 << 63)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\f\r")), _UPPER, _LOWER)


# ---- minimal perfect hash -------------------------------------------------------------------------------------------


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: bit levels, each holding the keys that hit a bit alone.

    Keys that collide on a level go to the next; a key's number is the rank of its bit.  ``rest`` lists what the last
    level leaves (nothing, in practice).
    """

    LEVELS = 24

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks, at = [], 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(at + np.concatenate(([0], np.cumsum(ones)[:-1])) if len(ones) else ones)
            at += int(ones.sum())
        self.before_rest = at

    @staticmethod
    def _bit(keys: np.ndarray, level: int, n_bits: int) -> np.ndarray:
        return (mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(n_bits)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        keys, levels = np.asarray(keys, np.uint64), []
        for level in range(cls.LEVELS):
            if not len(keys):
                break
            n_bits = 64 * max(1, math.ceil(gamma * len(keys) / 64))
            at = cls._bit(keys, level, n_bits)
            alone = np.bincount(at, minlength=n_bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys = keys[~alone[at]]
        return cls(levels, np.sort(keys))

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, from 0; -1 for a key that hits no bit.  Other foreign keys get any number."""
        keys = np.asarray(keys, np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = self._bit(keys[left], level, 64 * len(bits))
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            below = bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.ranks[level][word[hit]] + np.bitwise_count(below)
            left = left[~hit]
        if len(self.rest) and len(left):
            place = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            hit = self.rest[place] == keys[left]
            out[left[hit]] = self.before_rest + place[hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels), len(self.rest)], np.int64)
        return b"".join(x.tobytes() for x in (sizes, *self.levels, self.rest))

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        sizes, at, parts = np.frombuffer(raw, np.int64, n + 1, 8), 8 * (n + 2), []
        for size in sizes.tolist():
            parts.append(np.frombuffer(raw, np.uint64, size, at))
            at += 8 * size
        return cls(parts[:-1], parts[-1])


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(np.asarray(a).view(np.uint64) ^ mix(np.asarray(b).view(np.uint64)))


def _mark(b: np.ndarray) -> np.ndarray:
    return (mix(np.asarray(b).view(np.uint64)) >> np.uint64(32)).astype(np.uint32)


_INDEX = "shard bigint, bits binary, marks binary, counts binary, last binary"


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    a, b = pdf["h1"].to_numpy(np.int64), pdf["h2"].to_numpy(np.int64)
    table = PerfectHash.build(_key(a, b))
    at = table.number(_key(a, b))
    marks, counts, last = np.zeros(len(a), np.uint32), np.zeros(len(a), np.uint32), np.zeros(len(a), np.int64)
    marks[at], counts[at], last[at] = _mark(b), np.minimum(pdf["n_docs"].to_numpy(), (1 << 32) - 1), pdf["last_doc"].to_numpy(np.int64)
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "bits": [table.to_bytes()], "marks": [marks.tobytes()], "counts": [counts.tobytes()], "last": [last.tobytes()]})


def line_index(lines: DataFrame, scratch: Scratch, keys_per_shard: int = 100_000) -> tuple[DataFrame, int]:
    """The index of all lines in (doc, h1, h2): one row of arrays for each shard, and the number of shards."""
    counts = lines.select("h1", "h2", "doc").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_doc"))
    counts = scratch.save(counts, "counts")
    n_shards = max(1, math.ceil(counts.count() / keys_per_shard))
    index = counts.withColumn("shard", F.pmod("h1", F.lit(n_shards))).groupBy("shard").applyInPandas(_build, _INDEX)
    return scratch.save(index, "index"), n_shards


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, probes_per_task: int = 400_000, keys_per_shard: int = 100_000, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Documents without the lines that many documents share.

    A line's key is :func:`line_key`.  Keys of at least ``min_chars`` code points that occur in at least ``min_docs``
    documents lose all their lines, except in the document with the largest id that holds the key.  Returns the columns
    of ``docs`` with the new text, plus ``n_lines`` (before) and ``n_dropped`` (these replace columns of the same name).
    A null text is one empty line; rows with one doc_id count as one document; null ids count together as one document
    below all others; an empty table gives an empty result.  Long texts are split like others, and only hashes of their
    lines move.  ``broadcast_rows`` bounds the list of crowded shards that is broadcast; beyond it it is joined.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rest = [F.col(f"`{c}`") for c in columns if c not in ("doc_id", "text")]
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID))
    found = docs.select(doc.alias("doc"), text_hash.alias("th"), F.posexplode(split).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    found = found.where(F.length("key") >= min_chars).select("doc", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"))
    found = scratch.save(found, "lines")

    index, n_shards = line_index(found, scratch, keys_per_shard)
    found = found.withColumn("shard", F.pmod("h1", F.lit(n_shards)))
    # Shards that hold over probes_per_task lines are crowded; few enough of them are broadcast, more are joined.
    crowded = found.groupBy("shard").agg(F.ceil(F.count("*") / probes_per_task).cast("int").alias("copies")).where("copies > 1")
    crowded = scratch.save(crowded, "crowded")
    n_crowded = crowded.count()
    if n_crowded:
        hint = F.broadcast(crowded) if n_crowded <= broadcast_rows else crowded
        found, index = (x.join(hint, "shard", "left").withColumn("copies", F.coalesce("copies", F.lit(1))) for x in (found, index))
    copies = F.col("copies") if n_crowded else F.lit(1)
    probes = found.withColumn("copy", F.pmod(F.xxhash64("doc", "pos"), copies).cast("int"))
    arrays = index.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))

    def probe(key: tuple, lines: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
        if not len(lines) or not len(tables):
            return pd.DataFrame({"doc": [], "th": [], "pos": []}).astype({"doc": "int64", "th": "int64", "pos": "int32"})
        row = tables.iloc[0]
        marks, counts, last = np.frombuffer(row["marks"], np.uint32), np.frombuffer(row["counts"], np.uint32), np.frombuffer(row["last"], np.int64)
        a, b, own = (lines[c].to_numpy(np.int64) for c in ("h1", "h2", "doc"))
        at = PerfectHash.from_bytes(row["bits"]).number(_key(a, b))
        known = at >= 0
        known &= marks[np.maximum(at, 0)] == _mark(b)
        drop = known & (counts[at] >= min_docs) & (last[at] != own)
        return lines.loc[drop, ["doc", "th", "pos"]]

    dropped = probes.groupBy("shard", "copy").cogroup(arrays.groupBy("shard", "copy")).applyInPandas(probe, "doc bigint, th bigint, pos int")
    dropped = dropped.groupBy("doc", "th").agg(F.collect_set("pos").alias("_gone"))
    whole = docs.select(F.col("doc_id"), doc.alias("_doc"), text_hash.alias("_th"), split.alias("_lines"), F.struct(*rest, F.lit(0).alias("_")).alias("_rest"))
    whole = whole.join(dropped.withColumnsRenamed({"doc": "_doc", "th": "_th"}), ["_doc", "_th"], "left")
    n = F.size("_lines")
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.array_join("_lines", "\n")).otherwise(F.array_join(F.transform(left, lambda i: F.element_at("_lines", i + 1)), "\n"))
    out = {"doc_id": F.col("doc_id"), "text": text} | {c: F.col(f"_rest.`{c}`") for c in columns if c not in ("doc_id", "text")}
    return whole.select(*(out[c].alias(c) for c in columns), n.cast("bigint").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_dropped"))
