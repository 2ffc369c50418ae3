"""Best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the largest capacity are cut into pieces.  Pieces are dealt to shards of bounded size by hash
and packed shard by shard, longest first: a piece goes where it leaves the least room; if it fits nowhere, the bin size
of least cost is opened, crediting the room left at the going rate.  Several opening policies are tried, and the
cheapest outcome of the shard stays.  In the end every bin shrinks to the smallest permitted length for its contents.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm._shared import Scratch
from trackloom.llm.mixing import n_words

_NO_ID = -(1 << 63)
CAPACITIES = (512, 1024, 2048, 4096)
_RUN = 1000


def sequence_cost(capacity: int) -> float:
    """Cost of a sequence: in proportion to its length, and a part that grows with its square (attention)."""
    return capacity * (1 + capacity / 65536)


def _pack(sizes: list[int], capacities: list[int], rate: float) -> tuple[list[int], list[int]]:
    """The bin of each size (descending), and the bins' contents; opened bins cost least after crediting their room."""
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    bins, contents = [], []
    for size in sizes:
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left = min((c for c in capacities if c >= size), key=lambda c: (sequence_cost(c) - rate * (c - size), c))
            b = len(contents)
            contents.append(0)
        contents[b] += size
        if left > size:
            insort(room, (left - size, b))
        bins.append(b)
    return bins, contents


def pack_shard(sizes: np.ndarray, capacities: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each size, capacity of each bin) for sizes in descending order, by the cheapest of the policies."""
    caps = sorted(capacities)
    base = min(sequence_cost(c) / c for c in caps)
    best: tuple[float, list[int], np.ndarray] | None = None
    for fill in (0.0, 0.9, 1.0):
        bins, contents = _pack(sizes.tolist(), caps, fill * base)
        final = np.asarray(caps)[np.searchsorted(caps, contents)]
        cost = float(sum(sequence_cost(c) for c in final.tolist()))
        if best is None or cost < best[0]:
            best = (cost, bins, final)
    return np.asarray(best[1], np.int64), best[2]


def best_fit_packing(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, pieces_per_shard: int = 20_000) -> DataFrame:
    """A row for each piece: doc_id, copy, piece, start_word, n_words, bin_id, capacity, slot, start_in_bin.

    Sizes are words.  ``copy`` counts rows with an equal doc_id and size from 1; ``slot`` and ``start_in_bin`` place a
    piece in its sequence.  A null text or one without words is one piece of 0 words in no bin (nulls).  No piece is
    dropped; rows without a doc_id are copies of one id, which is null in the result; a very long text is many pieces; other columns are not looked at; equal sizes go by doc_id, copy and piece;
    an empty table gives an empty result.
    """
    caps = tuple(sorted(set(capacities)))
    if not caps or caps[0] < 1:
        raise ValueError("capacities must be positive")
    largest = caps[-1]
    scratch = Scratch(docs.sparkSession, "packing")
    sizes = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("doc_id"), n_words(F.col("text")).alias("size")).groupBy("doc_id", "size").agg(F.count("*").alias("n"))
    # Copies come in runs of bounded length, which are dealt evenly: one id may hold a large part of all rows.
    run = F.lit(_RUN).cast("bigint")
    few = sizes.where(F.col("n") <= run).withColumn("run", F.lit(0).cast("bigint"))
    many = sizes.where(F.col("n") > run).withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / run)))).repartition("doc_id", "size", "run")
    first = F.col("run") * run + 1
    pieces = few.unionByName(many).withColumn("copy", F.explode(F.sequence(first, F.least(F.col("n"), first + run - 1))))
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.ceil(F.col("size") / largest) - 1))))
    pieces = pieces.withColumn("start_word", F.col("piece") * largest).select("doc_id", "copy", "piece", "start_word", F.least(F.lit(largest), F.col("size") - F.col("start_word")).cast("bigint").alias("n_words"))
    pieces = scratch.save(pieces, "pieces")
    shards = max(1, math.ceil(pieces.count() / pieces_per_shard))
    schema = "doc_id bigint, copy bigint, piece bigint, start_word bigint, n_words bigint, bin_id bigint, capacity bigint, slot bigint, start_in_bin bigint"

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_words", "doc_id", "copy", "piece"], ascending=[False, True, True, True], ignore_index=True)
        bins, final = pack_shard(pdf["n_words"].to_numpy(), caps)
        groups = pdf["n_words"].groupby(bins)
        pdf["bin_id"] = key[0] * (1 << 32) + bins
        pdf["capacity"] = final[bins]
        pdf["slot"] = groups.cumcount()
        pdf["start_in_bin"] = groups.cumsum() - pdf["n_words"]
        return pdf[["doc_id", "copy", "piece", "start_word", "n_words", "bin_id", "capacity", "slot", "start_in_bin"]]

    shard = F.pmod(F.xxhash64("doc_id", "copy", "piece", "n_words"), F.lit(shards)).alias("shard")
    packed = pieces.where("n_words > 0").select("*", shard).groupBy("shard").applyInPandas(pack, schema)
    nothing = pieces.where("n_words = 0").select("*", *(F.lit(None).cast("bigint").alias(c) for c in ("bin_id", "capacity", "slot", "start_in_bin")))
    return packed.unionByName(nothing).withColumn("doc_id", F.nullif("doc_id", F.lit(_NO_ID)))
