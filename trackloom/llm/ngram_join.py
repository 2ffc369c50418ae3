"""N-gram Jaccard self-join with several global token orders, and the groups that its links form.

1. Every document becomes a set of hashed shingles.  Equal sets are one class from here on, so that copies never meet
   as pairs.
2. Shingle frequencies are counted over the whole corpus into hash buckets; rare buckets come first in every order, so
   that passages which many documents share stay out of the prefixes.
3. Classes whose prefixes under the first order share a shingle are candidates, if their sizes and the shingle's places
   in both sets leave room for the overlap that a link needs.  A candidate must also share prefix
   shingles under the other orders; the intersection of these filters goes to verification with the whole sets.
4. Links between groups that are already joined decide nothing about groups.  So each posting list first compares its
   members with one hub each; the pairs that still lie in different groups follow in full.  The groups are exactly those
   of all links, although a group of n near copies costs about n comparisons in place of n * n.
5. All links lie inside these groups.  To count them, a group's sets are dealt to blocks of bounded size by level of
   size, and blocks whose levels can link meet two by two; each meeting is one matrix product and returns counts, never
   pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm._graph import components
from trackloom.llm._shared import Scratch
from trackloom.llm._text import Texts, distinct, mix, slices, windows

ORDERS = 3
_BLOCK = 1 << 12
_CELL_SETS, _CELL_TOKENS = 128, 1 << 17
_NO_ID = -(1 << 63)


def shingle_sets(texts: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed shingles of each text, ascending, and the texts' bounds in them."""
    words = texts.words()
    hashes = words.hashes(texts.data)
    at, keys = windows(hashes, words, n)
    rows = words.row[at]
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        few = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = counts[short] > k
            few[has] = mix(few[has] + hashes[words.first[short[has]] + k] + np.uint64(k + 1))
        keys, rows = np.concatenate((keys, mix(few + np.uint64(n)))), np.concatenate((rows, short))
    return distinct(keys, rows, len(texts))


def prefix_lengths(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of a set of which two sets with Jaccard similarity >= percent / 100 share at least one, in any order."""
    return np.where(sizes > 0, sizes - -(-percent * sizes // 100) + 1, 0)


def _first(keys: np.ndarray, bounds: np.ndarray, level: np.ndarray, order: int, lengths: np.ndarray) -> np.ndarray:
    """Indices of each set's first tokens, set by set, ordered by frequency level and then by the order's own hash."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.lexsort((mix(keys + np.uint64(order * 0x632BE59BD9B4E019 & (1 << 64) - 1)), level, rows))
    return place[np.arange(len(keys)) - bounds[rows] < lengths[rows]]


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))


def _digests(keys: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two sums of mixed tokens, which name each set."""
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(keys + np.uint64(k))))) for k in range(2)]
    return [(x[bounds[1:]] - x[bounds[:-1]]).view(np.int64) for x in sums]


def bucket_levels(docs: DataFrame, n: int, buckets: int) -> np.ndarray:
    """A frequency level (a byte) for each of ``buckets`` hash buckets, counted over all documents.

    Tasks sum whole arrays, cut into blocks for the shuffle; the result has ``buckets`` bytes, which bounds what is sent
    to the driver and from there to the tasks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 19):
                keys, _ = shingle_sets(Texts.of(batch.column("text"), lower=True), n)
                total += np.bincount((keys & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
        blocks = [b for b in range(max(1, buckets // _BLOCK)) if total[b * _BLOCK : (b + 1) * _BLOCK].any()]
        for b in blocks:
            yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([total[b * _BLOCK : (b + 1) * _BLOCK].astype(np.uint32).tobytes()])], ["block", "counts"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_BLOCK, np.int64)
        for raw in pdf["counts"]:
            part = np.frombuffer(raw, np.uint32)
            total[: len(part)] += part
        level = np.floor(4 * np.log2(total + 1)).astype(np.uint8)
        return pd.DataFrame({"block": [key[0]], "levels": [level.tobytes()]})

    parts = docs.select("text").mapInArrow(count, "block bigint, counts binary").groupBy("block").applyInPandas(add, "block bigint, levels binary")
    out = np.zeros(max(buckets, _BLOCK), np.uint8)
    for block, raw in parts.collect():
        out[block * _BLOCK : (block + 1) * _BLOCK] = np.frombuffer(raw, np.uint8)
    return out[:buckets]


def _may_link(a: Column, b: Column, percent: int) -> Column:
    """Whether postings a and b (n, at) of one token may be the first that two linked sets share.

    The sizes must be near enough, and what follows the token in both sets must hold the whole overlap.
    """
    sizes = 100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"])
    return sizes & ((100 + percent) * F.least(a["n"] - a["at"], b["n"] - b["at"]) >= percent * (a["n"] + b["n"]))


def _linked_cells(one: pa.Table, two: pa.Table | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all linked pairs between two tables of sets (tokens), or inside of one; equal ids are no pair."""

    def flat(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = t["tokens"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.diff(lists.offsets.to_numpy())
        return lists.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes), sizes

    a, rows_a, size_a = flat(one)
    b, rows_b, size_b = (a, rows_a, size_a) if two is None else flat(two)
    shared = np.intersect1d(a, b)
    inter = np.zeros((len(size_a), len(size_b)))
    places = []
    for keys, rows in ((a, rows_a), (b, rows_b)):
        at = np.searchsorted(shared, keys)
        hit = shared[np.minimum(at, len(shared) - 1)] == keys if len(shared) else np.zeros(len(keys), bool)
        order = np.argsort(at[hit], kind="stable")
        places.append((at[hit][order], rows[hit][order]))
    for start in range(0, len(shared), _BLOCK):
        marks = []
        for (at, rows), n in zip(places, inter.shape, strict=True):
            lo, hi = np.searchsorted(at, (start, start + _BLOCK))
            m = np.zeros((n, _BLOCK), np.float32)
            m[rows[lo:hi], at[lo:hi] - start] = 1
            marks.append(m)
        inter += marks[0] @ marks[1].T
    ids = [t["id"].to_numpy() for t in (one, one if two is None else two)]
    linked = ((100 + percent) * inter >= percent * (size_a[:, None] + size_b[None, :])) & (ids[0][:, None] != ids[1][None, :])
    return np.nonzero(np.triu(linked, 1) if two is None else linked)


def _links_in_groups(members: DataFrame, percent: int, scratch: Scratch, broadcast_rows: int, as_pairs: bool) -> DataFrame:
    """The links inside of groups, from ``members`` (id, root, tokens): (id, n_links), or the pairs (a, b).

    Sets link only if their sizes' levels, powers of 100 / percent, are equal or next to each other.  The sets of a
    group and level are dealt to cells by hash, and each two cells that can link meet in one place.
    """
    size = F.size("tokens")
    # A little above the largest ratio of linked sizes, so that rounding never takes linked sets two levels apart.
    level = F.floor(F.log(size) / math.log(1.001 * 100 / percent)).cast("int")
    members = scratch.save(members.withColumn("level", level), "members")
    cells = members.groupBy("root", "level").agg(F.ceil(F.greatest(F.count("*") / _CELL_SETS, F.sum(size) / _CELL_TOKENS)).cast("int").alias("cells"))
    up = cells.select("root", (F.col("level") - 1).alias("level"), F.col("cells").alias("up"))
    down = cells.select("root", (F.col("level") + 1).alias("level"), F.col("cells").alias("down"))
    near = cells.join(up, ["root", "level"], "left").join(down, ["root", "level"], "left")
    near = scratch.save(near.na.fill(0), "cells")
    few = near.count() <= broadcast_rows
    rows = members.join(F.broadcast(near) if few else near, ["root", "level"])
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("id", size), F.col("cells")).cast("int"))
    place = lambda l1, i, l2, j, side: F.struct(l1.cast("int").alias("l1"), i.cast("int").alias("i"), l2.cast("int").alias("l2"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    lv, cell = F.col("level"), F.col("cell")
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda _: n > 0)
    own = F.transform(upto(F.col("cells")), lambda j: F.when(cell <= j, place(lv, cell, lv, j, 0)).otherwise(place(lv, j, lv, cell, 1)))
    above = F.transform(upto(F.col("up")), lambda j: place(lv, cell, lv + 1, j, 0))
    below = F.transform(upto(F.col("down")), lambda j: place(lv - 1, j, lv, cell, 1))
    rows = rows.select("id", "root", "tokens", F.explode(F.concat(own, above, below)).alias("at")).select("id", "root", "tokens", "at.*")

    def meet(table: pa.Table) -> pa.Table:
        first, second = table["l1"][0].as_py(), table["l2"][0].as_py()
        alone = first == second and table["i"][0].as_py() == table["j"][0].as_py()
        side = table["side"].to_numpy()
        one = table if alone else table.filter(pa.array(side == 0))
        two = None if alone else table.filter(pa.array(side == 1))
        if not one.num_rows or (two is not None and not two.num_rows):
            x = y = np.zeros(0, np.int64)
        else:
            x, y = _linked_cells(one, two, percent)
        ids = one["id"].to_numpy(), (one if two is None else two)["id"].to_numpy()
        if as_pairs:
            a, b = ids[0][x], ids[1][y]
            return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})
        found, counts = np.unique(np.concatenate((ids[0][x], ids[1][y])), return_counts=True)
        return pa.table({"id": found, "n": counts})

    met = rows.groupBy("root", "l1", "i", "l2", "j").applyInArrow(meet, "a bigint, b bigint" if as_pairs else "id bigint, n bigint")
    return met.distinct() if as_pairs else met.groupBy("id").agg(F.sum("n").alias("n_links"))


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 80, buckets: int | None = None, hub_rounds: int = 2, broadcast_rows: int = 1_000_000, every_link: bool = True) -> DataFrame:
    """Groups of documents whose shingle sets are alike.

    The words of a text are lower-cased in A-Z; its set holds the distinct ``n``-word shingles, or the whole sequence
    of words if it is shorter.  Two documents link when 100 * intersection >= ``percent`` * union.  Returns one row for
    each row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included) and
    n_links (links of its class of equal sets with other classes; those of one doc_id's several texts are added up).
    Without ``every_link`` there is no n_links, and only links that decide groups are sought, in ``hub_rounds`` rounds of
    hubs and one of the pairs that remain.
    Null texts and texts without words have empty sets and are alone, as is a row with null doc_id and an empty set;
    other null ids take part as one document, below all others.  Rows with one doc_id each keep a row; they count as one
    document, which links if any of its texts does.
    Ties between sizes or shared shingles need no rule: links are links, and the smallest id names a group.  Very long
    texts are read whole, alone in their batch; columns other than doc_id and text are ignored; an empty table gives an
    empty result.
    ``broadcast_rows`` bounds the ids that are broadcast to pick candidates' texts; beyond it they are joined.
    """
    sets, names, groups, members, scratch = _linked(docs, n, percent, buckets, hub_rounds, broadcast_rows)
    moved = groups.select(F.col("node").alias("id"), "root")
    names = names.join(moved, "id", "left").withColumn("root", F.coalesce("root", "id"))
    if every_link:
        names = names.join(_links_in_groups(members, percent, scratch, broadcast_rows, False), "id", "left")
    # Classes of one document that nothing joins need no row here; copies and linked classes do.
    out = sets.select("doc_id", "n", "d1", "d2").join(names.drop("id"), ["d1", "d2"], "left")
    root = F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id"))
    counts = [F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")] if every_link else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.nullif(root, F.lit(_NO_ID)).alias("component_id"), *counts)


def ngram_links(docs: DataFrame, n: int = 5, percent: int = 80, buckets: int | None = None, broadcast_rows: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """All links of :func:`ngram_join` between classes of equal sets, as (a, b) with a < b, each once; and (doc_id, class).

    A class is named by its smallest doc_id, null as that; classes of different texts of one doc_id may share a name.
    """
    sets, names, _, members, scratch = _linked(docs, n, percent, buckets, 2, broadcast_rows)
    links = _links_in_groups(members, percent, scratch, broadcast_rows, True)
    a, b, own = (F.nullif(F.col(c), F.lit(_NO_ID)).alias(x) for c, x in (("a", "a"), ("b", "b"), ("id", "class")))
    return links.select(a, b), sets.where("n > 0").join(names, ["d1", "d2"]).select("doc_id", own)


def _linked(docs: DataFrame, n: int, percent: int, buckets: int | None, hub_rounds: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, Scratch]:
    """Sets (doc_id, n, d1, d2), class names (d1, d2, id), groups (node, root) and their sets (id, root, tokens)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    buckets = buckets or min(1 << 24, max(1 << 12, 1 << (8 * max(1, docs.count())).bit_length()))
    levels = spark.sparkContext.broadcast(bucket_levels(docs, n, buckets))
    mask = np.uint64(buckets - 1)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for whole in batches:
            for batch in slices(whole, "text", 1 << 19):
                keys, bounds = shingle_sets(Texts.of(batch.column("text"), lower=True), n)
                sizes = np.diff(bounds)
                sums = _digests(keys, bounds)
                lengths = prefix_lengths(sizes, percent)
                first = _first(keys, bounds, level[(keys & mask).astype(np.int64)], 0, lengths)
                cut = np.concatenate(([0], np.cumsum(lengths)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), _lists(keys[first], cut)], ["doc_id", "n", "d1", "d2", "prefix"])

    sets = scratch.save(docs.mapInArrow(prefixes, "doc_id bigint, n bigint, d1 bigint, d2 bigint, prefix array<bigint>"), "sets")
    classes = sets.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.min_by("n", "doc_id").alias("n"), F.first("prefix").alias("prefix"))
    # A null doc_id sorts below all others.
    nulls = sets.where("n > 0 and doc_id is null").select("d1", "d2").distinct().withColumn("_null", F.lit(True))
    has_nulls = not nulls.isEmpty()
    if has_nulls:
        classes = classes.join(nulls, ["d1", "d2"], "left").withColumn("id", F.when(F.col("_null"), F.lit(_NO_ID)).otherwise(F.col("id"))).drop("_null")
    classes = scratch.save(classes, "classes")
    names = scratch.save(classes.select("d1", "d2", "id"), "names")
    sets = scratch.save(sets.select("doc_id", "n", "d1", "d2"), "slim-sets")
    scratch.drop("sets")
    postings = classes.select("id", "n", F.posexplode("prefix").alias("at", "token"))
    # Counts are summed before the shuffle, and a join can be dealt anew where a token is very common; a window cannot.
    common = postings.groupBy("token").agg(F.count("*").alias("_size")).where("_size > 1").select("token")
    postings = scratch.save(postings.join(common, "token"), "postings")
    scratch.drop("classes")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for whole in batches:
            for batch in slices(whole, "text", 1 << 19):
                keys, bounds = shingle_sets(Texts.of(batch.column("text"), lower=True), n)
                lengths = prefix_lengths(np.diff(bounds), percent)
                out = [batch.column("id"), _lists(keys, bounds), *(pa.array(x) for x in _digests(keys, bounds))]
                for order in range(1, ORDERS):
                    first = _first(keys, bounds, level[(keys & mask).astype(np.int64)], order, lengths)
                    out.append(_lists(keys[first], np.concatenate(([0], np.cumsum(lengths)))))
                yield pa.RecordBatch.from_arrays(out, ["id", "tokens", "d1", "d2", *(f"p{k}" for k in range(1, ORDERS))])

    # The classes that one doc_id occurs in belong together.
    owned = sets.where("n > 0").groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("x"), F.max(F.struct("d1", "d2")).alias("y")).where("x <> y").select("doc_id")
    owned = scratch.save(owned, "owned")
    same = None
    if not owned.isEmpty():
        ids = sets.where("n > 0").join(owned, "doc_id").join(names, ["d1", "d2"]).select("doc_id", "id").distinct()
        same = ids.join(ids.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").where("a <> id").select("a", F.col("id").alias("b")).distinct()
        same = scratch.save(same, "same")

    held: list[DataFrame] = []

    def whole_sets(pairs: DataFrame, k: int) -> DataFrame:
        """(id, tokens, p1, ...) of the documents in ``pairs``; those of earlier rounds are not made again."""
        need = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        for have in held:
            need = need.join(have.select("id"), "id", "left_anti")
        need = scratch.save(need, f"need-{k}")
        few = need.count() <= broadcast_rows
        some = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "text").join(F.broadcast(need) if few else need, "id", "left_semi")
        some = some.groupBy("id", F.xxhash64("text").alias("_th")).agg(F.first("text").alias("text")).select("id", "text")
        made = some.mapInArrow(tokens, "id bigint, tokens array<bigint>, d1 bigint, d2 bigint, " + ", ".join(f"p{k} array<bigint>" for k in range(1, ORDERS)))
        if same is not None:
            # Of one doc_id's several texts only those whose class it names are meant.
            made = made.join(names, ["d1", "d2", "id"], "left_semi")
        held.append(scratch.save(made.drop("d1", "d2"), f"whole-sets-{k}"))
        return held[0] if k == 0 else spark.read.parquet(*(f"{scratch.path}/whole-sets-{i}" for i in range(k + 1)))

    def verified(pairs: DataFrame, k: int) -> DataFrame:
        """Those of the distinct pairs (a, b) that link: prefixes under the other orders first, then the whole sets.

        The pairs go to the sets of their first documents, and these to the sets of the second.
        """
        sets_of, few = whole_sets(pairs, k), pairs.count() <= broadcast_rows
        left, right = ([F.col("id").alias(x), F.col("tokens").alias(f"t{x}"), *(F.col(f"p{i}").alias(f"{x}{i}") for i in range(1, ORDERS))] for x in "ab")
        both = sets_of.select(*left).join(F.broadcast(pairs) if few else pairs, "a")
        seconds = pairs.select("b").distinct()
        both = both.join(sets_of.select(*right).join(F.broadcast(seconds) if few else seconds, "b", "left_semi"), "b")
        for i in range(1, ORDERS):
            both = both.where(F.arrays_overlap(f"a{i}", f"b{i}"))
        inter, total = F.size(F.array_intersect("ta", "tb")), F.size("ta") + F.size("tb")
        return scratch.save(both.where((100 + percent) * inter >= percent * total).select("a", "b").distinct(), f"links-{k}")

    groups, links, tested = None, None, None
    for k in range(hub_rounds + 1):
        members = postings.withColumn("root", F.col("id"))
        if groups is not None:
            few = groups.count() <= broadcast_rows
            moved = groups.select(F.col("node").alias("id"), F.col("root").alias("_root"))
            members = postings.join(F.broadcast(moved) if few else moved, "id", "left").withColumn("root", F.coalesce("_root", "id"))
        members = members.select("token", "id", "root", F.struct("n", "at").alias("p"))
        # The member with the fewest rarer tokens is the likeliest to be what the others are copies of.
        first = [F.col("p.at").cast("bigint"), F.xxhash64("id")] if k == 0 else [F.xxhash64("id", "token"), F.lit(0).cast("bigint")]
        hub = F.min(F.struct(first[0].alias("x"), first[1].alias("y"), "id", "root", "p")).alias("hub")
        open_ = members.groupBy("token").agg(hub, F.min("root").alias("_least"), F.max("root").alias("_most")).where("_least < _most").select("token", "hub")
        if k < hub_rounds:
            pairs = members.join(open_, "token").where(F.col("root") != F.col("hub.root")).select("id", F.col("hub.id").alias("id2"), "p", F.col("hub.p").alias("p2"))
        else:
            members = scratch.save(members.join(open_.select("token"), "token"), "open")
            other = members.withColumnsRenamed({"id": "id2", "p": "p2", "root": "root2"})
            pairs = members.join(other, "token").where((F.col("id") < F.col("id2")) & (F.col("root") != F.col("root2")))
        pairs = pairs.where(_may_link(F.col("p"), F.col("p2"), percent)).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.save(pairs, f"pairs-{k}")
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = verified(pairs, k)
        links = new if links is None else links.unionByName(new)
        groups = components(links if same is None else links.unionByName(same), scratch, f"groups-{k}")
    members = held[0] if len(held) == 1 else spark.read.parquet(*(f"{scratch.path}/whole-sets-{i}" for i in range(len(held))))
    members = members.select("id", "tokens").join(groups.select(F.col("node").alias("id"), "root"), "id")
    return sets, names, groups, members, scratch
