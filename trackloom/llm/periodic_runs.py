"""Periodic runs of words, found by probing harmonic grids.

A run is a stretch of words that its smallest period p describes: words p apart are equal, and no neighbouring word can
be added.  If it has at least 2 * p words, it holds a grid point j * p together with (j + 1) * p.  So for every period
only the words at its grid points are compared, n / p pairs of them and n * ln(n) for all periods.  From pairs of equal
words, comparison in chunks goes to the right up to the next grid point and to the left down to the one before; points
whose stretches touch are one run.  Periods are taken in octaves, since a multiple of a period lies in a later octave:
grid points inside of a run whose period divides theirs are skipped.

Many texts are searched at once, as one array of word numbers; a word's number is a 64-bit hash of its bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm._text import Texts, slices

_PROBES = 1 << 19
_CELLS = 1 << 20
_PIECE = 1 << 17


def _reach(words: np.ndarray, at: np.ndarray, period: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``at`` on (``step`` 1) or back (-1) equal those one period later, at most ``most`` of each."""
    out = np.zeros(len(at), np.int64)
    live, size = np.flatnonzero(most > 0), 4
    while len(live):
        ahead = np.arange(size)
        nxt = []
        for lo in range(0, len(live), max(1, _CELLS // size)):
            some = live[lo : lo + max(1, _CELLS // size)]
            width = np.minimum(size, most[some] - out[some])
            # Places past the limit repeat the last one inside it.
            places = at[some][:, None] + step * (out[some][:, None] + np.minimum(ahead, width[:, None] - 1))
            same = words[places] == words[places + period[some][:, None]]
            n = np.minimum(np.where(same.all(axis=1), size, np.argmin(same, axis=1)), width)
            out[some] += n
            nxt.append(some[(n == width) & (out[some] < most[some])])
        live, size = np.concatenate(nxt), min(2 * size, _CELLS)
    return out


def _inside(start: np.ndarray, end: np.ndarray, period: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Whether a span lies in one of ``runs`` (start, end, period; by start) whose period divides its own.

    Looks at the last run that starts before it and at the one that reaches farthest.  A run that is missed costs time
    only: what is found in it again has the same bounds, and the larger period goes.
    """
    out = np.zeros(len(start), bool)
    if not len(runs):
        return out
    last = np.searchsorted(runs[:, 0], start, "right") - 1
    far = np.maximum.accumulate(np.where(runs[:, 1] == np.maximum.accumulate(runs[:, 1]), np.arange(len(runs)), 0))
    for which in (np.maximum(last, 0), far[np.maximum(last, 0)]):
        out |= (last >= 0) & (runs[which, 1] >= end) & (period % runs[which, 2] == 0)
    return out


def _too_short(at: np.ndarray, period: np.ndarray, first: np.ndarray, need: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Whether known runs show that the stretch of equal words around a pair has under ``need`` words.

    If both words lie in runs of one period, with about a period of words left in both, the stretch ends where the first
    of the two runs ends, unless both end there; likewise at its start, or at the text's (``first``).
    """
    if not len(runs):
        return np.zeros(len(at), bool)
    one, two = (np.searchsorted(runs[:, 0], x, "right") - 1 for x in (at, at + period))
    a, b = runs[np.maximum(one, 0)], runs[np.maximum(two, 0)]
    known = (one >= 0) & (two >= 0) & (a[:, 1] > at) & (b[:, 1] > at + period) & (a[:, 2] == b[:, 2])
    right, right_b = a[:, 1] - at, b[:, 1] - at - period
    left, left_b = at - a[:, 0], at + period - b[:, 0]
    known &= (right != right_b) & (left != left_b)
    right, left = np.minimum(right, right_b), np.minimum(left, left_b)
    return known & (right >= a[:, 2]) & ((left >= a[:, 2] - 1) | (at - left == first)) & (right + left < need)


def find_runs(words: np.ndarray, bounds: np.ndarray, shortest: int = 12) -> np.ndarray:
    """All runs of at least max(``shortest``, 2 * period) words as rows (start, end, period), by start, then period.

    ``bounds`` are the texts' bounds in ``words``; starts and ends are places in ``words``.
    """
    sizes = np.diff(bounds)
    runs = np.zeros((0, 3), np.int64)
    low = 1
    while low <= sizes.max(initial=0) // 2:
        texts = np.flatnonzero(sizes >= 2 * low)
        found = []
        # One row for each text and period of this octave, with as many probes as the period has grid points.
        top = np.minimum(2 * low - 1, sizes[texts] // 2) - low + 1
        text = np.repeat(texts, top)
        period = low + np.arange(len(text)) - np.repeat(np.cumsum(top) - top, top)
        probes = (sizes[text] - 1) // period
        edge = np.concatenate(([0], np.cumsum(probes)))
        lo = 0
        while lo < len(text):
            hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + _PROBES, "right")) - 1)
            row = np.repeat(np.arange(lo, hi), probes[lo:hi])
            j = np.arange(len(row)) - (edge[row] - edge[lo])
            at, p = bounds[text[row]] + j * period[row], period[row]
            hit = words[at] == words[at + p]
            hit[hit] = ~_inside(at[hit], at[hit] + p[hit] + 1, p[hit], runs)
            hit[hit] = ~_too_short(at[hit], p[hit], bounds[text[row[hit]]], np.maximum(shortest - p[hit], p[hit]), runs)
            row, j, at, p = row[hit], j[hit], at[hit], p[hit]
            first, end = bounds[text[row]], bounds[text[row] + 1]
            right = _reach(words, at, p, np.minimum(p, end - p - at), 1)
            # A stretch that reaches the grid point before is taken from there.
            left = _reach(words, at - 1, p, np.minimum(p, at - first), -1)
            head = (left < p) | (j == 0)
            joined = np.zeros(len(row), bool)
            joined[1:] = (row[1:] == row[:-1]) & (j[1:] == j[:-1] + 1) & (right[:-1] == p[:-1])
            head |= ~joined
            at0, stop = at - left, at + right
            begin = np.flatnonzero(head)
            last = np.append(begin[1:], len(row))[: len(begin)] - 1
            start, end_ = at0[begin], stop[last] + p[begin] if len(begin) else stop[last]
            long = end_ - start >= np.maximum(shortest, 2 * p[begin])
            found.append(np.stack((start[long], end_[long], p[begin][long]), axis=1))
            lo = hi
        runs = np.concatenate((runs, *found))
        # Of equal bounds the smallest period is the run's own.
        runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
        runs = runs[np.concatenate(([True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)))] if len(runs) else runs
        low *= 2
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _repeat_tails(source: np.ndarray, bounds: np.ndarray, seeds: list[int | None]) -> None:
    """Replaces the tails of some texts, in place: places of words by places of the words that stand in for them."""
    for r, h in enumerate(seeds):
        first, n = int(bounds[r]), int(bounds[r + 1] - bounds[r])
        if h is None or h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source[first + a : first + n] = first + a + np.arange(n - a) % p


def joined_digests(texts: Texts, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> list[str]:
    """SHA-256 of each text's words ``start:end`` (in order of ``row``), joined by one space."""
    shas = [hashlib.sha256() for _ in range(len(texts))]
    lengths = end - start
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    # A space before each word but a text's first, in pieces of bounded size.
    widths = lengths + ~first
    total = np.concatenate(([0], np.cumsum(widths)))
    lo = 0
    while lo < len(row):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + 8 * _PIECE, "right")) - 1)
        at = total[lo:hi] - total[lo] + ~first[lo:hi]
        buffer = np.full(total[hi] - total[lo], 32, np.uint8)
        inner = np.arange(lengths[lo:hi].sum()) - np.repeat(np.cumsum(lengths[lo:hi]) - lengths[lo:hi], lengths[lo:hi])
        buffer[np.repeat(at, lengths[lo:hi]) + inner] = texts.data[np.repeat(start[lo:hi], lengths[lo:hi]) + inner]
        cuts = np.flatnonzero(np.concatenate(([True], row[lo + 1 : hi] != row[lo : hi - 1])))
        ends = np.append(total[lo + cuts[1:]], total[hi]) - total[lo]
        for r, x, y in zip(row[lo + cuts].tolist(), (total[lo + cuts] - total[lo]).tolist(), ends.tolist(), strict=True):
            shas[r].update(buffer[x:y])
        lo = hi
    return [s.hexdigest() for s in shas]


def _search(batch: pa.RecordBatch, repeat_tails: bool, shortest: int) -> pa.RecordBatch:
    texts = Texts.of(batch.column("text"))
    spans = texts.words()
    bounds = spans.first
    source = np.arange(len(spans.start))
    if repeat_tails:
        seeds = [None if x is None else zlib.crc32(str(x).encode()) for x in batch.column("doc_id").to_pylist()]
        _repeat_tails(source, bounds, seeds)
    words = spans.hashes(texts.data)[source]
    runs = find_runs(words, bounds, shortest)
    row = np.searchsorted(bounds, runs[:, 0], "right") - 1
    length = runs[:, 1] - runs[:, 0]
    # Each run drops what follows its first period.
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 1], -1)
    kept = source[np.cumsum(steps[:-1]) == 0]
    kept_row = spans.row[np.cumsum(steps[:-1]) == 0]
    cut = np.searchsorted(row, np.arange(len(texts) + 1))
    lines = [f"{s},{n},{p}\n" for s, n, p in zip((runs[:, 0] - bounds[row]).tolist(), length.tolist(), runs[:, 2].tolist(), strict=True)]
    order = np.lexsort((runs[:, 2], runs[:, 0], -length, row))
    best = np.full(len(texts), -1)
    best[row[order][::-1]] = order[::-1]
    has = best >= 0
    top = lambda v: pa.array(v[np.maximum(best, 0)] if len(v) else np.zeros(len(best), np.int64), pa.int64(), mask=~has)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"), pa.array(np.diff(cut), pa.int64()), top(runs[:, 0] - bounds[row]), top(length), top(runs[:, 2]), top(1000 * length // np.maximum(runs[:, 2], 1)),
            pa.array([hashlib.sha256("".join(lines[cut[r] : cut[r + 1]]).encode()).hexdigest() for r in range(len(texts))]),
            pa.array(joined_digests(texts, spans.start[kept], spans.end[kept], kept_row)),
        ],
        ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    )


SCHEMA = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, shortest: int = 12, repeat_tails: bool = False) -> DataFrame:
    """Runs of repeated words in each text, and the digest of the text without what they repeat.

    Words are runs of characters other than 0x20 and 0x09-0x0D, compared as they stand.  A run has a smallest period p
    and at least max(``shortest``, 2 * p) words; runs may overlap.  Returns one row for each row: doc_id, n_runs; start
    (word number), length, period and exponent_milli of the longest run (ties: smallest start, then period; null without
    runs); runs_sha256 over the lines ``start,length,period`` of all runs, by start, then period; collapsed_sha256 over
    the words that no run repeats (those after a run's first period are dropped), joined by one space.

    With ``repeat_tails`` the texts of a tenth of the ids, chosen by CRC-32, get a tail that repeats itself before the
    search, so that the search meets runs of all lengths and periods.

    Null and empty texts have no words: no runs, and digests of nothing.  Rows with a null doc_id are searched as they
    are.  Rows are read one by one, so equal ids and rows repeat their results.  A long text is searched whole, alone in
    its batch; probes and comparisons run in chunks of bounded size.  Other columns are ignored.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 19):
                yield _search(batch, repeat_tails, shortest)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(search, SCHEMA)


def collapse_runs(docs: DataFrame, shortest: int = 12) -> DataFrame:
    """``docs`` with texts in which every run of repeated words is cut to its first period.

    Texts without runs stay as they are; of others, the words that stay are joined by one space.  All columns stay.
    """
    names = docs.columns

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 19):
                texts = Texts.of(batch.column("text"))
                spans = texts.words()
                runs = find_runs(spans.hashes(texts.data), spans.first, shortest)
                steps = np.zeros(len(spans.start) + 1, np.int64)
                np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
                np.add.at(steps, runs[:, 1], -1)
                stays = np.cumsum(steps[:-1]) == 0
                out = batch.column("text").to_pylist()
                for r in np.unique(np.searchsorted(spans.first, runs[:, 0], "right") - 1).tolist():
                    lo, hi = spans.first[r], spans.first[r + 1]
                    at = lo + np.flatnonzero(stays[lo:hi])
                    out[r] = b" ".join(texts.data[x:y].tobytes() for x, y in zip(spans.start[at].tolist(), spans.end[at].tolist(), strict=True)).decode()
                text = pa.array(out, batch.column("text").type)
                yield pa.RecordBatch.from_arrays([text if c == "text" else batch.column(c) for c in names], names)

    return docs.mapInArrow(collapse, docs.schema)
