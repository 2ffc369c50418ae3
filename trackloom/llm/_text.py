"""Vectorised views of Arrow text columns, shared by the operators that run numpy inside Spark tasks.

A column is looked at as one run of UTF-8 bytes.  Words are maximal runs of bytes other than ``0x20`` and
``0x09-0x0D``; these bytes never occur inside a multi-byte character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; it depends on nothing outside the span."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=total[1:])
    raw = (total[end] - total[start]) * powers(_INVERSE, len(data) + 1)[start]
    return mix(raw + (end - start).astype(np.uint64))


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows holding about ``most`` bytes of text each; a longer text comes alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > at and (held + n > most or i - at >= rows):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


@dataclass
class Texts:
    """The bytes of a column and its rows' bounds: row ``r`` is ``data[bounds[r]:bounds[r + 1]]``."""

    data: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, column: pa.Array, lower: bool = False) -> Texts:
        """Null texts count as empty."""
        column = pc.fill_null(column, "") if column.null_count else column
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        _, offsets, data = column.buffers()
        if offsets is None or not len(column):
            return cls(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
        bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        bytes_ = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
        return cls(LOWER[bytes_] if lower else bytes_, bounds - bounds[0])

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def _runs(self, inside: np.ndarray) -> Spans:
        """Maximal runs of bytes with ``inside`` true, cut at row bounds."""
        first = np.zeros(len(inside) + 1, bool)
        first[self.bounds[:-1]] = True
        before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
        after = np.concatenate((inside[1:], [False])) if len(inside) else inside
        start = np.flatnonzero(inside & (~before | first[:-1]))
        end = np.flatnonzero(inside & (~after | first[1:])) + 1
        return Spans.cut(start, end, np.searchsorted(start, self.bounds))

    def words(self) -> Spans:
        return self._runs(~SPACE[self.data])

    def lines(self) -> Spans:
        """The pieces between newlines; an empty text is one empty line."""
        breaks = np.flatnonzero(self.data == 10)
        start = np.concatenate((self.bounds[:-1], breaks + 1))
        row = np.concatenate((np.arange(len(self)), np.searchsorted(self.bounds, breaks, "right") - 1))
        order = np.lexsort((start, row))
        start, row = start[order], row[order]
        last = np.concatenate((row[1:] != row[:-1], [True])) if len(row) else np.zeros(0, bool)
        end = np.empty_like(start)
        end[:-1] = start[1:] - 1
        end[last] = self.bounds[1:][row[last]]
        return Spans(start, end, row, np.searchsorted(row, np.arange(len(self) + 1)))

    def sums(self, hit: np.ndarray) -> np.ndarray:
        """How many bytes of each row have ``hit``."""
        total = np.concatenate(([0], np.cumsum(hit)))
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


@dataclass
class Spans:
    """Spans of bytes; those of row ``r`` are ``first[r]:first[r + 1]``."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray

    @classmethod
    def cut(cls, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> Spans:
        return cls(start, end, np.repeat(np.arange(len(first) - 1), np.diff(first)), first)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        return span_hashes(data, self.start, self.end)


def windows(hashes: np.ndarray, spans: Spans, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the spans that start a window of ``n`` spans inside one row, and the windows' hashes."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(spans.row[: len(hashes) - n + 1] == spans.row[n - 1 :])
    total, base = np.zeros(len(at), np.uint64), powers(_BASE, n)
    for k in range(n):
        total += hashes[at + k] * base[k]
    return at, mix(total)


def repeated(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """True for every key that occurs at least twice in its row."""
    if not len(keys):
        return np.zeros(0, bool)
    joint = mix(keys ^ mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(joint)
    same = np.concatenate(([False], joint[order][1:] == joint[order][:-1]))
    hit = same.copy()
    hit[:-1] |= same[1:]
    out = np.empty(len(keys), bool)
    out[order] = hit
    return out


def distinct(keys: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of each row, rows in order and keys ascending in a row, and each row's bounds."""
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    return keys[new], np.searchsorted(rows[new], np.arange(n_rows + 1))
