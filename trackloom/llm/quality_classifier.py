"""Naive Bayes support vectors over n-gram indicators.

Each text becomes the set of its hashed n-grams: byte trigrams, words, word pairs and runs of one word.  Indicators are
scaled by the log ratio of the classes' smoothed counts, and a linear hinge-loss model is fitted to them by dual
coordinate descent.  Ratios and weights come from a bounded sample of labelled rows (``sample_rows``); scoring is one
pass over all texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from trackloom.llm._shared import labelled_sample
from trackloom.llm._text import Texts, mix, slices, windows

BUCKETS = 1 << 17
RUNS = (2, 3, 4, 6, 8, 12, 16)  # lengths of n-grams of one and the same word, which count as one n-gram each
_ROWS = 128  # texts in one bit table


def indicators(texts: Texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: the first text's number, and (text in the run, bucket) of each indicator, texts ascending."""
    data, words = texts.data, texts.words()
    hashes = words.hashes(data)
    row_of = np.repeat(np.arange(len(texts)), np.diff(texts.bounds)) if len(data) else np.zeros(0, np.int64)
    if len(data) > 2:
        three = data[:-2].astype(np.uint64) | data[1:-1].astype(np.uint64) << np.uint64(8) | data[2:].astype(np.uint64) << np.uint64(16)
        inside = row_of[:-2] == row_of[2:]
        grams = [(row_of[:-2][inside], mix(three[inside] + np.uint64(1 << 40)))]
    else:
        grams = []
    at, pairs = windows(hashes, words, 2)
    grams += [(words.row, hashes), (words.row[at], pairs)]
    for n in RUNS:
        at, _ = windows(hashes, words, n)
        same = np.ones(len(at), bool)
        for k in range(1, n):
            same &= hashes[at + k] == hashes[at]
        grams.append((words.row[at][same], np.full(int(same.sum()), mix(np.array([n]))[0])))
    rows = np.concatenate([r for r, _ in grams])
    buckets = (np.concatenate([h for _, h in grams]) & np.uint64(BUCKETS - 1)).astype(np.int64)
    order = np.argsort(rows // _ROWS, kind="stable") if len(texts) > _ROWS else None
    rows, buckets = (rows, buckets) if order is None else (rows[order], buckets[order])
    cuts = np.searchsorted(rows // _ROWS, np.arange(0, max(1, -(-len(texts) // _ROWS)) + 1)) if len(rows) else np.zeros(-(-len(texts) // _ROWS) + 1, np.int64)
    for k in range(-(-len(texts) // _ROWS)):
        first = k * _ROWS
        n = min(_ROWS, len(texts) - first)
        table = np.zeros(n * BUCKETS, bool)
        table[(rows[cuts[k] : cuts[k + 1]] - first) * BUCKETS + buckets[cuts[k] : cuts[k + 1]]] = True
        hit = np.flatnonzero(table)
        yield first, hit // BUCKETS, hit % BUCKETS


@dataclass
class Model:
    """A text is the unit vector of its indicators scaled by ``ratio``; its margin is weight @ vector + bias."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float

    def score(self, texts: Texts) -> np.ndarray:
        """Probability of label 1; a text without n-grams has the bias alone."""
        dots, squares = np.zeros(len(texts)), np.zeros(len(texts))
        both, square = self.ratio * self.weight, self.ratio**2
        for first, rows, buckets in indicators(texts):
            n = min(_ROWS, len(texts) - first)
            dots[first : first + n] = np.bincount(rows, both[buckets], n)
            squares[first : first + n] = np.bincount(rows, square[buckets], n)
        margin = dots / np.sqrt(np.maximum(squares, 1e-12)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin, -500, 500)))


def fit(rows: list[np.ndarray], y: np.ndarray, smoothing: float = 1.0, cost: float = 10.0, epochs: int = 12, seed: int = 5, slope: float = 3.0) -> Model:
    """``rows`` are the buckets of each text; y is 0 or 1.

    Each class has the same total cost.  With a single class every text gets that class; without rows the score is 1/2.
    """
    y = np.asarray(y)
    if len(np.unique(y)) < 2:
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0 if not len(y) else (1.0 if y[0] else -1.0), slope)
    counts = [smoothing + np.bincount(np.concatenate([r for r, c in zip(rows, y, strict=True) if c == k]), minlength=BUCKETS) for k in (0, 1)]
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    values = [ratio[r] for r in rows]
    values = [v / max(1e-6, float(np.sqrt(v @ v))) for v in values]
    sign = np.where(y > 0, 1.0, -1.0)
    most = cost * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y == 0).sum()))
    squares = np.array([float(v @ v) + 1.0 for v in values])  # with the constant that carries the bias
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            gradient = sign[i] * (float(w[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - gradient / squares[i], 0.0), most[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * values[i]
                bias += step
    return Model(ratio, w, bias, slope)


#: Rows that labels are never learnt from.
HELD_OUT = "pmod(crc32(cast(doc_id AS string)), 3) = 1"


def fit_classifier(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 4000, seed: int = 7, where: str = f"NOT ({HELD_OUT})", **how) -> Model:
    """A model fitted on at most ``sample_rows`` labelled rows that satisfy ``where``; their bucket lists, about 4 KB a
    row, are what reaches the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                for first, at, buckets in indicators(Texts.of(batch.column("text"))):
                    n = min(_ROWS, batch.num_rows - first)
                    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(n + 1)), pa.int32()), pa.array(buckets, pa.int32()))
                    yield pa.RecordBatch.from_arrays([lists, batch.column("label").slice(first, n), batch.column("doc_id").slice(first, n)], ["buckets", "label", "doc_id"])

    sample = labelled_sample(docs, labels, label, sample_rows, seed, where).mapInArrow(rows, "buckets array<int>, label int, doc_id bigint").toArrow()
    order = np.lexsort((pa.compute.list_value_length(sample["buckets"]).to_numpy(), sample["doc_id"].to_numpy()))
    sample = sample.take(pa.array(order)).combine_chunks()
    lists = sample["buckets"].combine_chunks() if sample.num_rows else pa.array([], pa.list_(pa.int32()))
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    cuts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    return fit([flat[a:b].astype(np.int64) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], (sample["label"].to_numpy() > 0).astype(int), **how)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= 0.5) for each row of ``docs``.

    A null text counts as empty; empty texts get the score of the bias; long texts are scored as a whole.  Repeated rows
    give equal results, a null doc_id is not held out, other columns are not looked at, an empty table gives an empty
    result.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                score = model.score(Texts.of(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.selectExpr("doc_id", "text", f"coalesce({HELD_OUT}, false) AS held_out").mapInArrow(rows, "doc_id bigint, held_out boolean, score double, predicted int")
