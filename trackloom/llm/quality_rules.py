"""Quality rules: a few fixed rules, then gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows (``sample_rows``), with monotonic constraints on chosen
statistics, and flattened into numpy node arrays, which every task applies to whole batches of rows.
Statistics come from the whole text of every document in a single pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm._shared import labelled_sample
from trackloom.llm._text import Texts, distinct, repeated, slices, windows

#: Name and sign of the constraint: -1 means that more of it never raises the score.
STATISTICS = {
    "log_words": 0,
    "mean_word_chars": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_word_share": -1,
    "same_word_share": -1,
    "distinct_word_share": 0,
    "upper_share": -1,
    "digit_share": 0,
    "mark_share": 0,
    "words_per_line": 0,
    "ends_share": 0,
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL, _UPPER, _DIGIT, _MARK, _END = (np.isin(np.arange(256), list(x)) for x in (b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?;:,.()[]{}\"'", b".!?"))


def statistics(texts: Texts) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts of each text, and its row of ``STATISTICS``."""
    n, data = len(texts), texts.data
    words = texts.words()
    n_words = words.counts()
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = begins[words.end] - begins[words.start]
    per_row = lambda x: np.bincount(words.row, x, n).astype(np.int64)
    word_chars = per_row(chars)
    n_symbols = texts.sums(_SYMBOL[data])

    lines = texts.lines()
    held = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    _, line_bounds = distinct(lines.hashes(data)[held], lines.row[held], n)
    n_lines = np.bincount(lines.row[held], minlength=n)
    n_dup_lines = n_lines - np.diff(line_bounds)

    hashes = words.hashes(data)
    at, keys = windows(hashes, words, 8)
    again = at[repeated(keys, words.row[at])]
    cover = np.zeros(len(hashes) + 9, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 8, -1)
    covered = np.cumsum(cover)[: len(hashes)] > 0
    n_repeat_words = np.bincount(words.row[covered], minlength=n)

    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1])
    _, word_bounds = distinct(hashes, words.row, n)
    ends = _END[data[words.end - 1]] if len(hashes) else np.zeros(0, bool)
    base = dict(zip(BASE, (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), strict=True))
    some, all_chars = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    rows = np.column_stack([
        np.log1p(n_words), word_chars / some, n_symbols / some, n_dup_lines / np.maximum(n_lines, 1), n_repeat_words / some,
        np.bincount(words.row[same], minlength=n) / some, np.diff(word_bounds) / some, texts.sums(_UPPER[data]) / all_chars,
        texts.sums(_DIGIT[data]) / all_chars, texts.sums(_MARK[data]) / all_chars, n_words / np.maximum(n_lines, 1),
        np.bincount(words.row[ends], minlength=n) / some,
    ])
    return base, rows


@dataclass
class Trees:
    """All trees in one set of arrays; a node's children are ``left`` and ``left + 1``, and a leaf is its own child."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        node = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            inner = self.left[node] >= 0
            right = x[rows, self.feature[node]] > self.cut[node]
            node = np.where(inner, self.left[node] + right, node)
        return 1 / (1 + np.exp(-(self.start + self.value[node].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], n_trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 64, least: int = 8, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss over histograms of quantile bins.

    A split on a feature of sign s is allowed only if s * (right value - left value) >= 0; the mean of the two
    values bounds all leaves below, so that every tree, and their sum, is monotonic in that feature.
    """
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T] if len(x) else [np.zeros(0)] * x.shape[1]
    binned = [np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)]  # c <= e[b] goes left of cut b
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    start = float(np.log(share / (1 - share)))
    margin = np.full(len(y), start)
    feature, cut, left, value, roots = [], [], [], [], []

    def add() -> int:
        feature.append(0), cut.append(0.0), left.append(-1), value.append(0.0)
        return len(feature) - 1

    def grow(node: int, rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, deep: int) -> None:
        own = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
        best = (1e-6, None)
        if deep < depth and len(rows) >= 2 * least:
            for f, sign in enumerate(signs):
                if not len(edges[f]):
                    continue
                b = binned[f][rows]
                sums = [np.cumsum(np.bincount(b, w, len(edges[f]) + 1))[:-1] for w in (g[rows], h[rows], None)]
                gl, hl, nl = sums
                gr, hr, nr = g[rows].sum() - gl, h[rows].sum() - hl, len(rows) - nl
                vl, vr = (np.clip(-a / (b_ + ridge), low, high) for a, b_ in ((gl, hl), (gr, hr)))
                gain = -(gl * vl + (hl + ridge) * vl * vl / 2) - (gr * vr + (hr + ridge) * vr * vr / 2)
                gain += g[rows].sum() * own + (h[rows].sum() + ridge) * own * own / 2
                gain[(nl < least) | (nr < least) | (sign * (vr - vl) < 0)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, vl[k], vr[k]))
        if best[1] is None:
            value[node] = rate * own
            margin[rows] += value[node]
            return
        f, k, vl, vr = best[1]
        feature[node], cut[node], left[node] = f, float(edges[f][k]), add()
        add()
        go_left = binned[f][rows] <= k
        mid = (vl + vr) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[signs[f]]
        for side, part, (lo, hi) in ((0, rows[go_left], bounds[0]), (1, rows[~go_left], bounds[1])):
            grow(left[node] + side, part, g, h, lo, hi, deep + 1)

    for _ in range(n_trees if len(np.unique(y)) > 1 else 0):
        p = 1 / (1 + np.exp(-margin))
        roots.append(add())
        grow(roots[-1], np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-9), -4.0, 4.0, 0)
    return Trees(np.array(feature, np.int64), np.array(cut), np.array(left, np.int64), np.array(value), np.array(roots, np.int64), depth, start)


def fit_quality_trees(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, seed: int = 11, **how) -> Trees | None:
    """Trees fitted on at most ``sample_rows`` labelled documents; None without labelled documents.

    Only the statistics of the sample (12 numbers a row) reach the driver.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                _, x = statistics(Texts.of(batch.column("text")))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("label"), batch.column("doc_id")], ["x", "label", "doc_id"])

    sample = labelled_sample(docs, labels, "quality", sample_rows, seed).mapInArrow(rows, "x array<double>, label int, doc_id bigint").toPandas()
    if not len(sample):
        return None
    sample = sample.iloc[np.lexsort((sample["x"].map(tuple), sample["doc_id"]))]  # the same order in every run
    return fit_trees(np.stack(sample["x"]), (sample["label"].to_numpy() > 0).astype(float), list(STATISTICS.values()), **how)


def quality_rules(docs: DataFrame, trees: Trees | None, keep_columns: bool = False) -> DataFrame:
    """Every document's counts and verdict.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs), base_failed (under 20 words,
    or over 30 % of the words in repeated 8-word windows), score (of the trees; null without trees) and kept: false if
    base_failed, else score >= 0.5, else true without trees.  A null text counts as empty and so fails; repeated rows
    get one result each, and so do rows of one doc_id or of none; a score of exactly 0.5 is kept; an empty table gives an
    empty result.  Very long texts are read whole, alone in their batch.  With ``keep_columns`` the kept documents come
    back instead, with their own columns; else other columns are ignored, whatever their names.
    """
    columns = docs.columns if keep_columns else ["doc_id"]
    schema_of = {f.name: f.dataType.simpleString() for f in docs.schema}
    base_schema = ", ".join(f"{n} bigint" for n in BASE)
    out_schema = ", ".join(f"`{c}` {schema_of[c]}" for c in columns)
    out_schema += "" if keep_columns else f", {base_schema}, base_failed boolean, score double, kept boolean"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                base, x = statistics(Texts.of(batch.column("text")))
                failed = (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])
                score = trees.score(x) if trees else None
                kept = ~failed & (score >= 0.5 if trees else True)
                if keep_columns:
                    yield batch.filter(pa.array(kept))
                    continue
                values = [batch.column("doc_id"), *(pa.array(base[n], pa.int64()) for n in BASE), pa.array(failed), pa.array(score) if trees else pa.nulls(batch.num_rows, pa.float64()), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(values, ["doc_id", *BASE, "base_failed", "score", "kept"])

    return docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*columns, "text"]))).mapInArrow(rows, out_schema)
