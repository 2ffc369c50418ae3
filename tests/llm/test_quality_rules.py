import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.llm._text import Texts
from trackloom.llm.quality_rules import BASE, STATISTICS, fit_quality_trees, fit_trees, quality_rules, statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "é#", "\n", "\n", " ", "\t", "日本|", "a b c d e f g h "]), max_size=60).map("".join)), max_size=6))
def test_counts_match_brute_force(texts):
    base, rows = statistics(Texts.of(pa.array(texts, pa.string())))
    assert list(zip(*(base[n].tolist() for n in BASE), strict=True)) == [brute(t) for t in texts]
    assert rows.shape == (len(texts), len(STATISTICS)) and np.isfinite(rows).all()


def test_trees_are_monotonic_and_fit():
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    y = (x[:, 0] + 0.1 * rng.standard_normal(600) < 0.5).astype(float)
    trees = fit_trees(x, y, [-1, 0, 0])
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.93
    grid = np.tile(x[:50, None, :], (1, 40, 1))
    grid[:, :, 0] = np.linspace(0, 1, 40)
    scores = trees.score(grid.reshape(-1, 3)).reshape(50, 40)
    assert (np.diff(scores, axis=1) <= 1e-12).all()


def test_query_edges(spark, make_docs):
    good = " ".join(f"word{i}" for i in range(40)) + "."
    bad = " ".join(f"w{i}***" for i in range(40))
    docs = make_docs([(1, None), (2, ""), (3, good), (3, good), (4, bad), (None, good), (5, "same line here\n" * 30), (6, good * 3000)])
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    trees = fit_quality_trees(docs, labels, least=1)
    out = [r.asDict() for r in quality_rules(docs, trees).collect()]
    assert len(out) == 8
    by = {r["doc_id"]: r for r in out}
    assert by[1]["base_failed"] and by[2]["base_failed"] and not by[1]["kept"]
    assert by[3]["kept"] and not by[4]["kept"] and by[5]["base_failed"]
    assert [r["n_words"] for r in out if r["doc_id"] == 3] == [40, 40]
    kept = quality_rules(docs, trees, keep_columns=True)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {3, None}
    none = spark.createDataFrame([], labels.schema)
    assert fit_quality_trees(docs, none) is None
    assert {r.doc_id for r in quality_rules(docs, None).where("kept").collect()} >= {3, 4}
    assert quality_rules(docs.limit(0), trees).count() == 0
