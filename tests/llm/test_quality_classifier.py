import random
import zlib

import pyarrow as pa

from trackloom.llm._text import Texts
from trackloom.llm.quality_classifier import classify, fit, fit_classifier, indicators


def test_held_out_accuracy_and_edges(spark, make_docs):
    rng = random.Random(4)
    text = lambda good: " ".join("".join(rng.choice("abcdef") for _ in range(4)) + ("" if good else rng.choice(["***", "!!"])) for _ in range(rng.randrange(5, 60)))
    rows = [(i, text(i % 4 > 0)) for i in range(300)]
    docs = make_docs([*rows, (1000, None), (1001, ""), (None, "x"), (5, rows[5][1]), (1002, "word " * 100_000)])
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(300)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    model = fit_classifier(docs, labels)
    out = {r.doc_id: r for r in classify(docs, model).collect()}
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())
    held = [i for i in range(300) if out[i].held_out]
    assert len(held) > 50 and sum(out[i].predicted == (i % 4 > 0) for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    assert out[1000].score == out[1001].score
    assert classify(docs, model).count() == 305 and classify(docs.limit(0), model).count() == 0
    none = fit_classifier(docs, labels.limit(0))
    assert {r.score for r in classify(docs, none).collect()} == {0.5}


def test_single_class_and_indicators():
    texts = Texts.of(pa.array(["a a a b", "", None, "xyz"]))
    (first, rows, buckets), = indicators(texts)
    assert first == 0 and set(rows.tolist()) == {0, 3} and len(buckets) == len(rows)
    assert fit([buckets], [1]).score(texts).min() > 0.5
