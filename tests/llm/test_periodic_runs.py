import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from trackloom.llm.periodic_runs import collapse_runs, find_runs, periodic_runs

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_runs(w, shortest=12):
    """Every stretch of equal words p apart, for every p; of equal bounds the smallest p."""
    best = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(shortest, 2 * p):
                best.setdefault((i, j + p), p)
            i = max(i + 1, j)
    return sorted(((s, e - s, p) for (s, e), p in best.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, tails, shortest=12):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if tails and doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w, shortest)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return doc_id, len(runs), *best, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def made(rng):
    n, k = rng.randrange(0, 120), rng.choice([1, 2, 3, 8, 60])
    w = [f"ä{rng.randrange(k)}" for _ in range(n)]
    if n and rng.random() < 0.7:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(2, 9)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return rng.choice([" ", "\n", "\t  "]).join(w)


@pytest.mark.parametrize("tails", [False, True])
def test_periodic_runs_against_plain_version(spark, make_docs, tails):
    rng = random.Random(1)
    docs = [(i, made(rng)) for i in range(250)] + [(300, None), (301, ""), (302, " \n"), (None, "a " * 40), (None, None), (7, "b " * 30), (7, "b " * 30)]
    got = sorted((tuple(r) for r in periodic_runs(make_docs(docs), repeat_tails=tails).collect()), key=repr)
    assert got == sorted((plain_row(*d, tails) for d in docs), key=repr)


def test_whole_fixture_against_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 8000]
    got = {tuple(r) for r in periodic_runs(docs, repeat_tails=True).collect()}
    want = [plain_row(*r, True) for r in rows]
    assert set(want) <= got and any(r[1] for r in want)


def test_short_limits_and_many_texts_at_once():
    rng = random.Random(2)
    for _ in range(60):
        texts = [[rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(0, 70))] for _ in range(4)]
        bounds = np.cumsum([0] + [len(t) for t in texts])
        flat = np.array([x for t in texts for x in t], np.uint64)
        for shortest in (2, 5, 12):
            got = [(int(s), int(e - s), int(p)) for s, e, p in find_runs(flat, bounds, shortest)]
            assert got == [(s + int(b), n, p) for t, b in zip(texts, bounds, strict=False) for s, n, p in plain_runs(t, shortest)]


def test_long_texts_and_long_words(spark, make_docs):
    block = [f"w{i}" for i in random.Random(3).sample(range(10**6), 700)]
    docs = [(1, " ".join(block * 300)), (2, "x" * 100_000 + " y" * 200_000), (3, " ".join(str(i) for i in range(150_000)))]
    got = {r["doc_id"]: r for r in periodic_runs(make_docs(docs)).collect()}
    assert (got[1]["n_runs"], got[1]["start"], got[1]["length"], got[1]["period"]) == (1, 0, 210_000, 700)
    assert (got[2]["n_runs"], got[2]["start"], got[2]["length"], got[2]["period"]) == (1, 1, 200_000, 1)
    assert got[3]["n_runs"] == 0
    assert got[1]["collapsed_sha256"] == hashlib.sha256(" ".join(block).encode()).hexdigest()


def test_collapse_keeps_texts_without_runs_and_all_columns(spark, make_docs):
    docs = make_docs([(1, "a  b\nc"), (2, "x y " * 9 + "end"), (3, None)])
    got = collapse_runs(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "a  b\nc", 2: "x y end", 3: None}


def test_empty_table(spark, make_docs):
    assert periodic_runs(make_docs([])).count() == 0
