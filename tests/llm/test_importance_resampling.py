import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trackloom.llm._text import Texts
from trackloom.llm.importance_resampling import crc_states, feature_buckets, resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text, max_n):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, max_n + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, max_n=1, buckets=10000, percent=10, least=20, seed=2024):
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    feats = [plain_features(text, max_n) for _, text in docs]
    s = Counter(crc(f) for _, fs in feats for f in fs)
    t = Counter(crc(f) for text in target for f in plain_features(text, max_n)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)}
    rows = []
    for (doc_id, _), (words, fs) in zip(docs, feats, strict=True):
        weight = sum(gain[crc(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted(((*r[:4], drawn.get(id(r))) for r in rows), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(rng, n, of=300):
    return " ".join(rng.choice(["w", "Wörd", "x9", "ÄB"]) + str(rng.randrange(of)) for _ in range(n))


@pytest.mark.parametrize("max_n", [1, 2, 3])
@pytest.mark.parametrize("percent", [10, 55, 100])
def test_resample_against_plain_version(spark, make_docs, max_n, percent):
    rng = random.Random(max_n * percent)
    docs = [(i, words(rng, rng.randrange(0, 60))) for i in range(120)] + [(500, None), (501, ""), (502, "... !!"), (503, "a" * 5000 + " b" * 400)]
    target = [words(rng, 40, 30) for _ in range(20)] + [None, ""]
    got = resample(make_docs(docs), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"), max_n=max_n, percent=percent, buckets=1000)
    assert result(got) == plain(docs, target, max_n, 1000, percent)


def test_repeated_rows_null_ids_and_extra_columns(spark, make_docs):
    rng = random.Random(4)
    text, other = words(rng, 30), words(rng, 25)
    docs = [(7, text)] * 40 + [(8, other), (None, text), (None, other)] * 3
    target = spark.createDataFrame([(text,)], "text string")
    got = result(resample(make_docs(docs), target, percent=50))
    want = plain(docs, [text], percent=50)
    assert got == want and sum(r[4] is not None for r in got) == 24


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "text string")
    assert resample(make_docs([]), none).count() == 0
    docs = [(i, words(random.Random(i), 30)) for i in range(20)]
    assert result(resample(make_docs(docs), none)) == plain(docs, [])
    few = [(1, "one two"), (2, None)]
    assert result(resample(make_docs(few), none)) == plain(few, [])


def test_checksums_of_spans_and_their_extension():
    rng = random.Random(0)
    parts = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 5, 31, 32, 33, 200]))) for _ in range(60)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    end = np.cumsum([len(p) for p in parts])
    start = end - [len(p) for p in parts]
    state = crc_states(data, start, end)
    assert (~state).tolist() == [zlib.crc32(p) for p in parts]
    assert (~crc_states(data, start[1:], end[1:], state[:-1])).tolist() == [zlib.crc32(a + b) for a, b in zip(parts, parts[1:], strict=False)]


def test_streams_keep_documents_apart():
    keys, features, counts = feature_buckets(Texts.of(pa.array(["a b", None, "", "b c d"]), lower=True), 2, 10000)
    want = [zlib.crc32(f) % 10000 for f in (b"a", b"b", b"a b", b"b", b"c", b"d", b"b c", b"c d")]
    assert keys.tolist() == want and features.tolist() == [3, 0, 0, 5] and counts.tolist() == [2, 0, 0, 3]
