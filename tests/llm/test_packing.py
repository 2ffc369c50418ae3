from collections import defaultdict

import numpy as np
import pytest

from trackloom.llm.packing import best_fit_packing, pack_shard


def test_shard_packing_is_tight():
    rng = np.random.default_rng(2)
    sizes = np.sort(rng.integers(1, 1000, 3000))[::-1]
    bins, caps = pack_shard(sizes, (256, 512, 1024))
    held = np.bincount(bins, sizes)
    assert (held <= caps).all() and len(held) == len(caps)
    assert all(c == min(x for x in (256, 512, 1024) if x >= h) for c, h in zip(caps, held, strict=True))
    assert held.sum() / caps.sum() > 0.97


def test_every_word_once(spark, make_docs):
    texts = {1: "w " * 10, 2: "w " * 100, 3: None, 4: "", 5: "w " * 37, 6: "w", 7: "w " * 5000}
    docs = make_docs([*texts.items(), (5, texts[5]), (None, "a b c")])
    rows = best_fit_packing(docs, capacities=(16, 32), pieces_per_shard=50).collect()
    words, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        words[(r.doc_id, r.copy)].append((r.start_word, r.n_words))
        if r.bin_id is None:
            assert r.n_words == 0 and r.capacity is None
        else:
            bins[(r.bin_id, r.capacity)].append((r.slot, r.start_in_bin, r.n_words))
    size = lambda d: len(("a b c" if d is None else texts[d] or "").split())
    assert set(words) == {(d, 1) for d in texts} | {(5, 2), (None, 1)}
    for (d, _), spans in words.items():
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at == size(d)
    for (_, capacity), slots in bins.items():
        at = 0
        for i, (slot, start, n) in enumerate(sorted(slots)):
            assert (slot, start) == (i, at)
            at += n
        assert at <= capacity and (capacity == 16 or at > 16)
    assert best_fit_packing(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        best_fit_packing(docs, capacities=())
