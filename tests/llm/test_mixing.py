import hashlib
from collections import defaultdict

import pytest

from trackloom.llm.mixing import mix_sources


def targets(sizes):
    """Resharing round by round."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return out


def test_matches_brute_force(spark, make_docs):
    rows = [(i, "w " * (i * 7 % 23), ["a", "b", None, "", "é", "zz"][i % 6]) for i in range(400)] + [(1000, None, "a"), (1001, "", "only-empty"), (None, "q q", "b"), (5, "w w", "b"), (1002, "w " * 30_000, "big")]
    docs = make_docs(rows)
    got = mix_sources(docs).collect()
    size = lambda t: len((t or "").split())
    sums, groups = defaultdict(int), defaultdict(lambda: defaultdict(int))
    hash_ = lambda d: int(hashlib.md5(f"mix:{'null' if d is None else d}".encode()).hexdigest()[:15], 16)
    for d, t, s in rows:
        sums[s] += size(t)
        groups[s][hash_(d)] += size(t)
    want = targets(sums)
    times = {}
    for s, by in groups.items():
        epochs = int(want[s] >= sums[s])
        left, before = want[s] - epochs * sums[s], 0
        for h in sorted(by):
            times[s, h] = epochs + (before + by[h] / 2 <= left)
            before += by[h]
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got), key=repr) == sorted(((d, size(t), sums[s], round(want[s], 6), size(t) * times[s, hash_(d)]) for d, t, s in rows), key=repr)
    mixed = mix_sources(docs, rows=True)
    assert mixed.columns == docs.columns
    taken = defaultdict(int)
    for r in mixed.collect():
        taken[r.source] += size(r.text)
    assert taken == {s: v for s in sums if (v := sum(r.taken for r in got if (r.source_size, round(r.target, 6)) == (sums[s], round(want[s], 6)))) or s in taken}
    assert mix_sources(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mix_sources(docs, cap=3)


@pytest.mark.parametrize("cap", [2.0, 0.7, 0.03])
def test_equal_rows_are_split_where_a_budget_ends(spark, make_docs, cap):
    """Sources of many equal rows come within half a row of their targets, whatever their other columns hold."""
    rows = [(7, "w " * 4, "one")] * 1000 + [(i, "w " * (i % 9), "two") for i in range(300)] + [(8, "x y z", "two")] * 200 + [(None, "q " * 6, None)] * 77
    docs = make_docs(rows).repartition(5)
    got = mix_sources(docs, cap=cap)
    by = got.groupBy("source_size", "target").agg({"taken": "sum"}).collect()
    assert len(by) == 3
    for r in by:
        assert abs(r["sum(taken)"] - r["target"]) <= 4.5
    mixed = mix_sources(docs, cap=cap, rows=True)
    assert mixed.columns == docs.columns
    sums = {s: sum(len(r.text.split()) for r in mixed.collect() if r.source == s) for s in ("one", "two", None)}
    assert sorted(sums.values()) == sorted(r["sum(taken)"] for r in by)


def test_columns_named_like_the_operators_own(spark, make_docs):
    docs = make_docs([(i, "a b", "s") for i in range(9)] + [(3, "a b", "s")] * 4).withColumnsRenamed({"hash": "_mix", "size": "_mix1"})
    assert mix_sources(docs, rows=True).columns == docs.columns
    assert mix_sources(docs).count() == 13
