import random
import re
from collections import defaultdict

import pytest

from trackloom.llm._graph import components
from trackloom.llm._shared import Scratch
from trackloom.llm.ngram_join import ngram_join, ngram_links

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(rows, n, percent):
    sets, parent = defaultdict(list), {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        s = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
        sets[d].append(s)
        parent[d] = d

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(parent, key=lambda d: (d is not None, d))
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = sorted((find(a), find(b)), key=lambda d: (d is not None, d))
                parent[rb] = ra
    return sorted(((d, len(s), find(d)) for d in sets for s in sets[d]), key=repr)


@pytest.mark.parametrize(("n", "percent", "rounds"), [(3, 90, 2), (5, 80, 0)])
def test_matches_brute_force(spark, make_docs, n, percent, rounds):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(200)]
    shared = " ".join(rng.choice(words) for _ in range(60))
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([2, 30, 80]))) + (" " + shared if i % 3 == 0 else "")) for i in range(40)]
    base = [rng.choice(words) for _ in range(120)]
    for i in range(40, 90):  # a group of copies with zero to six changed words
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, "A b"), (103, "a B"), (104, "a"), (105, rows[0][1].upper()), (106, rows[0][1]), (106, rows[0][1]), (None, "a b"), (107, " ".join(f"x{i}" for i in range(30_000)))]
    out = ngram_join(make_docs(rows), n, percent, hub_rounds=rounds)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=repr)
    assert got == brute(rows, n, percent)


def test_no_links_and_empty_table(spark, make_docs):
    docs = make_docs([(1, "a b c d e"), (2, "f g h i j"), (3, None)])
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in ngram_join(docs).collect()) == [(1, 1, 0), (2, 2, 0), (3, 3, 0)]
    assert ngram_join(docs.limit(0)).count() == 0


def test_components_of_long_paths(spark):
    order = list(range(60))
    random.Random(3).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(59)] + [(100, 101), (102, 101), (103, 103)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect())
    assert {got[i] for i in range(60)} == {0} and got[100] == got[101] == got[102] == 100


def test_every_link_between_distinct_sets(spark, make_docs, monkeypatch):
    monkeypatch.setattr("trackloom.llm.ngram_join._CELL_SETS", 4)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join(w if j != 5 * k else f"new{k}" for j, w in enumerate(base))) for k in range(12)]
    rows += [(20, rows[0][1].upper()), (21, " ".join(f"v{rng.randrange(90)}" for _ in range(50))), (22, None)]
    sets = {d: frozenset(zip(*(t.lower().split()[i:] for i in range(3)))) for d, t in rows if t}
    alike = {(a, b) for a in sets for b in sets if a < b and sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    links, members = ngram_links(make_docs(rows), 3, 80)
    want = {(a, b) for a, b in alike if 20 not in (a, b)}
    assert len(want) == 66 and sorted(map(tuple, links.collect())) == sorted(want)
    assert dict(map(tuple, members.collect())) == {d: 0 if d == 20 else d for d in sets}
    got = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join(make_docs(rows), 3, 80).collect()}
    assert got == {k: (0, 11) for k in [*range(12), 20]} | {21: (21, 0), 22: (22, 0)}


@pytest.mark.parametrize("every_link", [True, False])
def test_repeated_ids_with_different_texts(spark, make_docs, every_link):
    x, y, z = ("a b c d e f", "g h i j k l", "m n o p q r")
    rows = [(3, x), (5, x), (5, y), (7, y), (9, z), (9, y), (11, "s t u v w"), (12, "s t u v w"), (2, "q w e r t y"), (2, "u i o p a s")]
    out = ngram_join(make_docs(rows), 3, 90, every_link=every_link)
    assert ("n_links" in out.columns) is every_link
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=repr) == brute(rows, 3, 90)


def test_links_between_sets_of_different_sizes(spark, make_docs, monkeypatch):
    monkeypatch.setattr("trackloom.llm.ngram_join._CELL_SETS", 3)
    base = [f"w{i}" for i in range(140)]
    rows = [(k, " ".join(base[: 60 + k])) for k in range(80)]  # prefixes of one text: sizes near each other link
    sets = {d: frozenset(zip(*(t.split()[i:] for i in range(3)))) for d, t in rows}
    alike = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    links, _ = ngram_links(make_docs(rows), 3, 90)
    assert sorted(map(tuple, links.collect())) == sorted(alike)
    got = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join(make_docs(rows), 3, 90).collect()}
    assert got == {d: (0, sum(d in pair for pair in alike)) for d in sets}
