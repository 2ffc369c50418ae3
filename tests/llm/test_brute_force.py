"""Operators that SQL cannot express, against plain versions of the same work."""

import hashlib
import math
import os
import time
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
import regex

from trackloom.llm import html_extract as H
from trackloom.llm import license_scan as L
from trackloom.llm._shared import labelled_sample
from trackloom.llm._text import Texts
from trackloom.llm.line_dedup import line_dedup
from trackloom.llm.media_audio import AudioShape, _mel_bank, _phases, log_mel, resample
from trackloom.llm.mixing import mix_sources
from trackloom.llm.packing import best_fit_packing, pack_shard, sequence_cost
from trackloom.llm.quality_classifier import BUCKETS, fit
from trackloom.llm.quality_rules import fit_trees

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


# ---- quality rules and the sample of labelled rows ------------------------------------------------------------------


def test_flat_trees_score_like_a_recursive_walk():
    rng = np.random.default_rng(3)
    x = rng.random((400, 4))
    y = (x[:, 1] * x[:, 2] > 0.25).astype(float)
    trees = fit_trees(x, y, [0, 1, 1, 0], n_trees=15)

    def walk(node, row):
        if trees.left[node] < 0:
            return trees.value[node]
        return walk(trees.left[node] + (row[trees.feature[node]] > trees.cut[node]), row)

    want = [1 / (1 + math.exp(-(trees.start + sum(walk(r, row) for r in trees.roots)))) for row in x]
    assert np.allclose(trees.score(x), want)
    assert (np.diff(trees.score(np.column_stack((x[:50, 0], np.linspace(0, 1, 50), x[:50, 2] * 0 + 0.5, x[:50, 3] * 0)))) >= -1e-12).all()


def test_labelled_sample_is_bounded_in_rows(spark, make_docs):
    docs = make_docs([(1, f"text {i}") for i in range(300)] + [(2, None), (2, None), (3, "c"), (None, "x")])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (4, 1), (None, 1), (5, None)], "doc_id long, quality int")
    rows = labelled_sample(docs, labels, "quality", 10, 1).collect()
    assert sorted((r.doc_id, r.label) for r in rows) == [(1, 1), (2, 0), (3, 1)]
    assert labelled_sample(docs, labels, "quality", 2, 1).count() <= 2


# ---- classifier -----------------------------------------------------------------------------------------------------


def test_dual_coordinate_descent_reaches_the_primal_minimum():
    rng = np.random.default_rng(8)
    rows, y = [], rng.integers(0, 2, 80)
    for label in y:
        rows.append(np.unique(rng.integers(0, 60, 12) + (20 if label else 0)))
    model = fit(rows, y, cost=1.0, epochs=400)
    scaled = np.zeros((80, BUCKETS), np.float32)
    for i, r in enumerate(rows):
        v = model.ratio[r]
        scaled[i, r] = v / math.sqrt(v @ v)
    used = np.unique(np.concatenate(rows))
    a, sign = scaled[:, used].astype(float), np.where(y > 0, 1.0, -1.0)
    most = 80 / (2 * np.where(y > 0, (y > 0).sum(), (y == 0).sum()))

    def primal(w, b):
        return (w @ w + b * b) / 2 + (most * np.maximum(0, 1 - sign * (a @ w + b))).sum()

    w, b, best = np.zeros(len(used)), 0.0, np.inf
    for k in range(20_000):  # plain subgradient steps
        hit = sign * (a @ w + b) < 1
        step = 1 / (1 + k)
        g = most * sign * hit
        w, b = w - step * (w - a.T @ g), b - step * (b - g.sum())
        best = min(best, primal(w, b))
    assert primal(model.weight[used], model.bias) <= best * 1.002


# ---- audio ----------------------------------------------------------------------------------------------------------


def test_log_mel_and_resampling_by_direct_sums():
    shape = AudioShape(frame=32, hop=16, mels=5, block=4)
    x = np.random.default_rng(0).standard_normal(75).astype(np.float32)
    window = np.hanning(32)
    n = 1 + -(-(75 - 32) // 16)
    padded = np.concatenate((x, np.zeros((n - 1) * 16 + 32 - 75)))
    want = []
    for f in range(n):
        piece = padded[16 * f : 16 * f + 32] * window
        power = [abs(sum(piece[t] * np.exp(-2j * np.pi * k * t / 32) for t in range(32))) ** 2 for k in range(17)]
        want.append(np.log(np.array(power) @ _mel_bank(shape) + 1e-6))
    assert np.allclose(log_mel(x, shape), want, atol=1e-3)
    up, down = 3, 2
    taps = _phases(up, down)
    flat = taps[:, ::-1].T.ravel()
    spread = np.zeros(75 * up)
    spread[::up] = x
    full = np.convolve(spread, flat)
    delay = 8 * max(up, down)
    got = resample(x, 2 * 8000, 3 * 8000)
    assert np.allclose(got, full[delay : delay + down * len(got) : down][: len(got)], atol=1e-4)


# ---- packing --------------------------------------------------------------------------------------------------------


def test_packing_by_a_plain_search():
    caps = (8, 16, 32)
    rng = np.random.default_rng(5)
    base = min(sequence_cost(c) / c for c in caps)
    for _ in range(20):
        sizes = np.sort(rng.integers(1, 33, 60))[::-1]
        best = None
        for fill in (0.0, 0.9, 1.0):
            bins = []  # [capacity opened, contents]
            where = []
            for s in sizes:
                fits = [(c - h, b) for b, (c, h) in enumerate(bins) if c - h >= s]
                if fits:
                    b = min(fits)[1]
                else:
                    c = min((c for c in caps if c >= s), key=lambda c: (sequence_cost(c) - fill * base * (c - s), c))
                    bins.append([c, 0])
                    b = len(bins) - 1
                bins[b][1] += s
                where.append(b)
            cost = sum(sequence_cost(min(c for c in caps if c >= h)) for _, h in bins)
            if best is None or cost < best[0]:
                best = (cost, where)
        got, final = pack_shard(sizes, caps)
        assert got.tolist() == best[1] and math.isclose(sum(map(sequence_cost, final.tolist())), best[0])


def test_many_copies_of_one_id(spark, make_docs, monkeypatch):
    monkeypatch.setattr("trackloom.llm.packing._RUN", 10)
    docs = make_docs([(1, "a b c")] * 95 + [(2, "d e")] * 3 + [(3, "x " * 10_000)])
    rows = best_fit_packing(docs, capacities=(16, 64)).collect()
    assert sorted(r.copy for r in rows if r.doc_id == 1) == list(range(1, 96))
    assert sorted(r.copy for r in rows if r.doc_id == 2) == [1, 2, 3]
    assert sum(r.n_words for r in rows) == 95 * 3 + 6 + 10_000


# ---- mixing and lines -----------------------------------------------------------------------------------------------


def test_rows_with_one_id_are_mixed_one_by_one(spark, make_docs):
    docs = make_docs([(None, f"word{i} " * 10, "a") for i in range(200)] + [(i, "x " * 10, "b") for i in range(200)])
    out = mix_sources(docs).toPandas()
    taken = out.groupby("target")["taken"].sum()
    assert all(abs(t - n) <= 10 for t, n in taken.items())


def test_crowded_shards(spark, make_docs):
    line = "This very long line is held by every one of the documents"
    docs = make_docs([(i, f"{line}\nown {i}") for i in range(60)])
    for limit in (1_000_000, 0):
        out = line_dedup(docs, probes_per_task=7, broadcast_rows=limit).collect()
        assert sorted(r.doc_id for r in out if line in r.text) == [59] and all(f"own {r.doc_id}" in r.text for r in out)


# ---- licences -------------------------------------------------------------------------------------------------------


def plain_canonical(text):
    text = regex.sub(L._COPYRIGHT, " ", text)
    text = regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).strip()
    for a, b in L.SPELLINGS.items():
        text = text.replace(a, b)
    return text


@tables
def test_licences_by_plain_digests(spark):
    known = L.known_licenses(spark)
    table = {}
    for r in sorted(known.collect()):
        if c := plain_canonical(r.text):
            table.setdefault(hashlib.sha256(c.encode()).hexdigest(), r.license_id)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    mit = L.KNOWN["MIT"]
    more = [(-1, mit.upper()), (-2, "Copyright 2019 A\n\n" + mit), (-3, mit.replace("(the", "(c) sell copies (the")), (-4, mit + "\n(c) never sell anything"), (-5, mit + "\n(c) 2020 Someone")]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    look = lambda t: table.get(hashlib.sha256(plain_canonical(t).encode()).hexdigest())
    want = {}
    for r in docs.collect():
        text = r.text or ""
        want[r.doc_id] = (look(text) if plain_canonical(text) else None, sorted({x for line in text.split("\n") if plain_canonical(line) and (x := look(line))}))
    got = {r.doc_id: (r.license_id, list(r.line_licenses)) for r in L.license_scan(docs, known).collect()}
    assert got == want
    assert [got[-k][0] for k in range(1, 6)] == ["MIT", "MIT", None, None, "MIT"]


# ---- web pages ------------------------------------------------------------------------------------------------------


class Plain(HTMLParser):
    """Blocks inside of article elements, without elements of the names left out; pages must be well-formed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.parts, self.blocks = [], [], []

    def _end(self):
        text = " ".join("".join(self.parts).split())
        if text and any(t == "article" for t, _ in self.stack) and not any(out for _, out in self.stack):
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "br":
            self.parts.append(" ")
        if tag in H._VOID:
            return
        if tag in H._BLOCK or tag in ("script", "style", "head"):
            self._end()
        words = set(regex.split(r"[^a-z]+", f"{given.get('class') or ''} {given.get('id') or ''}".lower()))
        heading = len(tag) == 2 and tag[0] == "h"
        out = tag in H._OUT_TAGS or tag in H._HIDDEN or tag in ("script", "style", "title") or (tag in H._BLOCK and not heading and bool(words & H._OUT_NAMES))
        self.stack.append((tag, out))

    def handle_endtag(self, tag):
        if tag in H._BLOCK or tag in ("script", "style", "head"):
            self._end()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        if not any(t in ("script", "style", "title") or t in H._HIDDEN for t, _ in self.stack):
            self.parts.append(data)


@tables
def test_pages_by_a_plain_parser(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    want = {}
    for r in pages.collect():
        p = Plain()
        p.feed(r.html or "")
        p._end()
        want[r.page_id] = "\n\n".join(p.blocks)
    got = {r.page_id: r.text for r in H.extract_html(pages).collect()}
    assert sum(got[k] == want[k] for k in want) >= 0.98 * len(want)


def test_deep_and_broken_pages():
    deep = "<div>" * 3000 + "<p>deep text</p>" + "</div>" * 3000 + "<p>after</p>"
    page = H.Page(deep)
    assert [b[2] for b in page.blocks] == ["deep text", "after"]
    tree = H.skeleton(page.tree)
    wrapper = H.align(tree, H.skeleton(H.Page("<div>" * 2500 + "<p>x</p>").tree))
    assert H.Matcher(wrapper).slots(page.tree)[0] >= 0 and H.expression(wrapper)
    began = time.time()
    for broken in ("<a ", '<a "', "<!", "<p class='", "<", "</", "<script", "<div>", "<p><li>", "&lt;<b "):
        H.Page(broken * (300_000 // len(broken)))
    assert time.time() - began < 60
    assert [b[2] for b in H.Page("<p title='a > b'>x</p><p>1 < 2 and <b>3</b></p>").blocks] == ["x", "1 < 2 and 3"]


def test_long_lists_of_unlike_items_align():
    a = [[f"div.x{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", [], False, False] for i in range(1500)]
    b = [x for i, x in enumerate(a) if i % 7]
    began = time.time()
    out = H.align(a, b)
    assert time.time() - began < 20
    assert [x[0] for x in out] == [x[0] for x in a] and sum(x[2] for x in out) == len(a) - len(b)


def test_a_host_of_many_templates_is_folded_in_parts(spark):
    rows = [(k, f"http://a.example/{k}", f"<div><p>Always</p><h2>Title {k}</h2>" + "".join(f"<{t}>t{k}</{t}>" for j, t in enumerate(("pre", "h3", "h4", "section", "figure", "dl")) if k >> j & 1) + "</div>") for k in range(64)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    scratch = H.Scratch(spark, "test")
    rules = H.host_rules(pages, scratch, 8 << 20, 4, fan=4).collect()
    assert len(rules) == 1 and len(rules[0].template) == 1
    out = {r.page_id: r.text for r in H.extract_html(pages).collect()}
    assert all("Always" not in t and t.startswith(f"Title {k}") for k, t in out.items())


def test_empty_texts_have_no_counts():
    assert len(Texts.of(pa.array([], pa.string()))) == 0
