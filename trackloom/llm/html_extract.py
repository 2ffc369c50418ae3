"""Main text of web pages by wrappers inferred from pages of the same host.

A page becomes a tree of block elements and text slots, in which neighbours that repeat are one repeated group.  Equal
trees of a host are counted before anything is shuffled.  The distinct trees of a host are then aligned one after
another: what only some have becomes an optional group, what repeats a repeated group, and texts become slots.  The
result, a union-free regular expression, is the host's wrapper.

Pages are read by matching them to their host's wrapper, which gives each text its slot.  A slot with one and the same
text on all pages that have it is template text, and the slots of a repeated group that holds mostly links are a list of
links; what is left varies.  The article's region is the innermost element of the wrapper that holds nearly all text that
varies, and any heading that does; what lies outside of it is left out, whatever its name.  Names of elements and classes
decide what alignment cannot see: advertisements, comments and the like vary as articles do, so elements named so are
left out, and the search for a region ends at an article element.  Where a host has too few pages or no such region, each
of its pages is read inside of its article elements, if it has any, or outside of menus and lists.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm._shared import Scratch
from trackloom.llm._text import slices

# HTML element names by role.
_RAW = "script|style|textarea|title|iframe"  # text up to the end tag, or the end of the page
_HIDDEN = frozenset("noscript template svg math object select datalist button audio video canvas option".split())
_UNNESTED = frozenset("select datalist button option".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_OUT_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
_OUT_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar aside comment comments disqus reply replies menu nav navbar navigation breadcrumb breadcrumbs header masthead footer share sharing social related recommended newsletter subscribe signup login search popup modal overlay widget toolbar pagination".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead"}}
_CLOSES_TO = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}}

# A tag ends before the next "<" outside of quotes, so that markup without ">" is read in linear time.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^<>]*>|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*)>",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
MAIN, OUT, OTHER = "article", "out", "other"
_DEEP = 100  # deeper elements belong to the one around them, in paths and trees; their texts are read like others
_ALIGN = 1 << 18  # above so many pairs of items, alignment takes the next equal item in place of the longest sequence


def _label(tag: str, attrs: str) -> tuple[str, str]:
    """An element's name in paths, and its role by names."""
    if not attrs.strip():
        return tag, OUT if tag in _OUT_TAGS else MAIN if tag in ("article", "main") else OTHER
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    words = set(re.split(r"[^a-z]+", " ".join(names)))
    label = tag + "".join(f".{re.sub(r'[0-9]+', '0', n)}" for n in sorted(names))
    heading = len(tag) == 2 and tag[0] == "h"
    if tag in _OUT_TAGS or found.get("role", "").lower() in _OUT_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or (words & _OUT_NAMES and not heading and tag != "body"):
        return label, OUT
    return label, MAIN if tag in ("article", "main") or found.get("role", "").lower() in ("main", "article") else OTHER


def _ended(tokens: list[re.Match]) -> set[int]:
    """Where those hidden elements start that have an end tag."""
    out: set[int] = set()
    opened: dict[str, list[int]] = {}
    for m in tokens:
        if (tag := (m["tag"] or "").lower()) in _HIDDEN:
            starts = opened.setdefault(tag, [])
            if not m["close"]:
                if tag in _UNNESTED:
                    starts.clear()
                starts.append(m.start())
            elif starts:
                out.add(starts.pop())
    return out


class Page:
    """The blocks of a page in order: (path, role, text, characters in links), and its tree of elements and slots."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str, str, int]] = []
        self.tree: list = []
        self._stack: list[tuple[str, str, str, list]] = [("", "", OTHER, self.tree)]  # tag, path, role, children
        self._open_tags: Counter[str] = Counter()
        self._parts: list[str] = []
        self._links = self._link = 0
        self._unseen: list[str] = []  # a hidden element, and what is open inside it
        self._ends = False  # whether it has an end tag
        tokens = list(_TOKEN.finditer(source))
        ended, at = _ended(tokens), 0
        for m in tokens:
            if m.start() > at and not self._unseen:
                self._text(source[at : m.start()])
            at = m.end()
            if tag := (m["tag"] or "").lower():
                if self._unseen and self._hides(tag, bool(m["close"])):
                    continue
                if tag in _HIDDEN and not m["close"]:
                    if not (tag in ("svg", "math") and m["attrs"].rstrip().endswith("/")):
                        self._unseen, self._ends = [tag], m.start() in ended
                    continue
                (self._close if m["close"] else self._open)(tag, m["attrs"])
        if at < len(source) and not self._unseen:
            self._text(source[at:])
        self._flush()

    def _hides(self, tag: str, close: bool) -> bool:
        """Whether a tag belongs to the hidden element that is open; if not, the element has ended.

        It ends with its end tag or with the element around it.  Without an end tag it ends at the next block.
        """
        inside = self._unseen
        if close:
            if tag in inside:
                del inside[len(inside) - 1 - inside[::-1].index(tag) :]
                return True
            outside = tag in _BLOCK and (tag in ("html", "body") or self._open_tags[tag] > 0)
            if outside or (tag in _BLOCK and not self._ends):
                inside.clear()
                return False
            return True
        if tag in _BLOCK:
            ends = not self._ends or tag == "body"
            if tag in _CLOSES and not any(t in _CLOSES_TO[tag] for t in inside):
                up = next((x[0] for x in reversed(self._stack) if x[0] in _CLOSES[tag] | _CLOSES_TO[tag]), "")
                ends |= up in _CLOSES[tag]
            if ends:
                inside.clear()
                return False
        elif tag in _UNNESTED and tag == inside[0] and not self._ends:
            inside.clear()
            return False
        if (tag in _BLOCK and tag not in ("html", "hr")) or tag in _HIDDEN:
            inside.append(tag)
        return True

    def _text(self, text: str) -> None:
        text = html.unescape(text) if "&" in text else text
        self._parts.append(text)
        if self._link:
            self._links += len(text.strip())

    def _flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self._parts)).strip()
        if text:
            _, path, role, children = self._stack[-1]
            self.blocks.append((path, role, text, self._links))
            children.append("#")
        self._parts.clear()
        self._links = 0

    def _pop(self, depth: int) -> None:
        self._flush()
        self._open_tags.subtract(x[0] for x in self._stack[depth:])
        del self._stack[depth:]

    def _open(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self._parts.append(" ")
        if tag == "a":
            self._link += 1
        if tag not in _BLOCK:
            return
        self._flush()
        if tag == "hr":
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == "p" or self._stack[i][0] in _CLOSES.get(tag, ()):
                self._pop(i)
            elif tag not in _CLOSES or self._stack[i][0] in _CLOSES_TO[tag]:
                break
        if tag in ("html", "body"):
            return
        label, role = _label(tag, attrs)
        _, path, above, children = self._stack[-1]
        role = OUT if OUT in (above, role) else MAIN if MAIN in (above, role) else OTHER
        self._open_tags[tag] += 1
        if len(self._stack) > _DEEP:
            self._stack.append((tag, path, role, children))
            return
        mine: list = []
        children.append([label, mine])
        self._stack.append((tag, f"{path}/{label}", role, mine))

    def _close(self, tag: str, _: str) -> None:
        if tag == "a":
            self._link = max(0, self._link - 1)
        if tag not in _BLOCK:
            return
        self._flush()
        if not self._open_tags[tag]:
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == tag:
                self._pop(i)
                return


# ---- wrappers: lists of items [name, children, optional, repeated]; a slot is ["#", [], ...], a group has name "" ---


def _key(item: list) -> str:
    return item[0] or "(" + " ".join(map(_key, item[1])) + ")"


def _fold(items: list) -> list:
    """Neighbouring runs of one to four items that repeat become one repeated item or group."""
    for width in range(1, 5):
        out: list = []
        for item in items:
            out.append(item)
            while len(out) >= 2 * width and [_key(x) for x in out[-2 * width : -width]] == [_key(x) for x in out[-width:]]:
                merged = [_join(a, b) for a, b in zip(out[-2 * width : -width], out[-width:], strict=True)]
                del out[-2 * width :]
                out.append([merged[0][0], merged[0][1], merged[0][2], True] if width == 1 else ["", merged, False, True])
            if width > 1 and len(out) > width and out[-width - 1][0] == "" and out[-width - 1][3] and [_key(x) for x in out[-width - 1][1]] == [_key(x) for x in out[-width:]]:
                group = out[-width - 1]
                group[1] = [_join(a, b) for a, b in zip(group[1], out[-width:], strict=True)]
                del out[-width:]
        items = out
    return items


def _join(a: list, b: list) -> list:
    return [a[0], align(a[1], b[1]), a[2] or b[2], a[3] or b[3]]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; of very long lists, of a common subsequence that takes the next equal item."""
    pairs: list[tuple[int, int]] = []
    if len(a) * len(b) > _ALIGN:
        places: dict[str, list[int]] = {}
        for i, x in enumerate(a):
            places.setdefault(x, []).append(i)
        at = 0
        for j, x in enumerate(b):
            own = places.get(x, [])
            k = bisect_left(own, at)
            # An item far ahead would leave out all between.
            if k < len(own) and own[k] - at <= 1 + len(a) // 8:
                pairs.append((own[k], j))
                at = own[k] + 1
        return pairs
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs


def align(a: list, b: list) -> list:
    """The wrapper of both: a longest common subsequence by name is joined, the rest becomes optional."""
    if a == b:
        return a
    out, i, j = [], 0, 0
    for x, y in [*_common([_key(x) for x in a], [_key(x) for x in b]), (len(a), len(b))]:
        out += [[*item[:2], True, item[3]] for item in (*a[i:x], *b[j:y])]
        if x < len(a):
            out.append(_join(a[x], b[y]))
        i, j = x + 1, y + 1
    return _fold(out)


def skeleton(tree: list) -> list:
    """A page's tree as a wrapper of this page alone."""
    return _fold([["#", [], False, False] if x == "#" else [x[0], skeleton(x[1]), False, False] for x in tree])


def expression(wrapper: list) -> str:
    """The wrapper as text: names open elements, # is a slot, ()? optional, ()+ repeated."""
    out = []
    for name, children, optional, again in wrapper:
        body = "#" if name == "#" else expression(children) if not name else f"<{name}>{expression(children)}</{name.split('.')[0]}>"
        body = f"({body})+" if again else body
        out.append(f"({body})?" if optional else body)
    return "".join(out)


def slot_paths(wrapper: list, path: str = "", again: bool = False) -> dict[str, bool]:
    """Paths of a wrapper's slots, and whether a slot is repeated."""
    out: dict[str, bool] = {}
    for name, children, _, repeated in wrapper:
        if name == "#":
            out[path] = out.get(path, False) or again or repeated or path in out
        else:
            for p, r in slot_paths(children, f"{path}/{name}" if name else path, again or repeated).items():
                out[p] = out.get(p, False) or r or p in out
    return out


class Matcher:
    """A wrapper as pages are matched to it; slots are numbered in order."""

    def __init__(self, wrapper: list):
        #: For each slot, the number of the innermost repeated item or group around it, or a negative number of its own.
        self.groups: list[int] = []
        self._n = 0
        self._top = self._level(wrapper, None)

    def _level(self, items: list, group: int | None) -> list:
        """The items of one level, groups spelled out: [name, repeated, bounds of the innermost repeated group, inside]."""
        flat: list = []

        def add(items: list, group: int | None) -> None:
            for name, children, _, again in items:
                inner = group
                if again:
                    self._n += 1
                    inner = self._n
                if name == "#":
                    self.groups.append(-1 - len(self.groups) if inner is None else inner)
                    flat.append([name, again, None, len(self.groups) - 1])
                elif name:
                    flat.append([name, again, None, self._level(children, inner)])
                else:
                    start = len(flat)
                    add(children, inner)
                    for x in flat[start:]:
                        x[2] = x[2] or (start, len(flat))

        add(items, group)
        return flat

    def slots(self, tree: list) -> list[int]:
        """The slot of each of a page's blocks in order; -1 for those that the wrapper has no place for."""
        out: list[int] = []
        self._match(self._top, tree, out)
        return out

    def _match(self, flat: list, children: list, out: list[int]) -> None:
        last = -1
        for c in children:
            name = "#" if c == "#" else c[0]
            if last < 0 or not (flat[last][1] and flat[last][0] == name):
                last = next((i for i in self._ways(flat, last) if flat[i][0] == name), -1) if flat else -1
            if name == "#":
                out.append(-1 if last < 0 else flat[last][3])
            else:
                self._match([] if last < 0 else flat[last][3], c[1], out)

    @staticmethod
    def _ways(flat: list, last: int) -> Iterator[int]:
        """Where a match may go on: in its repeated group, once more from the group's start, after it, anywhere."""
        if last >= 0 and flat[last][2]:
            start, end = flat[last][2]
            yield from range(last + 1, end)
            yield from range(start, last + 1)
        yield from range(last + 1, len(flat))
        yield from range(last + 1)


@lru_cache(1024)
def _matcher(wrapper: str) -> Matcher:
    return Matcher(json.loads(wrapper))


def article_region(wrapper: list, varies: list[int], share: float = 0.9) -> tuple[int, int] | None:
    """The slots (first, past last) of the innermost element that holds nearly all of ``varies`` (characters by slot).

    From the top, the search enters an element that is not repeated if it holds at least ``share`` of what varies around
    it and no heading that varies stays outside; it ends at an article element, or at one that holds text itself.
    """
    at = [0]

    def measure(items: list) -> list:
        """[name, repeated, first slot, past last slot, inside, whether a heading varies] of elements and slots, groups opened."""
        out = []
        for name, children, _, again in items:
            first = at[0]
            if name == "#":
                at[0] += 1
                out.append([name, again, first, at[0], [], False])
            else:
                inside = measure(children)
                if not name:
                    out += [[x[0], True, *x[2:]] for x in inside]
                    continue
                tag = name.split(".")[0]
                heading = len(tag) == 2 and tag[0] == "h" and any(varies[first : at[0]])
                out.append([name, again, first, at[0], inside, heading or any(x[5] for x in inside)])
        return out

    items, region = measure(wrapper), None
    while True:
        whole = sum(sum(varies[x[2] : x[3]]) for x in items)
        best = max((x for x in items if x[0] != "#"), key=lambda x: sum(varies[x[2] : x[3]]), default=None)
        if best is None or not whole or sum(varies[best[2] : best[3]]) < share * whole:
            return region
        tag = best[0].split(".")[0]
        if best[1] or any(x[5] for x in items if x is not best) or any(x[0] == "#" and varies[x[2]] for x in best[4]) or tag[:1] == "h" and len(tag) == 2:
            return region
        region, items = (best[2], best[3]), best[4]
        if tag in ("article", "main"):
            return region


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _by_host(rows: DataFrame, rules: DataFrame, columns: list[str], small: bool, part: Column, copies: int) -> tuple[DataFrame, dict | None]:
    """Rows with their host's ``columns`` of ``rules``, or, if ``small``, rows as they are and the rules by host.

    Small rules are broadcast once to each executor; others are joined by host, every host in ``copies`` parts.
    """
    if small:
        return rows, {r["host"]: tuple(r[c] for c in columns) for r in rules.select("host", *columns).collect()}
    rules = rules.select("host", *columns).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return rows.withColumn("_part", F.pmod(part, F.lit(copies)).cast("int")).join(rules, ["host", "_part"], "left").drop("_part"), None


def _wrappers(scanned: DataFrame, scratch: Scratch, fan: int) -> DataFrame:
    """(host, tree): the wrapper of each host's pages.

    A host's distinct trees are folded in parts of about ``fan``, and the parts' wrappers once more, until one is left,
    so that a large host is not one task's work.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        wrapper: list | None = None
        for tree in sorted(pdf["tree"]):
            wrapper = json.loads(tree) if wrapper is None else align(wrapper, json.loads(tree))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "tree": [json.dumps(wrapper, separators=(",", ":"))]})

    trees, k = scratch.save(scanned.select("host", "tree").distinct(), "trees-0"), 0
    while True:
        parts = trees.groupBy("host").agg(F.ceil(F.count("*") / fan).alias("parts"))
        most = parts.agg(F.max("parts")).first()[0] or 1
        part = F.pmod(F.xxhash64("tree", F.lit(k)), F.col("parts")).alias("part")
        k += 1
        trees = scratch.save(trees.join(parts, "host").groupBy("host", part).applyInPandas(fold, "host string, tree string"), f"trees-{k}")
        scratch.drop(f"trees-{k - 1}")
        if most == 1:
            return trees


def host_rules(pages: DataFrame, scratch: Scratch, broadcast_bytes: int, copies: int, fan: int = 256) -> DataFrame:
    """(host, tree, template, links, region): each host's wrapper, its slots of template text and those of lists of links,
    and the bounds of its article's slots (NULL if alignment cannot tell).

    Template slots hold one and the same text on all pages that have them; pages that agree in all text outside of menus
    and the like count as one, and there must be 3, as for a region.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                out: list[list] = [[], [], [], []]
                for source in batch.column("html").to_pylist():
                    page = Page(source or "")
                    out[0].append(json.dumps(skeleton(page.tree), separators=(",", ":")))
                    out[1].append(json.dumps(page.tree, separators=(",", ":")))
                    out[2].append(_digest("\n".join(text for _, role, text, _ in page.blocks if role != OUT)))
                    out[3].append(json.dumps([(_digest(text), len(text), links, role == OUT) for _, role, text, links in page.blocks], separators=(",", ":")))
                yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], ["host", "tree", "page", "content", "blocks"])

    pages = pages.select(_host(F.col("url")).alias("host"), "html").where("host <> ''")
    scanned = scratch.save(pages.mapInArrow(scan, "host string, tree string, page string, content bigint, blocks string"), "scanned")
    wrappers = _wrappers(scanned, scratch, fan)
    taken = wrappers.agg(F.sum(F.length("host") + F.length("tree") + 64)).first()[0] or 0
    rows, known = _by_host(scanned.select("host", "page", "content", "blocks"), wrappers, ["tree"], taken <= broadcast_bytes, F.xxhash64("content"), copies)
    shared = None if known is None else pages.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = batch.column("host").to_pylist()
            trees = batch.column("tree").to_pylist() if shared is None else [shared.value[h][0] for h in hosts]
            found: dict[tuple[str, int], list] = {}
            for host, tree, page, content, blocks in zip(hosts, trees, batch.column("page").to_pylist(), batch.column("content").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
                own: dict[int, list] = {}
                for slot, (text, chars, links, named) in zip(_matcher(tree).slots(json.loads(page)), json.loads(blocks), strict=True):
                    x = own.setdefault(slot, [[], 0, 0, 0])
                    x[0].append(text)
                    x[1] += chars
                    x[2] += links
                    x[3] += chars * named
                for slot, (texts, chars, links, named) in own.items():
                    text = texts[0] if len(texts) == 1 else _digest(json.dumps(texts))
                    x = found.setdefault((host, slot), [text, text, 0, 0, 0, set()])
                    x[0], x[1], x[2], x[3], x[4] = min(x[0], text), max(x[1], text), x[2] + chars, x[3] + links, x[4] + named
                    if len(x[5]) < 3:
                        x[5].add(content)
            keys, values = list(found), list(found.values())
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64())]
            columns += [pa.array([v[i] for v in values], pa.int64()) for i in range(5)] + [pa.array([sorted(v[5]) for v in values], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["host", "slot", "least", "most", "chars", "links", "named", "contents"])

    slots = rows.mapInArrow(count, "host string, slot bigint, least bigint, most bigint, chars bigint, links bigint, named bigint, contents array<bigint>")
    several = F.size(F.array_distinct(F.flatten(F.collect_list("contents")))) >= 3
    slots = slots.groupBy("host", "slot").agg(((F.min("least") == F.max("most")) & several).alias("same"), several.alias("several"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.sum("named").alias("named"))
    slots = slots.groupBy("host").agg(F.collect_list(F.struct("slot", "same", "several", "chars", "links", "named")).alias("slots")).join(wrappers, "host")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            template, linked, region = [], [], []
            for tree, slots in zip(pdf["tree"], pdf["slots"], strict=True):
                groups = _matcher(tree).groups
                sums: dict[int, list[int]] = {}
                for x in slots:
                    if x["slot"] >= 0:
                        y = sums.setdefault(groups[x["slot"]], [0, 0])
                        y[0] += x["chars"]
                        y[1] += x["links"]
                template.append(sorted(x["slot"] for x in slots if x["slot"] >= 0 and x["same"]))
                linked.append([i for i, g in enumerate(groups) if g in sums and 2 * sums[g][1] > sums[g][0]])
                varies, still = [0] * len(groups), {*template[-1], *linked[-1]}
                for x in slots:
                    if x["slot"] >= 0 and x["slot"] not in still:
                        varies[x["slot"]] = x["chars"] - x["named"]
                region.append(article_region(json.loads(tree), varies) if any(x["several"] and x["slot"] not in still for x in slots) else None)
            yield pd.DataFrame({"host": pdf["host"], "tree": pdf["tree"], "template": template, "links": linked, "region": region})

    return scratch.save(slots.select("host", "tree", "slots").mapInPandas(decide, "host string, tree string, template array<bigint>, links array<bigint>, region array<bigint>"), "rules")


def article(page: Page, rule: tuple | None) -> tuple[list[str], str]:
    """The article's blocks of a page, and what decided on them; read by its host's rule (wrapper, template slots, link
    slots, region), if it has one.

    "region": what lies in the host's region; template text in it goes unless it stands in an article element.
    "elements": what lies in the page's article elements.  "rest": what lies outside of menus and the like, lists of links
    and template text.  Elements that are named like menus, advertisements and so on never count.
    """
    blocks = page.blocks
    inside = [i for i, b in enumerate(blocks) if b[1] == MAIN]
    slots = [-1] * len(blocks) if rule is None else _matcher(rule[0]).slots(page.tree)
    out = set() if rule is None else set(rule[1])
    if rule is not None and rule[3] is not None:
        first, last = rule[3]
        held = [i for i, slot in enumerate(slots) if blocks[i][1] != OUT and (first <= slot < last or (slot < 0 and blocks[i][1] == MAIN))]
        held = [i for i in held if blocks[i][1] == MAIN or slots[i] not in out]
        # A page of another make has its article elsewhere.
        if held and (not inside or any(blocks[i][1] == MAIN for i in held)):
            return [blocks[i][2] for i in held], "region"
    if inside:
        return [blocks[i][2] for i in inside], "elements"
    if rule is None:
        sums: dict[str, list[int]] = {}
        for path, _, text, links in blocks:
            x = sums.setdefault(path, [0, 0])
            x[0] += len(text)
            x[1] += links
        return [b[2] for b in blocks if b[1] == OTHER and 2 * sums[b[0]][1] <= sums[b[0]][0]], "rest"
    out |= set(rule[2])
    return [b[2] for b, slot in zip(blocks, slots, strict=True) if b[1] == OTHER and slot not in out], "rest"


def extract_html(pages: DataFrame, broadcast_bytes: int = 8 << 20, copies: int = 64) -> DataFrame:
    """page_id, url, text and n_chars (code points) of the main text of every page, and what decided on it (:func:`article`).

    Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by
    two line breaks.  Pages without main text, and null html, give an empty text.  Pages with null urls or urls without
    a host are read one by one, without a wrapper; repeated rows give equal results; an empty table gives an empty
    result.  Long pages are read whole; elements nested over 100 deep count as part of those around them.  Other columns are
    ignored.  The wrappers of all hosts are broadcast if they take at most ``broadcast_bytes``; otherwise pages are joined
    with them by host, every host in ``copies`` parts.
    """
    scratch = Scratch(pages.sparkSession, "html")
    rules = host_rules(pages, scratch, broadcast_bytes, copies)
    taken = rules.agg(F.sum(F.length("host") + F.length("tree") + 32 * (F.size("template") + F.size("links")) + 64)).first()[0] or 0
    rows = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host"))
    columns = ["tree", "template", "links", "region"]
    rows, known = _by_host(rows, rules, columns, taken <= broadcast_bytes, F.xxhash64("page_id", "url"), copies)
    shared = None if known is None else pages.sparkSession.sparkContext.broadcast(known)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                if shared is None:
                    given = [x if x[0] is not None else None for x in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)]
                else:
                    given = [shared.value.get(h) for h in batch.column("host").to_pylist()]
                read_ = [article(Page(source or ""), rule) for source, rule in zip(batch.column("html").to_pylist(), given, strict=True)]
                texts = ["\n\n".join(blocks) for blocks, _ in read_]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([by for _, by in read_], pa.string())], ["page_id", "url", "text", "n_chars", "decided"])

    return rows.select("page_id", "url", "html", "host", *(columns if known is None else ())).mapInArrow(read, "page_id bigint, url string, text string, n_chars bigint, decided string")
