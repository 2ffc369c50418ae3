from trackloom.llm.html_extract import Matcher, Page, align, article_region, expression, extract_html, skeleton, slot_paths

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header>Top</header><nav><ul><li><a href="/">Home</a></li><li><a href="/x">X</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
<article><h1>Title {0}</h1><p><b>First &amp; {0}<br>line <p>Second&nbsp;<i>par</i>t {0}</p>{1}<form><input><p>sign up</p></form></article>
<section class="comments"><p>Nice!</p></section><aside>More</aside><div class="ad">Buy</div><footer>&copy; host</footer></body></html>"""


def test_blocks_and_wrapper():
    pages = [Page(PAGE.format(k, "<p>x</p>" * k)) for k in range(3)]
    wrapper = skeleton(pages[0].tree)
    for p in pages[1:]:
        wrapper = align(wrapper, skeleton(p.tree))
    text = expression(wrapper)
    assert "(<p>#</p>)+" in text and "<article><h1>#</h1>" in text
    assert slot_paths(wrapper)["/article/p"] is True and slot_paths(wrapper)["/article/h1"] is False
    only_some = align(skeleton(Page("<div><p>a</p></div>").tree), skeleton(Page("<div><p>a</p><table><tr><td>x</table></div>").tree))
    assert "(<table><tr><td>#</td></tr></table>)?" in expression(only_some)
    pair = expression(skeleton(Page("<dl><dt>a<dd>b<dt>c<dd>d</dl>").tree))
    assert pair == "<dl>(<dt>#</dt><dd>#</dd>)+</dl>"


def test_extraction(spark):
    rows = [(k, f"http://a.example/{k}", PAGE.format(k, "<p>x</p>" * k)) for k in range(3)]
    plain = "<body><div class=menu><a href=/>Home</a> <a href=/b>B</a></div><div id=main><p>Text {0} of the page</p><p>and more</p></div><div class=tag>Always the same</div></body>"
    rows += [(10 + k, f"http://b.example/{k}", plain.format(k)) for k in range(4)]
    rows += [(20, "http://c.example/", None), (21, None, ""), (22, "no url", "just text &lt;b&gt;"), (22, "no url", "just text &lt;b&gt;"), (23, "http://c.example/q", "<p>" + "long " * 50_000), (None, "http://c.example/", "<p>unclosed <div>x")]
    pages = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, html string, host string, `_paths` string")
    want = {0: "Title 0\n\nFirst & 0 line\n\nSecond part 0", 2: "Title 2\n\nFirst & 2 line\n\nSecond part 2\n\nx\n\nx", 11: "Text 1 of the page\n\nand more", 20: "", 21: "", 22: "just text <b>", 23: ("long " * 50_000).strip(), None: "unclosed\n\nx"}
    for limit in (8 << 20, 0):  # broadcast, then join
        out = extract_html(pages, broadcast_bytes=limit).collect()
        assert len(out) == len(rows)
        got = {r.page_id: r.text for r in out}
        assert {k: got[k] for k in want if k != 11} == {k: v for k, v in want.items() if k != 11}
        assert "Text 1 of the page" in got[11] and "Home" not in got[11] and "Always" not in got[11]
        assert all(r.n_chars == len(r.text) for r in out)
    assert extract_html(pages.limit(0)).count() == 0


def test_elements_without_end_tags_hide_no_text_after_them():
    def texts(source):
        return [text for _, _, text, _ in Page(source).blocks]

    assert texts("<head><title>t</title><meta charset=x><body><article><p>a</p></article>") == ["a"]
    for tag in ("button", "option", "object", "svg", "canvas", "video", "audio", "select", "noscript"):
        assert texts(f"<article><p>a</p><{tag}>no<p>b</p></article><p>c</p>") == ["a", "b", "c"]
        assert texts(f"<div><p>a <{tag}>no</p><p>b</p></div><{tag}>no</{tag}><p>c</p>") == ["a", "b", "c"]
        assert texts(f"<p>a <{tag}>no</{tag}> b</p>") == ["a b"]
        assert texts(f"<{tag}><p>no</p></{tag}><p>b</p>") == ["b"]
    assert texts("<div><video><p>no</div><p>b</p></video><p>c</p>") == ["b", "c"]
    assert texts("<p>a<select><option>1<option>2</select> b</p><object><object>no</object>no</object><script>x<p>no") == ["a b"]


def test_wrapper_chooses_slots(spark):
    wrapper = skeleton(Page("<p>a</p><dl><dt>a<dd>b<dt>c<dd>d</dl><p>b</p>").tree)
    matcher = Matcher(align(wrapper, skeleton(Page("<p>a</p><h2>x</h2><p>b</p>").tree)))
    assert expression(align(wrapper, wrapper)) == "<p>#</p><dl>(<dt>#</dt><dd>#</dd>)+</dl><p>#</p>"
    slots = matcher.slots(Page("<p>a</p><dl><dt>a<dd>b<dt>c<dd>d</dl><p>b</p>").tree)
    assert slots[1:3] == slots[3:5] and len({slots[0], slots[1], slots[2], slots[5]}) == 4
    # The same path twice: the first paragraph is template text, the second is not; teasers are a list of links as a whole.
    page = "<div><p>Read this {1}</p><h2>T {0}</h2><p>Text {0}</p></div><ul>" + "<li><p><a href=/>a long link {0}</a></p><h3>by {0}</h3></li>" * 3 + "</ul>{2}"
    inside = "<article><p>Please subscribe</p><h1>T {0}</h1><p>Text {0}</p></article>"
    rows = [(k, f"http://a.example/{k}", page.format(k, "first", "<table><tr><td>Old page</table>" if k % 2 else "")) for k in range(6)]
    rows += [(10 + k, f"http://b.example/{k}", inside.format(k)) for k in range(4)]
    out = {r.page_id: r.text for r in extract_html(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # What an article element holds stays, also if all pages share it.
    assert out == {k: f"T {k}\n\nText {k}" for k in range(6)} | {10 + k: f"Please subscribe\n\nT {k}\n\nText {k}" for k in range(4)}


def test_shared_text_inside_of_articles_stays(spark):
    page = "<nav><a href=/>Home</a></nav><article><h1>T {0}</h1><p>First {0}</p><h2>Summary</h2><p>Shared words</p><p>Last {0}</p></article><div class=ad>Buy {0}</div>"
    rows = [(k, f"http://a.example/{k}", page.format(k)) for k in range(4)]
    out = extract_html(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == {k: f"T {k}\n\nFirst {k}\n\nSummary\n\nShared words\n\nLast {k}" for k in range(4)}
    assert {r.decided for r in out} == {"region"}


def test_regions_without_names(spark):
    """No article element, and class names that say nothing: what varies, and where, decides."""
    text = "Paragraph {0} of some length, in which page {0} says this and that about matter {0}. " * 3
    page = "<div class=qa><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></div><div class=qb><div class=z9><h1>Head {0}</h1><div class=k><p>" + text + "</p><p>" + text + "</p></div></div></div><div class=qc><p>Deal {0}!</p></div><div class=qd>Always here</div>"
    rows = [(k, f"http://a.example/{k}", page.format(k)) for k in range(5)]
    rows += [(10 + k, f"http://b.example/{k}", page.format(k)) for k in range(2)]  # too few to tell
    out = {r.page_id: r for r in extract_html(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(5):
        assert out[k].decided == "region" and out[k].text == "\n\n".join([f"Head {k}", text.format(k).strip(), text.format(k).strip()])
    assert all(out[10 + k].decided == "rest" and "Deal" in out[10 + k].text and "Home" not in out[10 + k].text for k in range(2))


def test_article_regions():
    def region(source, varies):
        return article_region(skeleton(Page(source).tree), varies)

    # A heading outside holds the search back; so does text of the element's own, and a repeated element.
    assert region("<div><h1>a</h1><section><p>b</p><p>c</p></section></div><footer>d</footer>", [5, 90, 1]) == (0, 2)
    assert region("<div><section><p>b</p><h3>c</h3></section></div><footer>d</footer>", [90, 5, 1]) == (0, 2)
    assert region("<div>own text<p>b</p></div><footer>d</footer>", [50, 50, 1]) is None
    assert region("<div><p>a</p></div><div><p>b</p></div>", [100]) is None
    assert region("<div><p>a</p><h4>b</h4></div><section><p>c</p></section>", [50, 50, 100]) is None
    assert region("<div><article><section><p>a</p><ul><li>b</li></ul></section></article></div>", [9, 9]) == (0, 2)
    assert region("", []) is None


def test_each_page_by_itself(spark):
    story = "<article><p>Story {0}</p></article>"
    other = "<div class=menu>Menu</div><div class=content><p>Body {0}</p></div>"
    same = "<div class=content><p>One text</p></div>"
    rows = [(k, f"http://a.example/{k}", (other if k % 3 == 0 else story).format(k)) for k in range(9)]
    rows += [(20 + k, f"http://copies.example/{k}", f"<nav>{k}</nav>{same}") for k in range(5)]
    rows += [(30 + k, url, html) for k, (url, html) in enumerate([(None, story.format(1)), ("/x", same), ("no host", same), (None, same), (None, other.format(2))])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {k: f"Body {k}" if k % 3 == 0 else f"Story {k}" for k in range(9)} | {20 + k: "One text" for k in range(5)}
    want |= {30: "Story 1", 31: "One text", 32: "One text", 33: "One text", 34: "Body 2"}
    for limit in (8 << 20, 0):
        assert {r.page_id: r.text for r in extract_html(pages, broadcast_bytes=limit).collect()} == want
