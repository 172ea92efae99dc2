from __future__ import annotations

import html
import re

import pytest

from oathmill.llm import main_text as M

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body><header><p>Site</p></header><nav><ul><li><a href=/>Home</a></ul></nav><!-- <p>no</p> -->
<div class="notice">We use cookies</div><div id="main-ad">Buy</div><article><header><h1>Head &amp; more</h1></header><p>One  <b>bold</b>
line&nbsp;x<p>Two<br>Three &lt;tag&gt; &#233;<ul><li>a<li>b</ul><form><p>name</p></form><aside>side</aside><div class="comments"><p>reader</p></div><table><tr><td>c1<td>c2</table></article><section class="sidebar"><p>more</p></section><footer>&copy; f</footer></body></html>"""


def test_article_alone_with_blocks_in_order(spark):
    rows = spark.createDataFrame([(1, "https://a.x/1", PAGE, "t"), (2, None, None, "t"), (3, "https://a.x/3", "", "t"), (1, "https://a.x/1", PAGE, "t"), (4, "https://b.x/", "plain &lt; text", "t"), (5, "bad", "<p>open <b>never closed", "t")], "page_id long, url string, html string, template string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in M.main_text(spark, rows).collect())
    want = "Head & more\nOne bold line x\nTwo\nThree <tag> é\na\nb\nc1\nc2"
    assert got == [(1, want, len(want))] * 2 + [(2, "", 0), (3, "", 0), (4, "plain < text", 12), (5, "open never closed", 17)]
    assert M.main_text(spark, rows.limit(0)).count() == 0


def test_slots_without_semantic_tags(spark):
    """The slot that varies between pages is the text; what is the same on all of them is template."""
    page = lambda i: f'<html><body><div class="top"><p>Our site</p></div><div class="c{i % 2}"></div><div class="body"><p>Story {i} {"w" * i}</p><p>goes on {i}</p></div><div class="end"><p>All rights</p></div></body></html>'
    rows = spark.createDataFrame([(i, "https://h.x/p", page(i)) for i in range(8)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in M.main_text(spark, rows).collect()}
    assert got == {i: f"Story {i} {'w' * i}".strip() + f"\ngoes on {i}" for i in range(8)}


def test_classes_nest_and_vectors_decide(spark):
    from oathmill.llm.shared import Stage

    page = lambda i: "<html><body><nav><a>x</a></nav><article><h1>t</h1>" + "<p>w</p>" * i + "</article></body></html>"
    rows = spark.createDataFrame([(i, "https://h.x/", page(i)) for i in range(1, 6)], "page_id long, url string, html string")
    tokens = [t.asDict() for t in M.templates(Stage(spark, "t"), rows).first()["template"]]
    kind = {t["path"]: t["class"] for t in tokens}
    assert kind["html>body>article"] == kind["html>body>nav>a"] == kind["html"] != kind["html>body>article>p"]
    assert M.nested(tokens)["html>body>article>p"] == "html>body>article" and M.main_slot(tokens) == "html>body>article"


def test_whole_pages_against_a_plain_cut(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")

    def plain(page):
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br|div)\b[^>]*>", inner)
        texts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in blocks]
        return "\n".join(t for t in texts if t)

    got = {r["page_id"]: r["text"] for r in M.main_text(spark, pages).collect()}
    assert got == {r["page_id"]: plain(r["html"]) for r in pages.collect()}


def texts(spark, pages):
    rows = spark.createDataFrame([(i, "https://h.x/p", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in sorted(M.main_text(spark, rows).collect(), key=lambda r: r["page_id"])]


def test_copies_keep_their_text_and_constant_parts_of_the_article_stay(spark):
    page = lambda s: f'<html><body><div class="top"><p>Our site</p></div><div class="body"><h2>Summary</h2><p>{s}</p></div></body></html>'
    for n in (1, 2, 3, 5):
        assert texts(spark, [page("The same long story on every page of it")] * n) == ["Summary\nThe same long story on every page of it"] * n
    varied = [f"Story {i} with a tail long enough {i * i}" for i in range(5)]
    assert texts(spark, [page(s) for s in varied]) == [f"Summary\n{s}" for s in varied]
    split = lambda i: f"<html><body><div class=top>Our site</div><div class=x>left {i}</div><div class=y>right {i}</div></body></html>"
    assert texts(spark, [split(i) for i in range(3)]) == [f"left {i}\nright {i}" for i in range(3)]
    assert texts(spark, [split(0)] * 3 + [split(1)] * 2) == ["Our site\nleft 0\nright 0"] * 3 + ["Our site\nleft 1\nright 1"] * 2


def test_odd_pages_leave_the_slot_to_the_others(spark):
    """Empty, null and differently built pages on a host: the rest have their slot, and so has the other layout."""
    one = lambda i: f'<html><body><div class="head">Menu of {i}</div><div class="body"><p>Story {i} with a tail long enough {i * i}</p><p>goes on</p></div></body></html>'
    two = lambda i: f'<html><body><div class="top">Part {i}</div><div class="wrap"><div class="text"><p>Another {i} of some length, told {i}</p></div></div></body></html>'
    first, second = [f"Story {i} with a tail long enough {i * i}\ngoes on" for i in range(6)], [f"Another {i} of some length, told {i}" for i in range(4)]
    assert texts(spark, [one(i) for i in range(6)]) == first
    assert texts(spark, [*(one(i) for i in range(6)), "", None, "plain"]) == [*first, "", "", "plain"]
    assert texts(spark, [*(one(i) for i in range(6)), *(two(i) for i in range(4))]) == first + second
    assert texts(spark, [*(one(i) for i in range(6)), "<p>alone</p>"]) == [*first, "alone"]


def test_layout_around_the_article_is_no_noise():
    story = "<article><p>The story</p><div class=comments><article>reader</article></div></article>"
    side = "<div class=sidebar>side<article>teaser that is longer than the story itself</article></div>"
    for wrap in ("layout with-sidebar", "page has-nav", "sidebar-layout", "page banner-top"):
        assert M.extract(f"<html><body><nav>n</nav><div class='{wrap}'>{story}{side}</div></body></html>", None) == "The story"
    assert M.extract(f"<html><body><form id=f>{story}</form></body></html>", None) == "The story"
    assert M.extract(f"<html><body>{story}<div class=related><article>more</article></div></body></html>", None) == "The story"
    assert M.extract("<html><body><div class='page has-nav'><p>No article</p><div class=nav>n</div></div></body></html>", None) == "No article"


def test_names_are_judged_by_their_last_word_and_never_on_running_text():
    parts = '<section id="related-work"><p>Others did</p></section><p class="alert-free">calm</p><h2 id="search">Search</h2><p id="ad-hoc">done</p><math><mi>x</mi></math>'
    page = f'<html><body><div class="site-footer">f</div><div class="story"><h1>Title</h1>{parts}<div class="comment-list">reader</div><div id="main-ad">buy</div></div></body></html>'
    want = "Title\nOthers did\ncalm\nSearch\ndone\nx"
    assert M.extract(page, None) == want
    assert M.extract(page.replace('<div class="story">', "<article>").replace("<div id=\"main-ad\">buy</div></div>", '<div id="main-ad">buy</div></article>'), None) == want


def test_templates_decide_on_the_whole_table(spark, monkeypatch):
    """Without semantic tags and class names the classes find the same texts, which a page alone does not tell; no list of names is needed."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.collect()
    got = {r["page_id"]: r["text"] for r in M.main_text(spark, pages).collect()}
    bare = [(r["page_id"], r["url"], re.sub(r"<(/?)(?:article|nav|footer)\b[^>]*>", r"<\1div>", r["html"]).replace('<div class="ad">', "<div>")) for r in rows]
    again = {r["page_id"]: r["text"] for r in M.main_text(spark, spark.createDataFrame(bare, "page_id long, url string, html string")).collect()}
    assert again == got
    assert sum(M.extract(page, None) != got[i] for i, _, page in bare) > 0
    hosts: dict = {}
    for r in rows:
        hosts.setdefault(M.host(r["url"]), []).append(r["html"])
    monkeypatch.setattr(M, "NOISE_TAGS", M.RAW | {"head"})
    monkeypatch.setattr(M, "NOISE_WORDS", frozenset())
    from oathmill.llm.shared import Stage

    plans = {r["host"]: dict(zip(("slots", "static"), M.slots([t.asDict() for t in r["template"]]), strict=True)) for r in M.templates(Stage(spark, "t"), pages).where("texts").collect()}
    assert all(M.extract(r["html"], plans.get(M.host(r["url"])), plans["*"]) == got[r["page_id"]] for r in rows)


def test_long_open_and_deep_pages_take_seconds():
    import time

    begin = time.time()
    assert M.extract("<div><p>text</p>" + '<a href="x ' * 100_000, None).startswith("text")
    assert M.extract("<p>a</p>" + "<a b='>' " * 120_000, None).startswith("a")
    assert M.extract("<div>" * 50_000 + "deep" + "</div></b>" * 50_000, None) == "deep"
    assert M.extract("<p>x<!-- " * 50_000, None) == "x"
    assert M.extract("".join(f"<tr><td>{i}" for i in range(50_000)), None).endswith("\n49999")
    assert time.time() - begin < 30


def test_small_and_alike_hosts_follow_all_hosts(spark):
    """Short articles on hosts with one page: the template of all hosts' pages has the slot."""
    page = lambda i, s: f"<html><body><div class=x>Offers of the day {i} are many and long</div><div class=y><p>{s}</p></div></body></html>"
    rows = [(i, f"https://h{i % 3}.x/", page(i, f"Story {i} that goes on " * 9)) for i in range(12)] + [(50 + i, f"https://one{i}.x/", page(99 - i, f"s{i}")) for i in range(3)] + [(90, "https://one1.x/b", "")]
    got = {r["page_id"]: r["text"] for r in M.main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[50 + i] for i in range(3)] == ["s0", "s1", "s2"] and got[3] == ("Story 3 that goes on " * 9).strip() and got[90] == ""


def _words(i, n, salt):
    return " ".join(f"{salt}{(i * 31 + k * 7) % 997}" for k in range(n))


@pytest.mark.parametrize("box", ["section class='comments'", "div class='related'", "aside", "div", "div id='disqus_thread'", "div class='comment-list'"])
@pytest.mark.parametrize("times", [1, 2, 5])
def test_what_readers_add_never_becomes_the_text(spark, box, times):
    """Eight pages of a host with 60 words of article and up to five times as many beside it, in a box with a name, a tag, or neither."""
    story = lambda i: f"{_words(i, 40, 's')}\n{_words(i, 20, 't')}"
    item = lambda i, k: f"<div><b>Reader {i}{k}</b><p>{_words(i + 100 * k, 30, 'r')}</p></div>"

    def page(i, inside=False):
        body = "".join(f"<p>{p}</p>" for p in story(i).split("\n"))
        added = f"<{box}>{''.join(item(i, k) for k in range(2 * times))}</{box.split()[0]}>"
        text = f"<article>{body}{added}</article>" if inside else f"<article>{body}</article>{added}"
        return f"<html><body><div class=top>Our site</div><div class=page>{text}</div></body></html>"

    assert texts(spark, [page(i) for i in range(8)]) == [story(i) for i in range(8)]
    assert [M.extract(page(i), None) for i in range(2)] == [story(i) for i in range(2)]
    if box != "div":
        assert texts(spark, [page(i, True) for i in range(8)]) == [story(i) for i in range(8)]
        plain = [page(i).replace("<article>", "<div class=body>").replace("</article>", "</div>") for i in range(8)]
        assert texts(spark, plain) == [story(i) for i in range(8)]


def test_a_page_of_several_articles_keeps_them_all(spark):
    page = lambda i: "<html><body><div class=top>Our site</div><div class=list>" + "".join(f"<article><p>{_words(i + k, 30, 'n')}</p></article>" for k in range(3)) + "</div></body></html>"
    assert texts(spark, [page(i) for i in range(8)]) == ["\n".join(_words(i + k, 30, "n") for k in range(3)) for i in range(8)]
