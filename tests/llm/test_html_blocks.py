"""HTML extraction against a plain reader of article elements, and without helpful containers."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from weft.llm import html_extract
from weft.llm._common import table

BREAKS = set("html body article header h1 h2 p div ul li footer nav br".split())


class Articles(HTMLParser):
    """Text of article elements, a line for each block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.lines, self.raw = 0, [""], False

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.lines += [""] * (tag in BREAKS and tag != "br")
        self.lines[-1] += " " * (tag == "br")

    def handle_endtag(self, tag):
        self.lines += [""] * (tag in BREAKS)
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.lines[-1] += data


def plain(html):
    reader = Articles()
    reader.feed(html or "")
    reader.close()
    return "\n".join(" ".join(x.split()) for x in reader.lines if x.split())


def neutral(html):
    """All containers as div, without class and id."""
    html = re.sub(r' (class|id)="[^"]*"', "", html or "")
    return re.sub(r"<(/?)(article|main|nav|aside|section|header|footer)\b", r"<\1div", html)


def test_pages_against_a_plain_reader(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got == {r.page_id: plain(r.html) for r in pages.collect()}


def test_words_and_links_decide_where_containers_say_nothing(spark, sf_dir):
    tree = html_extract.train()
    used = set()

    def walk(node):
        if len(node) > 1:
            used.add(html_extract.FEATURES[node[0]])
            walk(node[2]), walk(node[3])

    walk(tree)
    assert {"links", "words_after"} <= used or {"links", "words"} <= used
    assert any(x in used for x in ("links_before", "links_after"))
    for r in table(spark, sf_dir, "pages").collect():
        got = html_extract.main_text(neutral(r.html), tree).split("\n")
        assert [x for x in plain(r.html).split("\n") if x not in got] == []
        assert not set(re.findall(r'<li><a href="[^"]*">([^<]+)</a>', r.html)) & set(got)


def test_layout_names_and_link_lists():
    tree = html_extract.train()
    text = "A first sentence of some length that nobody would take for a menu."
    wrap = lambda before, inner, after="": html_extract.main_text(f"{before}{inner}{after}", tree)
    assert wrap('<div class="layout has-sidebar">', f"<article><p>{text}</p></article>", "</div>") == text
    assert wrap('<div class="sidebar-page">', f"<main><p>{text}</p></main>", "</div>") == text
    assert wrap("", "<p><a href=1>one two three</a></p><p><a href=2>four five</a></p><p><a href=3>six</a></p>") == ""
    assert wrap("<article>", f"<p>{text}</p><ul><li><a href=1>Another page to read</a></li><li><a href=2>And one more</a></li></ul><p>{text}</p>", "</article>") == f"{text}\n{text}"
    assert wrap(f"<article><p>{text}</p></article><section class=comments>", f"<article><p>{text} I think.</p></article>", "</section>") == text


def test_long_and_repeated_pages(spark):
    long = "<article>" + "<p>" + "word " * 200_000 + "</p></article>"
    df = spark.createDataFrame([(1, "u", long), (1, "u", long), (2, None, None)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.n_chars) for r in html_extract.extract(df).collect())
    assert got == [(1, 999_999), (1, 999_999), (2, 0)]


TEXT = "A first sentence of some length that nobody would take for a menu. And then a second one follows it."


def test_wrappers_named_like_chrome_are_none():
    tree = html_extract.train()
    menu = "<nav><ul><li><a href=1>Home</a></li><li><a href=2>About us</a></li></ul></nav>"
    page = f"{menu}<article><p>{TEXT}</p><p>{TEXT}</p></article><footer><p>All rights reserved by nobody at all</p></footer>"
    for before, after in (("<div class='overflow-hidden'>", "</div>"), ("<div class=post-with-comments>", "</div>"), ("<div class='ad-free legal-news'>", "</div>"), ("<form id=aspnetForm action=x><div>", "</div></form>"), ("<body class=modal><div class=overlay><div>", "</div></div>")):
        assert html_extract.main_text(before + page + after, tree) == f"{TEXT}\n{TEXT}", before
        plain_page = f"{menu}<div><p>{TEXT}</p><p>{TEXT}</p></div>"
        assert html_extract.main_text(before + plain_page + after, tree) == f"{TEXT}\n{TEXT}", before
    inner = f"<div class=overflow-hidden><article><p>{TEXT}</p></article></div><section class=comments>" + f"<article><p>{TEXT} I think.</p></article>" * 5 + "</section>"
    assert html_extract.main_text(inner, tree) == TEXT  # many comments are no wrapper
    hidden = f"<article><p>{TEXT}</p></article><div hidden><p>{TEXT} {TEXT} {TEXT} {TEXT}</p></div>"
    assert html_extract.main_text(hidden, tree) == TEXT


def test_paragraphs_named_like_chrome_go():
    tree = html_extract.train()
    page = f"<article><h1>On something</h1><p class='advertisement'>{TEXT}</p><p class=lead>{TEXT}</p><p id=newsletter-signup>{TEXT}</p><p>{TEXT}</p></article>"
    assert html_extract.main_text(page, tree).split("\n")[-2:] == [TEXT, TEXT]
    assert html_extract.main_text(page, tree).count(TEXT) == 2


def test_bad_markup_takes_linear_time():
    import time

    tree = html_extract.train()
    for page in ("<div>" * 20_000 + "</span></i></section>" * 20_000 + f"<p>{TEXT}", "<div><p>" * 20_000 + "</section>" * 20_000 + f"{TEXT}", "<body><head>" * 5000 + "</head>" * 5000 + f"<p>{TEXT}"):
        began = time.time()
        html_extract.main_text(page, tree)
        assert time.time() - began < 3
