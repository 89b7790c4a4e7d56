import re
from html import unescape

import pytest

from vicinage.llm import html

ARTICLE = "<article><h1>Title here</h1><p>First, a paragraph of some length; it has words &amp; marks.</p><p>Second <b>bold</b>ly, with a <a href='x'>link</a>.<br>And more text, as one writes.</p><p>Of.</p></article>"
TEXT = "Title here First, a paragraph of some length; it has words & marks. Second boldly, with a link. And more text, as one writes. Of."
AROUND = [
    "{}", "<html><head><title>No</title><style>p{{}}</style><script>var t='</p>';if(a<b)x()</script></head><body>{}</body></html>",
    "<body><nav><ul><li><a href=/a>Menu one, two.</a></li></ul></nav>{}<footer>&copy; Foot, all rights.</footer></body>",
    "<header><h2>Site, name</h2></header><div class='sidebar'><p>Side text, which is long enough to look like an article, or so it seems. Really.</p></div>{}",
    "{}<section id=comments><p>Great article, I liked it very much, thanks for that, and so on and on.</p></section>",
    "<div class=\"cookie-notice\">We use cookies, accept.</div>{}<form><label>Mail, please</label><input value='x>y'><button>Go</button></form>",
    "<!-- comment <p>hidden, text</p> -->{}<aside>Also, see this.</aside><noscript>Enable, please</noscript>",
    "<DIV CLASS='ad banner'>Buy, now! Cheap, good.</DIV>{}<div role='complementary' class=\"related\"><a href=q>Other, story</a></div>",
]


@pytest.mark.parametrize("around", AROUND)
def test_article_without_its_surroundings(around):
    assert " ".join(html.main_blocks(around.format(ARTICLE))) == TEXT


def test_without_article_element():
    page = "<body><div id=top><a href=a>Home</a> <a href=b>News</a></div><div class=content><p>One long paragraph, with marks; and words enough.</p><p>Another one, again with marks, and so forth.</p></div></body>"
    assert " ".join(html.main_blocks(page)) == "One long paragraph, with marks; and words enough. Another one, again with marks, and so forth."


LONG = "Words of a long part, one after the other; as in a text, with marks. " * 12
PARTS = [
    "<h1>Title</h1><p>" + "An introduction, short. " * 6 + "</p><ul>" + "<li>" + "An item of the list, with some words. " * 3 + "</li></ul>",
    "<h1>Title</h1><p>An introduction, of a few words.</p><ul>" + ("<li>" + "An item of the list, with some words. " * 3 + "</li>") * 8 + "</ul>",
    "<section><h2>One</h2><p>" + LONG + "</p></section><section><h2>Two</h2><p>The shorter part, at the end; of a line.</p></section>",
    "<div><p>The shorter part, of a line, comes first.</p></div><div><p>" + LONG + "</p><p>" + LONG + "</p></div>",
    "<p>Before the table, a line.</p><table>" + ("<tr><td>" + "A cell of the table, with words. " * 3 + "</td><td>7</td></tr>") * 9 + "</table><p>After it, another.</p>",
    "<h1>T</h1><div class=text><p>" + LONG + "</p></div>",
]


@pytest.mark.parametrize("inner", PARTS)
@pytest.mark.parametrize("page", ["<nav><a href=a>Menu</a></nav><article>{}</article><footer>Foot, here.</footer>", "<main>{}</main>", "<div class=ad>Buy, now.</div><article>{}"])
def test_article_in_parts(page, inner):
    assert " ".join(html.main_blocks(page.format(inner))) == " ".join(re.sub(r"<[^>]*>", " ", inner).split())


def test_parts_without_article_element():
    page = f"<body><nav><a href=a>Menu</a></nav><div class=content><div><p>First, a line.</p></div><div><p>{LONG}</p><p>{LONG}</p></div></div></body>"
    assert " ".join(html.main_blocks(page)) == " ".join(f"First, a line. {LONG} {LONG}".split())


@pytest.mark.parametrize("page,text", [("", ""), ("just words", "just words"), ("<p>cut off, here &am", "cut off, here &am"), ("<p>a, b <b", "a, b"), ("<p>1 < 2, and 3 > 2.</p>", "1 < 2, and 3 > 2."), ("<p>x&nbsp;&#233;&#x41;\n\t y.</p>", "x éA y."), ("<script>only()", ""), ("<p>q <i>r</i>s, t.</p><p title=\"a>b\">u.</p>", "q rs, t. u.")])
def test_edges(page, text):
    assert " ".join(html.main_blocks(page)) == text


def test_long_pages_and_open_quotes():
    assert html.main_blocks("<p>w, w. " * 20000 + "</p>")
    assert html.main_blocks("<a href=\"x>" * 3000 + "text, text.") is not None


def test_whole_table(spark, small):
    rows = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: r for r in html.extract(rows).collect()}
    for r in rows.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.DOTALL)[1]
        plain = re.sub(r"<[^>]*>?", "", re.sub(r"<br>|</?p>|</?h1>", " ", inner))
        assert got[r.page_id].text == " ".join(unescape(plain).split()) and got[r.page_id].n_chars == len(got[r.page_id].text)


def article_text(page):
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.DOTALL)[1]
    return " ".join(unescape(re.sub(r"<[^>]*>?", "", re.sub(r"<br>|</?p>|</?h1>", " ", inner))).split())


def foreign(page):
    """The same page in plain containers whose class names say nothing."""
    for tag, name in (("article", "k9"), ("nav", "q1"), ("footer", "z3")):
        page = page.replace(f"<{tag}>", f"<div class='{name}'>").replace(f"</{tag}>", "</div>")
    return page.replace('<div class="ad">', "<div class='v5'>")


def test_ratios_decide_where_no_name_tells(spark):
    """Without <article> and known names nothing but the ratios finds the article; a constant ratio finds none."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    right = sum(" ".join(html.main_blocks(foreign(x))) == article_text(x) for x in pages)
    constant = sum(" ".join(html.main_blocks(foreign(x), ratio=lambda *_: 9.0)) == article_text(x) for x in pages)
    assert right >= 0.9 * len(pages) and constant == 0


def test_threshold_cuts_short_containers():
    page = "<body><div class=q1><a href=a>Home</a> <a href=b>News</a></div><div class=k9><p>One long paragraph, with marks; and words enough.</p><p>Short.</p><h2>Head</h2><p>Another one, again with marks, and so forth.</p><div class=zz>Buy now</div></div><div class=z3>Buy now</div></body>"
    assert " ".join(html.main_blocks(page)) == "One long paragraph, with marks; and words enough. Short. Head Another one, again with marks, and so forth."
    assert html.main_blocks(page, ratio=lambda *_: 9.0).count("Buy now") == 2
    assert "Buy now" in html.main_blocks(page, strength=0.0)


SOME, MORE = "First, a paragraph of some length; it has words & marks.", "Second paragraph, with some text; and marks."


@pytest.mark.parametrize("name", ["post-header", "notice", "social-history", "foot", "menu", "alert", "share", "related"])
def test_paragraphs_of_an_article_stay_whatever_their_container_is_called(name):
    assert html.main_blocks(f"<article><div class='{name}'><p>{SOME}</p></div><p>{MORE}</p></article>") == [SOME, MORE]


@pytest.mark.parametrize("inner,blocks", [
    ("<header><h1>Title</h1></header><p>{}</p>", ["Title", MORE]), ("<p>{}</p><ul><li><a href=x>Reference one</a></li><li><a href=y>Reference two</a></li></ul>", [MORE, "Reference one", "Reference two"]),
    ("<p>{}</p><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>", [MORE, "So x=2 holds."]), ("<p>{}</p><div class=share><a href=a>Tweet</a> <a href=b>Mail</a></div>", [MORE]),
    ("<p>{}</p><aside>Also, see this.</aside><nav><a>x</a></nav><footer>By me.</footer>", [MORE]), ("<div class='layout with-nav'><h2 class='section-header'>Head</h2><p>{}</p></div>", ["Head", MORE]),
])
def test_inside_an_article(inner, blocks):
    assert html.main_blocks(f"<div class='content has-sidebar'><article>{inner.format(MORE)}</article></div><div class=sidebar>Other, thing.</div>") == blocks


@pytest.mark.parametrize("page", ["<div>{}", "<div>a, b. {}", "<section>{}</p>", "<li><section>{}</li>"])
def test_deep_pages(page):
    """50,000 levels, in time and room that grow with the page only."""
    before, after = page.split("{}")
    assert html.main_blocks(before * 50_000 + "x, y. " + after * 50_000)


def test_awkward(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<p>a, b.</p>", "x"), (1, "u", "", "x")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or -1, r.url or "", r.text, r.n_chars) for r in html.extract(df).collect()) == [(-1, "", "a, b.", 5), (1, "u", "", 0), (1, "u", "", 0)]
    assert html.extract(df.where("false")).count() == 0
