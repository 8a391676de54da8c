import html
import re

import pytest

from maskframe.llm.html_text import extract_text, main_text, parse
from maskframe.llm.registry import QUERIES

ARTICLE = "<h1>Title &amp; more</h1><p>First  <b>bold</b> text,\n with a <a href='/x'>link</a>.<p>Second&nbsp;one.<ul><li>item<li>last</ul>"
TEXT = "Title & more First bold text, with a link. Second one. item last"
AROUND = (
    "<html><head><title>no</title><style>p{}</style><script>var a='</p><p>no';</script></head><body><header>no</header>"
    "<nav><ul><li><a href='/'>no</a></ul></nav><div class='ad-box advert'>no, really no, not this text here.</div>%s"
    "<aside>no</aside><form><p>no</p><input name=x></form><div id=comments><p>no, says a reader, no and no.</p></div>"
    "<div class='cookie-notice'>no</div><footer>&copy; no</footer></body></html>"
)


@pytest.mark.parametrize("wrap", [
    "<article>%s</article>", "<main><article>%s</article></main>", "<ARTICLE CLASS='post'>%s</ARTICLE>", "<main>%s</main>",
    "<div class='content'>%s</div>", "<div><div>%s</div></div>",
])
def test_the_article_is_all_that_is_left(wrap):
    assert main_text(AROUND % (wrap % ARTICLE)) == TEXT


@pytest.mark.parametrize("page, text", [
    ("", ""), ("no markup at all", "no markup at all"), ("<p>", ""), ("<article><p>a<br>b<!-- c --><i>d</i>e", "a bde"),
    ("<article><p>cut off <b", "cut off"), ("<article>a < b and 2 > 1 &lt;p&gt; &#233;&#x41; &am &unknown;", "a < b and 2 > 1 <p> éA &am &unknown;"),
    ("<article><p title='a > b'>x</p><script>if (a < b) '</scrip'</script><p>y</article>", "x y"),
    ("<body><nav>menu</nav></body>", ""), ("<article><header><h1>T</h1></header><p>x</p><footer>f</footer></article>", "T x"),
    ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1 2 3"),
    ("<article><p>a</p><div hidden>b</div><div style='display: none'>c</div><p>d</article>", "a d"),
    ("<article><p>x<span class='ad'>buy</span>y</p></article>", "x"),
])
def test_odd_pages(page, text):
    if "buy" in page:
        assert "buy" not in main_text(page)
    else:
        assert main_text(page) == text


@pytest.mark.parametrize("page, text", [
    ("<article><p>x<span class='ad'>buy</span>y</p></article>", "x y"),
    ("<p>x<span class=\"ad\">buy</span>y</p>", "x y"),
    ("<article><span class='share'>Share</span><p>a</p><p>b</p></article>", "a b"),
    ("<article><p>a <small class='ad'>no <small>no</small> no</small> b</p></article>", "a b"),
    ("<article><p>a <span class='ad'>no</p><p>b</p></article>", "a b"),
    ("<article><p>a <span class='ad'>no<p>b</span></article>", "a b"),
    ("<article>a<span class='ad'><div>no</span>no</div>no</span> b</article>", "a b"),
    ("<article><p>a <i style='display:none'>no</i><em>b</em></p><img class='ad' src=x><p>c</article>", "a b c"),
])
def test_skipped_inline_elements_end(page, text):
    assert main_text(page) == text


BODY = "<h1 class='%s'>T</h1><p>First paragraph of the text.</p><p>Second paragraph of the text.</p>"
BODY_TEXT = "T First paragraph of the text. Second paragraph of the text."


@pytest.mark.parametrize("name", [
    "content has-sidebar", "with-sidebar", "no-comments", "page-header", "post-header", "social-science", "alert-story",
    "research", "sidebar", "comments", "widget",
])
def test_names_of_wrappers_and_headings_drop_nothing(name):
    for wrap in ("<div class='%s'><article>%s</article></div>", "<div id='%s'>%s</div>", "<main><div class='%s'>%s</div></main>"):
        assert main_text(AROUND % (wrap % (name, BODY % "title"))) == BODY_TEXT
    for heading in ("page-header", "post-header", "header", "no-comments"):
        assert main_text(f"<article>{BODY % heading}</article>") == main_text(f"<div>{BODY % heading}</div>") == BODY_TEXT


@pytest.mark.parametrize("name", [
    "ad", "sidebar", "left-sidebar", "cookie-bar", "share_buttons", "related-posts", "comments-area", "post comments",
])
def test_asides_by_name_are_left_out(name):
    for wrap in ("<article>%s<div class='%s'><p>Not this one.</p></div></article>", "<div>%s<ul id='%s'><li>Not this one.</ul></div>"):
        name = name.split()[-1] if "id=" in wrap else name
        assert main_text(wrap % (BODY % "title", name)) == BODY_TEXT
    # An article elsewhere leaves even the longest comments out.
    long = "<article>%s</article><div class='comments'><article><p>%s</p></article></div>" % (BODY % "title", "no, " * 500)
    assert main_text(long) == BODY_TEXT


def test_only_whole_attributes_count():
    assert main_text("<article><p title='hidden gems' data-class='ad'>a</p><p alt=\"id='ads'\">b</p></article>") == "a b"


LINE = "A sentence of the text, long enough to count."
SIX, FOUR = f"<p>{LINE}</p>" * 6, f"<p>{LINE}</p>" * 4


@pytest.mark.parametrize("page, text", [
    (f"<body><div>{SIX}</div><div>{FOUR}</div></body>", " ".join([LINE] * 10)),
    (f"<article>{SIX}</article><article>{FOUR}</article>", " ".join([LINE] * 10)),
    (f"<main><article>{SIX}</article><p>{LINE}</p><article>{FOUR}</article></main>", " ".join([LINE] * 11)),
    (f"<main><ul><li><a href=x>all</a></ul><article>{SIX}</article></main>", " ".join([LINE] * 6)),
    (f"<div><h1>T</h1><p>lead</p><div class=body>{SIX}</div></div>", " ".join(["T lead", *[LINE] * 6])),
    (f"<div><h1><a href=x>T</a></h1><p>lead</p><div class=body>{SIX}</div></div>", " ".join(["T lead", *[LINE] * 6])),
    (f"<div>{SIX}</div><h2>T</h2><ul><li>a<li><a href=x>b</a></ul><div>{FOUR}</div>", " ".join([*[LINE] * 6, "T a b", *[LINE] * 4])),
    (f"<div><ul><li><a href=x>Home</a><li><a href=y>All</a></ul><div>{SIX}</div><section>{FOUR}</section></div>", " ".join([LINE] * 10)),
])
def test_content_in_several_elements(page, text):
    assert main_text(page) == text


def test_long_pages_are_read_whole():
    page = "<article>" + "".join(f"<p>paragraph {i} of many, with some words.</p>" for i in range(20_000)) + "</article>"
    assert main_text(page).count("paragraph") == 20_000
    deep = "<div>" * 3000 + "<p>deep down, a text.</p>"
    assert main_text(deep) == "deep down, a text."
    assert len(parse("<p>" + "a<" * 20_000)[0]) == 1


def test_rows_of_odd_tables(spark):
    rows = [(1, "u", None, 5), (None, None, "", None), (2, "u", f"<article>{ARTICLE}</article>", 1)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path long")
    out = extract_text(pages)
    assert out.columns == [*pages.columns, "main_text"]
    assert sorted(r.main_text for r in out.collect()) == [""] * 4 + [TEXT] * 2
    assert extract_text(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        extract_text(pages, out="url")


def test_given_pages(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br)[^>]*>", re.sub(r"</?b>", "", inside))
        want[r.page_id] = " ".join(filter(None, (" ".join(html.unescape(b).split()) for b in blocks)))
    got = QUERIES["op8_html_extraction"](spark, sf).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
