import html
import re

import duckdb
import pytest

from tidewater.llm import articles

CASES = {
    "": "",
    "text only": "text only",
    "a < b &amp; c &am": "a < b & c &am",
    "<div><p>one two</p><p>three</p></div><ul><li><a href=x>l</a></ul>": "one two three",
    "<body><div id=main><h2>T</h2><p>Long text here and more and more text to read.</p></div><div class=comments><p>me too</p></div></body>": "T Long text here and more and more text to read.",
    "<b>x<p>y</b>z": "x y z",
    "<article>in<b>si</b>de<br>new<script>no()</script><form>no</form><!-- no --></article><footer>no": "inside new",
    "<article><header><h1>Title</h1></header><p>Body.</p><aside>no</aside></article><header>no</header>": "Title Body.",
    "<article><p>open <b>never closed &lt;3": "open never closed <3",
    "<nav>only a menu</nav>": "",
}


@pytest.mark.parametrize("page", CASES)
def test_cases(page):
    assert articles.main_text(page) == CASES[page]


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "post-comments-open", "search-result"])
def test_marked_wrappers_of_the_article(name):
    text = "Long text here and more and more text to read."
    other = "<div class=comments><p>me too</p></div>"
    assert articles.main_text(f"<body><div class='{name}'><article><p>{text}</p></article>{other}</div></body>") == text
    assert articles.main_text(f"<body><div id=a class='{name}'><div class='{name}'><p>{text}</p></div>{other}</div><div class=ad>buy</div></body>") == text
    assert articles.main_text(f"<body><article><p>{text}</p></article><div class=comments><article>{text * 3}</article></div></body>") == text


LONG = "Long text here and more and more text to read, with words and words. " * 4


@pytest.mark.parametrize(
    "page",
    [
        "<div class='wrap has-sidebar'><article><p>{}</p></article></div>",
        "<div class='site nav-fixed'><article><p>{}</p></article></div>",
        "<div class='menu-open'><main><p>{}</p></main></div>",
        "<div class='post-content social'><p>{}</p></div>",
        "<form id=aspnet action=/><div><p>{}</p></div></form>",
        "<form><nav>menu</nav><article><p>{}</p><form>search</form></article></form>",
    ],
)
def test_pages_in_wrappers_keep_their_text(page):
    assert articles.main_text(f"<html><body>{page.format(LONG)}</body></html>") == LONG.strip()


@pytest.mark.parametrize("name", ["entry-content social", "content widget", "post related", "share-price", "search results", "ad-free", "login-required", "article-body comments-enabled", "promo", "comments"])
@pytest.mark.parametrize("frame", ["<article><h1>T</h1>{}</article>", "<main><h1>T</h1>{}</main>", "<main><article><h1>T</h1>{}</article></main>", "<div class=ad>no</div><article><h1>T</h1><div>{}</div></article><footer>no</footer>"])
def test_marked_parts_that_carry_the_article_stay(name, frame):
    for attribute in ("class", "id"):
        assert articles.main_text("<body>" + frame.format(f"<div {attribute}='{name}'>{LONG}</div>") + "</body>") == f"T {LONG}".strip()
    inner = f"<div class='{name}'><p>{LONG}</p><div class=related>{LONG[:60]}</div></div>"
    assert articles.main_text(frame.format(inner)) == f"T {LONG}".strip()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<main><div id=social>{LONG}</div></main>", LONG),
        (f"<article><form>{LONG}</form></article>", LONG),
        (f"<article><form><h1>T</h1><p>{LONG}</p><input></form></article>", f"T {LONG}"),
        (f"<article><p>{LONG[:30]}</p><div class='entry-content social'><p>{LONG}</p></div></article>", f"{LONG[:30]} {LONG}"),
        # Parts that carry nothing go as before, and what readers write goes though it is longer.
        (f"<article><p>{LONG}</p><form>{LONG[:40]}</form><div class=promo>{LONG[:40]}</div></article>", LONG),
        (f"<article><p>{LONG}</p><div class=comments><p>{LONG * 5}</p></div></article>", LONG),
        (f"<main><article><p>{LONG}</p></article><div class=comments><p>{LONG * 5}</p></div></main>", LONG),
        (f"<article><p>{LONG}</p><section id=disqus_thread><p>{LONG * 5}</p></section></article>", LONG),
    ],
)
def test_what_stays_of_an_article(page, want):
    assert " ".join(articles.main_text(page).split()) == " ".join(want.split())


#: Pages whose parts are marked by nothing but their density.
UNMARKED = [
    f"<body><div><div><a href=/1>One</a><a href=/2>Two</a><a href=/3>Three</a><a href=/4>Four</a></div><div id=x><p>{LONG}</p><p>{LONG}</p></div><div><a href=/t>Terms</a><a href=/i>Imprint</a></div></div></body>",
    f"<body><table><tr><td><ul><li><a href=/1>a</a><li><a href=/2>b</a><li><a href=/3>c</a></ul></td><td><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div></td><td><b>x</b><i>y</i><b>z</b></td></tr></table></body>",
]


@pytest.mark.parametrize(("page", "want"), [(UNMARKED[0], f"{LONG}{LONG}"), (UNMARKED[1], f"T {LONG}{LONG}")])
def test_density_selects_and_the_body_would_not(page, want, monkeypatch):
    assert articles.main_text(page) == want.strip()
    monkeypatch.setattr(articles, "_select", lambda body: [body])
    assert articles.main_text(page) != want.strip()


def test_density_sums_like_brute_force():
    """Density of every node and the sum over its children, counted anew from the definition."""
    import math

    body = articles._measure(articles.parse(UNMARKED[0]))

    def inside(node):
        return [x for i in node.items if isinstance(i, articles.Node) and not i.cut for x in (i, *inside(i))]

    text = lambda n: "".join("".join(i.split()) for x in (n, *inside(n)) for i in x.items if isinstance(i, str))
    linked = lambda n: text(n) if n.tag == "a" else "".join(text(x) for x in inside(n) if x.tag == "a")
    share = len(linked(body)) / len(text(body))

    def density(n):
        c, t, lc = len(text(n)), len(inside(n)) or 1, len(linked(n))
        lt = sum(x.tag == "a" for x in inside(n)) or 1
        base = math.log(math.log(c / max(1, c - lc) * lc + share * c + math.e))
        return c / t * max(0.0, math.log(max(1.0, c / max(1, lc) * t / lt))) / base if base > 1e-9 else c / t

    for n in (body, *inside(body)):
        own = [x for x in n.items if isinstance(x, articles.Node) and not x.cut]
        assert n.density == pytest.approx(density(n)) and n.total == pytest.approx(sum(map(density, own)) or density(n))


@pytest.mark.parametrize("page", ["<a " * 350000 + '"', "<a x=" * 200000 + '"', "<div>" * 60000 + "</p>" * 170000, "<b><div>" + "<i>" * 60000 + "</b>" * 170000, "<ul>" + "<div>" * 60000 + "<li></li>" * 60000, "<div>" + "<i>" * 60000 + "<div></div>" * 60000, "<!--" * 250000, "<" * 1000000, "</" * 500000, "<p a='" * 100000 + ">x"])
def test_broken_markup_takes_linear_time(page):
    import time

    began = time.perf_counter()
    articles.main_text(page)
    assert time.perf_counter() - began < 4


def test_deep_pages_do_not_recurse():
    assert articles.main_text("<div>" * 30000 + "x") == "x"
    assert articles.main_text("<b><p>" * 20000 + "x") == "x"
    assert articles.main_text("<div class=sidebar>" * 30000 + "x") == "x"


def test_pages_of_the_table(spark, sf_dir):
    pages = duckdb.sql(f"select page_id, html from '{sf_dir}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in articles.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    for i, page in pages:
        m = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)
        text = re.sub(r"<[^>]*>", "", re.sub(r"<(?:p|/p|br|h1|/h1)>", " ", m.group(1) if m else ""))
        want = " ".join(html.unescape(text).split())
        assert got[i].text == want and got[i].n_chars == len(want)


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<p>x y</p>"), (2, "u", "<p>x y</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = articles.extract(pages).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == [("1", "", 0), ("2", "", 0), ("2", "x y", 3), ("None", "x y", 3)]
    assert articles.extract(pages.limit(0)).count() == 0
