import html
import itertools
import random
import re

import pytest

from tollgate.llm import html_extract as H

PAGE = """<html><body class="with-sidebar"><header><h1>Site</h1><a href=x>home</a></header>
<div class="cookie-notice">We use cookies on this site, as others do.</div><main><article><header><h1>Title &amp; more</h1></header>
<p>Para <i>one</i>, long enough.<p>Two<br>lines &nbsp; here.<p>a&lt;b<aside class="ad">Buy now</aside><ul><li>first<li>second</ul>
<form>Name <input> <button>Go</button></form><footer>Tags</footer></article><section id="comments"><article><p>nice post, I agree.</p>
</article></section></main><div class=sidebar><p>Recent posts</p></div><script>var a="<p>x</p>"</script><!-- c <p>d</p> -->
<style>p{}</style><footer>&copy; me</footer></body></html>"""
EXPECTED = "Title & more\n\nPara one, long enough.\n\nTwo lines here.\n\na<b\n\nfirst\n\nsecond"
ODD = ["", "<", "<p", "<!--", "<!-- <p>x", "<script>", "<script>x", "&amp", "<p>x</div></p>", '<a href="x>y</p> z', "<title>t",
       "</p>" * 3, "<p>" * 3000 + "x", "<![CDATA[x]]>", "\0", "<p a='b\"c'>x", "<table><tr><td>a<td>b<tr><td>c</table>"]


def test_page_with_and_without_training():
    weights = H.fit([PAGE] * 3)
    assert H.extract_text(PAGE, weights) == EXPECTED
    assert H.extract_text(PAGE, H.EXPECTED) == EXPECTED


TEXT = "<h1>Title</h1><p>A first paragraph, long enough to be read as text, yes.</p><p>A second one of the same kind, which ends here.</p>"
WHOLE = "\n\n".join(x for x in re.split("<[^>]+>", TEXT) if x)


@pytest.mark.parametrize("page", [
    f'<main class="has-sidebar">{TEXT}</main>',
    f'<article class="post category-social tag-search">{TEXT}</article>',
    f'<div class="page-content no-comments">{TEXT}</div>',
    f'<div class="page-content noComments"><article>{TEXT}</article></div>',
    f'<div class="comments-layout"><article>{TEXT}</article></div>',
    f'<form id="aspnetForm"><main>{TEXT}</main></form>',
    f'<main class="social">{TEXT}</main>'])
def test_names_around_a_whole_page_do_not_take_its_text(page):
    page = f'<html><body><nav><a href=x>home</a> <a href=y>news</a></nav>{page}<footer>&copy; me</footer></body></html>'
    for weights in (H.EXPECTED, H.fit([PAGE] * 3)):
        assert H.extract_text(page, weights) == WHOLE


@pytest.mark.parametrize("start, end", [('<form id="aspnetForm">', "</form>"), ('<div id="banner-page">', "</div>"), ('<div class="comments">', "</div>")])
def test_names_of_a_whole_page_say_nothing(start, end):
    page = f"<nav><a href=x>home</a> <a href=y>news</a></nav>{{}}<div>{TEXT}</div>{{}}<footer>&copy; me</footer>"
    for weights in (H.EXPECTED, H.fit([PAGE] * 3)):
        got = H.extract_text(page.format(start, end), weights)
        assert got == H.extract_text(page.format("<div>", "</div>"), weights) and got.endswith(WHOLE.removeprefix("Title\n\n"))


def test_names_still_decide_beside_an_article():
    long = "<p>I have much to say about this, and I say it at length.</p>" * 20
    for rest in (f'<div class="comments">{long}</div>', f'<form>{long}</form>', f'<div class="sidebar">{long}</div>',
                 f'<div style="display:none">{long}</div>'):
        assert H.extract_text(f"<body><article>{TEXT}</article>{rest}</body>", H.EXPECTED) == WHOLE, rest
    comment = '<article class="comment"><p>nice post, I agree with it.</p></article>'
    assert H.extract_text(f"<body><article>{TEXT}{comment}</article></body>", H.EXPECTED) == WHOLE


def test_odd_pages_do_not_fail():
    for page in ODD:
        assert isinstance(H.extract_text(page, H.EXPECTED), str)


@pytest.mark.parametrize("seed", range(30))
def test_min_cut_is_minimal(seed):
    r = random.Random(seed)
    n = r.randint(1, 9)
    unary = [r.uniform(-2, 2) for _ in range(n)]
    edges = [(a, b, r.uniform(0, 1.5)) for a in range(n) for b in range(a + 1, n) if r.random() < 0.4]

    def cost(labels):
        return (sum(abs(u) for u, x in zip(unary, labels, strict=True) if (u > 0) != x)
                + sum(w for a, b, w in edges if labels[a] != labels[b]))
    best = min(cost(x) for x in itertools.product([False, True], repeat=n))
    assert abs(cost(H.min_cut(unary, edges)) - best) < 1e-9


def test_min_cut_of_a_long_page_is_quick():
    r = random.Random(1)
    n = 20_000
    unary = [r.uniform(-1, 1) for _ in range(n)]
    edges = [(i, i + 1, 1.0) for i in range(n - 1)] + [(i, i + 3, 0.7) for i in range(n - 3)]
    labels = H.min_cut(unary, edges)

    def cost(x):
        return (sum(abs(u) for u, y in zip(unary, x, strict=True) if (u > 0) != y)
                + sum(w for a, b, w in edges if x[a] != x[b]))
    best = cost(labels)
    for at in r.sample(range(n - 5), 300):  # no run of flipped labels is cheaper
        other = list(labels)
        for k in range(at, at + r.randint(1, 5)):
            other[k] = not other[k]
        assert cost(other) >= best - 1e-6


def test_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p>" + "long text here, yes. " * 60_000),
            *((10 + i, "o", p) for i, p in enumerate(ODD))]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = H.extract(df).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert [r.text for r in out if r.page_id == 1] == [EXPECTED] * 2
    assert {r.text for r in out if r.page_id in (2, None)} == {""}
    assert next(r.n_chars for r in out if r.page_id == 3) == 60_000 * 21 - 1
    assert H.extract(df.where("false")).count() == 0


def test_query_on_the_given_pages(spark):
    import duckdb

    from tollgate.llm.queries import QUERIES
    got = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op10_html_extract"](spark, "/root/testdata/sf0.01").collect()}
    pages = duckdb.sql("select page_id, html from '/root/testdata/sf0.01/pages.parquet'").fetchall()
    assert len(got) == len(pages)
    for i, page in pages:  # in these pages the article is one element of headings and paragraphs
        inner = re.search("<article>(.*?)</article>", page, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", inner)]
        text = "\n\n".join(x for x in blocks if x)
        assert got[i] == (text, len(text))
