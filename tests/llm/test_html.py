import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veriloom.llm import html as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
<header><p>Site</p></header><nav><ul><li>A<li>B</ul></nav><!-- <article>no</article> --><div class="ad-box">Buy</div>
<article><h1>Head &amp; line</h1><p>One<br>two  <b>bo</b>ld &lt;x&gt; &#233;&nbsp;y<div class=notice>note</div><p>Three
 <form>f <input> g</form><aside>s</aside><blockquote>q</blockquote>tail<ul><li>i1<li>i2</ul><table><tr><td>c1<td>c2</table>
<section id="comments"><p>nice</p></section><footer>by</footer></article><div id="sidebar">x</div><footer>&copy;</footer></body></html>"""
TEXT = "Head & line\n\nOne two bold <x> é y\n\nThree\n\nq\n\ntail\n\ni1\n\ni2\n\nc1\n\nc2"


def wrapper_of(*pages):
    out = H.generalise(H.parse(pages[0])[0][1])
    for p in pages[1:]:
        out = H.align(out, H.generalise(H.parse(p)[0][1]))
    return out


def kept_on(page):
    """The paths of one page alone, as a host of one page has them."""
    found = [(p, n, b, 1, 1) for p, n, b, _, _ in H.page_texts(H.parse(page)[1])]
    return set(H.kept_paths(pd.DataFrame(found, columns=["path", "level", "beside", "texts", "pages"])))


def test_article_without_what_surrounds_it():
    assert H.main_text(PAGE, H.texts_of(wrapper_of(PAGE)), kept_on(PAGE)) == TEXT


def test_repeats_and_options_are_inferred():
    pages = ["<ul><li>a</ul><p>x", "<ul><li>a<li>b<li>c</ul><p>x<p>y", "<ul><li>a</ul><h2>t</h2><p>x"]
    w = wrapper_of(*pages)
    assert H.regular_expression(w) == "<ul>(<li>#</>)+</>(<h2>#</>)?(<p>#</>)+"
    assert all(H.matches(w, H.parse(p)[0]) for p in pages)
    assert not H.matches(w, H.parse("<ul><li>a</ul>")[0])
    assert H.regular_expression(wrapper_of("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>")) == "<dl>(<dt>#</><dd>#</>)+</>"


def test_wrappers_match_the_pages_they_come_from(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rules = {r["host"]: json.loads(r["wrapper"]) for r in H.wrappers(pages).collect()}
    rows = pages.collect()
    found = [rules[H.host_of(r["url"])] for r in rows]
    assert rows and all(H.matches(w, H.parse(r["html"], None, H.constants_of(H.texts_of(w)))[0]) for w, r in zip(found, rows))


@pytest.mark.parametrize("limit", [8 << 20, -1])
def test_every_page_has_a_row(spark, monkeypatch, limit):
    monkeypatch.setattr(H, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(H, "ALIGNED", 2)
    old = [f"<body><div class=nav>m</div><div class=wrap><div class=c><p>hello {i} some longer text that is main {i}</p>" + "<p>more text</p>" * i
           + "</div><div class=x>side</div></div><div>copyright</div></body>" for i in range(6)]
    rows = [(i, f"http://User@H:80/{i}", p, "h") for i, p in enumerate(old)]
    rows += [(10, None, "plain text only", "h"), (11, "http://h/", None, "h"), (12, "zz", "", "h"), (None, "http://a/", PAGE, "h"), (13, "http://a/", PAGE, "h"),
             (13, "http://a/", PAGE, "h"), (14, "http://q/", "<p>a" + "<div>" * 3000 + "deep &amp; down", "h"), (15, "http://q/", "a < b <unclosed", "h"),
             (16, "http://r/", "<article></article><div>other words that are longer</div>", "h"), (17, "http://s/", "<main><p>in main</p></main><p>out</p>", "h")]
    out = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string"))
    got = {(r["page_id"], r["text"]) for r in out.collect()}
    assert out.count() == len(rows)
    want = {(i, "\n\n".join([f"hello {i} some longer text that is main {i}"] + ["more text"] * i)) for i in range(6)}
    want |= {(10, "plain text only"), (11, ""), (12, ""), (None, TEXT), (13, TEXT), (14, "a\n\ndeep & down"), (15, "a < b"), (16, ""), (17, "in main")}
    assert got == want
    assert H.extract(out.limit(0).withColumn("html", out["text"])).count() == 0


def test_long_pages():
    page = "<article>" + "<p>x</p>" * 20_000 + "</article>"
    assert H.main_text(page, H.texts_of(wrapper_of(page)), kept_on(page)) == "\n\n".join("x" * 20_000)
    H.parse("<" * 20_000 + "<a b='" * 2_000 + "<!--" * 2_000)


def test_copies_of_a_page_do_not_make_its_text_a_template(spark):
    body = "<div><p>{}</p>{}</div><div class=x>all rights</div>"
    rows = [(i, "http://one/", body.format("the only article", "")) for i in range(4)]
    rows += [(i, "http://two/", body.format(f"article {i}", "")) for i in range(10, 14)]
    rows += [(i, "http://two/", body.format("copied", "<blockquote>quoted</blockquote>")) for i in range(14, 18)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: "the only article\n\nall rights" for i in range(4)}, **{i: f"article {i}" for i in range(10, 14)},
                   **{i: "copied\n\nquoted" for i in range(14, 18)}}


@pytest.mark.parametrize("element", ["article", "div"])
def test_the_wrapper_decides_what_is_template(spark, element):
    """Lines all pages repeat are literals, class words are outvoted by varying text; copies and hosts of two pages have no template."""
    body = (f"<body><nav><a>x</a></nav><{element}><h1>title {{0}}</h1><p>body {{0}}</p><p class='share-price'>shares rose {{0}} percent</p>"
            f"<p>Sign up for our daily letter</p><p class='search-results'>found {{0}}</p><div class='share-links'>tell {{0}}</div></{element}></body>")
    rows = [(i, "http://h/", body.format(i)) for i in range(6)] + [(i, "http://two/", body.format(i)) for i in (10, 11)]
    rows += [(i, "http://copies/", body.format("same")) for i in range(20, 25)]
    # versions of one article: most of the text is the same on all pages
    rows += [(i, "http://versions/", f"<{element}><p>a long paragraph all versions have</p><p>v{i}</p></{element}>") for i in range(30, 34)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"].split("\n\n") for r in H.extract(pages).collect()}
    for i in range(6):
        assert got[i] == [f"title {i}", f"body {i}", f"shares rose {i} percent", f"found {i}"]
    for i, name in [(10, 10), (11, 11), *((i, "same") for i in range(20, 25))]:
        assert got[i] == [f"title {name}", f"body {name}", "Sign up for our daily letter"]
    assert all(got[i] == ["a long paragraph all versions have", f"v{i}"] for i in range(30, 34))
    # a changed wrapper changes the result
    rules = H.wrappers(pages.where("page_id < 6"))
    line = H.literal(H.text_digest("Sign up for our daily letter"))
    assert all(line in r["wrapper"] for r in rules.collect())
    loose = rules.withColumn("wrapper", F.replace("wrapper", F.lit(line), F.lit(H.TEXT)))
    assert all("Sign up for our daily letter" in r["text"] for r in H.extract(pages.where("page_id < 6"), loose).collect())
    none = rules.withColumn("wrapper", F.replace("wrapper", F.lit("p.share-price"), F.lit("p.other")))
    assert not any("percent" in r["text"] for r in H.extract(pages.where("page_id < 6"), none).collect())
