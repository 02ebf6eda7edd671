"""Main texts of pages: against a plain reading of the given pages, and on made pages of all kinds of clutter."""

import collections
import html
import random
import re

import pytest

from strandlake.llm import entries, site_templates
from strandlake.llm.html_tree import article, digests, parse, unwanted

SCHEMA = "page_id long, url string, html string, host string, node int, nodes int, text string"


def text_of(page, templates=frozenset()):
    return article(parse(page), templates)


def test_given_pages_equal_a_plain_reading(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["page_id"]: r for r in entries.queries()["op12_main_texts"](spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        body = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", body)]
        want = "\n".join(x for x in blocks if x)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])


CLUTTER = """<!DOCTYPE html><html><head><title>Site &amp; title</title><style>p{}</style><script>var a = "</p><article>";</script></head>
<body class="has-sidebar"><header><h1>The site</h1></header><div id="cookie-banner">We use cookies</div><nav><ul><li>Home<li>About</ul></nav>
<div class="layout with-sidebar"><aside>Around</aside><div class="sidebar"><article>Teaser</article></div><form action=x><input>Search</form>
<article class="post"><header><h1>Title &mdash; one</h1></header><p>First&nbsp; <b>bold</b>er<br>line <!-- no <p> here --> goes
on.<p>Second &lt;p&gt; <script>no()</script>&#x41;&#66;<div class="ad-slot">Buy</div><ul><li>one<li>two</ul>
<table><tr><td>a<td>b<tr><td>c</table><div class="share">Tweet</div><footer>By us</footer></article>
<section id="comments"><article class="comment"><p>Nice!</p></article><article>Me too</article></section></div>
<div role="dialog">Sign up</div><div hidden>hidden</div><p style="display: none">no</p><footer>&copy; us</footer></body></html>"""


def test_clutter_goes_and_the_article_stays():
    assert text_of(CLUTTER).split("\n") == ["Title — one", "First bolder line goes on.", "Second <p> AB", "one", "two", "a b", "c"]


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""),
        ("just text", "just text"),
        ("<p>a<p>b</p>c", "a\nb\nc"),
        ("<main><h2>x</h2>y <i>z</i></main><p>out", "x\ny z"),
        ("<article>a</article><article>b</article><p>c", "a\nb"),
        ("<body><div>a<div>b</div>c</div>", "a\nb\nc"),
        ("a &amp b &lt;c&gt; &unknown; 1 < 2 <3", "a & b <c> &unknown; 1 < 2 <3"),
        ("<p title=it's>a</p><p>b</p>", "a\nb"),
        ('<p title="a > b">c</p>', "c"),
        ("<article><p>cut &am", "cut &am"),
        ("<article><p>cut <foo bar=", "cut"),
        ("<article><p>cut <!-- never ends", "cut"),
        ("<article>cut <script>never ends", "cut"),
        ("<!--><p>a<!---->b", "ab"),
        ("a<![CDATA[x]]>b<?php ?>c</ x>d", "abcd"),
        ("</p></div>a</article>b", "a\nb"),
        ("<form><h1>t</h1><article><p>a</article></form>", "a"),
        ("<article>a  b\n\tc</article>", "a b c"),
        ("<nav>only</nav>", ""),
        ("<head><title>t</title><p>no body tag", "no body tag"),
        ("<ARTICLE><P>A</P></ARTICLE>", "A"),
        ("<div>" * 50_000 + "deep", "deep"),
    ],
)
def test_odd_markup(page, want):
    assert text_of(page) == want


def test_long_pages_take_time_in_proportion():
    assert text_of("<article>" + "<p>w &amp; v</p>" * 100_000).count("\n") == 99_999
    text_of("<a b='" * 20_000)
    text_of("<" * 200_000)


def page(host, i, body):
    return (i, f"https://{host}/p/{i}", f"<html><body><div class=x{i}><div><a href=/{i}>Start</a> <a>Shop</a></div><p>We ship to all lands.</p></div>{body}</body></html>", "h", 1, 2, "t")


def made():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for i in range(60):  # div soup of one host: menu and notice have no telling names
        body = prose(20)
        rows.append(page("One.example:80", i, f"<div><p>{body}</p><p>Read on!</p></div>" if i % 5 == 0 else f"<div><p>{body}</p></div>"))
        want[i] = body + ("\nRead on!" if i % 5 == 0 else "")
    for i in range(100, 103):  # too few pages for a template
        body = prose(9)
        rows.append(page("two.example", i, f"<p>{body}</p>"))
        want[i] = f"Start Shop\nWe ship to all lands.\n{body}"
    for i in range(200, 240):  # one article under many addresses, and one line that articles share
        rows.append(page("three.example", i, "<article><p>The same article.</p><p>Shared line.</p></article>"))
        want[i] = "The same article.\nShared line."
    for i in range(300, 330):  # a box within all articles goes, a shared paragraph stays
        body = prose(5)
        rows.append(page("four.example", i, f"<article><p>{body}</p><div>Get our <b>paper</b></div><p>Shared line.</p></article>"))
        want[i] = f"{body}\nShared line."
    for i, url in ((400, None), (401, "/relative"), (402, "mailto:x")):
        rows.append((i, url, "<p>Read on!</p>", "h", 1, 2, "t"))
        want[i] = "Read on!"
    rows += [(500, "https://one.example/", None, "h", 1, 2, "t"), (501, "https://one.example/", "", "h", 1, 2, "t")]
    want |= {500: "", 501: ""}
    rng.shuffle(rows)
    return rows, want


@pytest.mark.parametrize("most", [site_templates.MOST_BROADCAST, -1])
def test_templates_go(spark, monkeypatch, most):
    monkeypatch.setattr(site_templates, "MOST_BROADCAST", most)
    rows, want = made()
    rows += [rows[0], (None, *rows[1][1:])]
    found = site_templates.main_texts(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    found = found.collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    assert {r["page_id"]: r["text"] for r in found if r["page_id"] is not None} == want
    assert [r["text"] for r in found if r["page_id"] is None] == [want[rows[1][0]]]
    assert site_templates.main_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_template_counts_equal_brute_force(spark):
    rows, _ = made()
    pages = [(r[1].split("/")[2].split(":")[0].lower(), r[2]) for r in rows if r[1] and "//" in r[1]]
    frame = spark.createDataFrame([(hash(h) if False else sum(map(ord, h)), x) for h, x in pages], "host long, html string")
    got = {r["host"]: {x % (1 << 64) for x in r["nodes"]} for r in site_templates.templates(frame, least=5, share=0.3).collect()}
    seen, articles = collections.defaultdict(lambda: collections.defaultdict(set)), collections.defaultdict(set)
    for h, x in pages:
        tree = parse(x or "")
        own = digests(tree, unwanted(tree)[0])
        arts = [i for i, n in enumerate(tree.names) if n == "article"] or [0]
        key = tuple(own[i] for i in arts)
        articles[sum(map(ord, h))].add(key)
        for i, n in enumerate(tree.names):
            up, inside = i, False
            while up > 0:
                up = tree.parents[up]
                inside |= tree.names[up] == "article"
            if own[i] and n in ("p", "div", "ul", "li") and (not inside or n in ("div", "ul")):
                seen[sum(map(ord, h))][own[i]].add(key)
    want = {h: {d for d, keys in nodes.items() if len(keys) >= max(5, 0.3 * len(articles[h]))} for h, nodes in seen.items()}
    assert got == {h: x for h, x in want.items() if x}


def test_hosts(spark):
    urls = ["https://A.b:8080/x", "//c.d?x", "http://u:p@e.f/", "ftp://[::1]:2/", "e.f/x", "", None, "http:///x", "https://g.h#t"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in frame.select(site_templates.host("url")).collect()] == ["a.b", "c.d", "e.f", "[::1]", None, None, None, None, "g.h"]
