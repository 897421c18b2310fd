from __future__ import annotations

import html
import itertools
import random
import re

from pyspark.sql import types as T

from keyvigil.llm import html_extraction as pages

LONG = "The committee met on Tuesday, and after a long debate it agreed on the plan for the old bridge."


def test_article_of_the_given_pages(spark):
    """The given pages hold one article; its blocks, decoded, are the text."""
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    result = {r["page_id"]: r["text"] for r in pages.extracted(given).collect()}
    for row in given.collect():
        article = re.search("<article>(.*)</article>", row["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", " ", x))).strip() for x in re.split("</?(?:p|h1)>|<br>", article)]
        assert result[row["page_id"]] == "\n".join(b for b in blocks if b)


def test_page_furniture_goes():
    page = f"""<!DOCTYPE html><HTML><head><title>no</title><style>p {{}}</style></head><body class="single"><script>if (a < b) document.write("<p>no</p>")</script>
    <header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/a">Archive of everything we have</a></ul></nav>
    <div id="cookie-banner"><p>We use cookies so that the site can work; please accept them all.</p></div>
    <main><h2>Bridge &amp; river</h2><p>{LONG}</p><div class="ad-slot"><p>Buy the finest shoes in town today, now cheaper than ever.</p></div>
    <p>Short one.</p><!-- <p>hidden remark</p> --><ul><li>First point of it.</li><li>Second point.</li></ul><form action="/x"><label>Your mail</label><input></form>
    <p>Caf&eacute;&nbsp;&#8212; <b>bold</b>\n\n and <i>more</i>.</p></main>
    <aside><p>Related stories that you may like are listed here for you.</p></aside><section id="comments"><article><p>{LONG} So says a reader.</p></article></section>
    <footer><p>&copy; 2024 All rights reserved by the site and its makers.</p></footer></body></HTML>"""
    assert pages.main_text(page).split("\n") == [
        "Bridge & river", LONG, "Short one.", "First point of it.", "Second point.", "Café — bold and more."]


def test_pages_without_an_article_element():
    page = f"""<body><div><a href=1>Home</a> | <a href=2>News</a> | <a href=3>About us</a></div>
    <table><tr><td><h1>Old page</h1><p>{LONG}<p>Yes.<p>{LONG}</td><td><a href=x>Links to other pages</a><br><a href=y>More links here</a></td></tr></table>
    <div>Copyright 2001. All rights reserved.</div></body>"""
    assert pages.main_text(page).split("\n") == ["Old page", LONG, "Yes.", LONG]


def test_broken_and_empty_pages(spark):
    assert pages.main_text("") == "" and pages.main_text("<p>") == "" and pages.main_text("<!-- open") == ""
    assert pages.main_text("<script>never closed <p>x</p>") == ""
    assert pages.main_text(f"<article><p>{LONG} 1 < 2 & 3 > 2") == f"{LONG} 1 < 2 & 3 > 2"
    assert pages.main_text("</p></div>" * 5000 + f"<div><p>{LONG}</p>") == LONG
    assert pages.main_text("<div>" * 3000 + f"<p>{LONG}</p>") == LONG
    kind = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                         T.StructField("html", T.StringType()), T.StructField("text", T.StringType())])
    rows = [(1, "u", None, "t"), (None, None, "", "t"), (2, "u", f"<p>{LONG}</p>", "t"), (2, "u", f"<p>{LONG}</p>", "t")]
    found = pages.extracted(spark.createDataFrame(rows, kind)).collect()
    assert sorted((str(r["page_id"]), r["text"]) for r in found) == [("1", ""), ("2", LONG), ("2", LONG), ("None", "")]
    assert pages.extracted(spark.createDataFrame([], kind)).count() == 0


def test_cut_is_minimal():
    """Against all labellings of small graphs."""
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randrange(1, 9)
        source = [rng.choice((0, 1, 2, 3)) + rng.random() for _ in range(n)]
        sink = [rng.choice((0, 1, 2, 3)) + rng.random() for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.random() * 4) for _ in range(rng.randrange(14))]

        def cost(side):
            cut = sum(w for a, b, w in edges if side[a] != side[b])
            return cut + sum(sink[k] if side[k] else source[k] for k in range(n))

        best = min(cost(side) for side in itertools.product((True, False), repeat=n))
        assert abs(cost(pages.minimum_cut(source, sink, edges)) - best) < 1e-9


def test_names_of_wrappers_do_not_take_the_article():
    """A layout wrapper or page-wide form goes by what stands below it; advertisements and comments in it still go."""
    paragraphs = [f"{LONG} It was report number {k}." for k in range(4)]
    body = "".join(f"<p>{x}</p>" for x in paragraphs)
    ad = '<div class="ad-slot"><p>Buy the finest shoes in town today, now cheaper than ever.</p></div>'
    comments = f'<section id="comments"><article><p>{LONG} So says a reader.</p></article></section>'
    nav = '<nav><ul><li><a href="/">Home</a><li><a href="/a">Archive of everything we have</a></ul></nav>'
    side = '<div class="sidebar"><p>Related stories that you may like are listed here for you.</p></div>'
    for wrapper in ('div class="layout has-sidebar"', 'form id="aspnetForm"', 'div class="post-message"', 'div class="review-body"'):
        end = wrapper.split()[0]
        for tag in ("article", "main"):
            page = f"<body>{nav}<{wrapper}><{tag}>{body}{ad}</{tag}>{comments}{side}</{end}><footer><p>All about us.</p></footer></body>"
            assert pages.main_text(page).split("\n") == paragraphs
        assert pages.main_text(f"<body>{nav}<{wrapper}>{body}{ad}</{end}{'>'}{side}</body>").split("\n") == paragraphs
    thread = "".join(f'<div class="post-message"><p>{x}</p></div>' for x in paragraphs)
    assert pages.main_text(f"<body>{nav}{thread}{side}</body>").split("\n") == paragraphs
    assert pages.main_text(f'<body><form class="login" hidden><article>{body}</article></form></body>') == ""
    assert pages.main_text(f"<body><nav><article>{body}</article></nav><script>{body}</script></body>") == ""
