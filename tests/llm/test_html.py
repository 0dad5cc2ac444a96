"""Composite text density on small trees, and on the test pages."""

from __future__ import annotations

import math
import os
import random
import re

import duckdb
import pytest

from spanloom.llm import html

PAGES = "/root/testdata/sf0.01/pages.parquet"


def brute(node, body_ratio):
    """(chars, tags, link chars, link tags, density) by recursion over the whole subtree of every node."""

    def walk(n, in_link):
        chars = tags = link_chars = link_tags = 0
        for k in n.kids:
            if isinstance(k, str):
                c = len("".join(k.split()))
                chars, link_chars = chars + c, link_chars + c * in_link
            else:
                a, b, c, d = walk(k, in_link or k.tag == "a")
                chars, tags, link_chars, link_tags = chars + a, tags + b + 1, link_chars + c, link_tags + d + (k.tag == "a")
        return chars, tags, link_chars, link_tags

    chars, tags, link_chars, link_tags = walk(node, node.tag == "a")
    link_tags += node.tag == "a"
    if not chars:
        return 0.0
    t, lc, lt = max(1, tags), max(1, link_chars), max(1, link_tags)
    base = max(math.e, math.log(chars / max(1, chars - link_chars) * link_chars + body_ratio * chars + math.e))
    return chars / t * math.log(max(1.0, chars / lc * t / lt) + 1e-9, base)


def random_page(rng, depth=0):
    tag = rng.choice(["div", "p", "section", "span", "a", "ul", "li"])
    inner = "".join(random_page(rng, depth + 1) if depth < 4 and rng.random() < 0.5 else "word " * rng.randint(0, 30) for _ in range(rng.randint(0, 4)))
    return f"<{tag}>{inner}</{tag}>"


def test_density_against_recursion():
    rng = random.Random(3)
    for _ in range(60):
        root = html.parse("<body>" + "".join(random_page(rng) for _ in range(3)) + "</body>")
        body = next(n for n in html._ordered(root) if n.tag == "body")
        nodes = html.measure(body)
        ratio = body.link_chars / max(1, body.chars)
        for n in nodes:
            assert n.density == pytest.approx(brute(n, ratio))
            blocks = [k for k in n.kids if not isinstance(k, str) and k.block]
            assert n.total == pytest.approx(sum(brute(k, ratio) for k in blocks))
        below = [n for n in nodes if n.block or n is body]
        assert body.top.total == pytest.approx(max(n.total for n in below))


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no test tables here")
def test_the_article_tag_decides_nothing():
    for (page,) in duckdb.sql(f"SELECT html FROM '{PAGES}' WHERE html IS NOT NULL").fetchall():
        whole = page[page.index("<article>") : page.index("</article>") + 10]
        assert html.extract(page) == html.extract(page.replace("<article>", "<div>").replace("</article>", "</div>")) == html.text_of(html.parse(whole))


def test_noise_by_name_and_forms():
    prose = "<p>" + "word " * 60 + "</p>"
    for name in ("comment-content", "comment-body", "post-comments", "sidebar-content", "commentEntry", "entry comment"):
        assert html.extract(f"<body><article>{prose}<div class='{name}'><p>{'bad ' * 80}</p></div></article></body>") == " ".join(["word"] * 60), name
    for name in ("content-sidebar-wrap", "has-sidebar", "no-sidebar", "entry-header"):
        assert html.extract(f"<body><div class='{name}'>{prose}</div></body>") == " ".join(["word"] * 60), name
    framed = f"<body><form id='f'><nav>menu</nav><div>{prose}</div><form><p>search here</p></form></form></body>"
    assert html.extract(framed) == " ".join(["word"] * 60)
    assert html.extract(f"<body><div>{prose}<form><p>{'mail ' * 20}</p></form></div></body>") == " ".join(["word"] * 60)
    assert html.extract(f"<body><article>{prose}<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article></body>").endswith("so x=1 holds")


def test_deep_pages_are_linear():
    assert html.extract("<body>" + "<div>" * 20_000 + "x " * 50 + "</div>" * 20_000 + "</body>") == " ".join(["x"] * 50)


def test_table(spark):
    rows = [(1, "u", "<body><p>a b</p></body>", "own"), (1, "u", "<body><p>a b</p></body>", "own"), (None, None, None, None), (2, "u", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.main_text(pages)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", "a b"), (1, "u", "a b"), (None, None, ""), (2, "u", "")], key=str)
    assert html.main_text(pages.limit(0)).count() == 0


def planted_page(rng):
    """A page and its article's words; all other words of the page start with x."""
    count = iter(range(10**6))

    def words(n, mark=""):
        return " ".join(f"{mark}w{next(count)}" for _ in range(n))

    def prose(mark="", least=15, most=60):
        return f"<p>{words(rng.randint(least, most), mark)}.</p>"

    def chrome():
        links = "".join(f"<li><a href='/{i}'>{words(rng.randint(1, 3), 'x')}</a></li>" for i in range(rng.randint(2, 6)))
        kind = rng.choice(["<nav>{}</nav>", "<div class='menu'>{}</div>", "<div id='related-posts'>{}</div>", "<div class='sidebar'><h3>{}</h3></div>", "<aside>{}</aside>"])
        return kind.format(f"<ul>{links}</ul>")

    def noise():
        form = f"<form><label>{words(2, 'x')}</label><input name=q><button>{words(1, 'x')}</button></form>"
        return rng.choice([f"<div class='cookie-notice'>{prose('x')}</div>", f"<div class='comments'><h2>{words(1, 'x')}</h2>{prose('x')}{prose('x')}</div>", f"<div class='ad'>{words(9, 'x')}</div>", form])

    title, lead = f"<h1>{words(5)}</h1>", f"<p class='lead'>{words(rng.randint(2, 12))}</p>"
    sections = "".join(f"<section><h2>{words(2)}</h2>{prose(most=4, least=1) if rng.random() < 0.3 else ''.join(prose() for _ in range(rng.randint(1, 4)))}</section>" for _ in range(rng.randint(2, 5)))
    inner = rng.choice([f"{title}{lead}<div class='body'>{sections}</div>", f"{title}{lead}{sections}", f"<header>{title}</header>{lead}{sections}"])
    inner += rng.choice(["", f"<div class='related-work'><h2>{words(2)}</h2>{prose()}</div>"])
    article = f"<article>{inner}</article>" if "<header>" in inner or rng.random() < 0.5 else f"<div id='main'>{inner}</div>"
    wrapper = rng.choice(["{}", "<div class='sidebar-left'>{}</div>", "<div id='menu-page'>{}</div>", "<form id='aspnet'>{}</form>", "<div class='header-fixed wrap'>{}</div>"])
    body = f"<header><a href='/'>{words(2, 'x')}</a></header>{chrome()}{noise()}{article}{noise()}{chrome()}<footer>{words(6, 'x')}</footer>"
    whole = f"<html><body class='has-sidebar'>{wrapper.format(body)}</body></html>"
    return whole, set(re.findall(r"\bw\d+", article))


def test_planted_articles_come_back_whole():
    rng = random.Random(11)
    lost = foreign = total = 0
    for _ in range(400):
        page, want = planted_page(rng)
        got = html.extract(page)
        own = set(re.findall(r"\bw\d+", got))
        lost, total = lost + len(want - own), total + len(want)
        foreign += len(set(re.findall(r"\bxw\d+", got))) + len(own - want)
    assert lost <= 0.01 * total and foreign <= 0.01 * total, (lost, foreign, total)


def test_wholes():
    prose = [f"<p>{x * 60}</p>" for x in ("word ", "text ", "more ")]
    text = ["word " * 59 + "word", "text " * 59 + "text", "more " * 59 + "more"]
    assert html.extract(f"<body><div id=main><h1>My title</h1><p class=lead>Lead.</p><div class=body>{''.join(prose)}</div></div></body>") == " ".join(["My title Lead.", *text])
    assert html.extract(f"<body><div><section>{prose[0]}</section><section><h2>B2</h2><p>tiny.</p></section><section>{prose[1]}</section></div></body>") == f"{text[0]} B2 tiny. {text[1]}"
    for wrapper in ("<div class='sidebar-left'>", "<div id='menu-page'>"):
        assert html.extract(f"<body>{wrapper}<article><h1>T</h1>{prose[0]}</article></div></body>") == "T " + text[0]
        assert html.extract(f"<body>{wrapper}{prose[0]}</div></body>") == text[0]
    assert html.extract(f"<body><article>{prose[0]}<div class='related-work'>{prose[1]}</div></article></body>") == f"{text[0]} {text[1]}"
    assert html.extract(f"<body><header><h1>Site</h1></header><article><header><h1>T</h1><a>by</a></header>{prose[0]}</article></body>") == "T " + text[0]
    # a comment, a notice and a form may be denser than the article
    for name in ("comments", "cookie-notice", "sidebar"):
        assert html.extract(f"<body><article><h1>T</h1><p>{'short ' * 20}</p></article><div class='{name}'>{''.join(prose)}</div></body>") == "T " + " ".join(["short"] * 20)
    # a form is a frame by what it holds
    assert html.extract(f"<body><form><nav>menu</nav><h1>T</h1>{prose[0]}<input></form></body>") == "T " + text[0]
    assert html.extract(f"<body><article><h1>T</h1>{prose[0]}<form>{prose[1]}{prose[2]}<input></form></article></body>") == "T " + text[0]
