"""Extraction on hand-made pages, and the minimum cut against all labellings."""

import time
from itertools import product

import numpy as np
import pytest

from graphsieve.llm import html_cut as hc

SCHEMA = "page_id long, url string, html string, text string, n_chars int"
LONG = "This paragraph has quite a few words in it, as the paragraphs of an article tend to have."


def test_min_cut_against_all_labellings():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        lean = rng.normal(0, 2, n).round(2).tolist()
        ties = [(i, j, float(rng.random().__round__(2))) for i in range(n) for j in range(i) if rng.random() < 0.4]
        cost = lambda on: sum(v for v, x in zip(lean, on, strict=True) if v > 0 and not x) - sum(v for v, x in zip(lean, on, strict=True) if v < 0 and x) + sum(w for a, b, w in ties if on[a] != on[b])
        got = hc.min_cut(lean, ties)
        assert cost(got) <= min(map(cost, product([False, True], repeat=n))) + 1e-9


def test_pages():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><a href=/>Home</a> The Daily Site</header><nav><ul><li><a href="/a">News</a><li><a href="/b">Sport</a></ul></nav><!-- ad <p>no</p> -->
    <div class="ad">Buy these shoes now, they are the best shoes you will ever own in your whole life.</div>
    <article><h1>A  title &amp; more</h1><p><b>{LONG}<br><p>Second&nbsp;one with <a href="x">a link</a>, 3 &lt; 4
    and an <i>inline</i> word.</p><p>Short.</p></article>
    <aside><p>{LONG}</p></aside><div id="comments"><p>{LONG}</p></div><form><p>Sign up to get all of our news by mail every single day.</p></form>
    <footer>&copy; x &middot; {LONG}</footer>"""
    assert hc.main_text(page) == f"A title & more\n{LONG}\nSecond one with a link, 3 < 4 and an inline word.\nShort."


def test_no_article_tag():
    page = f"<body><div class='menu'><a href=1>One</a> <a href=2>Two</a></div><div><h2>Heading</h2><p>{LONG}</p><p>Tiny.</p><p>{LONG}</p></div><div class='cookie-notice'>We use cookies, as all sites do, to make your visit better for us.</div>"
    assert hc.main_text(page) == f"Heading\n{LONG}\nTiny.\n{LONG}"


def test_odd_input():
    assert hc.main_text("") == "" and hc.main_text("<") in ("", "<") and hc.main_text("<p><p></b></p>") == ""
    assert hc.main_text("<article><p>" + "word " * 50_000 + "end.") == "word " * 50_000 + "end."
    assert hc.main_text(f"<article><script>never closed <p>{LONG}") == ""
    deep = "<div>" * 300 + f"<article><p>{LONG}</p></article>"
    assert hc.main_text(deep) == LONG
    assert len(hc.main_text("<article>" + f"<p>{LONG}</p>" * 500).split("\n")) == 500


def test_names_of_wrappers_and_headings_do_not_hide_the_article():
    want = f"Title\n{LONG}"
    body = f"<article><div class='entry-header'><h1>Title</h1></div><p>{LONG}</p><div class='ad'><p>{LONG}</p></div></article>"
    assert hc.main_text(f"<body class='home has-sidebar'>{body}") == want
    assert hc.main_text(f"<html><body id=page role='banner menu'><div class='sidebar-layout navigation'>{body}</div><div class='sidebar'><p>{LONG}</p></div>") == want
    assert hc.main_text(f"<div class='with-sidebar'><p>{LONG}</p><p>{LONG}</p></div>") == f"{LONG}\n{LONG}"
    assert hc.main_text(f"<div class='page-comments'><p>{LONG}</p></div>{body}") == want
    assert hc.main_text(f"<article><h1>Title</h1><p>{LONG}</p><section class='comments'><article><p>{LONG}</p></article></section>").startswith("Title")


@pytest.mark.parametrize("page", [
    lambda n: "<div>" * n + f"<article><p>{LONG}</p></article>",
    lambda n: "".join(f"<div>text {i}" for i in range(n)) + f"<article><p>{LONG}",
    lambda n: "<b>" * n + f"<p>{LONG}" + "</i>" * n,
    lambda n: "<a title=\"x <a title='y " * n + f"<article><p>{LONG}</p></article>",
    lambda n: "<a title=\"" + "<a x=1 " * n + f"><article><p>{LONG}</p></article>",
    lambda n: f"<article><p>{LONG}</p></article>" + "<ul><li><p>" * n,
    lambda n: "<article>" + f"<p>{LONG}</p><p>Short.</p>" * n,
    lambda n: "".join(f"<p>{LONG}</p><div class=ad>{LONG}</div>" for i in range(n)),
])
def test_time_grows_with_the_page(page):
    took = []
    for n in (2000, 8000):
        began = time.process_time()
        hc.main_text(page(n))
        took.append(time.process_time() - began)
    assert took[1] < 8 * max(took[0], 0.05) and took[1] < 8


def test_classifier_is_fitted_and_kept_near_its_start():
    assert hc.fitted({}) == hc.WEIGHTS and hc.fitted({(1, 0, 1, 1, 0, 0, 1): (10, 0)}) == hc.WEIGHTS
    key = lambda **k: tuple(float({"bias": 1, **k}.get(x, 0)) for x in hc.WEIGHTS)
    got = hc.fitted({key(long=1, very_long=1, sentence=1): (900, 30), key(links=1, short=1): (5, 700), key(short=1, sentence=1): (300, 20), key(heading=1): (100, 2)})
    assert got["links"] < -2 and got["long"] > 1 and got["heading"] > hc.WEIGHTS["heading"] and got["sentence"] > hc.WEIGHTS["sentence"]


def test_frames(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>"), (2, None, None), (3, "u", ""), (None, "u", f"<article><p>{LONG}</p></article>")]
    pages = spark.createDataFrame([(*r, "clash", 7) for r in [*rows, rows[0]]], SCHEMA)
    got = sorted(((r.page_id or 0), r.url or "", r.text, r.n_chars) for r in hc.extract(pages).collect())
    assert got == [(0, "u", LONG, len(LONG)), (1, "u", LONG, len(LONG)), (1, "u", LONG, len(LONG)), (2, "", "", 0), (3, "u", "", 0)]
    assert hc.extract(pages.limit(0)).collect() == []


def test_wrappers_and_compound_names_keep_content():
    paragraphs = f"<p>{LONG}</p><p>Short one.</p><p>{LONG}</p>"
    want = f"{LONG}\nShort one.\n{LONG}"
    menu = "<nav><a href=/a>One</a> <a href=/b>Two</a></nav>"
    for page in (
        f"<body>{menu}<form id=aspnetForm method=post><input type=hidden><article>{paragraphs}</article><input type=submit></form>",
        f"<body>{menu}<form id=aspnetForm><div id=content>{paragraphs}</div></form>",
        f"<body>{menu}<div class='sidebar-left layout'>{paragraphs}</div>",
        f"<body>{menu}<div class='legal-news'>{paragraphs}</div>",
        f"<body>{menu}<div class='searchPage'><div>{paragraphs}</div></div>",
        f"<body>{menu}<div class=sidebar-left>{paragraphs}</div>",
    ):
        assert hc.main_text(page) == want
    inside = f"<article><p class='ad-hoc'>{LONG}</p><div class='share-price'>{LONG}</div><p class='side-effects'>{LONG}</p><section id='related-work'><h2>Related work</h2><p>{LONG}</p></section></article>"
    assert hc.main_text(inside) == "\n".join([LONG] * 3 + ["Related work", LONG])
    assert hc.main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> be the number of all the things that we count here.</p></article>") == "Let x=2 be the number of all the things that we count here."


def test_boilerplate_still_goes():
    side = f"<div class='sidebarBox'><p>{LONG}</p></div>"
    for outside in (f"<form class=signup><label>Your mail address, so that we can send you all of our news each day</label></form>", f"<div class='site-footer'>{LONG}</div>", f"<div class='comment-list'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>", "<div class='cookieNotice'>We use cookies, as all of the sites do, to make your visit better for us.</div>", side):
        assert hc.main_text(f"<body><article><h1>Title</h1><p>{LONG}</p></article>{outside}") == f"Title\n{LONG}"
        assert LONG + "\n" + LONG == hc.main_text(f"<body><div id=content><p>{LONG}</p><p>{LONG}</p></div>{outside}"), outside


def made_pages(n):
    """Pages of many forms, a third of them without article or main, and their texts."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvwz"), int(rng.integers(2, 9))))
    sentence = lambda k: " ".join(word() for _ in range(k)).capitalize() + "."
    menu = lambda: "<ul>" + "".join(f"<li><a href='/{word()}'>{word()}</a>" for _ in range(int(rng.integers(3, 9)))) + "</ul>"
    outer = [("<article>", "</article>"), ("<main>", "</main>"), ("<form id=f><article>", "</article></form>"), ("<form><div id=main-column>", "</div></form>"), ("<div class='post'>", "</div>"), ("<div class='sidebar-right layout'><div class='entry'>", "</div></div>"), ("<div role=main>", "</div>")]
    notices = ["<div class='ad'>{}</div>", "<aside>{}</aside>", "<div class='cookie-notice'>{}</div>", "<div id=comments><p>{}</p></div>", "<div class='related-posts'>{}</div>", "<footer>{}</footer>", "<!-- {} -->", "<script>var x='{}';</script>"]
    for k in range(n):
        heading, parts, lines = sentence(5), [], []
        lines.append(heading[:-1])
        parts.append(f"<h1>{heading[:-1]}</h1>")
        for _ in range(int(rng.integers(4, 12))):
            text = sentence(int(rng.integers(14, 60)))
            shape = int(rng.integers(0, 5))
            lines.append(text)
            parts.append([f"<p>{text}</p>", f"<p>{text}", f"<p>  {text.replace(' ', '  ', 1)}\n</p>", f"<p>{text.replace(' ', ' <b>', 1).replace('.', '</b>.')}</p>", f"<div>{text}</div>"][shape])
        open_, close = outer[k % len(outer)]
        some = [str(rng.choice(notices)).format(sentence(int(rng.integers(6, 14)))) for _ in range(int(rng.integers(1, 5)))]
        yield f"<html><head><title>{word()}</title></head><body><nav>{menu()}</nav>{''.join(some[:1])}{open_}{''.join(parts)}{close}{''.join(some[1:])}</body></html>", "\n".join(lines)


def test_registered_query_on_made_pages(spark, tmp_path):
    from graphsieve.llm import queries

    pages = [*made_pages(140)]
    spark.createDataFrame([(i, f"u{i}", p) for i, (p, _) in enumerate(pages)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in queries.op7_html_cut(spark, str(tmp_path)).collect()}
    wrong = [(pages[i][0], r.text, pages[i][1]) for i, r in got.items() if r.text != pages[i][1]]
    assert len(got) == 140 and not wrong, (len(wrong), wrong[0])
    assert all(r.n_chars == len(r.text) and r.url == f"u{i}" for i, r in got.items())
