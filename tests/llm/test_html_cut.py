"""Main text of pages: cuts against all labellings, pages of several layouts whose main text is known, odd pages."""

import html
import itertools
import random
import re

import pytest

from paytrail.llm import html_cut

SCHEMA = "page_id long, url string, html string, k string, u string, page string, text string"
WEIGHTS = list(html_cut.FEATURES.values())
P = ["The council met on Tuesday, and after four hours it agreed on a budget.", "Nobody expected the vote to be that close & nobody left early.", "Short.", "A last paragraph, with a <b>bold</b> word and a <a href='/x'>link</a>, ends it."]
TEXT = ["The council met on Tuesday, and after four hours it agreed on a budget.", "Nobody expected the vote to be that close & nobody left early.", "Short.", "A last paragraph, with a bold word and a link, ends it."]
MENU = "".join(f"<li><a href='/{i}'>{w}</a></li>" for i, w in enumerate(["Home", "World", "Sport", "About us"]))
COMMENT = "<p>I read this twice, and I can't say that I agree with any of it.</p>"

LAYOUTS = {
    "semantic": "<body><header><h1>Daily News</h1><p>The best news, every day, since 1901.</p></header><nav><ul>{menu}</ul></nav><main><article><header><h1>Budget agreed</h1></header>{ps}"
    "<div class='ad'>Buy shoes now, they are cheap and good.</div></article><section id='comments'><h2>Comments</h2><article class='comment'>{comment}</article></section></main>"
    "<aside><h3>Most read</h3><ul>{menu}</ul></aside><form><label>Mail</label><p>Sign up for our letter, it is free.</p></form><footer>&copy; 2024 Daily News. All rights reserved.</footer></body>",
    "classes": "<div id='header' class=\"masthead\"><span>Daily News</span></div><div class='top-menu'><ul>{menu}</ul></div><div class='layout-with-sidebar'><div id='content' class='post-body'>"
    "<h1>Budget agreed</h1>{ps}</div><div class='sidebar'><div class='content'><p>Our editors pick the stories that you should read today.</p></div></div></div>"
    "<div class='cookie-notice'>We use cookies, and by staying you accept them.</div><div class='comment-list'><div>{comment}</div></div><div id=footer>Imprint, privacy, contact.</div>",
    "form around all": "<body><form action='/p'><div role='navigation'>{menu}</div><div role='main'><h1>Budget agreed</h1>{ps}</div></form><script>var a = '<p>no</p>';</script></body>",
    "plain": "<table><tr><td><a href=1>Home</a><td><a href=2>World</a><td><a href=3>Sport</a></table><div><h1>Budget agreed</h1>{ps}</div><div><a href=4>Imprint</a> <a href=5>Contact</a></div>",
    "unclosed": "<!doctype html><title>No</title><style>p{{margin:0}}</style><nav><ul>{menu}</ul></nav><!-- <p>no --><article><h1>Budget agreed{open}</article><footer>Imprint",
    "hidden": "<div hidden><p>This was never shown to anyone, but it is long enough.</p></div><article><h1>Budget agreed</h1>{ps}<div style='display: none'>Nor was this, ever.</div></article>",
}


@pytest.mark.parametrize("name", list(LAYOUTS))
def test_layouts(name):
    page = LAYOUTS[name].format(menu=MENU, comment=COMMENT, ps="".join(f"<p>{p.replace('&', '&amp;')}</p>" for p in P), open="".join(f"<p>{p}" for p in P))
    assert html_cut.main_text(page, WEIGHTS).split("\n") == ["Budget agreed", *TEXT]


def test_cuts_against_all_labellings():
    rng = random.Random(3)
    for _ in range(600):
        n = rng.randint(0, 8)
        z = [rng.choice([rng.uniform(-3, 3), float(rng.randint(-3, 3))]) for _ in range(n)]
        edges = [(i, j, rng.choice([0.5, 1.0, rng.random() * 2])) for i, j in ((rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 12) if n else 0)) if i != j]
        cost = lambda s: sum(-q for q, up in zip(z, s, strict=True) if up) + sum(w for i, j, w in edges if s[i] != s[j])  # noqa: B023, E731
        best = min(map(cost, itertools.product((False, True), repeat=n)))
        for cut in (html_cut.min_cut, html_cut.by_flow):
            assert abs(cost(cut(z, edges)) - best) < 1e-6


def test_smoothing_fills_a_gap_and_drops_a_stray():
    rows = ["<p>" + "Words of the story, which goes on, and on. " * 3 + "</p>"] * 3
    blocks = html_cut.blocks_of(f"<div>{rows[0]}<p>***</p>{rows[1]}</div><ul><li><a>Home</a></li><li><a>A longer link, really.</a></li><li>x</li></ul>")
    odds = html_cut.odds(blocks, WEIGHTS)
    keep = html_cut.min_cut(odds, html_cut.edges_of(blocks))
    assert odds[1] < 0 and keep == [True, True, True, False, False, False]


def test_fitted_weights_tell_the_blocks_apart():
    pages = [LAYOUTS["semantic"].format(menu=MENU, comment=COMMENT, ps="".join(f"<p>{p}</p>" for p in P))] * 5
    weights = html_cut.fit_weights(html_cut.told(pages))
    assert weights != WEIGHTS and weights[2] < 0 < weights[1]
    assert html_cut.fit_weights([]) == WEIGHTS == html_cut.fit_weights([((1.0,) * 9, 1)])


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001/pages.parquet"
    pages = spark.read.parquet(folder)
    got = {r.page_id: r for r in html_cut.extract(pages, html_cut.fit(pages)).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        lines = re.sub(r"<[^>]*>?", "", re.sub(r"<br>", " ", re.sub(r"</?(p|h1)>", "\n", body))).split("\n")
        want = "\n".join(x for x in (" ".join(html.unescape(x).split()) for x in lines) if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_odd_pages(spark):
    long = "<article>" + "<p>One more paragraph, and it is kept.</p>" * 40_000 + "</article>"
    deep = "<div>" * 30_000 + "<article><p>Deep down, there is text.</p></article>"
    odd = [None, "", "   ", "<p", "<<<<>>>", "&amp;&lt;p&gt;", "</div></p>text only", "<article><p>a\x00b &#x1F600;</p>", "<a" * 50_000, '<p class="' * 2_000, "<!--" * 20_000, "<script>" * 20_000, long, deep]
    rows = [(i, f"u{i}" if i else None, p, "1", "2", "3", "4") for i, p in enumerate(odd)] + [(None, "n", "<article><p>No key, but text.</p></article>", "", "", "", "")] * 2
    frame = spark.createDataFrame(rows, SCHEMA)
    got = html_cut.extract(frame, html_cut.fit(frame))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = got.collect()
    by = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert [r.text for r in out if r.page_id is None] == ["No key, but text."] * 2
    assert by[0] == by[1] == by[2] == by[3] == by[10] == by[11] == "" and by[13] == "Deep down, there is text."
    assert by[7] == "a\x00b 😀" and by[12].count("\n") == 39_999
    empty = frame.where("page_id > 1000")
    assert html_cut.extract(empty, html_cut.fit(empty)).count() == 0
