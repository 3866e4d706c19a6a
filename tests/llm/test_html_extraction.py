"""The cut against all labellings; blocks by hand; pages of several shapes whose main text is known."""

import itertools
import random

import pytest

from edgeloom.llm.html_extraction import PRIOR, blocks_of, extract_main_text, fit_weights, main_text
from edgeloom.llm.min_cut import min_cut


def test_cut_is_the_cheapest_with_fewest_nodes():
    rng = random.Random(1)
    for _ in range(800):
        n = rng.randint(1, 8)
        balance = [rng.randint(-6, 6) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 5)) for _ in range(rng.randint(0, 14))]

        def cost(kept, balance=balance, edges=edges):
            return sum(max(0, -b) if k else max(0, b) for b, k in zip(balance, kept, strict=True)) + sum(c for a, b, c in edges if kept[a] != kept[b])

        every = list(itertools.product((False, True), repeat=n))
        least = min(map(cost, every))
        best = [k for k in every if cost(k) == least]
        assert min_cut(balance, edges) == [all(k[i] for k in best) for i in range(n)]


def test_a_long_chain_is_cut():
    rng = random.Random(2)
    n = 20_000
    kept = min_cut([rng.randint(-3000, 3000) for _ in range(n)], [(i, i + 1, rng.randint(1, 3000)) for i in range(n - 1)])
    assert 0 < sum(kept) < n


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        (None, []),
        ("", []),
        (" \n\t ", []),
        ("a &amp; b &ampc &am &#65;&#x42; &nbsp; <b>x</b>y<br>z", ["a & b &c &am AB xy z"]),
        ("<p>one<p>two<div>three</div>four</p>five", ["one", "two", "three", "four", "five"]),
        ("<script>var t='</p>'; if (a<b) {}</script>x<style>p{}</style><!-- no <p> -->y<textarea><p>z</textarea>", ["xy"]),
        ("<a title='x>y' href=\"<p>\">q</a> 1 < 2 <3 a<b c", ["q 1 < 2 <3 a"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<p>a</b></div>b</p", ["a", "b"]),
        ("x<script>never ends <p>y", ["x"]),
        ("x<!-- never ends <p>y", ["x"]),
        ("<P CLASS=x>İß 𝒜</P\n>", ["İß 𝒜"]),
    ],
)
def test_blocks(page, texts):
    assert [b.text for b in blocks_of(page)] == texts


BODY = ["A short note on tides.", "The sea rises and falls twice a day, and those who live by it plan around that.", "Be. So.", "Old tables, kept by hand, were wrong by minutes; ours are not."]


def paragraphs(inside=""):
    h, *ps = BODY
    return f"<h1>{h}</h1><p><b>{ps[0]}</b><br><p>{ps[1]}</p>{inside}<p>{ps[2]}"


MENU = "<ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li><li><a href=/c>Contact</a></li></ul>"
SHAPES = [
    f"<html><head><title>T</title></head><body><nav>{MENU}</nav><div class=ad>Buy now, for less.</div><article>{paragraphs()}</article><footer>&copy; sea.org</footer></body></html>",
    f"<body class='has-sidebar'><header><h2>Sea news</h2>{MENU}</header><main id=content>{paragraphs()}</main><aside><p>Read more, it is good.</p></aside>",
    f"<body><div role=navigation>{MENU}</div><article>{paragraphs('<aside>Pull quote here.</aside>')}</article><section id='comments'><article><p>Great post, thanks a lot!</p></article></section>",
    f"<article><div class='cookie-notice'><p>We use cookies, as all do.</p></div>{paragraphs('<form><label>Mail</label><input></form>')}<section class='comment-list'><p>I do not agree, not at all.</p></section></article>",
    f"<div class='topbar'>{MENU}</div><div role='main'>{paragraphs('<div class=advertisement><p>Cheap boats, while they last.</p></div>')}</div><div class=site-footer><p>All rights reserved, by us.</p></div>",
]


@pytest.fixture(scope="module")
def weights(spark):
    return fit_weights(spark.createDataFrame([(p,) for p in SHAPES[:2] * 3], "html string"))


@pytest.mark.parametrize("learnt", [True, False])
@pytest.mark.parametrize("page", SHAPES)
def test_shapes(weights, page, learnt):
    assert main_text(page, weights if learnt else PRIOR) == "\n\n".join(BODY)


def test_bare_markup_is_judged_by_its_text(weights):
    long = "<br><br>".join(BODY[1::2] * 3)
    text = main_text(f"<div><div><a href=/a>Home</a> <a href=/b>About</a></div><div>{long}</div><div>© 2020</div></div>", weights)
    assert text == " ".join(BODY[1::2] * 3)


def test_table(spark):
    pages = [(1, SHAPES[0]), (1, SHAPES[0]), (2, None), (3, ""), (None, SHAPES[1]), (4, "<article>" + "<p>One of very many, all alike.</p>" * 20_000 + "</article>"), (5, "<nav>Menu</nav>")]
    df = spark.createDataFrame([(i, f"u{i}", p) for i, p in pages], "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars", "3 AS `row`", "4 AS label", "5 AS `a.b`")
    found = extract_main_text(df)
    assert found.columns == ["page_id", "url", "row", "label", "a.b", "text", "n_chars"]
    rows = found.collect()
    whole = "\n\n".join(BODY)
    assert sorted((r.page_id or 0, r.n_chars) for r in rows) == sorted([(1, len(whole)), (1, len(whole)), (2, 0), (3, 0), (0, len(whole)), (4, 20_000 * 30 - 2), (5, 0)])
    assert all(r.n_chars == len(r.text) and r["a.b"] == 5 for r in rows)
    assert extract_main_text(df.limit(0)).collect() == []
    one = extract_main_text(spark.createDataFrame([("<p>plain words, no more.</p>",)], "html string"))
    assert one.columns == ["text", "n_chars"] and one.count() == 1
