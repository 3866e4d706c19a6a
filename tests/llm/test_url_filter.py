"""Rules by a plain reading of them; the method on labelled URLs."""

import pytest

from edgeloom.llm.url_filter import RULES, judge_urls


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]


def plain_rule(host, path):
    fits = [r.text for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=len, default=None)


URLS = [
    "http://a.example.org/es/1", "https://EXAMPLE.ORG/en/12?x#y", "http://example.org/en/2", "http://b.com/fr/9", "http://b.com/de/9", "http://b.com/en/9",
    "http://x.net/es/1", "ftp://org", "http://org/", "http://notexample.org/es/", "no scheme", "", None, "://", "http://ÄB.com/fr/", "http://c.com?/fr/",
    "x\ny://q.org/\nes/?", "http://u.org/a://b.com/de/", "http://h.com/fr/" + "é" * 50_000,
]


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS + URLS)], "page_id long, url string, host string, `a.b` string").selectExpr("*", "1 AS grams", "2 AS says", "3 AS `row`")
    rows = judge_urls(pages).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        host, path = plain(r.url)
        assert (r.host, r.path, r.rule) == (host, path, plain_rule(host, path))
        verdicts = {x.text: x.verdict for x in RULES}
        assert r.verdict == verdicts[r.rule] if r.rule else r.verdict in ("allow", "block")
    assert len({(r.url, r.verdict) for r in rows}) == len({u for u in URLS})


def test_method_learns(spark):
    good = [f"http://news{i}.net/story/{i}" for i in range(60)]
    bad = [f"http://casino{i}.net/win/{i}" for i in range(60)]
    labelled = spark.createDataFrame([(*plain(u), 1.0) for u in good[:40]] + [(*plain(u), 0.0) for u in bad[:40]], "host string, path string, label double")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(good[40:] + bad[40:])], "page_id long, url string")
    said = {r.url: r.verdict for r in judge_urls(pages, labelled=labelled).collect()}
    assert all(said[u] == "allow" for u in good[40:]) and all(said[u] == "block" for u in bad[40:])


@pytest.mark.parametrize(("urls", "verdict"), [(["http://x.net/1"], "allow"), (["http://b.com/de/1", "http://x.net/1"], "block")])
def test_few_labels(spark, urls, verdict):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    assert {r.verdict for r in judge_urls(pages).collect()} == {verdict}


def test_empty(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []
