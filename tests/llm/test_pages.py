"""URL rules, host reputation and main text."""

import random

import numpy as np
import pytest

from temblor.llm import html_text, queries, url_filters
from temblor.llm.queries import URL_RULES

PAGES = "page_id bigint, url string, html string"


def judged(spark, urls, good=None):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGES)
    outcomes = spark.createDataFrame([(u, g) for u, g in good or []], "url string, good int")
    return {r["page_id"]: r for r in url_filters.judge_urls(pages, outcomes, URL_RULES).collect()}


def test_rules_and_parts(spark):
    urls = [None, "no scheme", "http://A.Example.COM/en/x?q#f", "http://www.example.com/en/", "http://x.www.EXAMPLE.com/en/y",
            "http://com/en", "http://com", "http://notexample.com/en/", "x://h.net/es/1", "x://net/fr/", "x://net/fr", "a://b://c/d",
            "http://É.net/es/?", "http://h.org/p?://x", "http://h.org?x/en/", "://e.net:80/es/"]
    r = judged(spark, urls)
    assert [(r[i]["host"], r[i]["path"], r[i]["rule"]) for i in range(len(urls))] == [
        ("", "", None), ("", "", None), ("a.example.com", "/en/x", "example.com/en/"), ("www.example.com", "/en/", "www.example.com/en/"),
        ("x.www.example.com", "/en/y", "www.example.com/en/"), ("com", "/en", "com/"), ("com", "", None), ("notexample.com", "/en/", "com/"),
        ("h.net", "/es/1", "net/es/"), ("net", "/fr/", "net/fr/"), ("net", "/fr", None), ("b:", "//c/d", None),
        ("É.net", "/es/", "net/es/"), ("h.org", "/p", None), ("h.org", "", None), ("e.net:80", "/es/", None)]
    assert r[3]["verdict"] == "allow" and r[2]["verdict"] == "block" and r[0]["verdict"] == "allow"


def test_reputation_shrinks_and_blocks(spark):
    good = [("x://bad.spam.org/1", 0)] * 60 + [("x://few.fine.org/1", 0)] * 2 + [("x://more.fine.org/", 1)] * 80 + [("x://a.ok.org/", 1)] * 50
    good += [("x://a.ok.org/", None), (None, 1)]
    r = judged(spark, ["x://bad.spam.org/", "x://few.fine.org/", "x://a.ok.org/q", "x://unseen.org/"], good)
    assert [r[i]["verdict"] for i in range(4)] == ["block", "allow", "allow", "allow"]
    outcomes = spark.createDataFrame(good, "url string, good int")
    posterior = {h["host"]: h for h in url_filters.host_reputation(outcomes).collect()}
    share = lambda h: posterior[h]["a"] / (posterior[h]["a"] + posterior[h]["b"])
    assert 0 < share("bad.spam.org") < 0.3 and 0.3 < share("few.fine.org") < share("more.fine.org")
    assert posterior["a.ok.org"]["n"] == 50


def test_no_pages_and_no_outcomes(spark):
    assert judged(spark, []) == {}
    assert judged(spark, ["x://a.b/c"])[0]["verdict"] == "allow"


def test_unlabelled_hosts_have_a_posterior(spark):
    good = [(f"x://h{k}.spam.org/{i}", 0) for k in range(8) for i in range(40)] + [(f"x://h{k}.fine.org/{i}", 1) for k in range(8) for i in range(40)]
    good += [("x://null.fine.net/", None)]
    urls = ["x://new.spam.org/", "x://new.fine.org/", "x://new.other.org/", "x://a.b/", None]
    r = judged(spark, urls, good)
    assert [r[i]["verdict"] for i in range(5)] == ["block", "allow", "allow", "allow", "allow"]
    assert r[0]["good_upper"] < 0.2 and all(r[i]["good_upper"] > 0.7 for i in (1, 2, 3)) and r[4]["good_upper"] is None
    # Labelled hosts are judged as without the others.
    outcomes = spark.createDataFrame(good, "url string, good int").filter("good is not null")
    alone = {h["host"]: (h["a"], h["b"]) for h in url_filters.host_reputation(outcomes).collect()}
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    both = {h["host"]: (h["a"], h["b"]) for h in url_filters.host_reputation(outcomes, pages=pages).collect()}
    assert len(both) == len(alone) + 4 and all(both[h] == pytest.approx(ab, rel=1e-9) for h, ab in alone.items())


def test_null_labels_are_no_outcomes(spark, tmp_path):
    pages = [(i, f"x://{h}.org/{i}", None) for i, h in enumerate(["nulls"] * 40 + ["half"] * 40 + ["bad"] * 40)]
    labels = [(i, None, 0) for i in range(20)] + [(i, 1, None) for i in range(20, 60)] + [(i, 1, 0) for i in range(60, 80)]
    labels += [(i, 0, None) for i in range(80, 100)] + [(i, None, 1) for i in range(100, 120)]
    spark.createDataFrame(pages, PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    r = {r["host"]: r for r in queries.op1(spark, str(tmp_path)).collect()}
    assert {h: x["verdict"] for h, x in r.items()} == {"nulls.org": "allow", "half.org": "allow", "bad.org": "block"}
    # Judged like a host without any label, by the prior of its domain.
    assert r["nulls.org"]["good_upper"] > 0.7


def page(*parts):
    return "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>" + "".join(parts)


CASES = [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"),
    (page("<nav><a>Menu</a></nav><article><h1>Head</h1><p>One<br>two\n three<p>Four&nbsp;&lt;b&gt; <b>f</b>ive</article><footer>F</footer>"),
     "Head One two three Four <b> five"),
    (page("<header>Site</header><main><header><h1>H</h1><p>by me</p></header><div class='share-box'>S</div><p>Text</p></main><div>out</div>"), "H Text"),
    (page("<article><p>A<script>var x='</p>';</script>B</p><!-- c --><aside>x</aside><form>y</form><div class='ad'>z</div>"
          "<div id='cookie-notice'>q</div><ul><li>l1<li>l2</ul><section class='comments'><p>c</p></section></article>"), "AB l1 l2"),
    (page("<article><p>unclosed <b>bold<br><p>next"), "unclosed bold next"),
    (page("<article>a<template><p>no</p></template><span>b</span><div hidden>no</div><div style='display: none'>no</div></article>"), "ab"),
    (page("<article>", "x " * 60_000, "</article>"), ("x " * 60_000).strip()),
    ("<article><p>a < b & c &copy &#233;&#x41;</p><table><tr><td>1<td>2</table></article><", "a < b & c © éA 1 2"),
]


def test_text_of_marked_articles(spark):
    pages = spark.createDataFrame([(i, f"x://h/{i}", h) for i, (h, _) in enumerate(CASES)], PAGES).repartition(2)
    found = {r["page_id"]: r for r in html_text.extract_text(pages).collect()}
    for i, (_, text) in enumerate(CASES):
        assert found[i]["text"] == text
        assert found[i]["n_chars"] == len(text)


def test_unmarked_pages_lose_what_their_neighbour_shares(spark):
    def plain(*lines):
        return "<body>" + "".join(f"<p>{t}</p>" for t in lines)

    top, end = ("Welcome", "Home"), ("Imprint",)
    rows = [(1, "x://h/a/1", plain(*top, "one", *end)), (2, "x://h/a/2", plain(*top, "two", "more", *end)),
            (3, "x://h/a/2", plain(*top, "two", "more", *end)), (4, "x://h/b/1", plain(*top, "three")),
            (5, "x://other/a/1", plain(*top, "one")), (6, None, plain("alone")), (None, "x://h/a/3", "<p>Welcome<article>Welcome</article>")]
    found = sorted((r["page_id"] or 0, r["text"]) for r in html_text.extract_text(spark.createDataFrame(rows, PAGES).repartition(3)).collect())
    assert found == [(0, "Welcome"), (1, "one"), (2, "two more"), (3, "two more"), (4, "three"), (5, "Welcome Home one"), (6, "alone")]
    assert html_text.extract_text(spark.createDataFrame([], PAGES)).collect() == []


def test_articles_lose_what_most_of_their_host_shares(spark):
    def article(*lines):
        return page("<article>", *[f"<div class='x{i}'>{t}</div>" for i, t in enumerate(lines)], "</article>")

    quote = "a passage that two articles quote"
    bodies = [[f"the own first text of article {i}", f"the own second text of article {i}"] for i in range(10)]
    bodies[3].insert(1, quote)
    bodies[4].insert(1, quote)
    rows = [(i, f"x://h/a/{i}", article("Buy one now", *b, "Read on")) for i, b in enumerate(bodies)]
    rows.append((10, "x://h/a/0", rows[0][2]))
    # Too few pages to tell a template, and a host of near copies.
    rows += [(20 + i, f"x://few/a/{i}", article("Buy one now", f"text {i}")) for i in range(3)]
    rows += [(30 + i, f"x://same/a/{i}", article("a long text that all pages of this host have alike", f"end {i}")) for i in range(9)]
    found = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, PAGES).repartition(4)).collect()}
    assert [found[i] for i in range(11)] == [" ".join(b) for b in bodies + bodies[:1]]
    assert found[20] == "Buy one now text 0"
    assert found[30] == "a long text that all pages of this host have alike end 0"


@pytest.mark.parametrize("seed", range(30))
def test_shared_lines_are_a_longest_common_subsequence(seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(4) for _ in range(rng.randrange(20))] for _ in range(2))
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
    found = html_text.shared_lines(a, b)
    assert len(found) == best[-1, -1] and found == sorted(set(found))
    rest = iter(b)
    assert all(any(y == a[i] for y in rest) for i in found)
