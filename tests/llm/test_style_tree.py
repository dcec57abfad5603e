"""The site style tree against plain counting over whole hosts."""

import re
from collections import Counter, defaultdict
from math import log

import pandas as pd
import pytest

from watchgrid.llm import common, html

SF = "/root/testdata/sf0.01"


def entropy(items, m):
    """Of items over m pages, to the base m."""
    return 0.0 if m < 2 else -sum(c / m * log(c / m) for c in Counter(items).values()) / log(m)


@pytest.fixture(scope="module")
def pages():
    p = pd.read_parquet(f"{SF}/pages.parquet")
    p["host"] = p["url"].str.extract(r"//([^/?#:]*)")[0].str.lower()
    return p


def clean(markup):
    import html as std

    return " ".join(std.unescape(re.sub(r"<br>", " ", re.sub(r"</?[ab]\b[^>]*>", "", markup))).split())


PARTS = {"nav": r"<nav>(.*?)</nav>", "ad": r'<div class="ad">(.*?)</div>', "footer": r"<footer>(.*?)</footer>"}
NODES = {"nav": ">html>body>nav!", "ad": ">html>body>div.ad!", "footer": ">html>body>footer!"}


def test_importance_of_branches(spark, pages):
    df = common.written(spark.createDataFrame(pages[["host", "html"]]))
    got = {(r["host"], r["node"]): r for r in html.style_tree(df).where("branch").collect()}
    for host, own in pages.groupby("host"):
        distinct = own["html"].drop_duplicates()
        m = len(distinct)
        for part, pattern in PARTS.items():
            inner = [re.search(pattern, x, re.S)[1] for x in distinct]
            texts = [tuple(clean(x) for x in re.split(r"</?(?:ul|li)>", i) if clean(x)) for i in inner]
            shapes = [i.count("<li>") for i in inner]
            content = 1 - sum(c * log(c) for c in Counter(texts).values()) / m / log(max(m, 2))
            r = got[host, html._branch(NODES[part])]
            assert r["pages"] == m and r["presentation"] == pytest.approx(entropy(shapes, m)) and r["content"] == pytest.approx(content)
            assert r["importance"] == pytest.approx((r["presentation"] + r["content"]) / 2)


def test_main_text_of_pages(spark, pages):
    got = html.op10(spark, SF).toPandas().set_index("page_id")
    hosts, removed = pages.drop_duplicates(["host", "html"]).groupby("host").size(), 0
    for _, p in pages.iterrows():
        article = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        want = "\n\n".join(t for x in re.split(r"</?(?:h1|p)>", article) if (t := clean(x)))
        r = got.loc[p["page_id"]]
        assert r["text"] == want and r["n_chars"] == len(want)
        about = [t for pattern in PARTS.values() for x in re.split(r"</?(?:ul|li)>", re.search(pattern, p["html"], re.S)[1]) if (t := clean(x))]
        assert (r["n_tree"], r["n_other"]) == ((len(about), 0) if hosts[p["host"]] > 1 else (0, len(about)))
        removed += r["n_tree"]
    assert removed > 500


def site(n, words=30):
    """Pages whose side column is as varied as an article on the first host, and always alike in shape on the second."""
    own = lambda i, k: " ".join(f"w{i * 7919 + k * 104729 + j}" for j in range(words))
    shape = lambda i, k: "".join(f"<{t}>{own(i, 10 * k + j)}</{t}>" for j, t in enumerate(("h2", "p", "pre", "p", "h3", "blockquote", "p")) if (i + 1) >> j & 1)
    varied = [(f"http://varied.example/{i}", f"<div class='main'><p>{own(i, 900)} {own(i, 901)}</p>{shape(i, 1)}{shape(i, 2)}</div><div class='sidebar'>{shape(i, 3)}</div>") for i in range(n)]
    return varied + [(f"http://fixed.example/{i}", f"<div class='main'><p>{own(i, 900)} {own(i, 901)}</p></div><div class='sidebar'><p>{own(i, 3)}</p></div>") for i in range(n)]


def texts(spark, pages):
    df = common.written(spark.createDataFrame([(i, u, s) for i, (u, s) in enumerate(pages)], "page_id long, url string, html string"))
    return {r["page_id"]: r["text"] for r in html.extract(df).collect()}


def test_a_hint_yields_to_an_important_branch(spark):
    n = 60
    pages = site(n)
    got = texts(spark, pages)
    blocks = lambda source: [clean(x) for x in re.split(r"</?(?:div|h2|h3|p|pre|blockquote)\b[^>]*>", source) if clean(x)]
    for i, (_, source) in enumerate(pages):
        main = source if i < n else source.split("<div class='sidebar'>")[0]
        assert got[i] == "\n\n".join(blocks(main))
    alone = texts(spark, pages[7:8])
    assert alone[0] == "\n\n".join(blocks(pages[7][1].split("<div class='sidebar'>")[0]))  # a single page says nothing against the hint


def test_comments_go_however_varied(spark):
    pages = [(u, s.replace("class='sidebar'", "class='comments'")) for u, s in site(60)]
    got = texts(spark, pages)
    assert all("w" + str(i * 7919 + 30 * 104729) not in got[i].split() for i in range(60))


def test_verdicts_without_broadcast(spark, monkeypatch):
    pages = [(f"http://h.example/{i}", f"<div class='x{i % 3}'>Subscribe to our letter</div><p>unique words number {i} here</p><div class='z'>Same end</div>") for i in range(40)]
    want = texts(spark, pages)
    monkeypatch.setattr(html, "BROADCAST_NODES", -1)
    monkeypatch.setattr(html, "GROUP_PAGES", 7)
    assert texts(spark, pages) == want and want[3] == "unique words number 3 here"


def test_references_end_at_tags():
    assert [t for _, t in html._candidates(html.blocks("<p>a &<b>amp;</b> b &amp; c &lt;i&gt;</p>")[0])] == ["a &amp; b & c <i>"]


def test_a_node_has_the_styles_of_all_its_elements():
    one, two = (html.blocks(f"<div><ul><li>x</ul></div><div>{x}</div>")[1] for x in ("<p>y</p>", "<pre>y</pre>"))
    assert one[">div"] != two[">div"]


def test_parts_of_real_pages(pages):
    kinds = defaultdict(int)
    for source in pages["html"]:
        for node, _, _ in html.parsed(source)[2]:
            kinds[node] += 1
    assert set(kinds) == set(NODES.values())


def test_deeply_nested_hints_are_quick():
    import time

    page = "<div class='nav'>" * 3000 + "".join(f"<p>word {i}</p>" for i in range(3000))
    began = time.time()
    text, tree, _ = html._main_text(page, (frozenset(), frozenset([html._branch(">x!")]), frozenset()))
    assert text.count("word") == 3000 and tree == 0 and time.time() - began < 10
