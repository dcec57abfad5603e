"""What the review of round 1 found missing."""

import math

import numpy as np
import pytest

from watchgrid.llm import caps, common, html, mixing


def pairs(rng, n, dim, cosine):
    x, z = rng.normal(size=(2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return x, cosine * x + math.sqrt(1 - cosine**2) * z


@pytest.mark.parametrize("largest", [5_000, 100_000, 1_000_000])
def test_caps_meet_at_any_size(largest):
    rng = np.random.default_rng(3)
    block, per, rotations = caps.scheme(64, largest, 0.93)
    x, y = pairs(rng, 2000, 64, 0.93)
    filters = caps.Filters(64, block, rotations, per)
    lost = sum(not len(np.intersect1d(a, b)) for a, b in zip(filters.decode(x), filters.decode(y), strict=True))
    assert lost <= 2 * 2000 * caps.MISS + 2


def test_caps_links_of_a_large_code(spark, monkeypatch):
    monkeypatch.setattr(caps, "BLOCK", 400)
    rng, n = np.random.default_rng(4), 900
    both = [pairs(rng, n // 3, 64, c) for c in (0.9301, 0.94, 0.95)]
    x = np.concatenate([a for a, _ in both] + [b for _, b in both])
    df = common.written(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int"))
    got = caps.link(df).toPandas().set_index("vec_id")
    assert (got["n_links"] == 1).sum() >= 2 * n - 8 and got["n_links"].max() == 1


def left(page):
    return [t for _, t in html._candidates(html.blocks(page)[0])]


def extracted(spark, pages):
    df = common.written(spark.createDataFrame([(i, u, s) for i, (u, s) in enumerate(pages)], "page_id long, url string, html string"))
    return {r["page_id"]: r["text"] for r in html.extract(df).collect()}


def test_hints_around_the_page_do_not_empty_it():
    article = "<nav>Menu</nav><article><h1>T</h1><p>Long text of it</p></article><aside><article>Card</article></aside>"
    assert left(f'<div class="content with-sidebar">{article}</div>') == ["T", "Long text of it"]
    assert left('<div id="wrapper" class="header-fixed"><nav>Menu</nav><h1>T</h1><p>Long text of it</p></div>') == ["T", "Long text of it"]
    assert left("<aside><article>Card of another page</article></aside><div><p>Own longer text of this page</p></div>") == ["Own longer text of this page"]
    assert left("<nav>One menu</nav><footer>One foot</footer>") == ["One menu", "One foot"]


def test_low_nodes_keep_unique_texts(spark):
    pages = [(f"http://h.example/{i}", f"<article><h1>Title {i}</h1><p>Unique paragraph {i}</p><p>Same on all pages</p></article>") for i in range(30)]
    assert extracted(spark, pages) == {i: f"Title {i}\n\nUnique paragraph {i}" for i in range(30)}


@pytest.mark.parametrize("m", [2, 5])
def test_small_hosts_are_judged(spark, m):
    pages = [(f"http://h.example/{i}", f"<div class='x'><p>Own words {i}</p></div><div class='z'>Same end</div>") for i in range(m)]
    pages.append(("http://single.example/", "<div class='x'><p>Own words</p></div><div class='z'>Same end</div>"))
    assert extracted(spark, pages) == {i: f"Own words {i}" for i in range(m)} | {m: "Own words\n\nSame end"}


@pytest.mark.parametrize("tag", ["object", "select", "svg", "math", "template", "noscript"])
def test_unclosed_elements_lose_nothing(tag):
    assert left(f"<p>one</p><{tag}><p>two</p><p>three</p>") == ["one", "two", "three"]


def test_math_and_preformatted_text_stay():
    page = "<article><p>Let <math><mi>x</mi></math> be</p><xmp>a &lt; <b></xmp><p>q <svg><text>no</text></svg> r</p><object>shown</object><select><option>z</select></article>"
    assert left(page) == ["Let x be", "a &lt; <b>", "q r", "shown"]


def test_long_and_deep_elements_count_whole():
    styles = [html.blocks("<div>" + "<p>x</p>" * 70 + end + "</div>")[1][">div"] for end in ("<ul><li>y</ul>", "<pre>y</pre>")]
    assert styles[0] != styles[1]
    assert left("<main><p>text of some length</p><section>" + "<i>" * 300 + "<b hidden><p>hidden</p></b>" + "</i>" * 300 + "</section></main>") == ["text of some length"]


def test_mix_shuffles_whole_shards(spark):
    docs = common.written(spark.createDataFrame([(i, f"{i} " + "w " * (i % 7 + 3), "ab"[i % 2]) for i in range(600)], "doc_id long, text string, source string"))
    drawn = mixing.mix(docs).where("copy IS NOT NULL").toPandas()
    assert drawn["block"].nunique() > 8 and drawn["shard"].nunique() > 8
    for _, shard in drawn.groupby("shard"):
        assert sorted(shard["place"]) == list(range(1, len(shard) + 1))
    want = [r.doc_id for r in drawn.sort_values(["shard", "place"]).itertuples()]
    assert [r["doc_id"] for r in mixing.drawn_rows(docs).collect()] == want and want != sorted(want)
    places = {r["doc_id"]: r["places"] for r in mixing.digest(docs).collect()}
    assert places == {i: ",".join(map(str, drawn[drawn["doc_id"] == i].sort_values(["shard", "place"])["place"])) for i in range(600)}
