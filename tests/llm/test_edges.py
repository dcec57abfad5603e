"""Nulls, empty and very long texts, repeated rows, empty tables and clashing names, for every operator."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchgrid.llm import ann, caps, common, html, jaccard, lm, mixing, pieces, pii, quality, vectors, warc

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(40_000))
DOCS = [
    (1, "a short text about nothing in particular, written down here.", "en", "s1", 10), (2, None, "en", "s1", None), (3, "", None, None, 0), (4, " \t\n ", "en", "s2", 4), (5, LONG, "en", "s2", len(LONG)),
    (6, "x", "en", "s1", 1), (7, "a short text about nothing in particular, written down here.", "en", "s1", 10), (7, "a short text about nothing in particular, written down here.", "en", "s1", 10),
    (8, "mail me: ann.lee@example.com or +1 (743) 555-3824, 10.0.0.1", "de", None, 9), (9, "\U0001f600 ünïcödé ▁ text", "fr", "s3", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = [f"'z' AS `{c}`" for c in ("key", "node", "size", "copy", "block", "train", "held", "n", "label", "t", "ids", "score", "w_", "component")]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with extra columns whose names the operators use inside."""
    return common.written(spark.createDataFrame(DOCS, SCHEMA).selectExpr("*", *CLASH))


@pytest.fixture(scope="module")
def none(spark):
    return common.written(spark.createDataFrame([], SCHEMA).selectExpr("*", *CLASH))


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_common(spark, docs, none):
    assert common.words("A b\tÄ\x0bC") == [b"a", b"b", "Ä".encode(), b"c"]
    x = np.arange(1000, dtype=np.uint64)
    assert len(np.unique(common.mix(x))) == 1000
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 3), (9, 3), (10, 11), (11, 12), (12, 13), (13, 14)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_path(spark):
    n = 200
    order = np.random.default_rng(1).permutation(n).tolist()
    e = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "a long, b long")
    assert {r["component"] for r in common.components(e).collect()} == {0}


def test_lm(docs, none):
    got = lm.score(docs).collect()
    assert len(got) == len(DOCS) and all(r["score"] <= 0 and r["base_score"] <= 0 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n_tokens"] == by[3]["n_tokens"] == by[4]["n_tokens"] == 1 and by[5]["n_tokens"] == 80_001
    assert lm.score(none).count() == 0


def test_mixing(docs, none):
    got = mixing.digest(docs).collect()
    assert len(got) == len(DOCS)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] or not r["taken"])
    sizes = {(r["source"], r["source_size"]) for r in got}
    assert len(sizes) == 4 and sum(s for _, s in sizes) == sum(r["size"] for r in got)
    assert mixing.digest(none).count() == 0
    assert mixing.drawn_rows(docs).columns == docs.columns
    assert mixing.drawn_rows(docs).count() == sum(r["n_draws"] for r in got)
    again = mixing.digest(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_pii(docs, none):
    got = rows(pii.find(docs))
    assert (got[8]["n_email"], got[8]["n_phone"], got[8]["n_ip"], got[8]["n_card"]) == (1, 1, 1, 0)
    assert got[2]["spans"] == "" and got[2]["redacted"] is None and got[3]["redacted"] == ""
    assert got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert "@" not in got[8]["redacted"] and pii.find(docs).count() == len(DOCS) and pii.find(none).count() == 0


def test_jaccard(docs, none):
    got = jaccard.join(docs).collect()
    assert len(got) == len(DOCS)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["component_id"] == by[7]["component_id"] == 1 and by[1]["n_shingles"] == 6
    assert all(by[i]["n_shingles"] == 0 and by[i]["component_id"] == i for i in (2, 3, 4)) and by[6]["n_shingles"] == 1
    assert jaccard.join(none).count() == 0


def test_pieces(docs, none):
    got = rows(pieces.tokenize(docs))
    assert got[2]["n_ids"] == got[3]["n_ids"] == 0 and got[5]["restored"] and got[4]["restored"] and not got[9]["restored"]
    assert pieces.tokenize(docs).count() == len(DOCS) and pieces.tokenize(none).count() == 0


def test_quality(docs, none):
    assert quality.classify(docs).count() == len(DOCS) and quality.classify(none).count() == 0
    assert quality.keep(docs).columns == docs.columns
    assert set(rows(quality.keep(docs))) >= {1, 7}  # the long text is full of digits


PAGES = [(1, "http://a.example/x", "<p>" + "same words " * 20 + "</p>"), (2, "http://a.example/y", "<p>" + "same words " * 20 + "</p>"), (3, None, None), (4, "http://b.example", ""), (5, "odd\r\nurl \x00é", "<p>tiny</p>"), (6, "http://b.example", "<p>tiny</p>"), (7, "//c", "<div>" * 3000 + "deep" + "</p>" * 10)]


def test_warc(spark, none, tmp_path):
    pages = common.written(spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", *CLASH))
    for zip64 in (False, True):
        folder = f"file://{tmp_path}/{zip64}"
        found = {r["page"]: r for r in warc.read_archives(warc.write_archives(pages, folder, zip64=zip64), folder).collect()}
        assert len(found) == len(PAGES)
        assert found["2"]["record_type"] == "revisit" and found["2"]["refers_to"] == "1" and found["2"]["payload"] is None
        assert found["6"]["record_type"] == "response" and bytes(found["6"]["payload"]) == b"<p>tiny</p>"
        assert found["3"]["payload_bytes"] == 0 and found["3"]["payload_digest"] == hashlib.sha256(b"").hexdigest()
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/none"
    assert warc.read_archives(warc.write_archives(empty, folder), folder).count() == 0


def test_html(spark):
    pages = common.written(spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", *CLASH))
    got = rows(html.extract(pages), "page_id")
    assert len(got) == len(PAGES) and got[3]["text"] == "" and got[5]["text"] == "tiny" and got[7]["text"] == "deep"
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


NAN, INF = float("nan"), float("inf")
VECTORS = [(i, [float(np.cos(i / 9)), float(np.sin(i / 9)), 0.1], i % 2) for i in range(60)] + [(100, None, 0), (101, [0.0, 0.0, 0.0], 0), (102, [1.0, NAN, 0.0], 0), (103, [INF, 0.0, 0.0], 0), (104, [None, 1.0, 0.0], 0), (105, [1.0, 0.0, 0.1], None), (0, [1.0, 0.0, 0.1], 0), (200, [1.0, 0.0, 0.1], 0)]


def table(spark, data=VECTORS):
    return common.written(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").select("*", F.lit("z").alias("v"), F.lit("z").alias("id"), F.lit("z").alias("rep")))


def test_ann(spark):
    got = ann.nearest(table(spark), F.col("id") % 20 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == {0, 20, 40, 200} and all(r["vec_id"] not in (100, 101, 102, 103, 104) for r in got)
    assert [r["rank"] for r in sorted(by[20], key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]
    assert ann.nearest(table(spark, VECTORS[:3]), F.col("id") == 0).count() == 2
    assert ann.nearest(table(spark, []), F.col("id") == 0).count() == 0


def test_caps(spark):
    got = caps.link(table(spark)).collect()
    assert len(got) == len(VECTORS)
    by = {r["vec_id"]: r for r in got}
    assert all(by[i]["n_links"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in range(100, 106))
    assert by[200]["component_id"] == 0 and not by[200]["kept"]
    assert caps.link(table(spark, [])).count() == 0 and caps.link(table(spark, VECTORS[60:66])).count() == 6


def test_equal_rows_have_equal_cosines():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(37, 64))
    x[20] = x[3]
    c = vectors.cosines(x, np.broadcast_to(x[5], x.shape))
    assert c[20] == c[3]
    assert vectors.cosines(np.array([[1e-200, 0.0]]), np.array([[1e200, 0.0]]))[0] == 1.0
