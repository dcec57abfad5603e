"""Operators against brute force, the library's own results, or labels."""

import io
import re
import zipfile
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from watchgrid.llm import ann, caps, catalog, common, html, jaccard, lm, mixing, pieces, pii, quality, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def components(sets):
    """By all pairs that share a shingle."""
    own, root, seen = defaultdict(list), {i: i for i in sets}, Counter()
    for i, s in sets.items():
        for g in s:
            own[g].append(i)
    for members in own.values():
        seen.update((a, b) for k, a in enumerate(members) for b in members[k + 1 :])

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in seen.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in sets}


def test_jaccard_on_documents(spark, docs):
    sets = {i: shingles(t) for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    got = {r["doc_id"]: r for r in jaccard.op5(spark, SF).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == components(sets)
    assert all(got[i]["n_shingles"] == len(s) for i, s in sets.items())


def test_jaccard_on_edited_copies(spark):
    """Copies with few to many edits, of short to long texts: pairs lie on both sides of the threshold; a large group needs several rounds."""
    rng, texts = np.random.default_rng(4), []
    for n in [*range(5, 40), 60, 90, 150, 400]:
        base = [f"w{int(x)}" for x in rng.integers(0, 5000, n)]
        for edits in (0, 1, 1, 2, max(1, n // 40), max(1, n // 25), max(1, n // 12)):
            t = list(base)
            for at in rng.choice(n, min(edits, n), replace=False):
                t[at] = f"e{int(rng.integers(0, 9999))}"
            texts.append(" ".join(t[: n - int(rng.integers(0, 2))]))
    base = [f"w{int(x)}" for x in rng.integers(0, 5000, 200)]
    for _ in range(150):
        t = list(base)
        for at in rng.choice(200, int(rng.integers(1, 7)), replace=False):
            t[at] = f"e{int(rng.integers(0, 9999))}"
        texts.append(" ".join(t))
    df = common.written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(df).collect()}
    assert got == components({i: shingles(t) for i, t in enumerate(texts)})


def test_allocation_covers_the_difference():
    for band in range(1, 60):
        most, ones, exact, spare = jaccard.allocate(band)
        assert 2 * ones + exact - spare >= most + 1 or not most
    for n in (4, 5, 9, 100, 999):
        for m in range(int(0.8 * n), n + 1):
            i = -(-80 * (n + m) // 180)
            assert jaccard.differ(n + m) == n + m - 2 * i


def test_lm_base_and_model(spark, docs):
    import zlib

    got = {r["doc_id"]: r for r in lm.op1(spark, SF).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    held = {i for i in tokens if zlib.crc32(str(i).encode()) % 5 == 1}
    c = Counter(w for i, x in tokens.items() if i not in held for w in x)
    n, v = sum(c.values()), len(c)
    for i, x in tokens.items():
        r = got[i]
        assert r["held_out"] == (i in held) and r["train_tokens"] == n and r["n_tokens"] == len(x) and r["n_known"] == sum(c[w] > 0 for w in x)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), abs=1e-8)
    better = [got[i]["score"] > got[i]["base_score"] for i in held]
    assert np.mean(better) > 0.8


def test_lm_model_is_a_distribution(spark):
    """Probabilities of all next words, an unseen one included, sum to 1."""
    texts = ["a b a c", "b a", "c a b a", "a", "b c", "a b c"] * 5
    df = common.written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    m = lm.Model(df, F.lit(True))
    c = Counter(w for t in texts for w in [*t.split(), "$"])
    pairs = Counter(p for t in texts for p in zip(["^", *t.split()], [*t.split(), "$"], strict=True))
    contexts = {**{w: c[w] for w in "abc"}, "^": len(texts)}
    p1 = lambda w: m.unigram_weight * c[w] / m.tokens + (1 - m.unigram_weight) / (m.vocabulary + 1)
    lam = lambda v: m.weights[0][int(lm.bucket(np.array([contexts[v]]))[0])]
    for v in contexts:
        assert sum(lam(v) * pairs[v, w] / contexts[v] + (1 - lam(v)) * p1(w) for w in [*"abc$", "new"]) == pytest.approx(1)
    want = sum(np.log10(lam(v) * pairs[v, w] / contexts[v] + (1 - lam(v)) * p1(w)) for v, w in zip("^aba", "aba$", strict=True))
    df2 = m.score().where("key = 2").first()  # "c a b a"
    alt = sum(np.log10(lam(v) * pairs[v, w] / contexts[v] + (1 - lam(v)) * p1(w)) for v, w in zip("^caba", "caba$", strict=True))
    assert df2["score"] == pytest.approx(alt) and want < 0


def test_lm_of_trigrams(spark):
    """Scores of order 3 from plain counts and the learned weights; all next words of a context have a probability of 1 together."""
    texts = ["a b a c", "b a c", "c a b a", "a", "b c a", "a b c"] * 6
    df = common.written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    m = lm.Model(df, F.lit(True), order=3)
    docs = [["^", *t.split(), "$"] for t in texts]
    c1, c2, c3 = Counter(w for d in docs for w in d[1:]), Counter(p for d in docs for p in zip(d, d[1:], strict=False)), Counter(p for d in docs for p in zip(d, d[1:], d[2:], strict=False))
    c1["^"] = len(texts)
    weight = lambda k, n: m.weights[k][int(lm.bucket(np.array([n]))[0])]

    def p(u, v, w):
        x = m.unigram_weight * (c1[w] if w != "^" else 0) / m.tokens + (1 - m.unigram_weight) / (m.vocabulary + 1)
        x = weight(0, c1[v]) * c2[v, w] / c1[v] + (1 - weight(0, c1[v])) * x
        n = c2[u, v] if u else 0
        return weight(1, n) * c3[u, v, w] / max(n, 1) + (1 - weight(1, n)) * x

    for u, v in (("a", "b"), ("^", "a"), (None, "^"), ("c", "b")):
        assert sum(p(u, v, w) for w in [*"abc$", "new"]) == pytest.approx(1)
    got = {r["key"]: r["score"] for r in m.score().collect()}
    for i, d in enumerate(docs):
        assert got[i] == pytest.approx(sum(np.log10(p(d[k - 2] if k > 1 else None, d[k - 1], d[k])) for k in range(1, len(d))))


def test_lm_without_training_documents(spark):
    """The uniform distribution over one token: every score is 0."""
    df = common.written(spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string"))
    for order in (2, 3):
        assert all(r["score"] == 0.0 and r["base_score"] == 0.0 for r in lm.Model(df, F.lit(False), order=order).score().collect())


def test_mixing_targets(spark):
    got = mixing.op3(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "source"]])
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] % got["size"].clip(lower=1) == 0).all()
    g = got.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert (abs(g["taken"] - g["target"]) <= g["most"]).all()
    sources = sorted(g.index)
    sizes, weights = np.array([int(g.loc[s, "size"]) for s in sources]), np.array([(3, 1, 2)[i % 3] for i in range(len(sources))])
    low, high = 0.0, 2.0 * sizes.max()  # targets are least(2 * size, weight * level), at the level where they add up to all
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if np.minimum(2 * sizes, weights * level).sum() < 1.5 * sizes.sum() else (low, level)
    assert np.allclose([g.loc[s, "target"] for s in sources], np.minimum(2 * sizes, weights * level))


def test_splitting_tree():
    quotas = np.array([100, 37, 0, 5])
    leaves = mixing.split(quotas, 7, 3)
    assert (leaves.sum(axis=0) == quotas).all() and (leaves >= 0).all() and leaves.sum(axis=1).max() - leaves.sum(axis=1).min() <= 2
    mean = np.mean([mixing.split(quotas, 4, s)[0] for s in range(300)], axis=0)
    assert np.allclose(mean, quotas / 4, atol=1.5)


def test_mix_draws_every_block_once(spark):
    drawn = mixing.mix(common.read(spark, SF, "documents")).where("copy IS NOT NULL").toPandas()
    assert (drawn.groupby(["source", "block", "copy"])["shard"].nunique() == 1).all()
    assert not drawn.duplicated(["row", "copy"]).any()


REF = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def base(text):
    out = []
    for kind, p in REF.items():
        for m in p.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 14 <= len(d) <= 19 and pii.luhn(d)) or (kind == "phone" and 10 <= len(d) <= 15)
            if ok:
                out.append((m.start(), list(REF).index(kind), kind, m.end()))
    return [(a, k, b) for a, _, k, b in sorted(out)]


def test_pii_base(docs):
    odd = ["a@b.c@d.e", "x@@y.z", "a.b@c", "@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "4111 1111-1111 1111", "4111111111111111 4111111111111111", "+1 (743) 555-3824 9", "++12345678901", "é+49 30 1234567é", "a%b@c-d.e-f.g!", "0" * 5000, "a@b.c.d@e.f"]
    for t in [*odd, *docs["text"].fillna("")]:
        assert pii.base_spans(t) == base(t), t[:80]


def test_pii_candidates():
    trees, limits = pii.model()
    spans = lambda t: [(t[a:b], k) for a, k, b in pii.spans(t, trees, limits)[1]]
    assert spans("pay 4111111111111111 4111111111111111 now") == [("4111111111111111", "card")] * 2
    assert spans("order 1234567812345678 shipped") == []
    assert spans("The words are clean, version 2.0 of 2024.") == []
    text = "write ann.lee@example.com, call +1 (743) 555-3824"
    assert pii.redact(text, pii.spans(text, trees, limits)[1]) == "write <EMAIL>, call <PHONE>"


def test_pieces_against_the_library(docs):
    sentencepiece = pytest.importorskip("sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    model = pieces.Model(pieces.load())
    texts = ["Hello  world\nfoo\t東京 ", " a", "", "   ", "\U0001f600 \U0001d518", "aaaa" * 30, "x" * 200 + " " + "ab" * 300, "\x00 a\x00b", " " * 50 + "z", *docs["text"].fillna("")]
    got = list(pieces.Encoder(model)(texts))
    assert [x.tolist() for x in got] == lib.encode(texts)
    assert [model.decode(x.tolist()) for x in got] == texts


def test_unigram_pieces_against_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    rng = np.random.default_rng(3)
    words = {"▁", "a", "b", "c", "▁a", "ab", "bc", "abc", "▁ab", "cab", "▁b", "ca", "aa"}
    for text, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3), *((w, 1) for w in sorted(words))):
        m.pieces.add(piece=text, score=float(-rng.uniform(1, 6)) if kind == 1 else 0.0, type=kind)
    m.trainer_spec.model_type = 1
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = True, False, True
    lib = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    texts = ["".join(rng.choice(list("abc "), rng.integers(1, 40))) for _ in range(200)] + ["axxb", "x", "a xx"]
    got = list(pieces.Encoder(pieces.Model(m.SerializeToString()))(texts))
    assert [x.tolist() for x in got] == lib.encode(texts)


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op7(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"))
    assert (got["kept"] == (got["quality"] == 1)).mean() > 0.97
    assert got[got["quality"] == 1]["kept"].mean() > 0.98


def test_weak_labels_find_accuracies():
    rng = np.random.default_rng(0)
    k = len(quality.LABELLERS)
    hits, false = rng.uniform(0.3, 0.9, k), rng.uniform(0.0, 0.05, k)
    truth = rng.random(4000) < 0.8
    patterns = Counter("".join("0" if rng.random() < (false[j] if t else hits[j]) else "-" for j in range(k)) for t in truth)
    w = quality.WeakLabels(dict(patterns))
    assert abs(w.share - 0.8) < 0.05 and np.abs(w.rates[0, :, 0] - hits).mean() < 0.1


def test_warc_packages():
    for wide in (False, True):
        out = io.BytesIO()
        warc.write_package(out, [("a", [b"x" * 10, b"y"]), ("b/c", [b""])], wide)
        z = zipfile.ZipFile(io.BytesIO(out.getvalue()))
        assert z.testzip() is None and z.read("a") == b"x" * 10 + b"y" and z.namelist() == ["a", "b/c"]
        f = io.BytesIO(out.getvalue())
        at, n = warc.stored_members(f, len(out.getvalue()))["a"]
        assert out.getvalue()[at : at + n] == b"x" * 10 + b"y"
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.writestr("stored", b"abc")
        z.writestr("packed", b"abc" * 100, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"a note"
    assert set(warc.stored_members(io.BytesIO(other.getvalue()), len(other.getvalue()))) == {"stored"}


def test_html_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a>Menu</a></nav><div class="ad">Buy</div><article><header><h1>Title &amp; more</h1></header>
    <p>One <b>two<br>three<p>four&nbsp;five</p><aside>Side</aside><form>Search</form><script>var t="</p>";</script><ul><li>x<li>y</ul><div class="user-comments">No</div></article><footer>&copy; F</footer></body></html>"""
    found, _ = html.blocks(page)
    assert [t for _, t in html._candidates(found)] == ["Title & more", "One two three", "four five", "x", "y"]
    assert [t for _, t in html._candidates(html.blocks("<p>a < b</p><p>c &lt d")[0])] == ["a < b", "c < d"]
    assert [t for _, t in html._candidates(html.blocks("plain <b>text")[0])] == ["plain text"]


def test_style_tree_removes_what_a_host_repeats(spark):
    pages = [(i, f"http://h.example/{i}", f"<div class='x1'>Subscribe to our letter</div><div class='y{i}'><p>unique words number {i} here</p></div><div class='z'>Same end</div>") for i in range(20)]
    df = common.written(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in html.extract(df).collect()} == {i: f"unique words number {i} here" for i in range(20)}


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_ann_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 32))
    df = common.written(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int"))
    got = ann.nearest(df, F.col("id") % 50 == 0).toPandas()
    s = unit(x) @ unit(x).T
    np.fill_diagonal(s, -2)
    hits = sum(len(set(g["vec_id"]) & set(np.argsort(-s[q])[:5])) for q, g in got.groupby("query_id"))
    assert hits / 5 / 60 >= 0.9 and np.allclose(got["score"], s[got["query_id"], got["vec_id"]], atol=1e-12)


def test_caps_links(spark):
    rng = np.random.default_rng(0)
    centres = unit(rng.normal(size=(300, 64)))
    x = np.concatenate([centres, *[unit(centres[: 300 // k] + rng.normal(size=(300 // k, 64)) * 0.02) for k in (1, 2, 3)], unit(centres[:1] + rng.normal(size=(120, 64)) * 0.03)])
    label = np.concatenate([np.arange(300) % 3, *[np.arange(300 // k) % 3 for k in (1, 2, 3)], np.zeros(120, dtype=int)])
    df = common.written(spark.createDataFrame([(i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int"))
    got = caps.link(df).toPandas().set_index("vec_id").sort_index()
    s = (unit(x) @ unit(x).T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(s, False)
    want, have = s.sum(axis=1), got["n_links"].to_numpy()
    assert (have <= want).all() and have.sum() / want.sum() > 0.995
    assert (got["kept"] == (got.index == got["component_id"])).all()
    if (have == want).all():
        root = np.arange(len(x))
        for _ in range(len(x)):
            root = np.where(s, root[None, :], root[:, None]).min(axis=1, initial=len(x), where=s | np.eye(len(x), dtype=bool))
        assert (got["component_id"] == root).all()


def test_catalog_names():
    import __spark_entry__ as entry

    assert {f"op{n}_" for n in range(1, 11)} == {k.split("_")[0] + "_" for k in catalog.QUERIES}
    assert set(catalog.QUERIES) | {"pipeline"} <= set(entry.queries())


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = common.read(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SF))
        assert docs.columns == columns
        if name != "mixing":
            assert docs.count() <= before
        before = docs.count()
    last = pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == before and last.where("n_ids = 0").count() == 0


def test_pii_in_a_long_text_is_quick():
    import time

    trees, limits = pii.model()
    text = " ".join(f"call 555-{i % 900 + 100}-{i % 9000 + 1000} a{i}@b.com 4111111111111111 4111111111111111" for i in range(6000))
    began = time.time()
    found = pii.spans(text, trees, limits)[1]
    assert time.time() - began < 30 and sum(k == "email" for _, k, _ in found) == 6000 and sum(k == "card" for _, k, _ in found) == 12000


def test_html_of_deep_and_broken_pages_is_quick():
    import time

    began = time.time()
    found, _ = html.blocks("<div class='a'>" * 60_000 + "deep")
    assert [t for _, t, _, _ in found] == ["deep"]
    found, _ = html.blocks("<b><p>x</p>" * 20_000)
    assert len(found) == 20_000 and time.time() - began < 20
