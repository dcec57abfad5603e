"""The pipeline's stages on odd and empty tables."""

import pytest

import corpus_pipeline as pipeline
from test_edges import CLASH, DOCS, SCHEMA
from watchgrid.llm import ann, common, quality, vectors


@pytest.fixture(scope="module")
def docs(spark):
    return common.written(spark.createDataFrame(DOCS, SCHEMA).selectExpr("*", *CLASH))


@pytest.fixture(scope="module")
def none(spark):
    return common.written(spark.createDataFrame([], SCHEMA).selectExpr("*", *CLASH))


@pytest.mark.parametrize("k", range(len(pipeline.STAGES)))
def test_odd_rows(spark, docs, k):
    name, stage = pipeline.STAGES[k]
    out = common.written(stage(spark, docs, ""))
    ids = sorted(r["doc_id"] for r in out.select("doc_id").collect())
    if name == "encoding":
        assert out.columns == ["doc_id", "source", "n_ids", "ids"] and len(ids) == len(DOCS)
        return
    assert out.columns == docs.columns
    if name == "near_duplicates":
        assert ids == [1, 2, 3, 4, 5, 6, 8, 9]
    if name == "personal_data":
        text = out.where("doc_id = 8").first()
        assert "@" not in text["text"] and text["n_chars"] == len(text["text"]) and len(ids) == len(DOCS)
    if name == "mixing":
        assert not {2, 3, 4} & set(ids) and len(ids) >= 1


@pytest.mark.parametrize("k", range(len(pipeline.STAGES)))
def test_empty_table(spark, none, k):
    assert common.written(pipeline.STAGES[k][1](spark, none, "")).count() == 0


def test_a_key_repeated_often_is_one_row_of_the_sample(spark):
    rows = [(1, "Plain words that end like a sentence does.")] * 3000 + [(2, "X!!! $$$ ### %%% &&&& *** 12345 99999 !!!! ????")] + [(i, "Good words make good lines, as they should.") for i in range(3, 30)]
    df = common.written(spark.createDataFrame(rows, "doc_id long, text string"))
    assert quality.classify(df).count() == len(rows)


def test_visits_follow_the_structure(spark):
    """Vectors in tight groups need fewer leaves for the same recall than vectors without structure."""
    import numpy as np

    rng = np.random.default_rng(1)
    loose = rng.normal(size=(3000, 32))
    tight = rng.normal(size=(100, 32))[rng.integers(0, 100, 3000)] + 0.2 * rng.normal(size=(3000, 32))
    a, b = (ann.needed(ann.Forest(x), x) for x in (loose, tight))
    assert b < a / 4 and vectors.unit(loose).shape == loose.shape
