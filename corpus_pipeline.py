"""A corpus from raw documents to token ids: quality, near-duplicates, personal data, mixing, encoding.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns what it keeps of docs. Each result is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents; further columns of docs pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid.llm import common, jaccard, mixing, pieces, pii, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier does not reject."""
    return quality.keep(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of a shingle similarity of 0.8 or more tie together, the one with the smallest doc_id. Repeated rows of a doc_id stay together."""
    gone = jaccard.join(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind."""
    return docs.withColumn("text", pii.redacted(F.col("text"))).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix of sources draws a document; documents without words can't be drawn and go."""
    return mixing.drawn_rows(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_ids and ids of every row."""
    return docs.select("doc_id", "source", pieces.encode(F.col("text")).alias("ids")).select("doc_id", "source", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [("quality", quality_stage), ("near_duplicates", dedup_stage), ("personal_data", pii_stage), ("mixing", mix_stage), ("encoding", encode_stage)]

#: Scores, spans and ids have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
