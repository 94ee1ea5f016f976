"""From documents to training ids: quality, line dedup, near-duplicates, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and
returns a DataFrame that is written as Parquet and read again for the next. All but the
last return the columns of documents. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table, text_of, written
from gridloom.llm.linededup import dedup_lines
from gridloom.llm.mixing import mix_documents
from gridloom.llm.neardup import drop_near_duplicates
from gridloom.llm.pieces import digests, encode
from gridloom.llm.quality import THRESHOLD, score


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return score(docs, table(spark, sf_dir, "labels")).where(F.col("score") >= THRESHOLD).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, except in the largest doc_id that holds them; n_chars follows the text."""
    kept = dedup_lines(docs.drop("n_chars")).withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long"))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mix_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text: their number and digest, and the digest of the text that they decode to."""
    return encode(docs.select("doc_id", text_of().alias("text")), and_decode=True).select("doc_id", *digests())


STAGES = [("quality", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("mixing", mixing), ("pieces", pieces)]

#: SQL expresses neither the classifier, the signatures nor the lattice search; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
