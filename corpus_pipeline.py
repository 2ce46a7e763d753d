"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs.  All but the last return the columns of documents, in the input's order; columns beside
those of documents come along unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelake.llm import language, mixing, nearcopies, pieces, secrets
from mergelake.llm.queries import piece_model
from mergelake.llm.shared import stored, unused


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models reject go (null texts and texts without a letter among them); lang becomes the predicted one."""
    found_name = unused(docs, "language")
    found = language.identify(docs, language.fit(docs, F.lit(True)), keep=docs.columns, results=found_name)
    return found.filter(~found[found_name]["rejected"]).withColumn("lang", F.col(found_name)["lang_pred"]).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id (null ids last, ties by the text's hash); a document that is no copy stays, with an id or without."""
    return nearcopies.keep_one(docs).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are masked and n_chars follows (a null text stays null, with its n_chars)."""
    found_name = unused(docs, "found")
    found = secrets.scan(docs, secrets.fit(docs), results=found_name)
    n_chars = F.coalesce(F.length(F.col(found_name)["redacted"]).cast("long"), F.col("n_chars"))
    return found.withColumn("n_chars", n_chars).withColumn("text", F.col(found_name)["redacted"]).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says, shuffled."""
    return mixing.replicate(docs, results=unused(docs, "copy")).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian 32-bit) of each row."""
    return pieces.encode(docs, piece_model()).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Three of the stages are beyond SQL; tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
