"""The queries of the operators in this subpackage, one for each, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontam, mixing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op3_source_mixing": mixing.ORACLE, "op12_benchmark_decontamination": decontam.ORACLE, "op13_vector_codes": codes.ORACLE}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def piece_model() -> bytes:
    """The public piece model; other models are a parameter of the operator."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pieces

    return pieces.encode(documents(spark, sf_dir), piece_model()).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substrings

    return substrings.remove_repeats(documents(spark, sf_dir), 35).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(documents(spark, sf_dir))


def fold(n: int) -> Column:
    """The id's remainder; null for a null id, which is held out everywhere."""
    return F.crc32(F.col("doc_id").cast("string")) % n


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language

    docs = documents(spark, sf_dir)
    model = language.fit(docs, fold(5) != 0)
    return language.identify(docs, model).withColumn("held_out", F.coalesce(fold(5) == 0, F.lit(True))).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import nearcopies

    return nearcopies.near_copies(documents(spark, sf_dir))


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    docs = documents(spark, sf_dir).select("doc_id", "text")
    spans = secrets.scan(docs, secrets.fit(docs)).select("doc_id", "spans")
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    joined = lambda spans: F.concat_ws(",", F.transform(spans, secrets.named))
    return spans.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(secrets.KINDS[:3])],
        F.sha2(joined(F.filter("spans", lambda s: s["rank"] < 3)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query
def op1_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import katz

    out = katz.score(documents(spark, sf_dir), fold(7) != 2)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op4_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import imatch

    out = imatch.fingerprint_all(documents(spark, sf_dir))
    return out.withColumns({c: F.array_join(c, ",") for c in ("fingerprint", "edited_fingerprint")})


@query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import personal

    found = personal.find(documents(spark, sf_dir), personal.fit())
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    kinds = F.array(*map(F.lit, personal.KINDS))
    name = lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, name))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(personal.KINDS[:4])],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] < 4)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query
def op5_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    return topk.search(documents(spark, sf_dir), F.col("doc_id") % 50 == 0, 10)


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import whitening

    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
