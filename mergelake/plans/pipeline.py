"""The resolver pipeline and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import apply, resolver
from ..sources import shared
from ..sources.views import sql
from ..streaming import detect
from .files import DETECT_LANG, sql_any
from .hunks import hunks
from .registry import query
from .tables import stream_input

SQL_ANSWERS = """asked AS (SELECT md5(path || ':' || idx) AS h FROM hunks), bytes AS (SELECT ('0x' || h[3:4])::INT / 255.0::DOUBLE AS c, ('0x' || h[5:6])::INT % 16 AS k FROM asked),
answers AS (SELECT CASE WHEN k = 0 OR c >= 0.6 THEN 1 WHEN k = 1 OR c + 0.2::DOUBLE >= 0.6 THEN 2 ELSE 3 END AS turns, CASE WHEN k = 0 THEN 0.0::DOUBLE WHEN k = 1 OR c >= 0.6 THEN c WHEN c + 0.2::DOUBLE >= 0.6 THEN c + 0.2::DOUBLE ELSE c + 0.4::DOUBLE END AS confidence, k = 0 AS failed FROM bytes)"""


@query(sql(f", {SQL_ANSWERS} SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n, sum(turns)::BIGINT AS turns, count(*) FILTER (failed) AS errors, round(sum(confidence), 6) AS confidence FROM answers GROUP BY 1", "hunks"))
def mock_resolver_pipeline(spark, sf_dir):
    """Hunks to a resolver that sometimes fails and back, tiers of confidence counted."""
    h = hunks(spark, sf_dir).select(F.concat_ws(":", "path", F.col("idx").cast("string")).alias("hunk_id"), "ours", "theirs")
    answers = resolver.resolve(h, resolver.flaky, wait=0.0)
    return answers.groupBy(apply.tier(F.col("confidence")).alias("tier")).agg(F.count("*").alias("n"), F.sum("turns").alias("turns"), F.count_if(F.col("error") != "").alias("errors"), F.round(F.sum("confidence"), 6).alias("confidence"))


@query(sql(f"SELECT doc_id, path, idx, start_line::INT AS start_line, end_line::INT AS end_line, {DETECT_LANG} AS language FROM hunks WHERE NOT {sql_any('lower(path)', dims.DETECT_EXCLUDED)}", "hunks"))
def stream_detect(spark, sf_dir):
    """The conflict files as a stream of Parquet files, detected in micro-batches; the same rows as in batch."""
    root = shared.folder(spark)
    detect.detect(spark, f"{root}/in", f"{root}/out", f"{root}/state", files_per_batch=stream_input(spark, sf_dir, root))
    return spark.read.schema("doc_id long, path string, idx long, start_line int, end_line int, language string").json(f"{root}/out")
