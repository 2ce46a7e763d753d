"""Detection as a structured stream: files in, hunks out, in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import parse

SCHEMA = "doc_id long, path string, lines array<string>"


def hunk_stream(files: DataFrame) -> DataFrame:
    """A streaming DataFrame of files to one of hunks: exclude, parse, project."""
    kept = files.filter(~T.detect_excluded(F.col("path")))
    return parse.hunk_rows(kept).select("doc_id", "path", "idx", "start_line", "end_line", T.detect_language(F.col("path")).alias("language"))


def detect(spark: SparkSession, source: str, sink: str, checkpoint: str, files_per_batch: int = 50) -> None:
    """Everything in a folder of Parquet files, in micro-batches, as JSON lines; a rerun takes up what is new."""
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    writer = hunk_stream(files).writeStream.format("json").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.start().awaitTermination()
