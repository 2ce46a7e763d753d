"""A report that is written while files stream in, with counts that are right after any restart, and the metrics of each of its batches.

Each micro-batch writes its conflicts, its counts and its metrics into folders that carry the batch's id, in place of what an earlier try of that batch has left; so a batch that is run
again after a failure counts once.  What is counted is of the batch alone; the report sums over batches.  A second stream keeps the running summary of all files by language as
state of the query, and writes it after each batch.

Edge cases: a batch without files writes nothing; excluded files are counted and not parsed; a file without conflicts counts as a file; no batch at all gives a report of zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..functions import text as T
from ..operators import parse
from .detect import SCHEMA

HUNK = "doc_id long, path string, idx long, start_line int, end_line int, language string"
METRICS = "batch long, files long, excluded long, parsed long, hunks long, longest long, most_lines long"


def parsed(files: DataFrame) -> DataFrame:
    """Files with their language, whether they are excluded, and the hunks of those that are not."""
    excluded = T.detect_excluded(F.col("path"))
    return files.select("doc_id", "path", F.size("lines").alias("n_lines"), T.detect_language(F.col("path")).alias("language"), excluded.alias("excluded"), F.when(~excluded, parse.hunks(F.col("lines"))).alias("h"))


def metrics() -> list:
    """What is measured of a batch as it runs."""
    n = F.coalesce(F.size("h"), F.lit(0)).cast("long")
    length = F.aggregate(F.coalesce("h", F.array()), F.lit(0), lambda m, h: F.greatest(m, h["end_line"] - h["start_line"] + 1))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return [F.count("*").alias("files"), zero(F.count_if("excluded")).alias("excluded"), zero(F.count_if(~F.col("excluded") & (n > 0))).alias("parsed"), zero(F.sum(n)).alias("hunks"), zero(F.max(length)).alias("longest"), zero(F.max("n_lines")).alias("most_lines")]


def write_batch(rows: DataFrame, batch: int, sink: str) -> None:
    """One batch's conflicts and metrics, in place of any earlier try."""
    seen = Observation(f"batch-{batch}")
    hunks = parsed(rows).observe(seen, *metrics()).select("doc_id", "path", F.posexplode_outer("h").alias("idx", "x"), "language")
    hunks = hunks.filter("x IS NOT NULL").select("doc_id", "path", F.col("idx").cast("long"), "x.start_line", "x.end_line", "language")
    hunks.write.mode("overwrite").parquet(f"{sink}/hunks/batch={batch}")
    spark = rows.sparkSession
    spark.createDataFrame([(batch, *[seen.get[c.split()[0]] for c in METRICS.split(", ")[1:]])], METRICS).coalesce(1).write.mode("overwrite").parquet(f"{sink}/metrics/batch={batch}")


def run(spark: SparkSession, source: str, sink: str, checkpoint: str, files_per_batch: int = 50, write=write_batch) -> None:
    """Everything new in a folder of Parquet files, in micro-batches; a rerun goes on where the last one ended, also in the middle of a batch."""
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = files.writeStream.foreachBatch(lambda rows, batch: write(rows, batch, sink)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def running_summary(spark: SparkSession, source: str, sink: str, checkpoint: str, files_per_batch: int = 50) -> None:
    """The summary of all files so far by language, kept as state and written after each batch under its id."""
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    n = F.coalesce(F.size("h"), F.lit(0)).cast("long")
    state = parsed(files).groupBy("language").agg(F.count("*").alias("files"), F.count_if("excluded").alias("excluded"), F.sum(n).alias("hunks"))
    write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{sink}/summary/batch={batch}")
    state.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def conflicts(spark: SparkSession, sink: str) -> DataFrame:
    """The conflicts of all batches."""
    return spark.read.schema(HUNK).parquet(f"{sink}/hunks")


def log(spark: SparkSession, sink: str) -> DataFrame:
    """The metrics of each batch."""
    return spark.read.schema(METRICS).parquet(f"{sink}/metrics")


def totals(spark: SparkSession, sink: str) -> DataFrame:
    """One row: the report's counts and peaks over all batches."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return log(spark, sink).agg(F.count("*").alias("batches"), *[zero(F.sum(c)).alias(c) for c in ("files", "excluded", "parsed", "hunks")], *[zero(F.max(c)).alias(c) for c in ("longest", "most_lines")])


def latest_summary(spark: SparkSession, sink: str) -> DataFrame:
    """The running summary after the last batch."""
    every = spark.read.parquet(f"{sink}/summary")
    return every.join(every.agg(F.max("batch").alias("batch")), "batch").drop("batch")


class Progress(StreamingQueryListener):
    """Rows and milliseconds of each batch of the session's streams; ``rows`` is bounded by the batches of a run."""

    def __init__(self):
        self.rows: list[tuple[str, int, int, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append((str(p.id), p.batchId, p.numInputRows, int(p.batchDuration)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
