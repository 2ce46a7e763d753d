"""Queries that go through the engine's own sources, sinks and streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import rewrite
from ..sources import files as sources
from ..sources import shared
from ..sources import views as V
from ..sources.views import quoted, sql
from ..streaming import report
from .files import DETECT_LANG, sql_any
from .hunks import hunks
from .registry import query
from .resolutions import SQL_SPLICE, by_file

PARTS = 4
#: Bytes of text in a part of a stream's input, and parts of a batch at most.
PART_BYTES, BATCH_PARTS = 32 << 20, 64
SQL_EXCLUDED = sql_any("lower(path)", dims.DETECT_EXCLUDED)


def stream_input(spark, sf_dir, root: str) -> int:
    """Files in conflict as a folder of Parquet files for a stream, as many as their texts ask for and PARTS at least; returns how many of them a batch takes: half of them, within a bound."""
    size = V.table(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(PARTS, -(-2 * size // PART_BYTES))  # each text is in two files
    V.conflicts(spark, sf_dir).repartition(parts, "doc_id").write.parquet(f"{root}/in")
    return min(parts // 2, BATCH_PARTS)


@query(sql(f""", sized AS (SELECT c.doc_id, c.path, len(c.lines) AS n_lines, {SQL_EXCLUDED} AS excluded, h.n, h.longest FROM conflicts c LEFT JOIN (SELECT doc_id, count(*) AS n, max(end_line - start_line + 1) AS longest FROM hunks GROUP BY 1) h USING (doc_id))
SELECT count(*) AS files, count(*) FILTER (excluded) AS excluded, count(*) FILTER (NOT excluded AND n > 0) AS parsed, coalesce(sum(n) FILTER (NOT excluded), 0)::BIGINT AS hunks, max(longest) FILTER (NOT excluded) AS longest, max(n_lines)::BIGINT AS most_lines FROM sized""", "hunks"))
def stream_report(spark, sf_dir):
    """The counts and peaks of a report that was written batch by batch."""
    root = shared.folder(spark)
    report.run(spark, f"{root}/in", f"{root}/out", f"{root}/state", stream_input(spark, sf_dir, root))
    return report.totals(spark, f"{root}/out").drop("batches")


@query(sql(f"""SELECT {DETECT_LANG} AS language, count(*) AS files, count(*) FILTER ({SQL_EXCLUDED}) AS excluded, coalesce(sum(n) FILTER (NOT {SQL_EXCLUDED}), 0)::BIGINT AS hunks
FROM conflicts LEFT JOIN (SELECT doc_id, count(*) AS n FROM hunks GROUP BY 1) h USING (doc_id) GROUP BY 1""", "hunks"))
def stream_summary(spark, sf_dir):
    """The running summary by language, kept as state, after the last batch."""
    root = shared.folder(spark)
    report.running_summary(spark, f"{root}/in", f"{root}/out", f"{root}/state", stream_input(spark, sf_dir, root))
    return report.latest_summary(spark, f"{root}/out")


@query(sql(f", {SQL_SPLICE} SELECT f.path, md5(CASE WHEN d.ok THEN array_to_string(d.new, chr(10)) ELSE array_to_string(f.lines, chr(10)) END) AS content_md5, coalesce(d.ok, false) AS changed FROM conflicts f LEFT JOIN done d USING (doc_id)", "res"))
def rewritten_files(spark, sf_dir):
    """Files in conflict as a versioned table, with the resolutions of each file that all fit written as its next version."""
    table = rewrite.Files(spark, shared.folder(spark))
    table.create(V.conflicts(spark, sf_dir).select("path", F.array_join("lines", "\n").alias("content")))
    lines = table.read().select("path", F.split("content", "\n", -1).alias("lines"))
    applied = by_file(spark, sf_dir, lines).filter("ok")
    table.upsert(applied.select(F.col("file_path").alias("path"), F.array_join("new", "\n").alias("content")))
    changed = table.changed_paths().withColumn("changed", F.lit(True))
    return table.read(of=F.md5).join(changed, "path", "left").select("path", F.col("content").alias("content_md5"), F.coalesce("changed", F.lit(False)).alias("changed"))


@query(sql(f"SELECT line[1:2] AS status, trim(line[4:]) AS path, count(*) AS n FROM status WHERE list_contains({quoted(dims.CONFLICT_STATUS)}, line[1:2]) GROUP BY ALL", "status"))
def listing_source(spark, sf_dir):
    """Status listings written as text files and read by the listing source."""
    sources.register(spark)
    root = shared.folder(spark)
    V.status(spark, sf_dir).repartition(PARTS).write.text(root)
    rows = spark.read.format("merge_listing").load(root)
    return rows.filter(F.col("status").isin(dims.CONFLICT_STATUS)).groupBy("status", "path").agg(F.count("*").alias("n"))


@query(sql("SELECT path, idx, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, md5(array_to_string(ours, chr(10))) AS ours_md5, (SELECT count(*) FROM hunks) AS count FROM hunks", "hunks"))
def json_document(spark, sf_dir):
    """All hunks as one JSON document, and what a reader finds in it."""
    sources.register(spark)
    path = f"{shared.folder(spark)}.json"
    hunks(spark, sf_dir).select("path", "idx", "start_line", "end_line", "ours").write.format("merge_document").option("key", "hunks").option("header", json.dumps({"success": True})).mode("append").save(path)
    rows = sources.document(spark, path, "path string, idx bigint, start_line bigint, end_line bigint, ours array<string>", "success boolean, count bigint")
    return rows.select("row.path", "row.idx", "row.start_line", "row.end_line", F.md5(F.array_join("row.ours", "\n")).alias("ours_md5"), "head.count")
