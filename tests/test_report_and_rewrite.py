"""The streamed report over restarts, its metrics, and the versioned table."""

import pytest
from pyspark.sql import functions as F

from mergelake.functions import text as T
from mergelake.operators import parse
from mergelake.operators.rewrite import Files
from mergelake.sources import views as V
from mergelake.streaming import report


@pytest.fixture
def folder(spark, sf_dir, tmp_path):
    V.conflicts(spark, sf_dir).repartition(6).write.parquet(f"{tmp_path}/in")
    return tmp_path


def wanted(spark, folder):
    """(hunks, counts) of the files there, in one batch."""
    files = spark.read.parquet(f"{folder}/in")
    kept = files.filter(~T.detect_excluded(F.col("path")))
    hunks = parse.hunk_rows(kept).select("doc_id", "idx", "start_line", "end_line")
    lengths = hunks.agg(F.count("*"), F.max(F.col("end_line") - F.col("start_line") + 1), F.countDistinct("doc_id")).first()
    return sorted(map(tuple, hunks.collect())), (files.count(), files.count() - kept.count(), lengths[2], lengths[0], lengths[1], files.agg(F.max(F.size("lines"))).first()[0])


def got(spark, sink):
    t = report.totals(spark, sink).first()
    rows = report.conflicts(spark, sink).select("doc_id", "idx", "start_line", "end_line").collect()
    return sorted(map(tuple, rows)), (t.files, t.excluded, t.parsed, t.hunks, t.longest, t.most_lines)


def test_report_counts_after_a_failure_in_mid_stream(spark, folder):
    """The third batch fails after it has written its conflicts and before its metrics; a restart writes it again, once."""
    sink, state = f"{folder}/out", f"{folder}/state"

    def failing(rows, batch, sink):
        report.write_batch(rows, batch, sink)
        if batch == 2:
            rows.limit(1).select("doc_id", "path", F.lit(0).cast("long").alias("idx"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("half").alias("language")).write.mode("append").parquet(f"{sink}/hunks/batch={batch}")
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        report.run(spark, f"{folder}/in", sink, state, 1, failing)
    assert report.log(spark, sink).count() == 3
    report.run(spark, f"{folder}/in", sink, state, 1)
    assert got(spark, sink) == wanted(spark, folder) and report.totals(spark, sink).first().batches == 6
    spark.read.parquet(f"{folder}/in").limit(7).withColumn("doc_id", F.col("doc_id") + 100_000).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    report.run(spark, f"{folder}/in", sink, state, 1)
    assert got(spark, sink) == wanted(spark, folder) and report.totals(spark, sink).first().batches == 7
    assert sorted(r.batch for r in report.log(spark, sink).collect()) == list(range(7))


def test_running_summary_goes_on_after_a_restart(spark, folder):
    sink, state = f"{folder}/out", f"{folder}/state"
    heard = report.Progress()
    spark.streams.addListener(heard)
    try:
        report.running_summary(spark, f"{folder}/in", sink, state, 4)
        spark.read.parquet(f"{folder}/in").limit(9).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        report.running_summary(spark, f"{folder}/in", sink, state, 4)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(heard)
    files = spark.read.parquet(f"{folder}/in")
    want = report.parsed(files).groupBy("language").agg(F.count("*").alias("files"), F.count_if("excluded").alias("excluded"), F.sum(F.coalesce(F.size("h"), F.lit(0)).cast("long")).alias("hunks"))
    rows = lambda df: sorted(map(tuple, df.select("language", "files", "excluded", "hunks").collect()))
    assert rows(report.latest_summary(spark, sink)) == rows(want)
    assert sum(n for _, _, n, _ in heard.rows) == files.count()


def content(table, version=None):
    return {r.path: r.content for r in table.read(version).collect()}


@pytest.fixture
def table(spark, tmp_path):
    t = Files(spark, str(tmp_path / "table"))
    t.create(spark.createDataFrame([(f"f{k}", f"old {k}") for k in range(5)], "path string, content string"))
    return t


def changes(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def test_upsert_and_undo(spark, table):
    old = content(table)
    assert table.upsert(changes(spark, [("f1", "new 1"), ("f2", None), ("g", "new")])) == 2
    assert content(table) == {k: v for k, v in (old | {"f1": "new 1", "g": "new"}).items() if k != "f2"}
    assert sorted(map(tuple, table.last_change().collect())) == [("f1", "old 1", "new 1"), ("f2", "old 2", None), ("g", None, "new")]
    table.upsert(changes(spark, [("f1", "newer 1"), ("f2", "back")]))
    assert content(table)["f1"] == "newer 1" and content(table)["f2"] == "back" and content(table, 1) == old
    assert sorted(map(tuple, table.last_change().collect())) == [("f1", "new 1", "newer 1"), ("f2", None, "back")]
    table.undo()
    assert content(table)["f1"] == "new 1" and "f2" not in content(table)
    table.undo()
    assert content(table) == old
    with pytest.raises(ValueError):
        table.undo()


def test_a_failed_rewrite_leaves_the_version_before(spark, table):
    old = content(table)
    bad = spark.range(0, 100, 1, 4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") < 90, F.lit("x")).otherwise(F.raise_error(F.lit("lost")).cast("string")).alias("content"))
    with pytest.raises(Exception, match="lost"):
        table.upsert(bad)
    assert content(table) == old and table.versions() == [1]
    with pytest.raises(Exception, match="several contents"):
        table.upsert(changes(spark, [("f1", "a"), ("f1", "b")]))
    assert content(table) == old and table.versions() == [1]


def test_compact_and_empty(spark, table):
    table.upsert(changes(spark, []))
    table.upsert(changes(spark, [("f0", "n")]))
    before = content(table)
    table.compact()
    assert content(table) == before and table.manifest()["changes"] == [] and content(table, 1)["f0"] == "old 0"
