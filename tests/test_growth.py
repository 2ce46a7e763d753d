"""Figures that must not grow with the input: what a step shuffles, holds or makes anew."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mergelake.operators import apply, blocks, order, resolver, rewrite, versions
from mergelake.plans import tables
from mergelake.sources import files, shared


def exchanges(df) -> int:
    """Shuffles of a plan, a reused one not counted."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("Exchange hashpartitioning" in x and "Reused" not in x for x in plan.splitlines())


def test_following_values_and_groups(spark):
    """The next of each group, over bucket edges, with a null group and one with most rows."""
    rows = [(k * 3, None if k % 10 == 0 else "big" if k % 10 < 8 else f"g{k % 7}", f"t{k}") for k in range(2000)]
    got = {r.k: r for r in order.following(spark.createDataFrame(rows, "k long, w string, t string").repartition(7), "k", "t", "next", "w").collect()}
    assert len(got) == len(rows)
    after = {}
    for k, w, t in reversed(rows):
        assert (got[k].w, got[k].t, got[k].next) == (w, t, after.get(w))
        after[w] = t


def test_following_of_nothing(spark):
    assert order.following(spark.createDataFrame([], "k long, w string, t string"), "k", "t", "next", "w").count() == 0


def test_following_shuffles_values_once(spark):
    """The text goes through one shuffle; the others are of bucket edges."""
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("w"), F.repeat(F.lit("x"), F.lit(50)).alias("t"))
    out = order.following(df, "k", "t", "next", "w")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum("Exchange hashpartitioning(__w" in x and "Reused" not in x for x in plan.splitlines()) == 1
    assert "ReusedExchange" in plan


def test_documents_are_read_in_splits(spark, tmp_path):
    """A document larger than a split is read by several tasks, with all its rows and its header."""
    files.register(spark)
    path = str(tmp_path / "d.json")
    odd = ['},\n    {"n": 7}', "a\r\nb", " ", "tail,", '"', ""]
    rows = spark.range(3000).select(F.col("id").alias("n"), F.element_at(F.array(*map(F.lit, odd)), (F.col("id") % len(odd) + 1).cast("int")).alias("s"), F.array(F.repeat(F.lit("y"), F.lit(200))).alias("a"))
    rows.write.format("merge_document").option("key", "rows").option("header", json.dumps({"success": True, "deep": {"list": [{}, {"b": 1}]}})).mode("append").save(path)
    with open(path) as f:
        whole = json.load(f)
    assert whole["deep"] == {"list": [{}, {"b": 1}]} and whole["count"] == 3000
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        out = files.document(spark, path, "n bigint, s string, a array<string>", "success boolean, count bigint")
        assert out.select(F.spark_partition_id()).distinct().count() > 3
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    assert all((r.head.success, r.head["count"]) == (True, 3000) for r in got)
    assert sorted((r.row.n, r.row.s, r.row.a[0]) for r in got) == sorted((x["n"], x["s"], x["a"][0]) for x in whole["rows"])
    assert {r.row.s for r in got} == set(odd)


def test_batches_are_taken_in_parts(monkeypatch):
    """Only a part of a batch is Python objects at a time; the results are those of the whole."""
    held = []
    monkeypatch.setattr(versions, "PART_BYTES", 1000)
    texts = pa.array([None, "", *["x" * 90] * 98])
    listed = pa.array

    def seen(values, kind):
        held.append(len(values))
        return listed(values, kind)

    monkeypatch.setattr(versions.pa, "array", seen)
    out = versions.by_parts(lambda a, b: f"{a}{b}"[:5], pa.string())(texts, texts)
    monkeypatch.undo()
    assert out.to_pylist()[:3] == ["NoneN", "", "xxxxx"] and len(out) == 100
    assert max(held) < 10
    assert versions.by_parts(lambda a: a, pa.string())(pa.array([], pa.string())).to_pylist() == []


def test_resolver_answers_in_parts(spark):
    """A batch of large hunks comes back in many small ones, the same answers."""
    sizes = spark.range(300).select(F.col("id").cast("string").alias("hunk_id"), F.array(F.repeat(F.lit("o"), F.lit(20_000))).alias("ours"), F.array(F.lit("t")).alias("theirs")).coalesce(1)
    got = {r.hunk_id: r for r in resolver.resolve(sizes, resolver.flaky, wait=0.0).collect()}
    assert len(got) == 300
    for k, r in got.items():
        try:
            want = resolver.flaky(k, ["o" * 20_000], ["t"], 0)
        except RuntimeError:
            assert r.error == "the model is away" and r.resolved_lines == []
            continue
        assert r.resolved_lines == want[0] and r.confidence >= want[1]


def test_go_issues_are_linear(spark):
    """Twenty thousand lines: each is trimmed once, not once for every other one."""
    lines = F.concat(F.array(F.lit("x, err := call(a)"), F.lit("ok"), F.lit("if err != nil {"), F.lit("}")), F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda k: F.concat(F.lit("  v = "), k.cast("string"))))
    rows = spark.createDataFrame([(0, []), (1, ["  y, err := f(b)"])], "k int, tail array<string>").withColumn("lines", F.concat(lines, "tail"))
    got = {r.k: r.u for r in rows.select("k", apply.go_issues(F.col("lines"))["unhandled_error"].alias("u")).collect()}
    assert got == {0: False, 1: True}


def test_go_issues_of_no_lines(spark):
    one = spark.createDataFrame([([],), (["a, err := b()"],), (None,)], "lines array<string>")
    assert [r.u for r in one.select(apply.go_issues(F.col("lines"))["unhandled_error"].alias("u")).collect()][:2] == [False, True]


def test_parts_of_a_stream_follow_the_text(spark, sf_dir, tmp_path, monkeypatch):
    """More text makes more parts, within the bound of a batch."""
    monkeypatch.setattr(tables, "PART_BYTES", 20_000)
    batch = tables.stream_input(spark, sf_dir, str(tmp_path))
    parts = len(spark.read.parquet(str(tmp_path / "in")).inputFiles())
    assert parts > 2 * tables.PARTS and batch == min(tables.BATCH_PARTS, batch) and batch > 2


def test_changes_hold_no_content_twice(spark, tmp_path):
    """A change is written without what was there before, which the version before has; digests are made before files are compared."""
    table = rewrite.Files(spark, str(tmp_path))
    pairs = lambda xs: spark.createDataFrame(xs, "path string, content string")
    table.create(pairs([("a", "1"), ("b", "2"), ("c", "3")]))
    table.upsert(pairs([("a", "4"), ("b", None)]))
    table.upsert(pairs([("a", "5"), ("d", "6")]))
    assert "before" not in spark.read.parquet(f"{tmp_path}/{table.manifest()['changes'][-1]}").columns
    assert sorted(map(tuple, table.last_change().collect())) == [("a", "4", "5"), ("d", None, "6")]
    assert sorted(r.path for r in table.changed_paths().collect()) == ["a", "d"]
    import hashlib

    want = {"a": "5", "c": "3", "d": "6"}
    assert {r.path: r.content for r in table.read(of=F.md5).collect()} == {k: hashlib.md5(v.encode()).hexdigest() for k, v in want.items()}
    assert {r.path: r.content for r in table.read().collect()} == want
    with pytest.raises(ValueError, match="several contents"):
        table.upsert(pairs([("a", "x"), ("a", "y")]))
    assert {r.path: r.content for r in table.read().collect()} == want


def test_split_files_are_made_once(spark):
    """Blocks and places are kept, and a conflict's bounds and pieces meet in one shuffle."""
    lines = ["a", "<<<<<<< x", "o", "=======", "t", "t2", ">>>>>>> y", "z"] * 20
    frame = spark.createDataFrame([(None, lines), ("p", lines[1:])], "path string, lines array<string>")
    kept = []

    def keep(df):
        kept.append(df)
        return shared.kept(df)

    split = blocks.split(frame, 3)
    out = blocks.hunk_rows(split, 5, keep)
    key = lambda r: (r.path or "", r.idx)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, blocks.hunk_rows(split, 5).collect()), key=str)
    assert len(kept) == 2 and len({key(r) for r in out.collect()}) == 40
    assert exchanges(out) <= 8
