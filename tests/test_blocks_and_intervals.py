"""Files in blocks against the parser of whole files, and range joins against every pair."""

import random

import pytest
from pyspark.sql import functions as F

from mergelake.operators import blocks, intervals, parse
from mergelake.plans import hunks as H

MARKS = ["<<<<<<< HEAD", "<<<<<<<", "||||||| base", "=======", "=======\r", ">>>>>>> x", ">>>>>>>y", "text", "", " <<<<<<<"]


def files(seed, n=40, most=120):
    r = random.Random(seed)
    return [(f"f{k}" if k else None, [r.choice(MARKS) for _ in range(r.randrange(most))]) for k in range(n)]


@pytest.mark.parametrize("size,fan", [(1, 2), (3, 4), (7, 1000), (500, 3)])
def test_split_files_give_the_hunks_of_the_whole(spark, size, fan):
    rows = files(size) + [("empty", []), ("one", ["<<<<<<< a", "=======", ">>>>>>> b"]), ("open", ["<<<<<<< a", "x"])]
    frame = spark.createDataFrame(rows, "path string, lines array<string>")
    got = blocks.hunk_rows(blocks.split(frame, size), fan).collect()
    want = frame.select("path", F.posexplode(parse.hunks(F.col("lines"))).alias("idx", "h")).select("path", "idx", "h.*").collect()
    key = lambda r: (str(r.path), r.idx, r.start_line, r.end_line, r.ours, r.theirs, r.base)
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(want) > 30


def test_blocks_with_gaps_nulls_and_any_order(spark):
    lines = ["a", "<<<<<<< h", "b", "||||||| o", "c", "=======", "d", ">>>>>>> t", "e"] * 3
    rows = [("p", 10 * k + 3, lines[k : k + 1]) for k in range(len(lines))] + [("p", 4, None), ("p", 5, [])]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "path string, block long, lines array<string>").repartition(3)
    got = sorted((r.idx, r.start_line, r.end_line, r.ours, r.base, r.theirs) for r in blocks.hunk_rows(frame, 5).collect())
    assert got == [(k, 9 * k + 2, 9 * k + 8, ["b"], ["c"], ["d"]) for k in range(3)]
    assert blocks.hunk_rows(frame.limit(0)).count() == 0


def test_one_conflict_over_many_blocks(spark):
    """A section of 100 000 lines in 1000 blocks comes in pieces, none longer than a block, and a file of one block a line is composed in runs."""
    n = 100_000
    text = F.when(F.col("id") == 4, "<<<<<<< a").when(F.col("id") == n - 10, "=======").when(F.col("id") == n - 5, ">>>>>>> b").otherwise(F.col("id").cast("string"))
    frame = spark.range(n).groupBy(F.lit("big").alias("path"), F.floor(F.col("id") / 100).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", text.alias("x")))), lambda s: s["x"]).alias("lines"))
    at = blocks.placed(frame, 10)
    assert [tuple(r) for r in blocks.bounds(at).collect()] == [("big", 0, 5, 0, n - 9, n - 4)]
    sizes = blocks.pieces(frame, at).groupBy("section").agg(F.sum(F.size("lines")).alias("n"), F.max(F.size("lines")).alias("most"), F.count("*").alias("rows")).collect()
    assert {(r.section, r.n, r.most, r.rows) for r in sizes} == {("ours", n - 15, 100, 1000), ("theirs", 4, 4, 1)}


def ranges(seed, n, most, longest):
    r = random.Random(seed)
    out = [(r.choice(["a", "b", None]), k, a := r.randrange(-5, most), a + r.randrange(longest)) for k in range(n)]
    return out + [("a", n, 5, 4), ("a", n + 1, None, 3), out[0]]


@pytest.mark.parametrize("longest", [3, 100, 300_000])
def test_joins_against_every_pair(spark, longest):
    left, right = ranges(1, 150, 3 * longest, longest), ranges(2, 150, 3 * longest, longest)
    a = spark.createDataFrame(left, "g string, x long, start long, end long")
    b = spark.createDataFrame(right, "h string, y long, start long, end long")
    pairs = [(p, q) for p in left for q in right if p[0] == q[0] and None not in (p[2], q[2]) and p[2] <= p[3] and q[2] <= q[3]]
    got = sorted((r.x, r.y, r.start, r.r_start) for r in intervals.overlapping(a, b, "g", "h").collect())
    assert got == sorted((p[1], q[1], p[2], q[2]) for p, q in pairs if p[2] <= q[3] and q[2] <= p[3]) and got
    got = sorted((r.x, r.y, r.start, r.o_start) for r in intervals.containing(a, b, "g", "h").collect())
    assert got == sorted((p[1], q[1], p[2], q[2]) for p, q in pairs if q[2] <= p[2] and p[3] <= q[3]) and got
    assert intervals.containing(a.limit(0), b, "g", "h").count() == 0 and intervals.overlapping(a, b.limit(0), "g", "h").count() == 0


def test_a_file_of_many_conflicts_is_no_product(spark):
    """100 000 conflicts and as many resolutions in one file: each finds its own, and few rows meet."""
    n = 100_000
    h = spark.range(n).select(F.lit("p").alias("path"), F.col("id").alias("idx"), (F.col("id") * 9).alias("start_line"), (F.col("id") * 9 + 6).alias("end_line"))
    res = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("idx"), F.lit("p").alias("file_path"), (F.col("id") * 9 + 1).alias("start_line"), (F.col("id") * 9 + 5).alias("end_line"))
    got = H.containing(res, h)
    assert got.filter("idx = h_idx").count() == n and got.count() == n
    kept = intervals.bins(h.select("path", F.col("start_line").alias("start"), F.col("end_line").alias("end")), "start", "end", None)
    assert kept.groupBy("__k", "__bin").count().agg(F.max("count")).first()[0] <= 66


def test_first_containing_takes_the_first(spark):
    h = spark.createDataFrame([("p", 0, 1, 100, ["o"], ["t"], []), ("p", 1, 5, 20, ["o"], ["t"], []), ("q", 0, 1, 9, ["o"], ["t"], [])], "path string, idx long, start_line int, end_line int, ours array<string>, theirs array<string>, base array<string>")
    res = spark.createDataFrame([(1, 0, "p", 6, 7), (1, 1, "p", 90, 101), (1, 2, "q", 1, 9), (1, 3, "", 1, 9), (1, 4, None, 1, 9)], "doc_id long, idx long, file_path string, start_line long, end_line long")
    assert sorted((r.idx, r.h_idx, r.h_start, r.h_end) for r in H.containing(res, h).collect()) == [(0, 0, 1, 100), (2, 0, 1, 9)]
    assert sorted((r.idx, r.path, r.ours) for r in H.first_containing(res, h).collect()) == [(0, "p", ["o"]), (2, "q", ["o"])]
