"""Diffs, patches and merges against plain versions, on random texts with repeated lines and on awkward ones."""

import random

import pytest
from pyspark.sql import functions as F

from mergelake.operators import parse, versions

AWKWARD = ["", "\n", "a", "a\n", "a\r\nb\n", "\n\n\n", "a\nb", "b\na\n", "+a\n-b\n@@ -1 +1 @@\n", "\\ x\n", "é\nü\n"]


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def texts(seed, n=60, kinds=4, most=40):
    r = random.Random(seed)
    return ["".join(f"line {r.randrange(kinds)}\n" for _ in range(r.randrange(most))) + r.choice(["", "end", "line 0"]) for _ in range(n)]


@pytest.mark.parametrize("kinds", [1, 3, 12, 200])
def test_common_is_longest(kinds):
    r = random.Random(kinds)
    for _ in range(150):
        a, b = ([r.randrange(kinds) for _ in range(r.randrange(60))] for _ in range(2))
        got = versions.common(a, b)
        assert len(got) == longest(a, b) and all(a[i] == b[j] for i, j in got)
        assert all(x < u and y < v for (x, y), (u, v) in zip(got, got[1:], strict=False))


def test_common_of_long_texts():
    r = random.Random(1)
    a = [r.randrange(5000) for _ in range(20_000)]
    b = [x for x in a if r.random() > 0.05]
    b = b[:7000] + [r.randrange(5000) for _ in range(300)] + b[7000:]
    assert len(versions.common(a, b)) >= len(b) - 300


@pytest.mark.parametrize("context", [0, 1, 3])
def test_diff_round_trip(context):
    every = [(a, b) for a in AWKWARD for b in AWKWARD] + list(zip(texts(1), texts(2), strict=True)) + list(zip(texts(3, kinds=60), texts(4, kinds=60), strict=True))
    for a, b in every:
        d = versions.unified("x", a, b, context)
        assert versions.patched(a, d) == b and (d == "") == (a == b)
        added, removed = (sum(x.startswith(s) and not x.startswith(s * 3) for x in d.split("\n")) for s in "+-")
        same = longest(versions.ended(a), versions.ended(b))
        if not any(x.startswith(("++", "--")) for x in (*versions.ended(a), *versions.ended(b))):
            assert (added, removed) == (len(versions.ended(b)) - same, len(versions.ended(a)) - same)


def test_diff_against_known():
    d = versions.unified("f.go", "a\nb\nc\nd\ne\n", "a\nB\nc\nd\ne")
    assert d == "diff --git a/f.go b/f.go\n--- a/f.go\n+++ b/f.go\n@@ -1,5 +1,5 @@\n a\n-b\n+B\n c\n d\n-e\n+e\n\\ No newline at end of file\n"
    assert versions.unified("f", "", "x\n") == "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -0,0 +1 @@\n+x\n"


def test_patch_of_another_text_is_null():
    d = versions.unified("x", "a\nb\nc\n", "a\nx\nc\n")
    assert versions.patched("a\nq\nc\n", d) is None and versions.patched("", d) is None
    assert versions.patched("a\nb\nc\n", d.rsplit("\n", 3)[0]) is None


def test_merge_rules():
    m = versions.merged("a\nb\nc", "a\nB\nc", "a\nb\nc\nd")
    assert (m["text"], m["n_conflicts"], m["n_taken"]) == ("a\nB\nc\nd", 0, 2)
    assert versions.merged("a\nb", "a\nx", "a\nx")["text"] == "a\nx"
    m = versions.merged("a\nb\nc", "a\nx\nc", "a\ny\nc")
    assert m["text"] == "a\n<<<<<<< ours\nx\n||||||| base\nb\n=======\ny\n>>>>>>> theirs\nc"
    assert m["hunks"] == [{"start_line": 2, "end_line": 8, "ours": ["x"], "theirs": ["y"], "base": ["b"]}]
    assert versions.merged("a", "a\nx", "a\ny")["hunks"][0]["base"] == []  # both put something in the same place


def test_merge_laws():
    for base, ours, theirs in zip(texts(5, kinds=30), texts(6, kinds=30), texts(7, kinds=30), strict=True):
        assert versions.merged(base, base, theirs)["text"] == theirs and versions.merged(base, ours, base)["text"] == ours and versions.merged(base, ours, ours)["text"] == ours
        m, other = versions.merged(base, ours, theirs), versions.merged(base, theirs, ours)
        assert [(h["ours"], h["theirs"], h["base"]) for h in m["hunks"]] == [(h["theirs"], h["ours"], h["base"]) for h in other["hunks"]]
        chunks = versions.aligned(*(x.split("\n") for x in (base, ours, theirs)))
        for k, text in enumerate((base, ours, theirs)):
            assert "\n".join(x for c in chunks for x in c[k]) == text


def test_merge_and_diff_in_spark(spark):
    """Nulls, empty texts, conflicts read again by the marker parser; a diff read by its own parser and applied."""
    rows = list(zip(range(60), texts(8, kinds=20), texts(9, kinds=20), texts(10, kinds=20), strict=True)) + [(60, None, "a", "b"), (61, "a", None, None), (62, None, None, None), (63, "", "", "")]
    frame = spark.createDataFrame(rows, "doc_id long, base string, ours string, theirs string")
    out = frame.withColumn("m", versions.merge("base", "ours", "theirs")).withColumn("again", parse.hunks(F.split("m.text", "\n", -1))).withColumn("d", versions.diff(F.lit("p"), "base", "ours")).withColumn("back", versions.patch("base", "d"))
    got = out.collect()
    for r, (_, b, o, t) in zip(sorted(got, key=lambda r: r.doc_id), rows, strict=True):
        assert r.m.text == versions.merged(b or "", o or "", t or "")["text"] and r.back == (o or "")
        assert [tuple(h) for h in r.again] == [tuple(h) for h in r.m.hunks] and len(r.m.hunks) == r.m.n_conflicts
    assert sum(r.m.n_conflicts for r in got) > 50
    read = parse.diff_rows(out.select("doc_id", F.col("d").alias("text"))).groupBy("doc_id").agg(F.sum("added").alias("a"), F.sum("removed").alias("r")).collect()
    size = {i: (len(versions.ended(o or "")), len(versions.ended(b or ""))) for i, b, o, _ in rows}
    assert all(r.a - r.r == size[r.doc_id][0] - size[r.doc_id][1] for r in read)


def test_merge_files(spark):
    frame = lambda rows: spark.createDataFrame(rows, "path string, content string")
    out = versions.merge_files(frame([("a", "1\n"), ("b", "1\n"), ("c", "1\n"), ("gone", "1\n")]), frame([("a", "2\n"), ("b", "1\n"), ("new", "x\n")]), frame([("a", "1\n"), ("b", "3\n"), ("c", "1\n")]))
    assert {r.path: r.merged.text for r in out.collect()} == {"a": "2\n", "b": "3\n", "c": "", "new": "x\n"}
