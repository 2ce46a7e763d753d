"""Metadata rules, times and cleaning of payloads, case by case."""

import json

import pytest
from pyspark.sql import functions as F

from mergelake.functions import text as T
from mergelake.operators import payload

GOOD = {"files": [{"path": "a.go", "language": "go", "conflicts": [{"id": "a:1", "start_line": 1, "end_line": 3, "ours_lines": ["x"], "theirs_lines": []}], "context": {}}], "metadata": {"repo_path": "/w"}}
CASES = {
    "plain": ({}, None), "version_20": ({"version": "é" * 20}, None), "version_21": ({"version": "v" * 21}, ("fields", "Version", "max")), "files_0": ({"total_files": 0}, None), "files_1000": ({"total_files": 1000}, None),
    "files_1001": ({"total_files": 1001}, ("fields", "TotalFiles", "max")), "files_-1": ({"total_files": -1}, ("fields", "TotalFiles", "min")), "conflicts_5000": ({"total_conflicts": 5000}, None), "conflicts_5001": ({"total_conflicts": 5001}, ("fields", "TotalConflicts", "max")),
    "conflicts_-1": ({"total_conflicts": -1}, ("fields", "TotalConflicts", "min")), "time": ({"timestamp": "2024-02-29T23:59:59Z"}, None), "offset": ({"timestamp": "2024-01-01T00:00:00.123456789-23:59"}, None), "null": ({"timestamp": None}, None),
    "empty": ({"timestamp": ""}, ("decode", "payload", "decode")), "words": ({"timestamp": "not a time"}, ("decode", "payload", "decode")), "day": ({"timestamp": "2023-02-29T00:00:00Z"}, ("decode", "payload", "decode")), "number": ({"timestamp": 5}, ("decode", "payload", "decode")),
    "no_zone": ({"timestamp": "2024-01-01T00:00:00"}, ("decode", "payload", "decode")), "second": ({"timestamp": "2024-01-01T00:00:60Z"}, ("decode", "payload", "decode")), "float": ({"total_files": 1.5}, ("decode", "payload", "decode")),
}


def frame(spark, texts):
    return spark.createDataFrame(texts, "name string, text string")


def test_metadata_rules(spark):
    rows = [(n, json.dumps(GOOD | {"metadata": GOOD["metadata"] | change})) for n, (change, _) in CASES.items()]
    got = {r.name: None if r.valid else (r.stage, r.field, r.tag) for r in payload.validated(frame(spark, rows)).collect()}
    assert got == {n: want for n, (_, want) in CASES.items()}


def test_errors_are_counted_in_the_order_of_the_fields(spark):
    bad = GOOD | {"metadata": {"repo_path": "/w;x", "total_files": -1, "total_conflicts": 9999, "version": "v" * 50}}
    r = payload.validated(frame(spark, [("a", json.dumps(bad))])).first()
    assert (r.n_errors, r.field, r.tag) == (4, "RepoPath", "repo_path")


def test_loaded_payloads_are_clean(spark):
    p = json.loads(json.dumps(GOOD))
    p["metadata"]["repo_path"] = "/w/../a//b///" + "é" * 300
    r = payload.loaded(frame(spark, [("a", json.dumps(p)), ("b", "{}")])).orderBy("name").collect()
    assert r[0].repo_path.encode("utf-8", "ignore")[:9] == b"/w/a/b//\xc3" and r[0].files[0].conflicts[0].base_lines == [] and r[0].files[0].context.before_lines == []
    assert r[1].files is None and not r[1].valid


@pytest.mark.parametrize("raw,want", [("a\0b", "ab"), ("..a..b", "ab"), ("a////b", "a//b"), ("x" * 600, "x" * 500), ("", ""), (None, None)])
def test_clean_path(spark, raw, want):
    assert frame(spark, [("a", raw)]).select(payload.clean_path(F.col("text")).alias("x")).first().x == want


def test_clean_lines_and_ids(spark):
    df = spark.createDataFrame([(["a\0b", "y" * 10_001, ""], "a b/é:_-.9" + "z" * 200), (None, None)], "lines array<string>, id string")
    got = df.select(payload.clean_lines(F.col("lines")).alias("l"), payload.clean_id(F.col("id")).alias("i")).collect()
    assert (got[0].l, got[0].i) == (["ab", "y" * 10_000, ""], ("ab/:_-.9" + "z" * 200)[:100]) and (got[1].l, got[1].i) == ([], "")


def test_suffix(spark):
    rows = [("a/b.GO", "GO"), ("a.b/c", ""), (".x", "x"), ("a." + "e" * 200, "e" * 200), ("a.", "")]
    assert [r.x for r in frame(spark, rows).select(T.suffix(F.col("name")).alias("x")).collect()] == [w for _, w in rows]
