"""Operators on their edge cases."""

import pytest
from pyspark.sql import functions as F

from mergelake import catalogue
from mergelake.functions import text as T
from mergelake.operators import apply, checks, order, parse, payload, resolver
from mergelake.streaming import detect


def parsed(spark, text):
    df = spark.createDataFrame([(1, "a.go", text.split("\n"))], "doc_id long, path string, lines array<string>")
    return [(r.start_line, r.end_line, r.ours, r.theirs, r.base) for r in parse.hunk_rows(df).orderBy("idx").collect()]


def test_long_file_parses(spark):
    """Linear in the lines: a file of 200 000 lines with two hunks."""
    body = ["x"] * 100_000
    got = parsed(spark, "\n".join(["<<<<<<<", *body, "=======", ">>>>>>>", "<<<<<<<", "=======", *body, ">>>>>>>"]))
    assert [(a, b, len(o), len(t)) for a, b, o, t, _ in got] == [(1, 100_003, 100_000, 0), (100_004, 200_006, 0, 100_000)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a\n<<<<<<< x\n1\n=======\n2\n>>>>>>> y\nb", [(2, 6, ["1"], ["2"], [])]),
        ("<<<<<<<\n1\n||||||| o\n0\n=======\n2\n>>>>>>>", [(1, 7, ["1"], ["2"], ["0"])]),
        ("<<<<<<<\n1\n=======\n2", []),
        ("<<<<<<<\n=======\r\n=======\n>>>>>>>", [(1, 4, ["=======\r"], [], [])]),
        ("<<<<<<<\n<<<<<<<\n=======\n|||||||\n>>>>>>>", [(1, 5, ["<<<<<<<"], ["|||||||"], [])]),
        ("", []),
        ("=======\n>>>>>>>", []),
        ("<<<<<<<\n=======\n>>>>>>>\n<<<<<<<\nx\n=======\n>>>>>>>", [(1, 3, [], [], []), (4, 7, ["x"], [], [])]),
    ],
)
def test_hunks(spark, text, want):
    assert parsed(spark, text) == want


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0]


def test_text(spark):
    assert one(spark, T.extension(F.col("p")), p="a.b/.gitignore") == ".gitignore"
    assert one(spark, T.extension(F.col("p")), p="a.b/Makefile") == ""
    assert one(spark, T.trimmed(F.col("p")), p="\t  a b \n") == "a b"
    assert one(spark, T.strict_path(F.col("p")), p="src/a.go\n") is False
    assert one(spark, T.detect_excluded(F.col("p")), p="x.org") is True
    assert one(spark, T.redact(F.col("p")), p="PASSWORD = x y, secret: z, Bearer a.b") == "[REDACTED] y, [REDACTED], [REDACTED]"


def test_splice(spark):
    lines = F.array(*map(F.lit, "abcde"))
    assert one(spark, apply.splice(lines, F.lit(2), F.lit(3), F.array(F.lit("X"))), p=1) == ["a", "X", "d", "e"]
    assert one(spark, apply.splice(lines, F.lit(5), F.lit(5), F.array().cast("array<string>")), p=1) == ["a", "b", "c", "d"]
    past = F.array(F.struct(F.lit(5).alias("start_line"), F.lit(6).alias("end_line"), F.array(F.lit("X")).alias("resolved_lines")))
    assert one(spark, apply.splice_all(lines, past), p=1) is None


def test_depth(spark):
    ok = lambda s: one(spark, apply.depth_ok(F.split("p", "\n")), p=s)
    assert ok("a {\n}") and not ok("}{") and not ok("{")


def greedy(tokens, most):
    """Packing one by one."""
    out, batch, used, held = [], 0, 0, 0
    for t in tokens:
        if used + t > most and held:
            batch, used, held = batch + 1, 0, 0
        out.append(batch)
        used, held = used + t, held + 1
        if t > most:
            batch, used, held = batch + 1, 0, 0
    return out


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_packing(spark, block):
    import random

    r = random.Random(block)
    for tokens in ([30, 30, 60, 10, 10], [60, 60], [0, 0, 50, 0, 51, 0], [r.choice((0, 5, 10, 20, 49, 50, 51, 90)) for _ in range(40)]):
        df = spark.createDataFrame([(k * 3, t) for k, t in enumerate(tokens)], "key long, tokens long").repartition(3)
        got = {x.key: x.batch for x in order.packed(df, "key", "tokens", 50, block).collect()}
        assert [got[k * 3] for k in range(len(tokens))] == greedy(tokens, 50)


def test_ordinal(spark):
    df = order.ordinal(spark.range(0, 5000, 7).withColumnRenamed("id", "k"), "k")
    assert df.filter("ordinal * 7 <> k").count() == 0


def test_resolver_retries(spark):
    def failing(hunk_id, ours, theirs, turn):
        raise ValueError("no model")

    h = spark.createDataFrame([("a:0", ["1"], ["2"])], "hunk_id string, ours array<string>, theirs array<string>")
    row = resolver.resolve(h, failing, retries=1, wait=0.01).first()
    assert (row.error, row.confidence, row.resolved_lines) == ("no model", 0.0, [])


def test_stream_restarts(spark, tmp_path):
    rows = [(k, f"f{k}.go", ["<<<<<<<", "a", "=======", "b", ">>>>>>>"]) for k in range(6)]
    df = spark.createDataFrame(rows, detect.SCHEMA)
    for part in range(2):
        df.filter(f"doc_id % 2 = {part}").write.mode("append").parquet(str(tmp_path / "in"))
        detect.detect(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.json(str(tmp_path / "out")).count() == 6


def test_ordinal_within_a_large_group(spark, sf_dir):
    df = spark.createDataFrame([(k * 7 % 301, None if k % 50 == 0 else "big" if k % 3 else "small") for k in range(301)], "id long, lang string").repartition(3)
    places = {}
    for r in sorted(order.ordinal(df, "id", "n", within="lang").collect(), key=lambda r: r.id):
        places.setdefault(r.lang, []).append(r.n)
    assert sum(map(len, places.values())) == 301 and all(p == list(range(len(p))) for p in places.values())
    plan = catalogue.QUERIES["batches_by_language"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "__bucket" in plan  # no window over a whole language


def answers(spark, text, parser):
    rows = one(spark, parser(F.col("p")), p=text)
    return rows and [(r.file_path, r.start_line, r.end_line, list(r.resolved_lines), round(r.confidence, 6), r.reasoning) for r in rows]


def test_answers(spark):
    text = "profile a.go\nLines 2-4\nlines 3-x\nconfidence: 0.7.1\nConfidence 0.9\nreasoning: why\nThe resolution:\n  x = 1 \n\n# no\n// no\n--- no\nlines 8-9\nfile: b.py\nlines 1-1\nresolved"
    assert answers(spark, text, parse.text_resolutions) == [("a.go", 2, 4, ["x = 1", "lines 8-9"], 0.9, "why")]
    assert answers(spark, "nothing here", parse.text_resolutions) is None
    assert answers(spark, 'so {"resolutions": []} done', parse.json_resolutions) == []
    assert answers(spark, "so {broken} done", parse.json_resolutions) is None
    json = '{"resolutions": [{"file_path": "A.GO", "start_line": 1, "end_line": 2, "resolved_lines": ["if x", "y"], "confidence": 0.5, "go_specific_notes": "n"}]}'
    assert answers(spark, json, parse.answer_resolutions) == [("A.GO", 1, 2, ["if x", "y"], 0.4, "Go-specific: n")]
    assert answers(spark, json.replace("A.GO", "a.py"), parse.answer_resolutions)[0][4] == 0.5


VALID = '{"files":[{"path":"a.go","language":"Go","conflicts":[{"id":"a:0","start_line":1,"end_line":5,"ours_lines":["x"],"theirs_lines":[]}],"context":{}}],"metadata":{"repo_path":"/w"}}'


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (VALID, (True, None, None, None, 0)),
        ("", (False, None, "payload", "required", 1)),
        ("{", (False, None, "payload", "json", 1)),
        ("[]", (False, None, "payload", "decode", 1)),
        (VALID.replace('"id"', '"ID"'), (False, None, "payload", "decode", 1)),
        (VALID.replace('"start_line":1', '"start_line":"1"'), (False, None, "payload", "decode", 1)),
        (VALID.replace('"path":"a.go"', '"path":""'), (False, "Field 'Path' is required", "Path", "required", 1)),
        (VALID.replace("a.go", "/etc/x"), (False, "Field 'Path' contains invalid file path", "Path", "filepath", 1)),
        (VALID.replace('"end_line":5', '"end_line":1'), (False, "Field 'EndLine' must be greater than StartLine", "EndLine", "gtfield", 1)),
        (VALID.replace('"start_line":1', '"start_line":0').replace('"Go"', '"cobol"'), (False, "Field 'Language' contains unsupported language", "Language", "language", 2)),
        (VALID.replace('"theirs_lines":[]', '"theirs_lines":null'), (False, "Field 'TheirsLines' is required", "TheirsLines", "required", 1)),
        (VALID.replace('["x"]', '["a","\\u0002"]'), (False, "Field 'OursLines[1]' contains unsafe content", "OursLines[1]", "safe_content", 1)),
        ('{"metadata":{"repo_path":"/w"}}', (False, "Field 'Files' is required", "Files", "required", 1)),
        ('{"files":[],"metadata":{"repo_path":"a;b"}}', (False, "Field 'RepoPath' contains invalid repository path", "RepoPath", "repo_path", 1)),
        ('{"files":[' + ",".join(['{"path":"a","language":"c","conflicts":[],"context":{}}'] * 2) + '],"metadata":{"repo_path":"/w"}}', (False, "duplicate", "files[0].path", "duplicate", 1)),
        ('{"files":[' + ",".join(f'{{"path":"a{k}","language":"c","conflicts":[],"context":{{}}}}' for k in range(1001)) + '],"metadata":{"repo_path":"/w"}}', (False, "Field 'Files' exceeds maximum length of 1000", "Files", "max", 1)),
    ],
)
def test_payload_rules(spark, text, want):
    r = payload.validated(spark.createDataFrame([(text,)], "text string")).first()
    message = r.message if r.stage in ("fields", "business") else None
    assert (r.valid, message, r.field, r.tag, r.n_errors) == want


def test_predicates_in_sql(spark):
    T.register_predicates(spark)
    ask = lambda e: spark.sql(f"SELECT {e} AS x").first()[0]
    assert ask("is_filepath('src/a.go')") and not ask("is_filepath('a//b')") and not ask("is_filepath('/ETC/x')") and not ask("is_filepath('')")
    assert ask("is_language('GO')") and not ask("is_language('cobol')")
    assert ask("is_conflict_id('')") and ask("is_conflict_id('a/b.go:1')") and not ask("is_conflict_id('a b')")
    assert ask("is_safe_content(concat('a', chr(9)))") and not ask("is_safe_content(concat('a', chr(2)))") and not ask("is_safe_content(repeat('a', 10001))")
    assert ask("is_repo_path('/w')") and not ask("is_repo_path('a;b')")


def test_syntax(spark):
    def found(language, *lines):
        r = one(spark, checks.syntax(F.lit(language), F.split("p", "\n")), p="\n".join(lines))
        return list(r.errors), list(r.warnings)

    assert found("go", "x;", "for ;", "{") == (["Unbalanced braces"], ["Line 1: Unnecessary semicolon in Go"])
    assert found("javascript", "a", "b;", "c // d", "(") == (["Unbalanced parentheses"], ["Line 1: Possible missing semicolon", "Line 4: Possible missing semicolon"])
    assert found("java", "package x", "import y", "z") == ([], ["Line 3: Possible missing semicolon"])
    assert found("python", "if x", "   y", "while z:", "]{") == (["Line 1: Missing colon", "Unbalanced brackets"], ["Line 2: Inconsistent indentation"])
    assert found("ruby", "{", "if") == ([], ["Potentially unbalanced braces"])
    assert one(spark, checks.unreachable(F.split("p", "\n")), p="return 1\nx\nconst return\ny\nreturn\n}") == ["Line 2: Possible unreachable code after return"]
    assert one(spark, checks.imports(F.split("p", "\n")), p='import "a"\nimport (\n  "b"\n\n// c\n)\n)\nx') == ['import "a"', '\t"b"']


def test_go_factor(spark):
    factor = lambda *lines: round(one(spark, apply.go_factor(F.split("p", "\n")), p="\n".join(lines)), 6)
    assert factor("func a() {", "}") == 1.1
    assert factor("func a() {", "}", "func a() {", "}") == 0.77
    assert factor("import (", ")") == 0.33
    assert factor('import "x') == 0.88
    assert factor("1") == 1.0


def test_splice_in_turn(spark):
    """A range that fits only before a later one is cut fails its file."""
    lines = F.array(*map(F.lit, "abcde"))
    r = lambda a, b, *new: F.struct(F.lit(a).alias("start_line"), F.lit(b).alias("end_line"), F.array(*map(F.lit, new)).cast("array<string>").alias("resolved_lines"))
    assert one(spark, apply.splice_all(lines, F.array(r(1, 1, "X", "Y"), r(4, 5, "Z"))), p=1) == ["X", "Y", "b", "c", "Z"]
    assert one(spark, apply.splice_all(lines, F.array(r(2, 5), r(3, 5))), p=1) is None


@pytest.mark.parametrize("n", [10, 2000, 20000])
def test_ordinal_of_a_computed_key(spark, n):
    """In a session of its own, as the first query: the key is computed from a range and joined with what is counted from it."""
    fresh = spark.newSession()
    df = fresh.range(n).select((F.col("id") * 7919 % n).alias("k"), (F.col("id") % 3).alias("w"))
    if n == 10:
        df = fresh.range(n).select(((F.col("id") * 7) % 10).alias("k"), (F.col("id") % 3).alias("w"))
    assert all(r.ordinal == r.k for r in order.ordinal(df, "k").collect())
    got = order.ordinal(df, "k", within="w").collect()
    assert all(sorted(r.ordinal for r in got if r.w == w) == list(range(sum(r.w == w for r in got))) for w in range(3))


def test_answers_and_imports_are_linear(spark):
    """A text answer with one long resolution, one with many, and a long import block."""
    one = "File: a.go\nLines 1-2\nresolved\n" + "\n".join(f"code {k}" for k in range(40_000))
    many = "\n".join(f"File: f{k}.go\nLines 1-{k + 2}\nConfidence: 0.5\nresolved:\ncode {k}" for k in range(6_000))
    got = {r.n: r.out for r in spark.createDataFrame([(1, one), (2, many)], "n int, t string").select("n", parse.text_resolutions(F.col("t")).alias("out")).collect()}
    assert len(got[1]) == 1 and got[1][0].resolved_lines == [f"code {k}" for k in range(40_000)]
    assert [(r.file_path, r.end_line, r.resolved_lines) for r in got[2]] == [(f"f{k}.go", k + 2, [f"code {k}"]) for k in range(6_000)]
    lines = ["import (", *[f'"p{k}"' for k in range(20_000)], "", "// x", ")", 'import "z"', "y"]
    found = spark.createDataFrame([(lines,)], "l array<string>").select(checks.imports(F.col("l")).alias("i")).first().i
    assert found == [f'\t"p{k}"' for k in range(20_000)] + ['import "z"']
