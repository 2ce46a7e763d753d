"""Parsers of conflict markers, resolutions, diffs and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import apply

BOUNDS = "struct<first:int,base:int,middle:int,last:int>"


def hunks(lines: Column) -> Column:
    """The conflict hunks of a file's lines, as (start_line, end_line, ours, theirs, base).

    Only lines that look like markers are folded over, with the section as the state; a hunk is kept as the places of its markers,
    and its lines are sliced out at the end, so the work is linear in the lines."""
    kind = lambda x: F.when(F.startswith(x, F.lit("<<<<<<<")), 1).when(F.startswith(x, F.lit("|||||||")), 2).when(x == "=======", 3).when(F.startswith(x, F.lit(">>>>>>>")), 4).otherwise(0)
    marks = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("n"), kind(x).alias("kind"))), lambda m: m["kind"] > 0)
    zero = F.lit(0)
    start = F.struct(zero.alias("at"), zero.alias("first"), zero.alias("base"), zero.alias("middle"), F.array().cast(f"array<{BOUNDS}>").alias("out"))

    def step(s: Column, m: Column) -> Column:
        at, k, n = s["at"], m["kind"], m["n"]  # at: 0 outside, 1 ours, 2 base, 3 theirs
        opens, to_base, to_theirs, closes = (at == 0) & (k == 1), (at == 1) & (k == 2), at.isin(1, 2) & (k == 3), (at == 3) & (k == 4)
        hunk = F.struct(s["first"].alias("first"), s["base"].alias("base"), s["middle"].alias("middle"), n.alias("last"))
        return F.struct(
            F.when(opens, 1).when(to_base, 2).when(to_theirs, 3).when(closes, 0).otherwise(at).alias("at"),
            F.when(opens, n).otherwise(s["first"]).alias("first"),
            F.when(opens, 0).when(to_base, n).otherwise(s["base"]).alias("base"),
            F.when(to_theirs, n).otherwise(s["middle"]).alias("middle"),
            F.when(closes, F.concat(s["out"], F.array(hunk))).otherwise(s["out"]).alias("out"),
        )

    between = lambda a, b: F.slice(lines, a + 1, b - a - 1)
    cut = lambda h: F.struct(
        h["first"].alias("start_line"), h["last"].alias("end_line"),
        between(h["first"], F.when(h["base"] > 0, h["base"]).otherwise(h["middle"])).alias("ours"),
        between(h["middle"], h["last"]).alias("theirs"),
        F.when(h["base"] > 0, between(h["base"], h["middle"])).otherwise(F.array().cast("array<string>")).alias("base"),
    )
    return F.transform(F.aggregate(marks, start, step)["out"], cut)


def hunk_rows(files: DataFrame) -> DataFrame:
    """(doc_id, path, lines, idx, start_line, end_line, ours, theirs, base): a row for each hunk of files with lines."""
    return files.select("doc_id", "path", "lines", F.posexplode(hunks(F.col("lines"))).alias("idx", "h")).select("doc_id", "path", "lines", F.col("idx").cast("long"), "h.*")


ANSWER = "struct<resolutions:array<struct<file_path:string,start_line:int,end_line:int,resolved_lines:array<string>,confidence:double,reasoning:string,go_specific_notes:string>>,_corrupt:string>"


def json_resolutions(text: Column) -> Column:
    """The resolutions of an answer: what stands between its first opening and last closing brace, as JSON; null where that is none.

    Notes are added to the reasoning, and a Go file's resolution with a sign of broken code loses a fifth of its confidence."""
    j = F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), ANSWER, {"columnNameOfCorruptRecord": "_corrupt"})

    def whole(r: Column) -> Column:
        path, why, notes, lines = (F.coalesce(r[c], F.lit("")) for c in ("file_path", "reasoning", "go_specific_notes", "file_path"))
        lines = F.coalesce(r["resolved_lines"], F.array().cast("array<string>"))
        noted = F.when(notes == "", why).when(why == "", F.concat(F.lit("Go-specific: "), notes)).otherwise(F.concat(why, F.lit(" [Go-specific: "), notes, F.lit("]")))
        confidence = F.coalesce(r["confidence"], F.lit(0.0))
        confidence = F.when(T.is_go(path) & apply.go_broken(lines), confidence * 0.8).otherwise(confidence)
        number = lambda c: F.coalesce(r[c], F.lit(0))
        return F.struct(path.alias("file_path"), number("start_line").alias("start_line"), number("end_line").alias("end_line"), lines.alias("resolved_lines"), confidence.alias("confidence"), noted.alias("reasoning"))

    return F.when(j.isNotNull() & j["_corrupt"].isNull(), F.transform(F.coalesce(j["resolutions"], F.array().cast("array<struct<file_path:string,start_line:int,end_line:int,resolved_lines:array<string>,confidence:double,reasoning:string,go_specific_notes:string>>")), whole))


def text_resolutions(text: Column) -> Column:
    """The well-formed resolutions of a plain-text answer; null where there is none.

    A line with a file opens one; lines with a range, a confidence or a reasoning fill it in; from the first that speaks of a resolution on,
    lines are its content, but for blank ones, rules and comments."""
    # Each record's lines are one slice, and what is in it is looked up there: the work is linear in the lines.
    opened = lambda ls: F.filter(F.transform(ls, lambda x, i: F.struct((i + 1).alias("n"), F.regexp_extract(x, r"(?i)file:?\s*(.+)", 1).alias("file"))), lambda m: m["file"] != "")
    record = lambda ls, ms, m, k: F.struct(m["file"].alias("file"), F.slice(ls, m["n"], F.coalesce(F.get(ms, k + 1)["n"], F.size(ls) + 1) - m["n"]).alias("lines"))
    records = T.let(F.transform(F.split(text, "\n", -1), T.trimmed), lambda ls: T.let(opened(ls), lambda ms: F.transform(ms, lambda m, k: record(ls, ms, m, k))))
    begins = lambda x: T.contains_any(F.lower(x), ["resolution", "resolved"])
    parted = F.transform(records, lambda r: r.withField("head", F.coalesce(F.array_min(F.filter(F.transform(r["lines"], lambda x, i: F.when(begins(x), i + 1)), lambda i: i.isNotNull())), F.size(r["lines"]))))
    last = lambda lines, found, other: F.coalesce(F.try_element_at(F.filter(F.transform(lines, found), lambda v: v.isNotNull()), F.lit(-1)), other)
    content = lambda x: (x != "") & ~T.contains_any(x, ["---", "==="]) & ~F.startswith(x, F.lit("#")) & ~F.startswith(x, F.lit("//"))

    def resolution(r: Column) -> Column:
        lines = r["lines"]
        number = lambda g: last(F.slice(lines, F.lit(1), r["head"]), lambda x: F.regexp_extract(x, r"(?i)lines?\s*(\d+)-(\d+)", g).try_cast("int"), F.lit(0))
        said = F.filter(F.transform(lines, lambda x: T.trimmed(F.regexp_extract(x, r"(?i)reasoning:?\s*(.+)", 1))), lambda w: w != "")
        return F.struct(
            T.trimmed(r["file"]).alias("file_path"),
            number(1).alias("start_line"),
            number(2).alias("end_line"),
            F.filter(F.slice(lines, r["head"] + 1, F.size(lines)), content).alias("resolved_lines"),
            last(lines, lambda x: F.regexp_extract(x, r"(?i)confidence:?\s*([0-9.]+)", 1).try_cast("double"), F.lit(0.5)).alias("confidence"),
            F.coalesce(F.try_element_at(said, F.lit(-1)), F.lit("")).alias("reasoning"),
        )

    every = F.transform(parted, resolution)
    good = F.filter(every, lambda r: apply.problem(r["file_path"], r["start_line"], r["end_line"], r["resolved_lines"], r["confidence"]) == "")
    return T.let(good, lambda g: F.when(F.size(g) > 0, g))


def answer_resolutions(text: Column) -> Column:
    """JSON where an answer has it, and else plain text."""
    return F.coalesce(json_resolutions(text), text_resolutions(text))


def diff_rows(diffs: DataFrame) -> DataFrame:
    """(doc_id, file_no, hunk_no, old_path, new_path, old_start, old_lines, new_start, new_lines, header, added, removed) of unified diffs (doc_id, text); every hunk counts, the last of each file too."""
    each = diffs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    order = Window.partitionBy("doc_id").orderBy("n")
    head = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)\z"
    each = each.withColumn("file_no", F.sum(F.when(F.startswith("line", F.lit("diff --git ")), 1).otherwise(0)).over(order)).withColumn("is_head", F.col("line").rlike(head))
    named = lambda g: F.last(F.when(F.startswith("line", F.lit("diff --git ")), F.regexp_extract("line", r"^diff --git a/(.*) b/(.*)\z", g)), ignorenulls=True).over(order)
    each = each.withColumn("old_path", named(1)).withColumn("new_path", named(2))
    each = each.withColumn("hunk_no", F.sum(F.when(F.col("is_head"), 1).otherwise(0)).over(Window.partitionBy("doc_id", "file_no").orderBy("n"))).filter("hunk_no > 0")
    part = lambda g: F.max(F.when(F.col("is_head"), F.regexp_extract("line", head, g)))
    number = lambda g: F.coalesce(F.when(part(g) != "", part(g).cast("long")), F.lit(1).cast("long"))
    count = lambda c: F.count_if(~F.col("is_head") & F.startswith("line", F.lit(c))).cast("long")
    return each.groupBy("doc_id", "file_no", "hunk_no").agg(
        F.max("old_path").alias("old_path"), F.max("new_path").alias("new_path"), number(1).alias("old_start"), number(2).alias("old_lines"), number(3).alias("new_start"), number(4).alias("new_lines"), F.trim(part(5)).alias("header"), count("+").alias("added"), count("-").alias("removed")
    )


ACTIONS = {"read": r"(?i)reading\s+file:?\s+(.+)", "write": r"(?i)writing\s+to\s+file:?\s+(.+)", "bash": r"(?i)executing:?\s+(.+)"}


def actions(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, action, target): what the lines of a text say was done; a line may say several things."""
    each = texts.select(*keys, F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    found = F.array(*[F.struct(F.lit(k).alias("action"), F.regexp_extract("line", p, 1).alias("target")) for k, p in ACTIONS.items()])
    return each.select(*keys, F.col("n").cast("long"), F.explode(found).alias("a")).select(*keys, "n", "a.*").filter("target != ''")
