"""Splicing resolutions into files, and their checks and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import text as T


def splice(lines: Column, start: Column, end: Column, new: Column) -> Column:
    """lines with the 1-based inclusive range replaced."""
    return F.concat(F.slice(lines, F.lit(1), start - 1), new, F.slice(lines, end + 1, F.greatest(F.size(lines) - end, F.lit(0))))


def splice_all(lines: Column, resolutions: Column) -> Column:
    """All (start_line, end_line, resolved_lines) spliced, the last range first; null where one ends past the file as it is when its turn comes."""
    order = F.reverse(F.array_sort(resolutions))
    return F.aggregate(order, lines, lambda ls, r: F.when(r["end_line"] <= F.size(ls), splice(ls, r["start_line"], r["end_line"], r["resolved_lines"])))


def problem(path: Column, start: Column, end: Column, new: Column, confidence: Column) -> Column:
    """The first thing wrong with a resolution; empty where nothing is."""
    return (
        F.when(path == "", "file path is empty")
        .when(start <= 0, "start line must be positive")
        .when(end < start, "end line before start line")
        .when(F.size(new) == 0, "no resolved lines")
        .when((confidence < 0) | (confidence > 1), "confidence out of range")
        .when(F.exists(new, T.is_marker), "conflict marker in resolution")
        .otherwise("")
    )


def concatenated(results: list[DataFrame]) -> DataFrame:
    """The results of batches as one table, columns by name; what a batch does not have is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)


def tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.6, "medium").otherwise("low")


def go_factor(lines: Column) -> Column:
    """How the looks of Go code change a confidence: syntax, signatures, imports, idiom."""
    code = F.array_join(lines, "\n")
    balanced = reduce(lambda a, b: a & b, [T.imbalance(code, o, c) == 0 for o, c in ("{}", "()", "[]")])
    syntax = balanced & ~T.contains_any(code, dims.GO_REJECTED)
    names = F.filter(go_function_names(lines), lambda x: x != "")
    unique = F.size(names) == F.size(F.array_distinct(names))
    cut = lambda x: x.rlike(r"^\s*import\s+") & F.contains(x, F.lit('import "')) & ~F.endswith(F.regexp_extract(x, r'import "(.*)\z', 1), F.lit('"'))
    # Naming always counts one; one more of the others makes an idiom.
    idiom = T.contains_any(code, dims.GO_ERRORS) | F.contains(code, F.lit("defer ")) | code.rlike(r"\b[a-z][a-zA-Z0-9]*\b") | code.rlike(r"\b[A-Z][A-Z0-9_]*\b")
    return F.when(syntax, 1.0).otherwise(0.3) * F.when(unique, 1.0).otherwise(0.7) * F.when(F.exists(lines, cut), 0.8).otherwise(1.0) * F.when(idiom, 1.1).otherwise(1.0)


def go_function_names(lines: Column) -> Column:
    """The word after func of each line with a function's signature, up to its bracket."""
    return F.transform(F.filter(lines, lambda x: x.rlike(dims.GO_FUNCTION)), lambda x: F.regexp_extract(x, r"^\s*func\s+([^\s(]*)", 1))


def clamped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def go_issues(lines: Column) -> dict[str, Column]:
    """Signs of broken Go code in lines, by name."""
    code = F.array_join(lines, "\n")
    trimmed = F.transform(lines, T.trimmed)
    incomplete = F.exists(trimmed, lambda x: x.rlike(r"func\s+\w+\([^)]*\)[^{]*\z") & ~F.contains(x, F.lit("{")))
    handled = dims.GO_HANDLED
    calls = lambda x: F.contains(x, F.lit("(")) & F.contains(x, F.lit(")")) & F.contains(x, F.lit(", err"))
    # A line beside the two after it, as three arrays zipped: an array that a function of each line looks into would be made anew for every line.
    ahead = lambda k: F.slice(F.concat(trimmed, F.array_repeat(F.lit(""), 2)), F.lit(k + 1), F.size(lines))
    ahead_two = F.arrays_zip(trimmed.alias("x"), ahead(1).alias("y"), ahead(2).alias("z"))
    unhandled = F.exists(ahead_two, lambda r: calls(r["x"]) & ~T.contains_any(r["y"], handled) & ~T.contains_any(r["z"], handled))
    return {"incomplete_function": incomplete, "bad_declaration": T.contains_any(code, dims.BAD_DECLARATIONS), "type_mismatch": T.contains_any(code, dims.TYPE_MISMATCHES), "unhandled_error": unhandled, "bad_depth": ~depth_ok(lines), "open_control": F.exists(trimmed, open_control)}


def open_control(line: Column) -> Column:
    """Whether a trimmed line begins a control structure and has no brace."""
    return line.rlike("^(" + "|".join(dims.GO_CONTROL) + r")[ (]") & ~F.contains(line, F.lit("{"))


def go_broken(lines: Column) -> Column:
    """Whether lines have any sign of broken Go code."""
    return reduce(lambda a, b: a | b, go_issues(lines).values())


def depth_ok(lines: Column) -> Column:
    """Whether braces never close more than is open, and all are closed."""
    state = F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok"))

    def step(s: Column, c: Column) -> Column:
        d = s["d"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(d.alias("d"), (s["ok"] & (d >= 0)).alias("ok"))

    braces = F.split(F.regexp_replace(F.array_join(lines, ""), r"[^{}]", ""), "")
    return F.aggregate(braces, state, step, lambda s: s["ok"] & (s["d"] == 0))
