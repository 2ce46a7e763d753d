"""Checks of a language's lines: brackets, line ends, indents, unreachable code, imports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import text as T

NONE = "array<string>"


def none() -> Column:
    return F.array().cast(NONE)


def said(cond: Column, message: str | Column) -> Column:
    return F.when(cond, F.array(message if isinstance(message, Column) else F.lit(message))).otherwise(none())


def at_lines(lines: Column, test, message: str, shift: int = 1) -> Column:
    """A message for each line that test, of it and the next one, holds for."""
    after = F.slice(lines, 2, F.size(lines))
    pairs = F.arrays_zip(lines.alias("line"), after.alias("after"))
    found = F.filter(F.transform(pairs, lambda p, i: F.when(test(p["line"], p["after"]), F.concat(F.lit("Line "), (i + shift).cast("string"), F.lit(": " + message)))), lambda x: x.isNotNull())
    return F.when(F.size(lines) > 0, found).otherwise(none())


def brackets(lines: Column, kinds: str, prefix: str) -> Column:
    """Which kinds of brackets do not balance."""
    code = F.array_join(lines, "\n")
    each = {"{": ("}", "braces"), "(": (")", "parentheses"), "[": ("]", "brackets")}
    return F.concat(*[said(T.imbalance(code, k, each[k][0]) != 0, f"{prefix} {each[k][1]}") for k in kinds])


def open_end(line: Column) -> Column:
    """Whether a line may want a semicolon."""
    return (line != "") & ~reduce(lambda a, b: a | b, [F.endswith(line, F.lit(c)) for c in (";", "{", "}")]) & ~F.contains(line, F.lit("//"))


def odd_indent(line: Column) -> Column:
    indent = F.length(line) - F.length(F.regexp_replace(line, r"^[ \t]+", ""))
    return (T.trimmed(line) != "") & (indent % 4 != 0) & (indent % 2 != 0)


def no_colon(line: Column) -> Column:
    """Whether a control line lacks its colon."""
    t = T.trimmed(line)
    return reduce(lambda a, b: a | b, [F.startswith(t, F.lit(c)) for c in dims.PYTHON_CONTROL]) & ~F.endswith(t, F.lit(":"))


def syntax(language: Column, lines: Column) -> Column:
    """(errors, warnings) of lines by their language's checks; any other language gets warnings alone."""
    t = F.transform(lines, T.trimmed)
    all_kinds = brackets(lines, "{([", "Unbalanced")
    both = lambda e, w: F.struct(e.alias("errors"), w.alias("warnings"))
    missing = "Possible missing semicolon"
    script = both(all_kinds, at_lines(t, lambda x, _: open_end(x), missing))
    return (
        F.when(language == "go", both(all_kinds, at_lines(t, lambda x, _: F.endswith(x, F.lit(";")) & ~F.contains(x, F.lit("for")), "Unnecessary semicolon in Go")))
        .when(language.isin("javascript", "typescript"), script)
        .when(language == "java", both(all_kinds, at_lines(t, lambda x, _: open_end(x) & ~F.startswith(x, F.lit("package ")) & ~F.startswith(x, F.lit("import ")), missing)))
        .when(language == "python", both(F.concat(at_lines(lines, lambda x, _: no_colon(x), "Missing colon"), brackets(lines, "([", "Unbalanced")), at_lines(lines, lambda x, _: odd_indent(x), "Inconsistent indentation")))
        .otherwise(both(none(), brackets(lines, "{([", "Potentially unbalanced")))
    )


def unreachable(lines: Column) -> Column:
    """Warnings of lines that follow a return; never an error."""
    t = F.transform(lines, T.trimmed)
    hit = lambda x, after: ~T.contains_any(x, ["var ", "let ", "const "]) & F.contains(x, F.lit("return")) & after.isNotNull() & (after != "") & ~F.startswith(after, F.lit("}"))
    return at_lines(t, hit, "Possible unreachable code after return", 2)


def outcome(there: Column, language: Column, found: Column, marked: Column) -> Column:
    """(valid, syntax_valid) of a resolution: a file that is missing ends the checks; faults of syntax only warn; markers that are left do not pass."""
    return F.struct((there & ~marked).alias("valid"), (~there | (language == "") | (F.size(found["errors"]) == 0)).alias("syntax_valid"))


def imports(lines: Column) -> Column:
    """Import lines of Go code: single ones, and those between the brackets of a block, after a tab."""
    opens = lambda x: F.startswith(x, F.lit("import ("))
    turn = lambda x, i: F.struct((i + 1).alias("n"), opens(x).alias("opens"), (opens(x) | F.startswith(x, F.lit(")"))).alias("turns"))
    first = F.array(F.struct(F.lit(0).alias("n"), F.lit(False).alias("opens"), F.lit(True).alias("turns")))

    def part(t: Column, marks: Column, m: Column, k: Column) -> Column:
        own = F.slice(t, m["n"] + 1, F.coalesce(F.get(marks, k + 1)["n"], F.size(t) + 1) - m["n"] - 1)
        line = lambda x: F.when(F.startswith(x, F.lit('import "')), x).when(m["opens"] & (x != "") & ~F.startswith(x, F.lit("//")), F.concat(F.lit("\t"), x))
        return F.filter(F.transform(own, line), lambda x: x.isNotNull())

    parts = lambda t: T.let(F.concat(first, F.filter(F.transform(t, turn), lambda m: m["turns"])), lambda marks: F.transform(marks, lambda m, k: part(t, marks, m, k)))
    return F.flatten(T.let(F.transform(lines, T.trimmed), parts))
