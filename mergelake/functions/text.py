"""Column helpers for lines, paths and code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims


def lines(text: Column) -> Column:
    """Lines as cut at each line feed; a trailing one leaves an empty line."""
    return F.split(text, "\n", -1)


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+\z", "")


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f's result names it, also inside other lambdas."""
    return F.get(F.transform(F.array(value), f), 0)


def extension(path: Column) -> Column:
    """From the last dot of the last path element; empty where there is none."""
    return F.regexp_extract(path, r"(\.[^./]*)\z", 1)


def suffix(path: Column) -> Column:
    """The extension without its dot; empty where there is none."""
    return F.regexp_replace(extension(path), r"^\.", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def contains_any(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def mapped(ext: Column, table: dict[str, list[str]], other: str) -> Column:
    """The key whose list has the extension."""
    out = F.lit(other)
    for key, values in table.items():
        out = F.when(ext.isin(values), F.lit(key)).otherwise(out)
    return out


def detect_language(path: Column) -> Column:
    return mapped(F.lower(extension(path)), dims.DETECT_LANGUAGE, "text")


def payload_language(path: Column) -> Column:
    low = F.lower(path)
    named = F.when(F.endswith(low, F.lit("dockerfile")), "dockerfile").when(F.endswith(low, F.lit("makefile")), "makefile").otherwise("text")
    known = [e for v in dims.PAYLOAD_LANGUAGE.values() for e in v]
    return F.when(F.lower(extension(path)).isin(known), mapped(F.lower(extension(path)), dims.PAYLOAD_LANGUAGE, "text")).otherwise(named)


def detect_excluded(path: Column) -> Column:
    return contains_any(F.lower(path), dims.DETECT_EXCLUDED)


def payload_excluded(path: Column) -> Column:
    return contains_any(path, dims.PAYLOAD_EXCLUDED) | F.lower(extension(path)).isin(dims.BINARY_EXTENSIONS)


def strict_path(path: Column) -> Column:
    """Relative, without a step up, of plain characters."""
    return path.rlike(r"^[a-zA-Z0-9._/-]+\z") & ~F.contains(path, F.lit("..")) & ~F.startswith(path, F.lit("/"))


def shell_safe(path: Column) -> Column:
    return (F.length(path) > 0) & ~path.rlike(r"[;|&`$]")


def payload_path(path: Column) -> Column:
    low = F.lower(path)
    prefixed = reduce(lambda a, b: a | b, [F.startswith(low, F.lit(p)) for p in dims.UNSAFE_PREFIXES])
    size = F.octet_length(path)
    return ~contains_any(path, dims.UNSAFE_TOKENS) & ~path.rlike(r"[\x00\n\r]") & ~prefixed & (size > 0) & (size < 500) & (path != "/")


def redact(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, "[REDACTED]"), dims.REDACTED, text)


def count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def imbalance(text: Column, open_: str, close: str) -> Column:
    return (count_of(text, open_) - count_of(text, close)).cast("long")


def is_marker(line: Column) -> Column:
    """Whether a line, trimmed, starts with one of the four conflict markers."""
    return trimmed(line).rlike(r"^(<{7}|={7}|>{7}|\|{7})")


def line_tokens(rows: Column) -> Column:
    """A quarter of each line's bytes, rounded down, summed."""
    return F.aggregate(rows, F.lit(0).cast("bigint"), lambda a, x: a + F.floor(F.octet_length(x) / 4).cast("bigint"))


def retryable(error: Column) -> Column:
    out, low = F.lit(False), F.lower(error)
    for parts, answer in reversed(dims.RETRY_RULES):
        out = F.when(contains_any(low, parts), F.lit(answer)).otherwise(out)
    return out


def text_file(path: Column) -> Column:
    """Whether a path is that of a text file, by its extension or, where it has no dot, its name."""
    return F.when(F.contains(path, F.lit(".")), extension_of_path(path).isin(dims.TEXT_EXTENSIONS)).otherwise(base_name(path).isin(dims.TEXT_NAMES))


def extension_of_path(path: Column) -> Column:
    """From the last dot of a whole path."""
    return F.regexp_extract(path, r"(\.[^.]*)\z", 1)


def apply_language(path: Column) -> Column:
    return mapped(F.lower(extension(path)), dims.APPLY_LANGUAGE, "")


def is_go(path: Column) -> Column:
    return F.endswith(F.lower(path), F.lit(".go"))


def revision(name: Column) -> Column:
    """Whether a revision's name is safe."""
    return name.rlike(r"^[a-zA-Z0-9_-]+\z")


def json_path(path: Column) -> Column:
    """Whether JSON may be read from or written to a path; empty and - stand for the standard streams."""
    return path.isin("", "-") | (~F.contains(path, F.lit("..")) & ~path.rlike(r"[;|&`$]"))


def conflict_id(name: Column) -> Column:
    return (F.octet_length(name) <= 100) & name.rlike(r"^[A-Za-z0-9:_./-]*\z")


def safe_content(line: Column) -> Column:
    """Whether a line is short enough and has no control characters but tab, line feed and carriage return."""
    return (F.octet_length(line) <= dims.MAX_LINE) & ~line.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")


def repo_path(path: Column) -> Column:
    return F.octet_length(path).between(1, 999) & ~path.rlike(r"[;|&`$\x00\r\n]")


def rfc3339(time: Column) -> Column:
    """Whether a text is a time of RFC 3339: a day that exists, T, a time of day, and Z or an offset of hours and minutes; null for null."""
    form = r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)\z"
    return F.when(time.isNotNull(), time.rlike(form) & F.substring(time, 1, 10).try_cast("date").isNotNull())


def first_bytes(text: Column, n: int) -> Column:
    """The first n bytes of a text, as binary: the cut may fall inside a character."""
    return F.substring(text.cast("binary"), 1, n)


def hints(error: Column) -> Column:
    """What to do about a plain error."""
    none = F.array().cast("array<string>")
    return F.flatten(F.array(*[F.when(contains_any(F.lower(error), parts), F.array(*map(F.lit, todo))).otherwise(none) for parts, todo in dims.ERROR_HINTS]))


def status_hints(status: Column) -> Column:
    """What to do about an answer's status code."""
    out = F.array().cast("array<string>")
    for code, todo in dims.STATUS_HINTS.items():
        out = F.when(status == code, F.array(*map(F.lit, todo))).otherwise(out)
    return out


def recoverable(kind: Column, status: Column) -> Column:
    """Whether an error of a kind may be recovered from."""
    return F.when(kind == "api", status >= 500).otherwise(~kind.isin([k for k, ok in dims.RECOVERABLE.items() if not ok]))


def register_predicates(spark) -> None:
    """The five named predicates for SQL, is_filepath and so on: SQL functions, which the optimiser inlines."""
    marks = " AND ".join(f"NOT contains(x, {_sql(t)})" for t in dims.UNSAFE_TOKENS) + " AND NOT x RLIKE '[\\\\x00\\\\n\\\\r]'"
    prefixes = " AND ".join(f"NOT startswith(lower(x), '{t}')" for t in dims.UNSAFE_PREFIXES)
    rules = {
        "filepath": f"{marks} AND {prefixes} AND octet_length(x) BETWEEN 1 AND 499 AND x <> '/'",
        "language": f"lower(x) IN ({', '.join(map(_sql, dims.LANGUAGES))})",
        "conflict_id": "octet_length(x) <= 100 AND x RLIKE '^[A-Za-z0-9:_./-]*\\\\z'",
        "safe_content": f"octet_length(x) <= {dims.MAX_LINE} AND NOT x RLIKE '[\\\\x00-\\\\x08\\\\x0B\\\\x0C\\\\x0E-\\\\x1F]'",
        "repo_path": "octet_length(x) BETWEEN 1 AND 999 AND NOT x RLIKE '[;|&`$\\\\x00\\\\r\\\\n]'",
    }
    for name, body in rules.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION is_{name}(x STRING) RETURNS BOOLEAN RETURN {body}")


def _sql(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
