"""Payloads as JSON documents: building, strict reading, rules, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import text as T

HUNK = "id:string,start_line:bigint,end_line:bigint,ours_lines:array<string>,theirs_lines:array<string>,base_lines:array<string>"
FILE = f"path:string,language:string,conflicts:array<struct<{HUNK}>>,context:struct<before_lines:array<string>,after_lines:array<string>>"
PAYLOAD = f"struct<files:array<struct<{FILE}>>,metadata:struct<timestamp:string,repo_path:string,total_files:bigint,total_conflicts:bigint,version:string>,_corrupt:string>"
FIELDS = {
    "payload": ["files", "metadata"], "file": ["path", "language", "conflicts", "context"], "hunk": ["id", "start_line", "end_line", "ours_lines", "theirs_lines", "base_lines"],
    "context": ["before_lines", "after_lines"], "metadata": ["timestamp", "repo_path", "total_files", "total_conflicts", "version"],
}
#: A broken rule: the field, the rule's tag and its limit.
ERROR = "struct<field:string,tag:string,param:string>"


def error(field: str | Column, tag: str, param: str = "") -> Column:
    return F.array(F.struct((field if isinstance(field, Column) else F.lit(field)).alias("field"), F.lit(tag).alias("tag"), F.lit(param).alias("param")))


def none() -> Column:
    return F.array().cast(f"array<{ERROR}>")


def first(*rules: tuple[Column, Column]) -> Column:
    """The error of the first rule that is broken."""
    out = none()
    for broken, what in reversed(rules):
        out = F.when(broken, what).otherwise(out)
    return out


def each(items: Column, rule) -> Column:
    """The errors of all items, in order; none for a missing list."""
    return F.coalesce(F.flatten(F.transform(items, rule)), none())


def unknown(text: Column, kind: str) -> Column:
    """Whether a JSON object, as text, has a field that its kind has not."""
    return F.size(F.array_except(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")), F.array(*map(F.lit, FIELDS[kind])))) > 0


def strict(text: Column) -> Column:
    """Whether all objects of a payload, as text, have known fields alone."""
    files = F.coalesce(F.from_json(F.get_json_object(text, "$.files"), "array<string>"), F.array().cast("array<string>"))
    hunks = F.flatten(F.transform(files, lambda f: F.coalesce(F.from_json(F.get_json_object(f, "$.conflicts"), "array<string>"), F.array().cast("array<string>"))))
    meta = F.get_json_object(text, "$.metadata")
    bad = unknown(text, "payload") | F.exists(files, lambda f: unknown(f, "file") | unknown(F.get_json_object(f, "$.context"), "context")) | F.exists(hunks, lambda h: unknown(h, "hunk")) | unknown(meta, "metadata")
    return ~F.coalesce(bad, F.lit(False))


def lines_errors(lines: Column, name: str) -> Column:
    return each(lines, lambda x, i: first((~T.safe_content(x), error(F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]")), "safe_content"))))


def tag_errors(p: Column) -> Column:
    """Every field's first broken rule, in the order of the fields."""
    most = str(dims.MAX_LINE_NUMBER)

    def number(x: Column, name: str, *more: tuple[Column, Column]) -> Column:
        return first((x.isNull() | (x == 0), error(name, "required")), (x < 1, error(name, "min", "1")), (x > dims.MAX_LINE_NUMBER, error(name, "max", most)), *more)

    def hunk(h: Column) -> Column:
        name = F.coalesce(h["id"], F.lit(""))
        sides = [first((h[c].isNull(), error(f, "required"))) for c, f in (("ours_lines", "OursLines"), ("theirs_lines", "TheirsLines"))]
        return F.concat(
            first(((name != "") & ~T.conflict_id(name), error("ID", "conflict_id"))),
            number(h["start_line"], "StartLine"),
            number(h["end_line"], "EndLine", (h["end_line"] <= F.coalesce(h["start_line"], F.lit(0)), error("EndLine", "gtfield", "StartLine"))),
            sides[0], lines_errors(h["ours_lines"], "OursLines"), sides[1], lines_errors(h["theirs_lines"], "TheirsLines"), lines_errors(h["base_lines"], "BaseLines"),
        )

    def context(lines: Column, name: str) -> Column:
        return F.when(F.coalesce(F.size(lines), F.lit(0)) > dims.MAX_CONTEXT, error(name, "max", str(dims.MAX_CONTEXT))).otherwise(lines_errors(lines, name))

    def file(f: Column) -> Column:
        path, lang = F.coalesce(f["path"], F.lit("")), F.coalesce(f["language"], F.lit(""))
        hunks = F.when(f["conflicts"].isNull(), error("Conflicts", "required")).when(F.size(f["conflicts"]) > dims.MAX_FILE_CONFLICTS, error("Conflicts", "max", str(dims.MAX_FILE_CONFLICTS))).otherwise(each(f["conflicts"], hunk))
        return F.concat(
            first((path == "", error("Path", "required")), (~T.payload_path(path), error("Path", "filepath"))),
            first((lang == "", error("Language", "required")), (~F.lower(lang).isin(dims.LANGUAGES), error("Language", "language"))),
            hunks, context(f["context"]["before_lines"], "BeforeLines"), context(f["context"]["after_lines"], "AfterLines"),
        )

    files, repo = p["files"], F.coalesce(p["metadata"]["repo_path"], F.lit(""))
    inside = F.when(files.isNull(), error("Files", "required")).when(F.size(files) > dims.MAX_FILES, error("Files", "max", str(dims.MAX_FILES))).otherwise(each(files, file))
    meta = p["metadata"]
    count = lambda c, name, limit: first((meta[c] < 0, error(name, "min", "0")), (meta[c] > limit, error(name, "max", str(limit))))
    return F.concat(
        inside, first((repo == "", error("RepoPath", "required")), (~T.repo_path(repo), error("RepoPath", "repo_path"))),
        count("total_files", "TotalFiles", dims.META_FILES), count("total_conflicts", "TotalConflicts", dims.META_CONFLICTS), first((F.length(meta["version"]) > dims.META_VERSION, error("Version", "max", str(dims.META_VERSION)))),
    )


def business_error(p: Column) -> Column:
    """The first broken rule across fields, null where none is: files in order, each file's path, then its hunks, then the total."""
    paths = F.transform(p["files"], lambda f: f["path"])
    at = lambda i, rest: F.concat(F.lit("files["), i.cast("string"), F.lit("]" + rest))

    def file(f: Column, i: Column) -> Column:
        ids = F.transform(f["conflicts"], lambda h: F.coalesce(h["id"], F.lit("")))

        def hunk(h: Column, k: Column) -> Column:
            place = F.concat(at(i, ".conflicts["), k.cast("string"), F.lit("]"))
            size = F.size(h["ours_lines"]) + F.size(h["theirs_lines"]) + F.coalesce(F.size(h["base_lines"]), F.lit(0))
            name = F.coalesce(h["id"], F.lit(""))
            again = (name != "") & (F.size(F.filter(ids, lambda x: x == name)) > 1)
            return first((size > dims.MAX_HUNK_LINES, error(place, "conflict_size")), (again, error(F.concat(place, F.lit(".id")), "duplicate_id")))

        twice = F.size(F.filter(paths, lambda x: x == f["path"])) > 1
        return F.concat(first((twice, error(at(i, ".path"), "duplicate"))), each(f["conflicts"], hunk))

    total = conflicts(p)
    every = F.concat(each(p["files"], file), first((total > dims.MAX_CONFLICTS, error("payload", "total_conflicts"))))
    return F.get(every, 0)


def conflicts(p: Column) -> Column:
    return F.aggregate(p["files"], F.lit(0), lambda n, f: n + F.size(f["conflicts"]))


def longest_line(p: Column) -> Column:
    """Bytes of the longest line of any side."""
    sides = lambda h: F.concat(h["ours_lines"], h["theirs_lines"], F.coalesce(h["base_lines"], F.array().cast("array<string>")))
    most = lambda ls: F.coalesce(F.array_max(F.transform(ls, lambda x: F.octet_length(x))), F.lit(0))
    return F.aggregate(p["files"], F.lit(0), lambda n, f: F.aggregate(f["conflicts"], n, lambda m, h: F.greatest(m, most(sides(h)))))


def message(e: Column) -> Column:
    """What is said of a broken rule of a field."""
    out = F.concat(F.lit("Field '"), e["field"], F.lit("' failed validation: "), e["tag"])
    for tag, form in dims.RULE_MESSAGES.items():
        out = F.when(e["tag"] == tag, F.format_string(form, *([e["field"], e["param"]] if form.count("%s") == 2 else [e["field"]]))).otherwise(out)
    return out


def validated(payloads: DataFrame) -> DataFrame:
    """Payloads (with a column text) with valid, stage, n_errors, field, tag, message, total_files, total_conflicts, longest_line and, of valid ones alone, files.

    Size, emptiness, JSON and strict reading end the checks one after another; then all fields' rules are collected, and only where none is broken the rules across fields run, up to the first.
    Each step is a column of its own, so that a text is read once."""
    names = payloads.columns
    rows = payloads.withColumn("__p", F.from_json("text", PAYLOAD, {"columnNameOfCorruptRecord": "_corrupt"}))
    p, text = F.col("__p"), F.col("text")
    one = lambda tag, say: F.struct(F.lit(tag).alias("stage"), F.lit(1).alias("n_errors"), F.get(error("payload", tag), 0).alias("error"), F.lit(say).alias("message"))
    early = (
        F.when(F.octet_length(text) > dims.MAX_PAYLOAD, one("max_size", "Payload is too large"))
        .when(F.octet_length(text) == 0, one("required", "Payload cannot be empty"))
        .when(F.try_parse_json(text).isNull(), one("json", "Invalid JSON format"))
        .when(p.isNull() | p["_corrupt"].isNotNull() | ~F.coalesce(T.rfc3339(p["metadata"]["timestamp"]), F.lit(True)) | ~strict(text), one("decode", "JSON parsing failed"))
    )
    rows = rows.withColumn("__early", early)
    rows = rows.withColumn("__tags", F.when(F.col("__early").isNull(), tag_errors(p))).withColumn("__tag", F.get("__tags", 0))
    rows = rows.withColumn("__business", F.when(F.col("__early").isNull() & (F.size("__tags") == 0), business_error(p)))
    tag, business = F.col("__tag"), F.col("__business")
    later = lambda stage, n, e, say: F.struct(F.lit(stage).alias("stage"), n.alias("n_errors"), e.alias("error"), say.alias("message"))
    found = F.when(F.col("__early").isNotNull(), F.col("__early")).when(tag.isNotNull(), later("fields", F.size("__tags"), tag, message(tag))).when(business.isNotNull(), later("business", F.lit(1), business, business["tag"]))
    rows = rows.withColumn("__found", found).withColumn("valid", F.col("__found").isNull())
    ok, f = F.col("valid"), F.col("__found")
    return rows.select(
        *names, "valid", f["stage"].alias("stage"), F.coalesce(f["n_errors"], F.lit(0)).alias("n_errors"), f["error"]["field"].alias("field"), f["error"]["tag"].alias("tag"), f["message"].alias("message"),
        F.when(ok, F.size(p["files"])).alias("total_files"), F.when(ok, conflicts(p)).alias("total_conflicts"), F.when(ok, longest_line(p)).alias("longest_line"), F.when(ok, p["files"]).alias("files"), F.when(ok, p["metadata"]).alias("metadata"),
    )


def clean_path(path: Column) -> Column:
    """A path without null bytes, double dots and double slashes, at most 500 bytes long: the cut may fall inside a character."""
    return T.first_bytes(F.replace(F.replace(F.replace(path, F.lit("\0"), F.lit("")), F.lit(".."), F.lit("")), F.lit("//"), F.lit("/")), dims.CLEAN_PATH).cast("string")


def clean_lines(lines: Column) -> Column:
    """Lines without null bytes, each at most as many bytes as a line may have; a missing list is an empty one."""
    return F.coalesce(F.transform(lines, lambda x: T.first_bytes(F.replace(x, F.lit("\0"), F.lit("")), dims.MAX_LINE).cast("string")), F.array().cast("array<string>"))


def clean_id(name: Column) -> Column:
    """A conflict's id with its safe characters alone, 100 of them at most; a missing one is empty."""
    return F.substring(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^A-Za-z0-9:_./-]", ""), 1, dims.CLEAN_ID)


def sanitized(files: Column) -> Column:
    """A payload's files as they may be worked on: paths, ids, sides and contexts cleaned."""
    sides = ("ours_lines", "theirs_lines", "base_lines")
    hunk = lambda h: F.struct(clean_id(h["id"]).alias("id"), h["start_line"].alias("start_line"), h["end_line"].alias("end_line"), *[clean_lines(h[c]).alias(c) for c in sides])
    context = lambda c: F.struct(*[clean_lines(c[k]).alias(k) for k in ("before_lines", "after_lines")])
    return F.transform(files, lambda f: F.struct(clean_path(f["path"]).alias("path"), f["language"].alias("language"), F.transform(f["conflicts"], hunk).alias("conflicts"), context(f["context"]).alias("context")))


def loaded(payloads: DataFrame) -> DataFrame:
    """Validated payloads, those that pass with their files and their repository's path cleaned."""
    repo = clean_path(F.col("metadata")["repo_path"])
    return validated(payloads).withColumn("repo_path", repo).withColumn("files", F.when(F.col("valid"), sanitized(F.col("files")))).drop("metadata")
