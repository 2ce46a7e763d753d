"""Files with conflict markers: parsing, summaries, payloads, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import text as T
from ..operators import blocks, intervals, parse
from ..sources import shared
from ..sources import views as V
from ..sources.views import sql
from .files import DETECT_LANG, PAYLOAD_EXCLUDED, PAYLOAD_LANG, sql_any
from .registry import query

HUNK_TOKENS = "(strlen(path) // 4 + coalesce(list_sum(list_transform(list_concat(ours, theirs), lambda x: strlen(x) // 4)), 0))::BIGINT"


def hunks(spark, sf_dir):
    return parse.hunk_rows(V.conflicts(spark, sf_dir))


def tokens():
    return (F.floor(F.octet_length("path") / 4) + T.line_tokens(F.concat("ours", "theirs"))).cast("long")


joined = lambda c: F.array_join(c, "\n")


@query(sql("SELECT doc_id, path, path || ':' || idx AS hunk_id, start_line::INT AS start_line, end_line::INT AS end_line, array_to_string(ours, chr(10)) AS ours, array_to_string(theirs, chr(10)) AS theirs, array_to_string(base, chr(10)) AS base FROM hunks", "hunks"))
def parse_conflict_hunks(spark, sf_dir):
    h = hunks(spark, sf_dir)
    return h.select("doc_id", "path", F.concat_ws(":", "path", F.col("idx").cast("string")).alias("hunk_id"), "start_line", "end_line", joined("ours").alias("ours"), joined("theirs").alias("theirs"), joined("base").alias("base"))


#: Lines of a block, and blocks of a run: small ones, so that files are split and runs are several.
BLOCK_LINES, RUN = 16, 8


@query(sql("SELECT path, idx, start_line, end_line, array_to_string(ours, chr(10)) AS ours, array_to_string(theirs, chr(10)) AS theirs, array_to_string(base, chr(10)) AS base FROM hunks", "hunks"))
def parse_split_files(spark, sf_dir):
    """The same hunks from files that are split into blocks of lines, none of which knows where the parser stands."""
    h = blocks.hunk_rows(blocks.split(V.conflicts(spark, sf_dir), BLOCK_LINES), RUN, shared.kept)
    return h.select("path", "idx", "start_line", "end_line", joined("ours").alias("ours"), joined("theirs").alias("theirs"), joined("base").alias("base"))


@query(sql(f"""SELECT {PAYLOAD_LANG} AS language, count(DISTINCT path) AS files, count(*) AS hunks, sum(len(ours))::BIGINT AS ours_lines, sum(len(theirs))::BIGINT AS theirs_lines, sum({HUNK_TOKENS})::BIGINT AS tokens
FROM hunks WHERE NOT {PAYLOAD_EXCLUDED} GROUP BY 1""", "hunks"))
def conflicts_by_language(spark, sf_dir):
    """The flagship: parse, exclude, classify, estimate, roll up."""
    h = parse.hunk_rows(V.conflicts(spark, sf_dir).filter(~T.payload_excluded(F.col("path"))))
    return h.groupBy(T.payload_language(F.col("path")).alias("language")).agg(
        F.countDistinct("path").alias("files"), F.count("*").alias("hunks"), F.sum(F.size("ours")).cast("long").alias("ours_lines"), F.sum(F.size("theirs")).cast("long").alias("theirs_lines"), F.sum(tokens()).cast("long").alias("tokens")
    )


@query(sql(f"""SELECT count(*) AS total_conflicts, count(*) FILTER (NOT x) AS processable_files, count(*) FILTER (x) AS excluded_files, sum(n)::BIGINT AS hunks
FROM (SELECT {sql_any("lower(c.path)", dims.DETECT_EXCLUDED)} AS x, coalesce(n, 0) AS n FROM conflicts c LEFT JOIN (SELECT doc_id, count(*) AS n FROM hunks GROUP BY 1) USING (doc_id))""", "hunks"))
def detect_summary(spark, sf_dir):
    rows = V.conflicts(spark, sf_dir).select(T.detect_excluded(F.col("path")).alias("x"), F.size(parse.hunks(F.col("lines"))).alias("n"))
    return rows.agg(F.count("*").alias("total_conflicts"), F.count_if(~F.col("x")).alias("processable_files"), F.count_if("x").alias("excluded_files"), F.sum("n").alias("hunks"))


@query(sql(f"SELECT path || ':' || idx AS conflict_id, 'File: ' || path || ' (lines ' || start_line || '-' || end_line || ') [' || {DETECT_LANG} || ']' AS context, 'Ours: ' || len(ours) || ' lines, Theirs: ' || len(theirs) || ' lines' AS options FROM hunks", "hunks"))
def payload_flatten(spark, sf_dir):
    return hunks(spark, sf_dir).select(
        F.concat_ws(":", "path", F.col("idx").cast("string")).alias("conflict_id"),
        F.format_string("File: %s (lines %d-%d) [%s]", "path", "start_line", "end_line", T.detect_language(F.col("path"))).alias("context"),
        F.format_string("Ours: %d lines, Theirs: %d lines", F.size("ours"), F.size("theirs")).alias("options"),
    )


@query(sql(f"""SELECT path, {DETECT_LANG} AS language, count(*) AS n_conflicts, string_agg(path || ':' || idx || '@' || start_line, ';' ORDER BY idx) AS conflicts FROM hunks
WHERE NOT {sql_any("lower(path)", dims.DETECT_EXCLUDED)} GROUP BY path""", "hunks"))
def payload_build(spark, sf_dir):
    """One row for each file of a payload, its hunks in order; the array never leaves the row it was parsed in."""
    rows = V.conflicts(spark, sf_dir).filter(~T.detect_excluded(F.col("path"))).select("path", parse.hunks(F.col("lines")).alias("h")).filter(F.size("h") > 0)
    each = F.transform("h", lambda h, i: F.concat("path", F.lit(":"), i.cast("string"), F.lit("@"), h["start_line"].cast("string")))
    return rows.select("path", T.detect_language(F.col("path")).alias("language"), F.size("h").cast("long").alias("n_conflicts"), F.array_join(each, ";").alias("conflicts"))


@query(sql("SELECT path || ':' || idx AS hunk_id, len(ours) + len(theirs) AS n, md5(array_to_string(list_concat(ours, theirs), chr(10))) AS both_md5 FROM hunks", "hunks"))
def ours_theirs_concat(spark, sf_dir):
    both = F.concat("ours", "theirs")
    return hunks(spark, sf_dir).select(F.concat_ws(":", "path", F.col("idx").cast("string")).alias("hunk_id"), F.size(both).cast("long").alias("n"), F.md5(joined(both)).alias("both_md5"))


TRIM = r"regexp_replace(line, '^[\s]+|[\s]+$', '', 'g')"


@query(sql(rf"""SELECT doc_id, n::BIGINT AS line_no, 'conflict marker' AS message, 'error' AS severity FROM (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS n, unnest(lines) AS line FROM conflicts)
WHERE regexp_matches({TRIM}, '^(<<<<<<<|=======|>>>>>>>)')""", "conflicts"))
def marker_scan_issues(spark, sf_dir):
    rows = V.conflicts(spark, sf_dir).select("doc_id", F.posexplode("lines").alias("p", "line"))
    return rows.filter(T.trimmed(F.col("line")).rlike(r"^(<{7}|={7}|>{7})")).select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), F.lit("conflict marker").alias("message"), F.lit("error").alias("severity"))


SQL_CONTEXT = "c.lines[greatest(h.start_line - {n}, 1):h.start_line - 1] AS pre, c.lines[h.end_line + 1:h.end_line + {n}] AS post"


def with_context(h, n):
    """Hunks with the n lines before and after each, a number or a column, fewer at a file's ends."""
    n = n if isinstance(n, Column) else F.lit(n)
    first = F.greatest(F.col("start_line") - n, F.lit(1))
    return h.withColumn("pre", F.slice("lines", first, F.col("start_line") - first)).withColumn("post", F.slice("lines", F.col("end_line") + 1, n))


@query(sql(f"""SELECT path || ':' || idx AS hunk_id, len(pre) AS n_pre, len(post) AS n_post, md5(array_to_string(pre, chr(10))) AS pre_md5, md5(array_to_string(post, chr(10))) AS post_md5, md5(array_to_string(ours, chr(10)) || '|' || array_to_string(theirs, chr(10))) AS sides_md5
FROM (SELECT h.*, {SQL_CONTEXT.format(n="s.n")} FROM hunks h JOIN conflicts c USING (doc_id), (SELECT CASE WHEN count(*) > {dims.LARGE_REPOSITORY} THEN {dims.LARGE_CONTEXT} ELSE {dims.CONTEXT} END AS n FROM documents) s)""", "hunks"))
def payload_contexts(spark, sf_dir):
    """A hunk of a payload with contexts: both sides, no base, and five lines before and after it, or three in a large repository."""
    text = lambda c: F.md5(joined(c))
    sides = F.md5(F.concat(joined("ours"), F.lit("|"), joined("theirs")))
    files = V.table(spark, sf_dir, "documents").agg(F.when(F.count("*") > dims.LARGE_REPOSITORY, dims.LARGE_CONTEXT).otherwise(dims.CONTEXT).alias("context"))
    sized = hunks(spark, sf_dir).crossJoin(F.broadcast(files))  # one row
    return with_context(sized, F.col("context")).select(hunk_id(), F.size("pre").cast("long").alias("n_pre"), F.size("post").cast("long").alias("n_post"), text("pre").alias("pre_md5"), text("post").alias("post_md5"), sides.alias("sides_md5"))


def hunk_id():
    return F.concat_ws(":", "path", F.col("idx").cast("string")).alias("hunk_id")


def block(ours, theirs, base):
    """A conflict as it stands in a file."""
    return F.concat(
        F.lit("<<<<<<< HEAD\n"), lined(ours), F.when(F.size(base) > 0, F.concat(F.lit("||||||| base\n"), lined(base))).otherwise(""), F.lit("=======\n"), lined(theirs), F.lit(">>>>>>> branch\n")
    )


def lined(xs):
    """Lines, each with its end."""
    return F.array_join(F.transform(xs, lambda x: F.concat(x, F.lit("\n"))), "")


def sql_lined(xs: str) -> str:
    return f"array_to_string(list_transform({xs}, lambda x: x || chr(10)), '')"


SQL_BLOCK = f"""'<<<<<<< HEAD' || chr(10) || {sql_lined("ours")} || CASE WHEN len(base) > 0 THEN '||||||| base' || chr(10) || {sql_lined("base")} ELSE '' END || '=======' || chr(10) || {sql_lined("theirs")} || '>>>>>>> branch' || chr(10)"""
ASK = "Merge each conflict below. Give the file, the lines, the merged content, a confidence from 0 to 1 and the reasons.\n\n"
FORM = 'Answer as JSON: {"resolutions": [{"file_path": "", "start_line": 1, "end_line": 2, "resolved_lines": [""], "confidence": 0.5, "reasoning": "", "go_specific_notes": ""}]}'


@query(sql(rf""", f AS (SELECT path, {PAYLOAD_LANG} AS language, any_value(doc_id) AS doc_id, string_agg(chr(10) || 'Conflict ' || (idx + 1) || ' (lines ' || start_line || '-' || end_line || '):' || chr(10) || {SQL_BLOCK}, '' ORDER BY idx) AS blocks,
  flatten(list(list_concat(ours, theirs) ORDER BY idx)) AS ls FROM hunks GROUP BY path),
g AS (SELECT *, list_transform(list_filter(ls, lambda x: regexp_matches(x, '^\s*func\s+(\w*\s*)?\w+\s*\([^)]*\)')), lambda x: trim(x)) AS fs FROM f),
x AS (SELECT g.*, CASE WHEN len(c.lines) > 10 THEN c.lines[1:5] ELSE c.lines END AS head, CASE WHEN len(c.lines) > 10 THEN c.lines[-5:] ELSE [] END AS tail FROM g JOIN conflicts c ON c.doc_id = g.doc_id)
SELECT path, md5('{ASK.replace(chr(10), "' || chr(10) || '")}' || 'File: ' || path || chr(10) || 'Conflicts:' || chr(10) || blocks
  || CASE WHEN language = 'go' AND len(fs) > 0 THEN chr(10) || 'Function signatures involved: ' || array_to_string(fs, '; ') || chr(10) ELSE '' END
  || chr(10) || 'Before conflict:' || chr(10) || array_to_string(list_transform(head, lambda x, i: i || ': ' || x || chr(10)), '')
  || CASE WHEN len(tail) > 0 THEN 'After conflict:' || chr(10) || array_to_string(list_transform(tail, lambda x, i: i || ': ' || x || chr(10)), '') ELSE '' END || chr(10) || '---' || chr(10) || chr(10) || '{FORM}') AS prompt_md5 FROM x""", "hunks"))
def prompt_build(spark, sf_dir):
    """The prompt for each file: its conflicts with bases, what Go's checks look at, the file's head and tail with numbers, and the form of the answer."""
    rows = V.conflicts(spark, sf_dir).select("path", "lines", parse.hunks(F.col("lines")).alias("h")).filter(F.size("h") > 0)
    return rows.select("path", F.md5(prompt(F.col("path"), F.col("h"), F.col("lines"))).alias("prompt_md5"))


def prompt(path, h, lines):
    each = F.transform(h, lambda x, i: F.concat(F.format_string("\nConflict %d (lines %d-%d):\n", i + 1, x["start_line"], x["end_line"]), block(x["ours"], x["theirs"], x["base"])))
    both = F.flatten(F.transform(h, lambda x: F.concat(x["ours"], x["theirs"])))
    signatures = F.transform(F.filter(both, lambda x: x.rlike(dims.GO_FUNCTION)), lambda x: F.trim(x))
    go = F.when((T.payload_language(path) == "go") & (F.size(signatures) > 0), F.concat(F.lit("\nFunction signatures involved: "), F.array_join(signatures, "; "), F.lit("\n"))).otherwise("")
    long = F.size(lines) > 10
    numbered = lambda xs: F.array_join(F.transform(xs, lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x, F.lit("\n"))), "")
    head = F.when(long, F.slice(lines, 1, 5)).otherwise(lines)
    tail = F.when(long, F.concat(F.lit("After conflict:\n"), numbered(F.slice(lines, -5, 5)))).otherwise("")
    return F.concat(F.lit(ASK), F.lit("File: "), path, F.lit("\nConflicts:\n"), F.array_join(each, ""), go, F.lit("\nBefore conflict:\n"), numbered(head), tail, F.lit("\n---\n\n"), F.lit(FORM))


@query(sql("""SELECT doc_id // 5 AS payload_id, 'Repository: /work/' || (doc_id // 5) || chr(10) || 'Total conflicts: ' || count(*) || chr(10) || 'Affected files: ' || array_to_string(list_sort(list_distinct(list(path))), ', ') AS context FROM hunks GROUP BY 1""", "hunks"))
def context_string(spark, sf_dir):
    """What a model is told about a payload: repository, conflicts, files."""
    h = hunks(spark, sf_dir).select(F.floor(F.col("doc_id") / 5).alias("payload_id"), "path")
    rows = h.groupBy("payload_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("path")).alias("paths"))
    return rows.select("payload_id", F.concat(F.lit("Repository: /work/"), F.col("payload_id").cast("string"), F.lit("\nTotal conflicts: "), F.col("n").cast("string"), F.lit("\nAffected files: "), F.array_join("paths", ", ")).alias("context"))


FIRST_TURN, LATER_TURN = "The confidence was low. Look for faults, weigh other merges and give a better one.\n\n", "Go on: practice, types, correctness.\n\n"


@query(sql(f"""SELECT r.doc_id, r.idx AS res_idx, h.path || ':' || h.idx AS hunk_id, md5('Refinement, turn ' || (r.doc_id % 2 + 1) || chr(10) || chr(10) || CASE WHEN r.doc_id % 2 = 0 THEN '{FIRST_TURN.replace(chr(10), "' || chr(10) || '")}' ELSE '{LATER_TURN.replace(chr(10), "' || chr(10) || '")}' END
  || 'File: ' || r.file_path || ' (lines ' || r.start_line || '-' || r.end_line || ')' || chr(10) || 'Confidence: ' || printf('%.2f', r.confidence) || chr(10) || CASE WHEN r.reasoning <> '' THEN 'Previous reasoning: ' || r.reasoning || chr(10) ELSE '' END
  || 'Resolved content:' || chr(10) || array_to_string(list_transform(r.resolved_lines, lambda x: '  ' || x || chr(10)), '') || chr(10) || 'Original conflict:' || chr(10) || {SQL_BLOCK.replace("(ours", "(h.ours").replace("len(base", "len(h.base").replace("(base,", "(h.base,").replace("(theirs", "(h.theirs")}) AS prompt_md5
FROM res r JOIN hunks h ON h.path = r.file_path AND h.start_line <= r.start_line AND h.end_line >= r.end_line WHERE r.confidence < 0.6
QUALIFY row_number() OVER (PARTITION BY r.doc_id, r.idx ORDER BY h.start_line) = 1""", "hunks", "res"))
def refinement_prompt(spark, sf_dir):
    """What a model is asked again about a resolution of low confidence, with the conflict it is for."""
    h = first_containing(V.resolutions(spark, sf_dir).filter("confidence < 0.6"), hunks(spark, sf_dir))
    turn = F.col("doc_id") % 2
    text = F.concat(
        F.format_string("Refinement, turn %d\n\n", turn + 1), F.when(turn == 0, FIRST_TURN).otherwise(LATER_TURN), F.format_string("File: %s (lines %d-%d)\nConfidence: %.2f\n", "file_path", "start_line", "end_line", "confidence"),
        F.when(F.col("reasoning") != "", F.concat(F.lit("Previous reasoning: "), "reasoning", F.lit("\n"))).otherwise(""), F.lit("Resolved content:\n"), lined(F.transform("resolved_lines", lambda x: F.concat(F.lit("  "), x))),
        F.lit("\nOriginal conflict:\n"), block(F.col("ours"), F.col("theirs"), F.col("base")),
    )
    return h.select("doc_id", F.col("idx").alias("res_idx"), F.concat_ws(":", "path", F.col("h_idx").cast("string")).alias("hunk_id"), F.md5(text).alias("prompt_md5"))


def containing(res, h):
    """(doc_id, idx, h_idx, h_start, h_end): the first hunk of its file that contains each resolution's range; only places are compared."""
    asked = res.select("doc_id", "idx", "file_path", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    spans = h.select("path", F.col("idx").alias("h_idx"), F.col("start_line").cast("long").alias("start"), F.col("end_line").cast("long").alias("end"))
    both = intervals.containing(asked, spans, "file_path", "path")
    best = F.min(F.struct("o_start", "h_idx", "o_end")).alias("h")
    return both.groupBy("doc_id", "idx").agg(best).select("doc_id", "idx", "h.h_idx", F.col("h.o_start").cast("int").alias("h_start"), F.col("h.o_end").cast("int").alias("h_end"))


def first_containing(res, h):
    """Each resolution with the first hunk of its file that contains its range, and that hunk's sides."""
    found = containing(res, h).withColumnsRenamed({"doc_id": "r_doc", "idx": "r_idx"})
    own = res.join(found, (res["doc_id"] == F.col("r_doc")) & (res["idx"] == F.col("r_idx"))).drop("r_doc", "r_idx")
    sides = h.select("path", F.col("idx").alias("s_idx"), "ours", "theirs", "base")
    return own.join(sides, (F.col("file_path") == F.col("path")) & (F.col("h_idx") == F.col("s_idx")))


@query(sql("""SELECT r.doc_id, r.idx, h.idx AS h_idx, h.start_line::INT AS h_start, h.end_line::INT AS h_end FROM res r JOIN hunks h ON h.path = r.file_path AND h.start_line <= r.start_line AND h.end_line >= r.end_line
QUALIFY row_number() OVER (PARTITION BY r.doc_id, r.idx ORDER BY h.start_line) = 1""", "hunks", "res"))
def resolution_hunk_range_join(spark, sf_dir):
    return containing(V.resolutions(spark, sf_dir), hunks(spark, sf_dir))


@query("""WITH p AS (SELECT *, replace(replace(replace('a..b//' || source || '///x' || doc_id || chr(0) || CASE WHEN doc_id % 10 = 0 THEN repeat('é', 300) ELSE '' END, chr(0), ''), '..', ''), '//', '/') AS path FROM documents)
SELECT doc_id, md5(unhex(left(hex(encode(path)), 1000))) AS path_md5, least(strlen(path), 500) AS path_bytes, regexp_replace('id ' || doc_id || '$:é-' || lang, '[^A-Za-z0-9:_./-]', '', 'g')[1:100] AS conflict_id, md5(unhex(left(hex(encode(replace(text, chr(0), ''))), 20000))) AS text_md5 FROM p""")
def payload_sanitize(spark, sf_dir):
    """Paths, ids and lines as a payload may hold them: cut at 500, 100 and 10000 bytes, also inside a character."""
    s = F.col("doc_id").cast("string")
    raw = F.concat(F.lit("a..b//"), "source", F.lit("///x"), s, F.lit("\0"), F.when(F.col("doc_id") % 10 == 0, F.repeat(F.lit("é"), F.lit(300))).otherwise(""))
    path = T.first_bytes(F.replace(F.replace(F.translate(raw, "\0", ""), F.lit(".."), F.lit("")), F.lit("//"), F.lit("/")), 500)
    name = F.substring(F.regexp_replace(F.concat(F.lit("id "), s, F.lit("$:é-"), "lang"), r"[^A-Za-z0-9:_./-]", ""), 1, 100)
    text = T.first_bytes(F.translate("text", "\0", ""), dims.MAX_LINE)
    return V.table(spark, sf_dir, "documents").select("doc_id", F.md5(path).alias("path_md5"), F.octet_length(path).cast("long").alias("path_bytes"), name.alias("conflict_id"), F.md5(text).alias("text_md5"))


@query(sql(f"SELECT count(*) AS total_files, count(*) AS total_conflicts, count(*) FILTER (NOT {PAYLOAD_EXCLUDED}) AS kept_files, count(DISTINCT {PAYLOAD_LANG}) FILTER (NOT {PAYLOAD_EXCLUDED}) AS languages FROM conflicts", "conflicts"))
def payload_metadata(spark, sf_dir):
    """A payload's own counts: files before exclusion, which are the conflicts reported too, and what is kept."""
    kept, path = ~T.payload_excluded(F.col("path")), F.col("path")
    return V.conflicts(spark, sf_dir).agg(F.count("*").alias("total_files"), F.count("*").alias("total_conflicts"), F.count_if(kept).alias("kept_files"), F.count_distinct(F.when(kept, T.payload_language(path))).alias("languages"))


@query(sql("""SELECT count(*) AS total_files, sum(n)::BIGINT AS total_conflicts, sum(bytes)::BIGINT AS payload_bytes, max(m)::BIGINT AS max_line_bytes FROM
(SELECT (SELECT count(*) FROM hunks h WHERE h.doc_id = c.doc_id) AS n, list_sum(list_transform(lines, lambda x: strlen(x) + 1)) AS bytes, list_max(list_transform(lines, lambda x: strlen(x))) AS m FROM conflicts c)""", "hunks"))
def schema_summary(spark, sf_dir):
    size = F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(x) + 1)
    most = F.array_max(F.transform("lines", lambda x: F.octet_length(x)))
    rows = V.conflicts(spark, sf_dir).select(F.size(parse.hunks(F.col("lines"))).alias("n"), size.alias("bytes"), most.alias("m"))
    return rows.agg(F.count("*").alias("total_files"), F.sum("n").cast("long").alias("total_conflicts"), F.sum("bytes").cast("long").alias("payload_bytes"), F.max("m").cast("long").alias("max_line_bytes"))


@query(sql("SELECT path, idx, start_line::INT AS start_line, end_line::INT AS end_line, true AS same FROM hunks", "hunks"))
def payload_json_roundtrip(spark, sf_dir):
    """Hunks written as JSON and read again, beside the originals."""
    kind = "struct<path:string,idx:bigint,start_line:int,end_line:int,ours:array<string>>"
    rows = hunks(spark, sf_dir).select(F.struct("path", "idx", "start_line", "end_line", "ours").alias("a"))
    back = rows.withColumn("b", F.from_json(F.to_json("a"), kind))
    return back.select("b.path", "b.idx", "b.start_line", "b.end_line", (F.col("a.ours") == F.col("b.ours")).alias("same"))


SQL_DIFF = """d AS (SELECT doc_id, flatten([['diff --git a/src/x' || doc_id || ' b/src/y' || doc_id, '--- src/x', '+++ src/y', '@@ -' || (doc_id % 7 + 1) || ',2 +' || (doc_id % 5 + 1) || ' @@ fn' || doc_id, '-old'],
  list_transform(string_split(text, chr(10)), lambda x: '+' || x), [' same', '@@ -9 +9,3 @@', '+more', 'diff --git a/y b/z', '@@ -1,4 +1,5 @@ end'], list_transform(string_split(text, chr(10))[1:3], lambda x: '-' || x)]) AS ls FROM documents),
e AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line FROM d), f AS (SELECT *, sum(CASE WHEN starts_with(line, 'diff --git ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS file_no, starts_with(line, '@@') AS is_head FROM e),
g AS (SELECT *, sum(CASE WHEN is_head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, file_no ORDER BY n) AS hunk_no, first_value(line) OVER (PARTITION BY doc_id, file_no ORDER BY n) AS file_line FROM f)"""


@query(
    "WITH "
    + SQL_DIFF
    + r""" SELECT doc_id, file_no::BIGINT AS file_no, hunk_no::BIGINT AS hunk_no, any_value(regexp_extract(file_line, 'a/(.*) b/', 1)) AS old_path, any_value(regexp_extract(file_line, ' b/(.*)$', 1)) AS new_path,
max(CASE WHEN is_head THEN regexp_extract(line, '-(\d+)', 1)::BIGINT END) AS old_start, coalesce(max(CASE WHEN is_head THEN try_cast(regexp_extract(line, '-\d+,(\d+)', 1) AS BIGINT) END), 1) AS old_lines,
max(CASE WHEN is_head THEN regexp_extract(line, '\+(\d+)', 1)::BIGINT END) AS new_start, coalesce(max(CASE WHEN is_head THEN try_cast(regexp_extract(line, '\+\d+,(\d+)', 1) AS BIGINT) END), 1) AS new_lines,
max(CASE WHEN is_head THEN trim(regexp_extract(line, '@@ .* @@(.*)', 1)) END) AS header, count(*) FILTER (NOT is_head AND starts_with(line, '+')) AS added, count(*) FILTER (NOT is_head AND starts_with(line, '-')) AS removed
FROM g WHERE hunk_no > 0 GROUP BY doc_id, file_no, hunk_no"""
)
def unified_diff_parse(spark, sf_dir):
    i, s = F.col("doc_id"), F.col("doc_id").cast("string")
    own = T.lines(F.col("text"))
    lines = F.concat(
        F.array(F.concat(F.lit("diff --git a/src/x"), s, F.lit(" b/src/y"), s), F.lit("--- src/x"), F.lit("+++ src/y"), F.format_string("@@ -%d,2 +%d @@ fn%d", i % 7 + 1, i % 5 + 1, i), F.lit("-old")),
        F.transform(own, lambda x: F.concat(F.lit("+"), x)),
        F.array(*map(F.lit, [" same", "@@ -9 +9,3 @@", "+more", "diff --git a/y b/z", "@@ -1,4 +1,5 @@ end"])),
        F.transform(F.slice(own, 1, 3), lambda x: F.concat(F.lit("-"), x)),
    )
    return parse.diff_rows(V.table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text")))
