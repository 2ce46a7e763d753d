"""Payloads of several files as JSON documents, some with a broken rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..functions import text as T
from ..operators import parse, payload
from ..sources import views as V
from ..sources.views import quoted, sql
from .files import PAYLOAD_LANG, sql_any
from .registry import query

#: Files of a payload; of so many payloads in a row each has another fault, or none.
FILES, CASES = 5, 30
REPO = '"repo_path":"/work/repo"'
# What is changed in a payload's text, by case: what stands there, and what is put in its place.
CHANGES = {
    3: ('"metadata":', '"extra":1,"metadata":'), 4: ('"repo_path":"/work/repo"', '"repo_path":""'), 5: ('"path":"src/', '"path":"../src/'), 6: ('"language":"', '"language":"x-'), 7: ('"id":"', '"id":"bad id '),
    8: ('"repo_path":"/work/repo"', '"repo_path":"/work;repo"'), 9: ('"start_line":', '"start_line":-'), 10: ('"end_line":', '"end_line":"x","old_line":'), 11: ('"start_line":', '"start_line":9000'), 14: ('"ours_lines":[', '"ours_lines":[' + '"x",' * 1001),
    15: ('"before_lines":[', '"before_lines":[' + '"c",' * 51), 16: ('"ours_lines":[', '"ours_lines":["\\u0001",'), 17: ('"end_line":', '"end_line":"x'), 18: ('"ours_lines":[', '"ours_lines":["' + "y" * 10001 + '",'), 19: ('"repo_path":"/work/repo",', ""),
    20: (REPO, REPO + ',"version":"' + "v" * 21 + '"'), 21: ('"total_files":', '"total_files":1000'), 22: (REPO, REPO + ',"total_conflicts":-1'), 23: (REPO, REPO + ',"timestamp":"not a time"'),
    24: (REPO, REPO + ',"version":"' + "é" * 20 + '","timestamp":"2024-02-29T23:59:59.5+05:30","total_conflicts":5000'), 25: (REPO, REPO + ',"timestamp":"2023-02-29T00:00:00Z"'), 26: (REPO, REPO + ',"total_conflicts":5001,"version":"1234567890.1234567890"'),
    27: ('"path":"src/', '"path":"src//x///'), 28: (REPO, '"repo_path":"/work/../a//b/' + "r" * 600 + '"'), 29: (REPO, REPO + ',"timestamp":null'),
}
SAME = {12: ('"path":"[^"]*"', '"path":"same.go"'), 13: ('"id":"[^"]*"', '"id":"dup:0"')}


def payloads(spark, sf_dir):
    """(payload_id, text): the files of a payload as one JSON document."""
    rows = V.conflicts(spark, sf_dir).select("doc_id", "path", "lines", parse.hunks(F.col("lines")).alias("h"))
    hunk = lambda x, i: F.struct(
        F.concat(F.col("path"), F.lit(":"), i.cast("string")).alias("id"), x["start_line"].alias("start_line"), x["end_line"].alias("end_line"), F.when(F.size(x["ours"]) > 0, x["ours"]).otherwise(F.array(F.lit(""))).alias("ours_lines"), x["theirs"].alias("theirs_lines"), x["base"].alias("base_lines")
    )
    context = F.struct(F.slice("lines", 1, 3).alias("before_lines"), F.slice("lines", -1, 1).alias("after_lines"))
    file = F.struct("doc_id", "path", T.payload_language(F.col("path")).alias("language"), F.transform("h", hunk).alias("conflicts"), context.alias("context"))
    groups = rows.groupBy(F.floor(F.col("doc_id") / FILES).cast("long").alias("payload_id")).agg(F.array_sort(F.collect_list(file), lambda a, b: (a["doc_id"] - b["doc_id"]).cast("int")).alias("fs"))
    files = F.transform("fs", lambda f: f.dropFields("doc_id"))
    text = F.to_json(F.struct(files.alias("files"), F.struct(F.lit("/work/repo").alias("repo_path"), F.size("fs").alias("total_files")).alias("metadata")))
    return groups.select("payload_id", text.alias("text"))


def faulty(rows):
    """Payloads with their case's change."""
    case, text = F.col("payload_id") % CASES, F.col("text")
    out = F.when(case == 1, F.lit("")).when(case == 2, F.substring(text, F.lit(1), F.length(text) - 1))
    for k, (old, new) in CHANGES.items():
        out = out.when(case == k, F.replace(text, F.lit(old), F.lit(new)))
    for k, (old, new) in SAME.items():
        out = out.when(case == k, F.regexp_replace(text, old, new))
    return rows.withColumn("text", out.otherwise(text))


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def repeated(text: str) -> str:
    for unit in ('"x",', '"c",', "y", "r"):
        n = 0
        while unit * (n + 1) in text:
            n += 1
        if n > 50:
            a, b = text.split(unit * n, 1)
            return f"{literal(a)} || repeat({literal(unit)}, {n}) || {literal(b)}"
    return literal(text)


SQL_FAULTY = (
    f"CASE payload_id % {CASES} WHEN 1 THEN '' WHEN 2 THEN text[1:-2] "
    + " ".join(f"WHEN {k} THEN replace(text, {literal(a)}, {repeated(b)})" for k, (a, b) in CHANGES.items())
    + " ".join(f" WHEN {k} THEN regexp_replace(text, {literal(a)}, {literal(b)}, 'g')" for k, (a, b) in SAME.items())
    + " ELSE text END"
)
# The payloads' text, then what is read from it.
SQL_PAYLOADS = f"""pfiles AS (SELECT c.doc_id, c.path, {PAYLOAD_LANG.replace("path", "c.path")} AS language, coalesce((SELECT list({{'id': h.path || ':' || h.idx, 'start_line': h.start_line, 'end_line': h.end_line, 'ours_lines': CASE WHEN len(h.ours) > 0 THEN h.ours ELSE [''] END, 'theirs_lines': h.theirs, 'base_lines': h.base}} ORDER BY h.idx) FROM hunks h WHERE h.doc_id = c.doc_id), []) AS conflicts,
  {{'before_lines': c.lines[1:3], 'after_lines': c.lines[-1:]}} AS context FROM conflicts c),
plain AS (SELECT doc_id // {FILES} AS payload_id, to_json({{'files': list({{'path': path, 'language': language, 'conflicts': conflicts, 'context': context}} ORDER BY doc_id), 'metadata': {{'repo_path': '/work/repo', 'total_files': count(*)}}}})::VARCHAR AS text FROM pfiles GROUP BY 1),
texts AS MATERIALIZED (SELECT payload_id, {SQL_FAULTY} AS text FROM plain),
valid_json AS MATERIALIZED (SELECT payload_id, text::JSON AS j FROM texts WHERE text <> '' AND json_valid(text)),
jf AS MATERIALIZED (SELECT payload_id, unnest(range(0, json_array_length(j, '$.files')::BIGINT)) AS fi, unnest(json_extract(j, '$.files[*]')) AS f FROM valid_json),
jh AS MATERIALIZED (SELECT payload_id, fi, unnest(range(0, json_array_length(f, '$.conflicts')::BIGINT)) AS hi, unnest(json_extract(f, '$.conflicts[*]')) AS h FROM jf),
jl AS (SELECT payload_id, fi, hi, side, unnest(range(0, len(ls))) AS li, unnest(ls) AS line FROM (SELECT payload_id, fi, hi, 4 AS side, (h->'ours_lines')::VARCHAR[] AS ls FROM jh UNION ALL SELECT payload_id, fi, hi, 5, (h->'theirs_lines')::VARCHAR[] FROM jh UNION ALL SELECT payload_id, fi, hi, 6, (h->'base_lines')::VARCHAR[] FROM jh)),
jc AS (SELECT payload_id, fi, side, unnest(range(0, len(ls))) AS li, unnest(ls) AS line FROM (SELECT payload_id, fi, 0 AS side, (f->'$.context.before_lines')::VARCHAR[] AS ls FROM jf UNION ALL SELECT payload_id, fi, 1, (f->'$.context.after_lines')::VARCHAR[] FROM jf) WHERE len(ls) <= 50),
undecoded AS (SELECT payload_id FROM valid_json WHERE len(list_filter(json_keys(j), lambda k: k NOT IN ('files', 'metadata'))) > 0 UNION SELECT payload_id FROM jh WHERE len(list_filter(json_keys(h), lambda k: k NOT IN ({", ".join(map(literal, payload.FIELDS["hunk"]))}))) > 0
  OR json_type(h, '$.end_line') NOT IN ('UBIGINT', 'BIGINT') OR json_type(h, '$.start_line') NOT IN ('UBIGINT', 'BIGINT')
  UNION SELECT payload_id FROM (SELECT payload_id, j->>'$.metadata.timestamp' AS t FROM valid_json) WHERE t IS NOT NULL AND NOT (regexp_full_match(t, '\\d{{4}}-\\d\\d-\\d\\dT([01]\\d|2[0-3]):[0-5]\\d:[0-5]\\d([.]\\d+)?(Z|[+-]([01]\\d|2[0-3]):[0-5]\\d)') AND try_cast(t[1:10] AS DATE) IS NOT NULL)),
meta AS (SELECT payload_id, (j->>'$.metadata.total_files')::BIGINT AS nf, (j->>'$.metadata.total_conflicts')::BIGINT AS nc, j->>'$.metadata.version' AS version FROM valid_json),
hn AS (SELECT payload_id, fi, hi, h->>'id' AS id, try_cast(h->>'start_line' AS BIGINT) AS a, try_cast(h->>'end_line' AS BIGINT) AS b FROM jh),
rules AS (SELECT payload_id, fi * 1e9 AS place, 'Path' AS field, 'filepath' AS tag, '' AS param FROM (SELECT *, f->>'path' AS path FROM jf) WHERE {sql_any("path", dims.UNSAFE_TOKENS)}
  UNION ALL SELECT payload_id, fi * 1e9 + 1, 'Language', 'language', '' FROM jf WHERE NOT list_contains({quoted(dims.LANGUAGES)}, lower(f->>'language'))
  UNION ALL SELECT payload_id, fi * 1e9 + (hi + 1) * 1e5 + 1, 'ID', 'conflict_id', '' FROM hn WHERE NOT regexp_matches(id, '^[A-Za-z0-9:_./-]*$')
  UNION ALL SELECT payload_id, fi * 1e9 + (hi + 1) * 1e5 + 2, 'StartLine', CASE WHEN a < 1 THEN 'min' ELSE 'max' END, CASE WHEN a < 1 THEN '1' ELSE '1000000' END FROM hn WHERE a < 1 OR a > 1000000
  UNION ALL SELECT payload_id, fi * 1e9 + (hi + 1) * 1e5 + 3, 'EndLine', 'gtfield', 'StartLine' FROM hn WHERE b <= a
  UNION ALL SELECT payload_id, fi * 1e9 + (hi + 1) * 1e5 + side * 15000 + li, ['OursLines', 'TheirsLines', 'BaseLines'][side - 3] || '[' || li || ']', 'safe_content', '' FROM jl WHERE strlen(line) > 10000 OR regexp_matches(line, '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]')
  UNION ALL SELECT payload_id, fi * 1e9 + 9e8 + side * 1e7 + li, ['BeforeLines', 'AfterLines'][side + 1] || '[' || li || ']', 'safe_content', '' FROM jc WHERE strlen(line) > 10000 OR regexp_matches(line, '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]')
  UNION ALL SELECT payload_id, fi * 1e9 + 9e8, 'BeforeLines', 'max', '50' FROM jf WHERE json_array_length(f, '$.context.before_lines') > 50
  UNION ALL SELECT payload_id, 1e15, 'RepoPath', CASE WHEN coalesce(j->>'$.metadata.repo_path', '') = '' THEN 'required' ELSE 'repo_path' END, '' FROM valid_json WHERE coalesce(j->>'$.metadata.repo_path', '') = '' OR regexp_matches(j->>'$.metadata.repo_path', '[;|&`$]')
  UNION ALL SELECT payload_id, 1e15 + 1, 'TotalFiles', CASE WHEN nf < 0 THEN 'min' ELSE 'max' END, CASE WHEN nf < 0 THEN '0' ELSE '1000' END FROM meta WHERE nf NOT BETWEEN 0 AND 1000
  UNION ALL SELECT payload_id, 1e15 + 2, 'TotalConflicts', CASE WHEN nc < 0 THEN 'min' ELSE 'max' END, CASE WHEN nc < 0 THEN '0' ELSE '5000' END FROM meta WHERE nc NOT BETWEEN 0 AND 5000
  UNION ALL SELECT payload_id, 1e15 + 3, 'Version', 'max', '20' FROM meta WHERE length(version) > 20),
field_errors AS (SELECT payload_id, count(*)::INT AS n, arg_min(field, place) AS field, arg_min(tag, place) AS tag, arg_min(param, place) AS param FROM rules GROUP BY 1),
across AS (SELECT payload_id, fi * 1e9 AS place, 'files[' || fi || '].path' AS field, 'duplicate' AS tag FROM jf QUALIFY count(*) OVER (PARTITION BY payload_id, f->>'path') > 1
  UNION ALL SELECT payload_id, fi * 1e9 + (hi + 1) * 10, 'files[' || fi || '].conflicts[' || hi || ']', 'conflict_size' FROM (SELECT payload_id, fi, hi, count(*) AS n FROM jl GROUP BY ALL) WHERE n > 1000
  UNION ALL SELECT payload_id, fi * 1e9 + (hi + 1) * 10 + 1, 'files[' || fi || '].conflicts[' || hi || '].id', 'duplicate_id' FROM hn QUALIFY count(*) OVER (PARTITION BY payload_id, fi, id) > 1),
across_first AS (SELECT payload_id, arg_min(field, place) AS field, arg_min(tag, place) AS tag FROM across GROUP BY 1),
totals AS (SELECT v.payload_id, json_array_length(j, '$.files')::INT AS total_files, (SELECT count(*) FROM jh WHERE jh.payload_id = v.payload_id)::INT AS total_conflicts, coalesce((SELECT max(strlen(line)) FROM jl WHERE jl.payload_id = v.payload_id), 0)::INT AS longest_line FROM valid_json v),
staged AS (SELECT t.payload_id, CASE WHEN t.text = '' THEN 'required' WHEN v.payload_id IS NULL THEN 'json' WHEN u.payload_id IS NOT NULL THEN 'decode' WHEN e.n > 0 THEN 'fields' WHEN a.payload_id IS NOT NULL THEN 'business' END AS stage,
  e.n, e.field AS e_field, e.tag AS e_tag, e.param, a.field AS a_field, a.tag AS a_tag, x.* EXCLUDE (payload_id) FROM texts t LEFT JOIN valid_json v USING (payload_id) LEFT JOIN undecoded u USING (payload_id) LEFT JOIN field_errors e USING (payload_id) LEFT JOIN across_first a USING (payload_id) LEFT JOIN totals x USING (payload_id))"""
SQL_MESSAGE = "CASE e_tag " + " ".join(f"WHEN '{t}' THEN {literal(m.split('%s')[0])} || e_field || {literal(m.split('%s')[1])}" + (f" || param || {literal(m.split('%s')[2])}" if m.count("%s") == 2 else "") for t, m in dims.RULE_MESSAGES.items()) + " END"


@query(sql(f""", {SQL_PAYLOADS} SELECT payload_id, stage IS NULL AS valid, stage, CASE WHEN stage IS NULL THEN 0 WHEN stage = 'fields' THEN n ELSE 1 END AS n_errors,
CASE stage WHEN 'fields' THEN e_field WHEN 'business' THEN a_field ELSE CASE WHEN stage IS NOT NULL THEN 'payload' END END AS field, CASE stage WHEN 'fields' THEN e_tag WHEN 'business' THEN a_tag ELSE stage END AS tag,
CASE stage WHEN 'fields' THEN {SQL_MESSAGE} WHEN 'business' THEN a_tag WHEN 'required' THEN 'Payload cannot be empty' WHEN 'json' THEN 'Invalid JSON format' WHEN 'decode' THEN 'JSON parsing failed' END AS message,
CASE WHEN stage IS NULL THEN total_files END AS total_files, CASE WHEN stage IS NULL THEN total_conflicts END AS total_conflicts, CASE WHEN stage IS NULL THEN longest_line END AS longest_line FROM staged""", "hunks"))
def payload_strict_validate(spark, sf_dir):
    """Each payload's stage, errors and summary, from its text alone."""
    return payload.validated(faulty(payloads(spark, sf_dir))).drop("text", "files", "metadata")


def sql_clean(path: str) -> str:
    return f"left(replace(replace(replace({path}, chr(0), ''), '..', ''), '//', '/'), {dims.CLEAN_PATH})"


@query(sql(f""", {SQL_PAYLOADS} SELECT h.payload_id, {sql_clean("j->>'$.metadata.repo_path'")} AS repo_path, h.fi::INT AS file_index, {sql_clean("f->>'path'")} AS path, h.hi::INT AS hunk_index, h->>'id' AS hunk_id, (h->>'start_line')::BIGINT AS start_line,
md5(array_to_string((h->'ours_lines')::VARCHAR[], chr(10))) AS ours_md5, md5(array_to_string((f->'$.context.before_lines')::VARCHAR[], chr(10))) AS before_md5
FROM jh h JOIN jf USING (payload_id, fi) JOIN valid_json v ON v.payload_id = h.payload_id JOIN staged s ON s.payload_id = h.payload_id WHERE stage IS NULL""", "hunks"))
def payload_load(spark, sf_dir):
    """Payloads that pass, cleaned and read into hunks; the others do not get in."""
    # Outer, and filtered by what comes out: a filter on valid would run all checks once more for each step below it.
    files = payload.loaded(faulty(payloads(spark, sf_dir))).select("payload_id", "repo_path", F.posexplode_outer("files").alias("file_index", "f")).filter("f IS NOT NULL")
    hunks = files.select("payload_id", "repo_path", "file_index", F.col("f.path").alias("path"), F.col("f.context.before_lines").alias("before"), F.posexplode("f.conflicts").alias("hunk_index", "h"))
    text = lambda c: F.md5(F.array_join(c, "\n"))
    return hunks.select("payload_id", "repo_path", "file_index", "path", "hunk_index", F.col("h.id").alias("hunk_id"), F.col("h.start_line").alias("start_line"), text("h.ours_lines").alias("ours_md5"), text("before").alias("before_md5"))


@query("""SELECT doc_id, replace(text, chr(0), '') = text AS clean_text, CASE WHEN doc_id % 2 = 0 THEN strlen(text) <= 10000 AND NOT regexp_matches(text, '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]') ELSE false END AS safe,
list_contains(['go', 'rust', 'text'], ['Go', 'cobol', 'rust'][doc_id % 3 + 1].lower()) AS known_language, doc_id % 4 <> 1 AS good_id FROM documents""")
def sql_predicates(spark, sf_dir):
    """The named predicates as SQL functions."""
    T.register_predicates(spark)
    V.table(spark, sf_dir, "documents").createOrReplaceTempView("predicate_documents")
    return spark.sql(
        """SELECT doc_id, replace(text, chr(0), '') = text AS clean_text, is_safe_content(CASE WHEN doc_id % 2 = 0 THEN text ELSE concat(text, chr(1)) END) AS safe,
        is_language(element_at(array('Go', 'cobol', 'rust'), CAST(doc_id % 3 + 1 AS INT))) AS known_language, is_conflict_id(CASE WHEN doc_id % 4 = 1 THEN 'a b' ELSE concat('src/x.go:', doc_id) END) AND is_filepath(concat('src/', doc_id)) AND is_repo_path('/work') AS good_id FROM predicate_documents"""
    )
