"""Resolutions: statistics, checks, splicing, parsing of answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import text as T
from ..operators import apply, parse
from ..sources import views as V
from ..sources.views import sql
from .files import PAYLOAD_LANG, sql_any
from .registry import query

SQL_PROBLEM = r"""CASE WHEN file_path = '' THEN 'file path is empty' WHEN start_line <= 0 THEN 'start line must be positive' WHEN end_line < start_line THEN 'end line before start line'
  WHEN len(resolved_lines) = 0 THEN 'no resolved lines' WHEN confidence < 0 OR confidence > 1 THEN 'confidence out of range'
  WHEN len(list_filter(resolved_lines, lambda x: regexp_matches(x, '^\s*(<<<<<<<|=======|>>>>>>>|[|][|][|][|][|][|][|])'))) > 0 THEN 'conflict marker in resolution' ELSE '' END"""


def problem():
    return apply.problem(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("resolved_lines"), F.col("confidence"))


@query(sql("""SELECT count(*) AS total, coalesce(round(avg(confidence), 6), 0) AS avg_confidence, least(coalesce(min(confidence), 0), 1.0) AS min_confidence, greatest(coalesce(max(confidence), 0), 0.0) AS max_confidence,
count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence >= 0.6 AND confidence < 0.8) AS medium, count(*) FILTER (confidence < 0.6) AS low, count(*) FILTER (reasoning <> '') AS with_reasoning FROM res""", "res"))
def resolution_stats(spark, sf_dir):
    c = F.col("confidence")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return V.resolutions(spark, sf_dir).agg(
        F.count("*").alias("total"), zero(F.round(F.avg(c), 6)).alias("avg_confidence"), F.least(zero(F.min(c)), F.lit(1.0)).alias("min_confidence"), F.greatest(zero(F.max(c)), F.lit(0.0)).alias("max_confidence"),
        F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.6) & (c < 0.8)).alias("medium"), F.count_if(c < 0.6).alias("low"), F.count_if(F.col("reasoning") != "").alias("with_reasoning"),
    )


@query(sql("SELECT CASE WHEN confidence >= 0.7 THEN 'kept' ELSE 'skipped' END AS part, count(*) AS n, round(avg(confidence), 6) AS mean FROM res GROUP BY 1", "res"))
def confidence_split(spark, sf_dir):
    part = F.when(F.col("confidence") >= 0.7, "kept").otherwise("skipped")
    return V.resolutions(spark, sf_dir).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"))


@query(sql(f"SELECT doc_id, idx, {SQL_PROBLEM} AS error FROM res", "res"))
def resolution_validate(spark, sf_dir):
    return V.resolutions(spark, sf_dir).select("doc_id", "idx", problem().alias("error"))


@query(sql(f"SELECT bool_and({SQL_PROBLEM} = '') AS all_valid, count(*) FILTER ({SQL_PROBLEM} = '') AS valid, count(*) FILTER ({SQL_PROBLEM} = '' AND confidence >= 0.7) AS applied_if_continuing FROM res", "res"))
def safe_apply_gate(spark, sf_dir):
    r = V.resolutions(spark, sf_dir).select((problem() == "").alias("ok"), "confidence")
    return r.agg(F.bool_and("ok").alias("all_valid"), F.count_if("ok").alias("valid"), F.count_if(F.col("ok") & (F.col("confidence") >= 0.7)).alias("applied_if_continuing"))


SPLICED = "list_concat(list_concat(c.lines[1:r.start_line - 1], r.resolved_lines), c.lines[r.end_line + 1:])"


@query(sql(f"SELECT r.doc_id, r.idx, len({SPLICED})::BIGINT AS n_lines, md5(array_to_string({SPLICED}, chr(10))) AS content_md5 FROM res r JOIN conflicts c USING (doc_id) WHERE {SQL_PROBLEM} = '' AND r.end_line <= len(c.lines)", "conflicts", "res"))
def splice_single(spark, sf_dir):
    """Each well-formed resolution spliced alone into its file."""
    good = V.resolutions(spark, sf_dir).filter(problem() == "").join(V.conflicts(spark, sf_dir).select("doc_id", "lines"), "doc_id")
    new = apply.splice(F.col("lines"), F.col("start_line").cast("int"), F.col("end_line").cast("int"), F.col("resolved_lines"))
    return good.filter(F.col("end_line") <= F.size("lines")).select("doc_id", "idx", F.size(new).cast("long").alias("n_lines"), F.md5(F.array_join(new, "\n")).alias("content_md5"))


def by_file(spark, sf_dir, contents=None):
    """(doc_id, file_path, lines, rs, ok, new): each named file with its resolutions in one array; ok if it is there, all are well-formed and fit when spliced from the last on, new the result.

    Resolutions count for the path they name, and those that name none for no file. A file has at most a hundred or so: its array is bounded by the file's own lines.
    The files are those in conflict, with their doc_id, unless given as contents (path, lines)."""
    one = F.struct(F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "resolved_lines")
    rs = V.resolutions(spark, sf_dir).filter("file_path <> ''").groupBy("file_path").agg(F.collect_list(one).alias("rs"), F.bool_and(problem() == "").alias("formed"))
    contents = V.conflicts(spark, sf_dir) if contents is None else contents
    files = rs.join(contents.withColumnRenamed("path", "file_path"), "file_path", "left").withColumn("new", F.when(F.col("formed"), apply.splice_all(F.col("lines"), F.col("rs"))))
    return files.withColumn("ok", F.col("new").isNotNull())


# Lines are numbered in quarters, so that what is put in stands after what is before it; overlapping ranges are cut as the file is when their turn comes.
SQL_SPLICE = f"""ordered AS (SELECT r.*, row_number() OVER (PARTITION BY doc_id ORDER BY start_line DESC, end_line DESC) AS turn, count(*) OVER (PARTITION BY doc_id) AS turns, bool_and({SQL_PROBLEM} = '') OVER (PARTITION BY doc_id) AS formed FROM res r WHERE file_path <> ''),
spliced(doc_id, turn, turns, formed, lines) AS (SELECT c.doc_id, 0::BIGINT, any_value(o.turns), any_value(o.formed), any_value(c.lines) FROM conflicts c JOIN ordered o USING (doc_id) GROUP BY c.doc_id
  UNION ALL SELECT s.doc_id, o.turn, s.turns, s.formed AND s.lines IS NOT NULL, CASE WHEN o.end_line <= len(s.lines) THEN list_concat(list_concat(s.lines[1:o.start_line - 1], o.resolved_lines), s.lines[o.end_line + 1:]) END
  FROM spliced s JOIN ordered o ON o.doc_id = s.doc_id AND o.turn = s.turn + 1 WHERE s.formed),
done AS (SELECT c.doc_id, s.lines AS new, c.lines, coalesce(s.lines IS NOT NULL AND s.formed, false) AS ok FROM (SELECT DISTINCT doc_id FROM res WHERE file_path <> '') r JOIN conflicts c USING (doc_id) LEFT JOIN (SELECT * FROM spliced WHERE turn = turns) s USING (doc_id))"""


@query(sql(f", {SQL_SPLICE} SELECT doc_id, md5(array_to_string(new, chr(10))) AS content_md5, len(lines)::BIGINT AS n_before, len(new)::BIGINT AS n_after FROM done WHERE ok", "res"))
def splice_multi(spark, sf_dir):
    """All resolutions of each file, spliced from the last on."""
    return by_file(spark, sf_dir).filter("ok").select("doc_id", F.md5(F.array_join("new", "\n")).alias("content_md5"), F.size("lines").cast("long").alias("n_before"), F.size("new").cast("long").alias("n_after"))


@query(sql(f", {SQL_SPLICE}, unnamed AS (SELECT least(count(*), 1) AS n FROM res WHERE file_path = '') SELECT count(*) FILTER (ok) AS applied_count, count(*) FILTER (NOT ok) + any_value(unnamed.n) AS failed_count FROM done, unnamed", "res"))
def apply_rollup(spark, sf_dir):
    """Counts of files, not of resolutions: one that fails fails its file, and others go on; all that name no file are one that fails."""
    counts = by_file(spark, sf_dir).agg(F.count_if("ok").alias("applied_count"), F.count_if(~F.col("ok")).alias("failed"))
    unnamed = V.resolutions(spark, sf_dir).agg(F.least(F.count_if(F.col("file_path") == ""), F.lit(1)).alias("unnamed"))
    return counts.crossJoin(unnamed).select("applied_count", (F.col("failed") + F.col("unnamed")).alias("failed_count"))  # one row and one row


@query(sql(f"SELECT doc_id % 4 AS batch, doc_id, idx, confidence, NULL AS error FROM res WHERE doc_id % 4 <> 3 UNION ALL SELECT 3, doc_id, NULL, NULL, 'batch 3 failed' FROM (SELECT DISTINCT doc_id FROM res WHERE doc_id % 4 = 3)", "res"))
def batch_results_concat(spark, sf_dir):
    """The results of four batches as one table: a batch that failed has errors in place of results."""
    r = V.resolutions(spark, sf_dir).withColumn("batch", F.col("doc_id") % 4)
    done = [r.filter(F.col("batch") == k).select("batch", "doc_id", "idx", "confidence") for k in range(3)]
    failed = r.filter("batch = 3").select("batch", "doc_id").distinct().withColumn("error", F.lit("batch 3 failed"))
    return apply.concatenated([*done, failed])


@query(sql(f", x AS (SELECT r.*, NOT list_contains((SELECT list(doc_id) FROM documents WHERE doc_id % 9 = 0), r.doc_id) AS there FROM res r) SELECT doc_id, idx, CASE WHEN file_path = '' THEN 'File path is empty' WHEN NOT there THEN 'File does not exist: ' || file_path ELSE '' END AS missing, {SQL_PROBLEM} = '' AND there AS valid FROM x", "res"))
def apply_checks(spark, sf_dir):
    """Resolutions whose file is there and which are well-formed."""
    there = V.table(spark, sf_dir, "documents").filter("doc_id % 9 <> 0").select("doc_id", F.lit(True).alias("there"))
    r = V.resolutions(spark, sf_dir).join(there, "doc_id", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    missing = F.when(F.col("file_path") == "", "File path is empty").when(~F.col("there"), F.concat(F.lit("File does not exist: "), "file_path")).otherwise("")
    return r.select("doc_id", "idx", missing.alias("missing"), ((problem() == "") & F.col("there")).alias("valid"))


GO_LINES = "CASE WHEN doc_id % 2 = 0 THEN list_concat(['func a() error {', '  v, err := call(x)'], resolved_lines) ELSE resolved_lines END"
SQL_ANSWER = f"""answers AS (SELECT doc_id, idx, 'Here you are:' || chr(10) || to_json({{'resolutions': [{{'file_path': file_path, 'start_line': start_line, 'end_line': end_line, 'resolved_lines': {GO_LINES}, 'confidence': confidence, 'reasoning': reasoning,
  'go_specific_notes': CASE WHEN doc_id % 3 = 0 THEN 'note' ELSE '' END}}]}})::VARCHAR || chr(10) || 'Bye.' AS text FROM res),
found AS (SELECT doc_id, idx, json_extract(regexp_extract(text, '(?s)(\\{{.*\\}})', 1), '$.resolutions[0]') AS r FROM answers),
parsed AS (SELECT doc_id, idx, r->>'file_path' AS file_path, (r->>'start_line')::INT AS start_line, (r->>'end_line')::INT AS end_line, (r->>'confidence')::DOUBLE AS confidence, r->>'reasoning' AS why, r->>'go_specific_notes' AS notes, (r->'resolved_lines')::VARCHAR[] AS ls FROM found),
plines AS (SELECT doc_id, idx, unnest(range(1, len(ls) + 1)) AS n, regexp_replace(unnest(ls), '^[\\s]+|[\\s]+$', '', 'g') AS line FROM parsed),
pahead AS (SELECT *, coalesce(lead(line, 1) OVER w, '') AS l1, coalesce(lead(line, 2) OVER w, '') AS l2, sum(length(line) - length(replace(line, '{{', '')) - length(line) + length(replace(line, '}}', ''))) OVER (w ROWS UNBOUNDED PRECEDING) AS depth FROM plines WINDOW w AS (PARTITION BY doc_id, idx ORDER BY n)),
broken AS (SELECT doc_id, idx, bool_or(regexp_matches(line, 'func\\s+\\w+\\([^)]*\\)[^{{]*$') AND NOT contains(line, '{{')) OR bool_or({sql_any("line", dims.BAD_DECLARATIONS)}) OR bool_or({sql_any("line", dims.TYPE_MISMATCHES)})
  OR bool_or(contains(line, '(') AND contains(line, ')') AND contains(line, ', err') AND NOT {sql_any("l1", dims.GO_HANDLED)} AND NOT {sql_any("l2", dims.GO_HANDLED)}) OR min(depth) < 0 OR arg_max(depth, n) <> 0
  OR bool_or(regexp_matches(line, '^(if|for|switch|select)[ (]') AND NOT contains(line, '{{')) AS bad FROM pahead GROUP BY ALL),
json_parsed AS (SELECT p.doc_id, p.idx, file_path, start_line, end_line, confidence * CASE WHEN ends_with(lower(file_path), '.go') AND coalesce(bad, false) THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS confidence,
  CASE WHEN notes = '' THEN why WHEN why = '' THEN 'Go-specific: ' || notes ELSE why || ' [Go-specific: ' || notes || ']' END AS reasoning, array_to_string(ls, chr(10)) AS resolved FROM parsed p LEFT JOIN broken b ON b.doc_id = p.doc_id AND b.idx = p.idx)"""


def json_answers(spark, sf_dir):
    """(doc_id, idx, text): answers with prose around their JSON."""
    code = F.when(F.col("doc_id") % 2 == 0, F.concat(F.array(F.lit("func a() error {"), F.lit("  v, err := call(x)")), "resolved_lines")).otherwise(F.col("resolved_lines"))
    one = F.struct("file_path", "start_line", "end_line", code.alias("resolved_lines"), "confidence", "reasoning", F.when(F.col("doc_id") % 3 == 0, "note").otherwise("").alias("go_specific_notes"))
    return V.resolutions(spark, sf_dir).select("doc_id", "idx", F.concat(F.lit("Here you are:\n"), F.to_json(F.struct(F.array(one).alias("resolutions"))), F.lit("\nBye.")).alias("text"))


def answer_rows(answers, parser):
    r = answers.select("doc_id", "idx", F.explode(parser(F.col("text"))).alias("r")).select("doc_id", "idx", "r.*")
    return r.select("doc_id", "idx", "file_path", "start_line", "end_line", F.round("confidence", 6).alias("confidence"), "reasoning", F.md5(F.array_join("resolved_lines", "\n")).alias("resolved_md5"))


@query(sql(f", {SQL_ANSWER} SELECT doc_id, idx, file_path, start_line, end_line, round(confidence, 6) AS confidence, reasoning, md5(resolved) AS resolved_md5 FROM json_parsed", "res"))
def parse_json_resolutions(spark, sf_dir):
    """Answers with prose around their JSON; Go code with a fault costs confidence."""
    return answer_rows(json_answers(spark, sf_dir), parse.json_resolutions)


SQL_TEXT = f"""texts AS (SELECT doc_id, idx, 'I looked at it.' || chr(10) || 'File: ' || file_path || chr(10) || '  Lines ' || start_line || '-' || end_line || chr(10) || 'confidence: ' || CASE WHEN doc_id % 5 = 0 THEN '0.2.5' ELSE '0.' || (doc_id % 90 + 10) END || chr(10)
  || 'Reasoning: ' || reasoning || chr(10) || CASE WHEN doc_id % 6 = 0 THEN 'nothing more' ELSE 'Resolved content:' END || chr(10) || '--- a rule' || chr(10) || '# a remark' || chr(10) || array_to_string(resolved_lines, chr(10)) || chr(10) || 'file second.go' || chr(10) || 'the resolution' || chr(10) || '  kept line' AS text FROM res),
tl0 AS (SELECT doc_id, idx, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n, regexp_replace(unnest(string_split(text, chr(10))), '^[\\s]+|[\\s]+$', '', 'g') AS line FROM texts),
tl1 AS (SELECT *, regexp_extract(line, '(?i)file:?\\s*(.+)', 1) AS file FROM tl0), tl2 AS (SELECT *, count(*) FILTER (file <> '') OVER (PARTITION BY doc_id, idx ORDER BY n) AS rec FROM tl1),
tl3 AS (SELECT *, min(n) FILTER (contains(lower(line), 'resolution') OR contains(lower(line), 'resolved')) OVER (PARTITION BY doc_id, idx, rec) AS began FROM tl2 WHERE rec > 0),
tl4 AS (SELECT doc_id, idx, rec, trim(max(file)) AS file_path, coalesce(arg_max(try_cast(regexp_extract(line, '(?i)lines?\\s*(\\d+)-(\\d+)', 1) AS INT), n) FILTER (regexp_matches(line, '(?i)lines?\\s*(\\d+)-(\\d+)') AND n <= coalesce(began, n)), 0) AS start_line,
  coalesce(arg_max(try_cast(regexp_extract(line, '(?i)lines?\\s*(\\d+)-(\\d+)', 2) AS INT), n) FILTER (regexp_matches(line, '(?i)lines?\\s*(\\d+)-(\\d+)') AND n <= coalesce(began, n)), 0) AS end_line,
  coalesce(arg_max(try_cast(regexp_extract(line, '(?i)confidence:?\\s*([0-9.]+)', 1) AS DOUBLE), n) FILTER (try_cast(regexp_extract(line, '(?i)confidence:?\\s*([0-9.]+)', 1) AS DOUBLE) IS NOT NULL), 0.5) AS confidence,
  coalesce(arg_max(regexp_extract(line, '(?i)reasoning:?\\s*(.+)', 1), n) FILTER (regexp_matches(line, '(?i)reasoning:?\\s*(.+)')), '') AS reasoning,
  coalesce(list(line ORDER BY n) FILTER (n > began AND line <> '' AND NOT contains(line, '---') AND NOT contains(line, '===') AND NOT starts_with(line, '#') AND NOT starts_with(line, '//')), []) AS resolved_lines FROM tl3 GROUP BY ALL),
text_parsed AS (SELECT * FROM tl4 WHERE {SQL_PROBLEM} = '')"""


def text_answers(spark, sf_dir):
    """(doc_id, idx, text): answers in plain text, two records each."""
    i = F.col("doc_id")
    parts = [
        F.lit("I looked at it."), F.concat(F.lit("File: "), "file_path"), F.concat(F.lit("  Lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")),
        F.concat(F.lit("confidence: "), F.when(i % 5 == 0, "0.2.5").otherwise(F.concat(F.lit("0."), (i % 90 + 10).cast("string")))), F.concat(F.lit("Reasoning: "), "reasoning"),
        F.when(i % 6 == 0, "nothing more").otherwise("Resolved content:"), F.lit("--- a rule"), F.lit("# a remark"), F.array_join("resolved_lines", "\n"), F.lit("file second.go"), F.lit("the resolution"), F.lit("  kept line"),
    ]
    return V.resolutions(spark, sf_dir).select("doc_id", "idx", F.concat_ws("\n", *parts).alias("text"))


@query(sql(f", {SQL_TEXT} SELECT doc_id, idx, file_path, start_line, end_line, round(confidence, 6) AS confidence, reasoning, md5(array_to_string(resolved_lines, chr(10))) AS resolved_md5 FROM text_parsed", "res"))
def parse_text_resolutions(spark, sf_dir):
    """Answers in plain text: records that are well-formed."""
    return answer_rows(text_answers(spark, sf_dir), parse.text_resolutions)


@query(sql(f""", {SQL_ANSWER}, {SQL_TEXT} SELECT doc_id, idx, file_path, start_line, end_line, round(confidence, 6) AS confidence, reasoning, md5(resolved) AS resolved_md5 FROM json_parsed WHERE (doc_id + idx) % 2 = 0
UNION ALL SELECT doc_id, idx, file_path, start_line, end_line, round(confidence, 6), reasoning, md5(array_to_string(resolved_lines, chr(10))) FROM text_parsed WHERE (doc_id + idx) % 2 = 1""", "res"))
def parse_answers(spark, sf_dir):
    """Answers of both forms through one parser: JSON where an answer has it, and else plain text."""
    even = (F.col("doc_id") + F.col("idx")) % 2 == 0
    both = json_answers(spark, sf_dir).filter(even).unionByName(text_answers(spark, sf_dir).filter(~even))
    return answer_rows(both, parse.answer_resolutions)


@query(sql(f"SELECT r.doc_id, r.idx, CASE WHEN f.path IS NULL THEN 'file not found in payload' ELSE '' END AS failure, coalesce(f.language = 'go', false) AS is_go FROM res r LEFT JOIN (SELECT path, {PAYLOAD_LANG} AS language FROM files WHERE doc_id % 2 = 0) f ON f.path = r.file_path", "files", "res"))
def resolution_file_lookup(spark, sf_dir):
    """Each resolution with its file in the payload: a failure where there is none, and whether Go's checks apply."""
    f = V.files(spark, sf_dir).filter("doc_id % 2 = 0").dropDuplicates(["path"]).select(F.col("path").alias("file_path"), T.payload_language(F.col("path")).alias("language"))
    r = V.resolutions(spark, sf_dir).select("doc_id", "idx", "file_path").join(f, "file_path", "left")
    return r.select("doc_id", "idx", F.when(F.col("language").isNull(), "file not found in payload").otherwise("").alias("failure"), F.coalesce(F.col("language") == "go", F.lit(False)).alias("is_go"))


@query(sql("""SELECT file_path, string_agg(CASE WHEN reasoning <> '' THEN file_path || ': ' || reasoning END, '; ' ORDER BY idx) AS reasoning FROM res GROUP BY file_path, doc_id HAVING arg_min(reasoning, idx) <> ''""", "res"))
def reasoning_by_file(spark, sf_dir):
    """The reasonings of a file's resolutions in one text, where the first has one."""
    rows = V.resolutions(spark, sf_dir).groupBy("file_path", "doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "reasoning"))).alias("rs"))
    rows = rows.filter(F.col("rs")[0]["reasoning"] != "")
    each = F.transform(F.filter("rs", lambda r: r["reasoning"] != ""), lambda r: F.concat("file_path", F.lit(": "), r["reasoning"]))
    return rows.select("file_path", F.array_join(each, "; ").alias("reasoning"))


@query(sql("SELECT file_path || ':' || start_line AS conflict_id, array_to_string(resolved_lines, chr(10)) AS resolution, CASE WHEN reasoning = '' THEN '' ELSE file_path || ': ' || reasoning END AS reasoning FROM res", "res"))
def ai_result_projection(spark, sf_dir):
    named = F.when(F.col("reasoning") == "", "").otherwise(F.concat_ws(": ", "file_path", "reasoning"))
    return V.resolutions(spark, sf_dir).select(F.concat_ws(":", "file_path", F.col("start_line").cast("string")).alias("conflict_id"), F.array_join("resolved_lines", "\n").alias("resolution"), named.alias("reasoning"))


@query(sql("SELECT doc_id, confidence, array_to_string(resolved_lines[1:2], ' | ') AS preview FROM res ORDER BY confidence DESC, doc_id, idx LIMIT 3", "res"))
def preview_topk(spark, sf_dir):
    return V.resolutions(spark, sf_dir).orderBy(F.desc("confidence"), "doc_id", "idx").limit(3).select("doc_id", "confidence", F.array_join(F.slice("resolved_lines", 1, 2), " | ").alias("preview"))


@query(sql("SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n, count(*) FILTER (reasoning <> '') AS with_reasoning, min(doc_id) AS first_doc FROM res GROUP BY 1", "res"))
def resolution_tiers(spark, sf_dir):
    return V.resolutions(spark, sf_dir).groupBy(apply.tier(F.col("confidence")).alias("tier")).agg(F.count("*").alias("n"), F.count_if(F.col("reasoning") != "").alias("with_reasoning"), F.min("doc_id").alias("first_doc"))


@query(sql("SELECT doc_id, idx, start_line, lead(start_line) OVER (PARTITION BY file_path ORDER BY start_line, doc_id) <= end_line AS overlaps FROM res WHERE file_path <> ''", "res"))
def resolution_overlaps(spark, sf_dir):
    """Ranges of one file that overlap the next one: splicing them in turn would cut shifted text."""
    after = F.lead("start_line").over(Window.partitionBy("file_path").orderBy("start_line", "doc_id"))
    return V.resolutions(spark, sf_dir).filter("file_path <> ''").select("doc_id", "idx", "start_line", (after <= F.col("end_line")).alias("overlaps"))
