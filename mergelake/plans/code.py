"""Checks over code and text: balance, look-ahead, Go heuristics, redaction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import text as T
from ..operators import apply, checks
from ..sources import views as V
from ..sources.views import quoted, sql
from .registry import query


def sql_balance(column: str, a: str, b: str) -> str:
    return f"(length(replace({column}, '{b}', '')) - length(replace({column}, '{a}', '')))::BIGINT"


@query(f"SELECT page_id, {sql_balance('html', '{', '}')} AS braces, {sql_balance('html', '(', ')')} AS parens, {sql_balance('html', '[', ']')} AS brackets FROM pages")
def bracket_balance(spark, sf_dir):
    h = F.col("html")
    return V.table(spark, sf_dir, "pages").select("page_id", T.imbalance(h, "{", "}").alias("braces"), T.imbalance(h, "(", ")").alias("parens"), T.imbalance(h, "[", "]").alias("brackets"))


PYTHON = "list_concat(['if x' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ':' ELSE '' END, repeat(' ', (doc_id % 6)::INT) || 'y = (1', 'for i in z:', '   pass', 'elif done'], string_split(text, chr(10)))"


@query(rf"""WITH l AS (SELECT doc_id, unnest(range(1, len({PYTHON}) + 1)) AS n, unnest({PYTHON}) AS line FROM documents),
i AS (SELECT *, length(line) - length(ltrim(line, ' ' || chr(9))) AS indent, trim(line, ' ' || chr(9)) AS t FROM l)
SELECT doc_id, n, unnest(list_filter([CASE WHEN t <> '' AND indent % 4 <> 0 AND indent % 2 <> 0 THEN 'Line ' || n || ': Inconsistent indentation' END, CASE WHEN regexp_matches(t, '^(if|for|while|def|class) ') AND NOT ends_with(t, ':') THEN 'Line ' || n || ': Missing colon' END], lambda x: x IS NOT NULL)) AS message FROM i""")
def python_line_checks(spark, sf_dir):
    i = F.col("doc_id")
    fixed = F.array(F.concat(F.lit("if x"), i.cast("string"), F.when(i % 2 == 0, ":").otherwise("")), F.concat(F.repeat(F.lit(" "), (i % 6).cast("int")), F.lit("y = (1")), F.lit("for i in z:"), F.lit("   pass"), F.lit("elif done"))
    rows = V.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.concat(fixed, T.lines(F.col("text")))).alias("p", "line")).withColumn("n", (F.col("p") + 1).cast("long"))
    each = F.array_compact(F.array(*[F.when(c, F.concat(F.lit("Line "), F.col("n").cast("string"), F.lit(": " + m))) for c, m in ((checks.odd_indent(F.col("line")), "Inconsistent indentation"), (checks.no_colon(F.col("line")), "Missing colon"))]))
    return rows.select("doc_id", "n", F.explode(each).alias("message"))


# What each language's checks say of lines, as SQL: imbalances of brackets, and lines.
BRACKETS = [("{", "}", "braces"), ("(", ")", "parentheses"), ("[", "]", "brackets")]
SQL_NET = ", ".join(f"sum(length(replace(t, '{b}', '')) - length(replace(t, '{a}', ''))) AS {n}" for a, b, n in BRACKETS)


@query(sql(rf""", f AS (SELECT c.doc_id, ['go', 'javascript', 'typescript', 'python', 'java', 'c', ''][c.doc_id % 7 + 1] AS language, c.lines, d.doc_id % 8 <> 3 AS there FROM code c JOIN documents d USING (doc_id)),
l AS (SELECT doc_id, language, unnest(range(1, len(lines) + 1)) AS n, unnest(lines) AS line FROM f), t AS (SELECT *, regexp_replace(line, '^[\s]+|[\s]+$', '', 'g') AS t, lead(regexp_replace(line, '^[\s]+|[\s]+$', '', 'g')) OVER (PARTITION BY doc_id ORDER BY n) AS after FROM l),
g AS (SELECT doc_id, any_value(language) AS language, {SQL_NET},
 count(*) FILTER (t <> '' AND NOT ends_with(t, ';') AND NOT ends_with(t, '{{') AND NOT ends_with(t, '}}') AND NOT contains(t, '//')) AS open_lines, count(*) FILTER (t <> '' AND NOT ends_with(t, ';') AND NOT ends_with(t, '{{') AND NOT ends_with(t, '}}') AND NOT contains(t, '//') AND (starts_with(t, 'package ') OR starts_with(t, 'import '))) AS exempt,
 count(*) FILTER (ends_with(t, ';') AND NOT contains(t, 'for')) AS semicolons, count(*) FILTER (t <> '' AND (length(line) - length(ltrim(line, ' ' || chr(9)))) % 2 <> 0) AS odd, count(*) FILTER (regexp_matches(t, '^(if|for|while|def|class) ') AND NOT ends_with(t, ':')) AS colons,
 count(*) FILTER (NOT contains(t, 'var ') AND NOT contains(t, 'let ') AND NOT contains(t, 'const ') AND contains(t, 'return') AND after <> '' AND NOT starts_with(after, '}}')) AS unreachable,
 bool_or(regexp_matches(t, '^(<<<<<<<|=======|>>>>>>>|[|][|][|][|][|][|][|])')) AS marked FROM t GROUP BY doc_id),
h AS (SELECT g.*, there, (CASE WHEN language IN ('go', 'javascript', 'typescript', 'java') THEN (braces <> 0)::INT + (parentheses <> 0)::INT + (brackets <> 0)::INT WHEN language = 'python' THEN (parentheses <> 0)::INT + (brackets <> 0)::INT + colons ELSE 0 END)::BIGINT AS errors,
 (CASE language WHEN 'go' THEN semicolons WHEN 'javascript' THEN open_lines WHEN 'typescript' THEN open_lines WHEN 'java' THEN open_lines - exempt WHEN 'python' THEN odd ELSE (braces <> 0)::INT + (parentheses <> 0)::INT + (brackets <> 0)::INT END)::BIGINT AS warnings FROM g JOIN (SELECT doc_id, there FROM f) f USING (doc_id))
SELECT doc_id, language, there AND NOT marked AS valid, NOT there OR language = '' OR errors = 0 AS syntax_valid, errors, warnings, unreachable FROM h""", "code"))
def syntax_checks(spark, sf_dir):
    """Each language's checks over lines of code, and what applying a resolution makes of them."""
    language = V.picked(["go", "javascript", "typescript", "python", "java", "c", ""], F.col("doc_id") % 7)
    rows = V.code(spark, sf_dir).select("doc_id", "lines", language.alias("language"), (F.col("doc_id") % 8 != 3).alias("there"))
    rows = rows.withColumn("s", checks.syntax(F.col("language"), F.col("lines"))).withColumn("u", checks.unreachable(F.col("lines")))
    done = checks.outcome(F.col("there"), F.col("language"), F.col("s"), F.exists("lines", T.is_marker))
    count = lambda c: F.size(F.col("s")[c]).cast("long").alias(c)
    return rows.select("doc_id", "language", done["valid"].alias("valid"), done["syntax_valid"].alias("syntax_valid"), count("errors"), count("warnings"), F.size("u").cast("long").alias("unreachable"))


@query(sql(r""", l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS n, unnest(lines) AS line FROM code), a AS (SELECT *, trim(lead(line) OVER (PARTITION BY doc_id ORDER BY n)) AS after FROM l)
SELECT doc_id, n + 1 AS n, after FROM a WHERE starts_with(trim(line), 'return') AND NOT regexp_matches(line, '\b(var|let|const)\b') AND after <> '' AND NOT starts_with(after, '}')""", "code"))
def unreachable_after_return(spark, sf_dir):
    rows = V.code(spark, sf_dir).select("doc_id", F.posexplode("lines").alias("p", "line")).withColumn("n", (F.col("p") + 1).cast("long"))
    rows = rows.withColumn("after", F.trim(F.lead("line").over(Window.partitionBy("doc_id").orderBy("n"))))
    hit = F.startswith(F.trim("line"), F.lit("return")) & ~F.col("line").rlike(r"\b(var|let|const)\b") & (F.col("after") != "") & ~F.startswith("after", F.lit("}"))
    return rows.filter(hit).select("doc_id", (F.col("n") + 1).alias("n"), "after")


def sql_has(column: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"


SQL_FUNCTIONS = r"list_filter(list_transform(list_filter(lines, lambda x: regexp_matches(x, '^\s*func\s+(\w*\s*)?\w+\s*\([^)]*\)')), lambda x: regexp_extract(x, '^\s*func\s+([^\s(]*)', 1)), lambda x: x <> '')"
SQL_FACTOR = f"""(CASE WHEN {sql_balance('body', '{', '}')} = 0 AND {sql_balance('body', '(', ')')} = 0 AND {sql_balance('body', '[', ']')} = 0 AND NOT {sql_has('body', dims.GO_REJECTED)} THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END
 * CASE WHEN len({SQL_FUNCTIONS}) = len(list_distinct({SQL_FUNCTIONS})) THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END
 * CASE WHEN len(list_filter(lines, lambda x: regexp_matches(x, '^\\s*import\\s+') AND contains(x, 'import "') AND NOT ends_with(regexp_extract(x, 'import "(.*)$', 1), '"'))) > 0 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END
 * CASE WHEN {sql_has('body', dims.GO_ERRORS)} OR contains(body, 'defer ') OR regexp_matches(body, '\\b[a-z][a-zA-Z0-9]*\\b') OR regexp_matches(body, '\\b[A-Z][A-Z0-9_]*\\b') THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END)"""


@query(sql(f""", b AS (SELECT c.doc_id, array_to_string(c.lines, chr(10)) AS body, c.lines, (c.doc_id * 37 % 101)::DOUBLE / 100.0::DOUBLE AS confidence, CASE WHEN c.doc_id % 10 < 8 THEN f.path END AS path FROM code c JOIN files f USING (doc_id))
SELECT doc_id, confidence, round(CASE WHEN ends_with(lower(path), '.go') THEN least(greatest(confidence * {SQL_FACTOR}, 0.0), 1.0) ELSE confidence END, 6) AS adjusted FROM b""", "files", "code"))
def go_confidence_adjust(spark, sf_dir):
    """Resolutions whose file is Go in the payload are scored by their code; others, and those without a file there, stay as they are."""
    r = V.code(spark, sf_dir).withColumn("confidence", F.col("doc_id") * 37 % 101 / 100.0)
    payload = V.files(spark, sf_dir).filter("doc_id % 10 < 8").select("doc_id", T.payload_language(F.col("path")).alias("language")).filter("language = 'go'")
    scored = apply.clamped(F.col("confidence") * apply.go_factor(F.col("lines")))
    return r.join(payload, "doc_id", "left").select("doc_id", "confidence", F.round(F.when(F.col("language").isNotNull(), scored).otherwise(F.col("confidence")), 6).alias("adjusted"))


@query(sql(f""", l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS n, trim(unnest(lines)) AS line FROM code), a AS (SELECT *, coalesce(lead(line, 1) OVER w, '') AS l1, coalesce(lead(line, 2) OVER w, '') AS l2 FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
chars AS (SELECT doc_id, string_split(regexp_replace(array_to_string(lines, ''), '[^{{}}]', '', 'g'), '') AS cs FROM code), ch AS (SELECT doc_id, unnest(range(1, len(cs) + 1)) AS k, unnest(cs) AS c FROM chars),
d AS (SELECT doc_id, sum(CASE c WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY k) AS depth, k FROM ch), dd AS (SELECT doc_id, min(depth) < 0 OR arg_max(depth, k) <> 0 AS bad FROM d GROUP BY doc_id)
SELECT a.doc_id, bool_or(regexp_matches(line, 'func\\s+\\w+\\([^)]*\\)[^{{]*$') AND NOT contains(line, '{{')) AS incomplete_function, bool_or({sql_has('line', dims.BAD_DECLARATIONS)}) AS bad_declaration,
bool_or({sql_has('line', dims.TYPE_MISMATCHES)}) AS type_mismatch, bool_or(contains(line, '(') AND contains(line, ')') AND contains(line, ', err') AND NOT {sql_has('l1', dims.GO_HANDLED)} AND NOT {sql_has('l2', dims.GO_HANDLED)}) AS unhandled_error,
coalesce(any_value(dd.bad), false) AS bad_depth, bool_or(regexp_matches(line, '^(if|for|switch|select)[ (]') AND NOT contains(line, '{{')) AS open_control FROM a LEFT JOIN dd USING (doc_id) GROUP BY a.doc_id""", "code"))
def go_semantic_issues(spark, sf_dir):
    issues = apply.go_issues(F.col("lines"))
    return V.code(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in issues.items()])


@query(sql(r""", l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS n, regexp_replace(unnest(lines), '^[\s]+|[\s]+$', '', 'g') AS t FROM code),
b AS (SELECT *, max(CASE WHEN starts_with(t, 'import (') THEN n END) OVER w AS opened, max(CASE WHEN starts_with(t, ')') THEN n END) OVER w AS closed FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
i AS (SELECT doc_id, string_agg(CASE WHEN starts_with(t, 'import "') THEN t ELSE chr(9) || t END, '|' ORDER BY n) AS imports FROM b
  WHERE starts_with(t, 'import "') OR (opened > coalesce(closed, 0) AND NOT starts_with(t, 'import (') AND t <> '' AND NOT starts_with(t, '//')) GROUP BY doc_id)
SELECT c.doc_id, substr(list_filter(list_transform(lines[1:10], lambda x: trim(x)), lambda x: starts_with(x, 'package '))[1], 9) AS package, coalesce(imports, '') AS imports,
array_to_string(list_filter(lines, lambda x: regexp_matches(x, '^\s*func\s+(\w*\s*)?\w+\s*\([^)]*\).*$')), '|') AS functions, array_to_string(list_filter(lines, lambda x: regexp_matches(x, '^\s*type\s+\w+\s+(struct|interface).*$')), '|') AS types FROM code c LEFT JOIN i USING (doc_id)""", "code"))
def go_context_extract(spark, sf_dir):
    """Package, imports (also those of a block), signatures and types of Go code."""
    like = lambda p: F.array_join(F.filter("lines", lambda x: x.rlike(p)), "|")
    package = F.get(F.filter(F.transform(F.slice("lines", 1, 10), T.trimmed), lambda x: F.startswith(x, F.lit("package "))), 0)
    return V.code(spark, sf_dir).select("doc_id", F.regexp_replace(package, "^package ", "").alias("package"), F.array_join(checks.imports(F.col("lines")), "|").alias("imports"), like(dims.GO_FUNCTION).alias("functions"), like(dims.GO_TYPE).alias("types"))


@query(sql(r""", f AS (SELECT doc_id, unnest(regexp_extract_all(array_to_string(lines, chr(10)), 'func (\w+)\(', 1)) AS name FROM code) SELECT doc_id, name, count(*) AS n FROM f GROUP BY ALL HAVING count(*) > 1""", "code"))
def go_function_duplicates(spark, sf_dir):
    rows = V.code(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all(F.array_join("lines", "\n"), F.lit(r"func (\w+)\("), F.lit(1))).alias("name"))
    return rows.groupBy("doc_id", "name").agg(F.count("*").alias("n")).filter("n > 1")


SECRETS = """text || chr(10) || CASE doc_id % 5 WHEN 0 THEN 'password: hunter' || doc_id WHEN 1 THEN 'Bearer abc.' || doc_id WHEN 2 THEN 'api_key = k' || doc_id || ', rest' WHEN 3 THEN 'ghp_' || repeat('a1B2c3D4', 4) || ' x' ELSE 'no secret' END"""
SQL_REDACT = "s"
for _p in dims.REDACTED:
    SQL_REDACT = f"regexp_replace({SQL_REDACT}, '{_p}', '[REDACTED]', 'g')"


@query(f"WITH x AS (SELECT doc_id, {SECRETS} AS s FROM documents) SELECT doc_id, md5({SQL_REDACT}) AS clean_md5, (length(s) - length({SQL_REDACT}))::BIGINT AS shorter FROM x")
def redact_secrets(spark, sf_dir):
    i = F.col("doc_id")
    s = i.cast("string")
    planted = F.when(i % 5 == 0, F.concat(F.lit("password: hunter"), s)).when(i % 5 == 1, F.concat(F.lit("Bearer abc."), s)).when(i % 5 == 2, F.concat(F.lit("api_key = k"), s, F.lit(", rest"))).when(i % 5 == 3, "ghp_" + "a1B2c3D4" * 4 + " x").otherwise("no secret")
    rows = V.table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n"), planted).alias("s")).withColumn("clean", T.redact(F.col("s")))
    return rows.select("doc_id", F.md5("clean").alias("clean_md5"), (F.length("s") - F.length("clean")).cast("long").alias("shorter"))


ACTION_TEXT = """string_split(CASE WHEN (conv_id + turn) % 3 = 0 THEN 'Reading file: src/a' || conv_id || chr(10) || text WHEN (conv_id + turn) % 3 = 1 THEN text || chr(10) || 'now executing: make and writing to file b' || turn ELSE text END, chr(10))"""


@query(rf"""WITH l AS (SELECT conv_id, turn, unnest(range(0, len({ACTION_TEXT}))) AS n, unnest({ACTION_TEXT}) AS line FROM conversations),
a AS (SELECT conv_id, turn, n, 'read' AS action, regexp_extract(line, '(?i)reading\s+file:?\s+(.+)', 1) AS target FROM l UNION ALL SELECT conv_id, turn, n, 'write', regexp_extract(line, '(?i)writing\s+to\s+file:?\s+(.+)', 1) FROM l
UNION ALL SELECT conv_id, turn, n, 'bash', regexp_extract(line, '(?i)executing:?\s+(.+)', 1) FROM l) SELECT * FROM a WHERE target <> ''""")
def action_extract(spark, sf_dir):
    from ..operators import parse

    k = (F.col("conv_id") + F.col("turn")) % 3
    text = F.when(k == 0, F.concat(F.lit("Reading file: src/a"), F.col("conv_id").cast("string"), F.lit("\n"), "text"))
    text = text.when(k == 1, F.concat("text", F.lit("\nnow executing: make and writing to file b"), F.col("turn").cast("string"))).otherwise(F.col("text"))
    return parse.actions(V.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text")), "conv_id", "turn")


@query("""WITH r AS (SELECT conv_id, turn, CASE (conv_id + turn) % 3 WHEN 0 THEN to_json({'success': true, 'content': text})::VARCHAR WHEN 1 THEN to_json({'content': text})::VARCHAR ELSE text END AS raw FROM conversations),
j AS (SELECT *, json_valid(raw) AND left(ltrim(raw), 1) = '{' AS is_json FROM r)
SELECT conv_id, turn, CASE WHEN is_json THEN coalesce((raw->>'success')::BOOLEAN, false) ELSE true END AS success, md5(CASE WHEN is_json THEN raw->>'content' ELSE raw END) AS content_md5 FROM j""")
def response_envelope(spark, sf_dir):
    """Answers as JSON where they are that (no success field: a failure), and as plain successful text where not."""
    k = (F.col("conv_id") + F.col("turn")) % 3
    raw = F.when(k == 0, F.to_json(F.struct(F.lit(True).alias("success"), F.col("text").alias("content")))).when(k == 1, F.to_json(F.struct(F.col("text").alias("content")))).otherwise(F.col("text"))
    rows = V.table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("raw")).withColumn("j", F.from_json("raw", "struct<success:boolean,content:string,_corrupt_record:string>", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    is_json = F.col("j").isNotNull() & F.col("j._corrupt_record").isNull()
    return rows.select("conv_id", "turn", F.when(is_json, F.coalesce("j.success", F.lit(False))).otherwise(F.lit(True)).alias("success"), F.md5(F.when(is_json, F.col("j.content")).otherwise(F.col("raw"))).alias("content_md5"))


ERRORS = ["Connection reset", "context deadline exceeded", "HTTP 429 too many requests", "HTTP 503", "invalid token", "network path not found", "open x: Permission denied", "rate limit 503"]
ERROR = f"({quoted(ERRORS)})[event_id % 8 + 1]"
RETRY = "CASE " + " ".join(f"WHEN {sql_has('lower(error)', p)} THEN {str(a).lower()}" for p, a in dims.RETRY_RULES) + " ELSE false END"


def errors(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select("event_id", V.picked(ERRORS, F.col("event_id") % 8).alias("error"))


@query(f"WITH e AS (SELECT event_id, {ERROR} AS error FROM events) SELECT error, {RETRY} AS retry, count(*) AS n FROM e GROUP BY ALL")
def retry_classify(spark, sf_dir):
    return errors(spark, sf_dir).groupBy("error", T.retryable(F.col("error")).alias("retry")).agg(F.count("*").alias("n"))


@query(f"""WITH e AS (SELECT event_id, {ERROR} AS error FROM events) SELECT CASE WHEN {sql_has('error', ['connection', 'deadline'])} THEN 'network' WHEN {sql_has('error', ['429', '503', 'rate limit'])} THEN 'api' WHEN {sql_has('error', ['token'])} THEN 'authentication'
WHEN {sql_has('error', ['not found'])} THEN 'file' ELSE 'other' END AS kind, count(*) AS n, min(event_id) AS first_event FROM e GROUP BY 1""")
def error_classify(spark, sf_dir):
    e = F.col("error")
    kind = F.when(T.contains_any(e, ["connection", "deadline"]), "network").when(T.contains_any(e, ["429", "503", "rate limit"]), "api").when(F.contains(e, F.lit("token")), "authentication").when(F.contains(e, F.lit("not found")), "file").otherwise("other")
    return errors(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


BASE = f"CASE WHEN {sql_has('lower(error)', ['500', '502', '503', '504'])} THEN 2.0::DOUBLE WHEN {sql_has('lower(error)', ['rate limit', '429'])} THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END"


@query(f"WITH e AS (SELECT DISTINCT {ERROR} AS error, event_id % 4 AS attempt FROM events) SELECT error, attempt, least({BASE} * (1 << attempt::INT) * 0.75::DOUBLE, 30.0) AS least_seconds, least({BASE} * (1 << attempt::INT) * 1.25::DOUBLE, 30.0) AS most_seconds FROM e")
def backoff_bounds(spark, sf_dir):
    low = F.lower("error")
    base = F.when(T.contains_any(low, ["500", "502", "503", "504"]), 2.0).when(T.contains_any(low, ["rate limit", "429"]), 5.0).otherwise(1.0)
    rows = errors(spark, sf_dir).select("error", (F.col("event_id") % 4).alias("attempt")).distinct()
    wait = lambda j: F.least(base * F.pow(F.lit(2.0), "attempt") * j, F.lit(30.0))
    return rows.select("error", "attempt", wait(0.75).alias("least_seconds"), wait(1.25).alias("most_seconds"))


@query(f"WITH e AS (SELECT event_id, {ERROR} AS error FROM events) SELECT event_id, 'api: ' || error || CASE WHEN event_id % 3 = 0 THEN ' (line ' || event_id || ')' ELSE '' END AS message FROM e")
def error_text(spark, sf_dir):
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" (line "), F.col("event_id").cast("string"), F.lit(")"))).otherwise("")
    return errors(spark, sf_dir).select("event_id", F.concat(F.lit("api: "), "error", line).alias("message"))


HINTS = "array_to_string(flatten([" + ", ".join(f"CASE WHEN {sql_has('lower(error)', parts)} THEN {quoted(hints)} ELSE []::VARCHAR[] END" for parts, hints in dims.ERROR_HINTS) + "]), '; ')"
STATUS = "CASE status " + " ".join(f"WHEN {c} THEN '{'; '.join(h)}'" for c, h in dims.STATUS_HINTS.items()) + " ELSE '' END"
KINDS = ["repository", "conflict", "filesystem", "validation", "authentication", "network", "configuration", "api"]
KIND = f"({quoted(KINDS)})[event_id % 8 + 1]"
CAN_RECOVER = "CASE WHEN kind = 'api' THEN status >= 500 ELSE NOT list_contains(" + quoted([k for k, ok in dims.RECOVERABLE.items() if not ok]) + ", kind) END"


@query(f"""WITH e AS (SELECT event_id, {ERROR} AS error, {KIND} AS kind, ([401, 403, 429, 500, 503, 404])[event_id % 6 + 1] AS status FROM events)
SELECT error, kind, status, {HINTS} AS hints, CASE WHEN kind = 'api' THEN {STATUS} ELSE '' END AS status_hints, {CAN_RECOVER} AS recoverable, upper(left(kind, 1)) || substr(kind, 2) || ' Error: ' || error AS title, count(*) AS n FROM e GROUP BY ALL""")
def error_hints(spark, sf_dir):
    """Errors with what to do about them, whether they may be recovered from, and their headings."""
    i = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, [401, 403, 429, 500, 503, 404])), (i % 6 + 1).cast("int"))
    e = V.table(spark, sf_dir, "events").select(V.picked(ERRORS, i % 8).alias("error"), V.picked(KINDS, i % 8).alias("kind"), status.alias("status"))
    e = e.groupBy("error", "kind", "status").agg(F.count("*").alias("n"))
    return e.select("error", "kind", "status", F.array_join(T.hints(F.col("error")), "; ").alias("hints"), F.when(F.col("kind") == "api", F.array_join(T.status_hints(F.col("status")), "; ")).otherwise("").alias("status_hints"), T.recoverable(F.col("kind"), F.col("status")).alias("recoverable"), F.concat(F.initcap("kind"), F.lit(" Error: "), "error").alias("title"), "n")
