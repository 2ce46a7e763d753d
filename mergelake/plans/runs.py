"""Roll-ups of batch runs and validation runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import text as T
from ..operators import checks
from ..sources import views as V
from ..sources.views import quoted, sql
from .files import PACKAGE, make_targets, package_text, scripts
from .registry import query


@query(sql("""SELECT batch_id, count(*) AS n, (sum(ms) // count(*))::BIGINT AS mean_ms, CASE WHEN sum(ms) > 0 THEN round(sum(conflicts) / (sum(ms) / 1000.0::DOUBLE), 6) ELSE 0 END AS per_second, round(coalesce(avg(confidence) FILTER (ok), 0), 6) AS confidence FROM runs GROUP BY 1""", "runs"))
def batch_metrics(spark, sf_dir):
    """Mean latency in whole milliseconds, throughput, mean confidence of what succeeded."""
    ms = F.sum("ms")
    return V.runs(spark, sf_dir).groupBy("batch_id").agg(
        F.count("*").alias("n"), F.floor(ms / F.count("*")).cast("long").alias("mean_ms"), F.when(ms > 0, F.round(F.sum("conflicts") / (ms / 1000.0), 6)).otherwise(0.0).alias("per_second"),
        F.round(F.coalesce(F.avg(F.when(F.col("ok"), F.col("confidence"))), F.lit(0.0)), 6).alias("confidence"),
    )


@query(sql("SELECT count(*) AS processed, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, coalesce(sum(conflicts) FILTER (ok), 0)::BIGINT AS resolved, round(avg(confidence) FILTER (ok), 6) AS confidence FROM runs", "runs"))
def batch_outcome_rollup(spark, sf_dir):
    ok = F.col("ok")
    return V.runs(spark, sf_dir).agg(
        F.count("*").alias("processed"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("conflicts"))), F.lit(0).cast("long")).alias("resolved"), F.round(F.avg(F.when(ok, F.col("confidence"))), 6).alias("confidence")
    )


@query(sql("SELECT max(ms) AS peak_ms, max(conflicts) AS peak_conflicts, count(*) AS samples, count(DISTINCT batch_id) AS batches FROM runs", "runs"))
def peak_and_counts(spark, sf_dir):
    return V.runs(spark, sf_dir).agg(F.max("ms").alias("peak_ms"), F.max("conflicts").alias("peak_conflicts"), F.count("*").alias("samples"), F.countDistinct("batch_id").alias("batches"))


@query(sql("SELECT batch_id, 'Batch ' || batch_id || ' failed: ' || count(*) || ' of its calls' AS warning FROM runs WHERE NOT ok GROUP BY batch_id", "runs"))
def batch_warnings(spark, sf_dir):
    """A warning for each batch with a failed call."""
    rows = V.runs(spark, sf_dir).filter(~F.col("ok")).groupBy("batch_id").agg(F.count("*").alias("n"))
    return rows.select("batch_id", F.concat(F.lit("Batch "), F.col("batch_id").cast("string"), F.lit(" failed: "), F.col("n").cast("string"), F.lit(" of its calls")).alias("warning"))


#: Projects of a workspace stand for repositories; each document is a file of one.
PROJECTS = 40
TYPES = ["go", "typescript", "javascript", "python", "rust", "other"]
CATALOGUE = " UNION ALL ".join(f"SELECT '{t}' AS type, {k} AS ordinal, '{n}' AS name, '{c}' AS command, '{a}' AS args, {str(r).lower()} AS required" for t, cs in dims.COMMANDS.items() for k, (n, c, a, r) in enumerate(cs))
SQL_CATALOGUE = f"""projects AS (SELECT DISTINCT doc_id % {PROJECTS} AS project, ({quoted(TYPES)})[doc_id % {PROJECTS} % 6 + 1] AS type FROM documents), catalogue AS ({CATALOGUE}),
npm AS (SELECT project, list_filter({quoted(dims.NPM_SCRIPTS)}, lambda x: list_contains(json_keys({PACKAGE.replace("doc_id", "project")}, '$.scripts'), x)) AS scripts FROM projects WHERE type IN ('typescript', 'javascript')),
commands AS (SELECT p.project, p.type, c.ordinal, c.name, c.command, c.args, c.required FROM projects p JOIN catalogue c USING (type) LEFT JOIN npm n USING (project) WHERE coalesce(len(n.scripts), 0) = 0
  UNION ALL SELECT p.project, p.type, s.k - 1, 'npm_' || s.name, 'npm', 'run ' || s.name, s.name = 'build' FROM projects p JOIN (SELECT project, unnest(scripts) AS name, unnest(range(1, len(scripts) + 1)) AS k FROM npm) s USING (project)
  UNION ALL SELECT project, type, k, 'make_' || ['test', 'build', 'lint'][k + 1], 'make', ['test', 'build', 'lint'][k + 1], k = 1 FROM (SELECT *, unnest(range(3)) AS k FROM projects WHERE type = 'other'))"""
MAKEFILE = "# all of it\ntest: a\n\techo\nbuild : b\nother: c\nlint:"


def catalogue(spark, sf_dir):
    """(project, type, ordinal, name, command, args, required): what is run to validate each project.

    A Node project with known npm scripts runs these in place of its type's own commands; any other kind of project runs the known targets of its make file."""
    k = F.col("doc_id") % PROJECTS
    projects = V.table(spark, sf_dir, "documents").select(k.alias("project"), V.picked(TYPES, k % 6).alias("type")).distinct()
    fixed = spark.createDataFrame([(t, i, *c) for t, cs in dims.COMMANDS.items() for i, c in enumerate(cs)], "type string, ordinal bigint, name string, command string, args string, required boolean")
    own = F.when(F.col("type").isin("typescript", "javascript"), scripts(package_text(F.col("project")))).otherwise(F.array().cast("array<string>"))
    projects = projects.withColumn("scripts", own)
    direct = projects.filter(F.size("scripts") == 0).join(F.broadcast(fixed), "type").select("project", "type", "ordinal", "name", "command", "args", "required")
    npm = projects.select("project", "type", F.posexplode("scripts").alias("ordinal", "s"))
    npm = npm.select("project", "type", F.col("ordinal").cast("long"), F.concat(F.lit("npm_"), "s").alias("name"), F.lit("npm").alias("command"), F.concat(F.lit("run "), "s").alias("args"), (F.col("s") == "build").alias("required"))
    targets = make_targets(projects.filter("type = 'other'").select("project", "type", F.posexplode(T.lines(F.lit(MAKEFILE))).alias("n", "line")))
    place = F.row_number().over(Window.partitionBy("project").orderBy("n")) - 1
    make = targets.select("project", "type", place.cast("long").alias("ordinal"), F.concat(F.lit("make_"), "target").alias("name"), F.lit("make").alias("command"), F.col("target").alias("args"), (F.col("target") == "build").alias("required"))
    return direct.unionByName(npm).unionByName(make)


@query(f"WITH {SQL_CATALOGUE} SELECT project, type, ordinal::BIGINT AS ordinal, name, command, args, required FROM commands")
def command_catalogue(spark, sf_dir):
    return catalogue(spark, sf_dir)


SQL_RESULTS = """results AS (SELECT *, (project * 7 + ordinal * 5) % 11 NOT IN (3, 4) AS success, (project * 7 + ordinal * 5) % 11 = 4 AS skipped FROM commands)"""
SQL_TRIMMED = r"regexp_replace(line, '^[\s]+|[\s]+$', '', 'g')"
SQL_KINDS = " + ".join(f"(sum(length(replace(t, '{b}', '')) - length(replace(t, '{a}', ''))) <> 0)::INT" for a, b in ("{}", "()", "[]"))
SQL_OPEN = "t <> '' AND NOT ends_with(t, ';') AND NOT ends_with(t, '{') AND NOT ends_with(t, '}') AND NOT contains(t, '//')"
SQL_ISSUES = rf"""scanned AS (SELECT doc_id, path, unnest(lines) AS line FROM conflicts WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, path, unnest(string_split(coalesce(content, ''), chr(10))) FROM files WHERE doc_id % 3 <> 0),
stripped AS (SELECT *, {SQL_TRIMMED} AS t, lower(regexp_extract(path, '([^.]*)$', 1)) AS ext FROM scanned),
checked AS (SELECT doc_id, count(*) FILTER (regexp_matches(t, '^(<<<<<<<|=======|>>>>>>>)')) AS errors, (CASE WHEN ext = 'go' THEN {SQL_KINDS} + count(*) FILTER (ends_with(t, ';') AND NOT contains(t, 'for')) WHEN ext IN ('js', 'ts') THEN {SQL_KINDS} + count(*) FILTER ({SQL_OPEN})
  WHEN ext = 'py' THEN {SQL_KINDS.split(" + ", 1)[1]} + count(*) FILTER (regexp_matches(t, '^(if|for|while|def|class) ') AND NOT ends_with(t, ':')) + count(*) FILTER (t <> '' AND (length(line) - length(ltrim(line, ' ' || chr(9)))) % 2 <> 0) ELSE 0 END)::BIGINT AS warnings FROM stripped GROUP BY doc_id, path, ext)"""


def results(spark, sf_dir):
    """The catalogue's commands with what came of them; running them is outside this engine."""
    r = (F.col("project") * 7 + F.col("ordinal") * 5) % 11
    return catalogue(spark, sf_dir).withColumn("success", ~r.isin(3, 4)).withColumn("skipped", r == 4)


def checked(spark, sf_dir):
    """(doc_id, errors, warnings) of every file, each scanned whole: markers left in it are errors, and what its language's checks find are warnings, for faults of syntax don't make a file invalid.

    One file of three is still in conflict, the others are resolved."""
    unresolved = V.conflicts(spark, sf_dir).filter("doc_id % 3 = 0").select("doc_id", "path", "lines")
    resolved = V.files(spark, sf_dir).filter("doc_id % 3 <> 0").select("doc_id", "path", T.lines(F.coalesce("content", F.lit(""))).alias("lines"))
    language = T.mapped(F.lower(F.regexp_extract("path", r"([^.]*)\z", 1)), {"go": ["go"], "javascript": ["js"], "typescript": ["ts"], "python": ["py"]}, "")
    rows = unresolved.unionByName(resolved).withColumn("language", language).withColumn("found", F.when(F.col("language") != "", checks.syntax(F.col("language"), F.col("lines"))))
    markers = F.size(F.filter("lines", lambda x: T.trimmed(x).rlike(r"^(<{7}|={7}|>{7})"))).cast("long")
    return rows.select("doc_id", markers.alias("errors"), F.coalesce(F.size("found.errors") + F.size("found.warnings"), F.lit(0)).cast("long").alias("warnings"))


SQL_COMMAND_COUNTS = "count(*) AS commands, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success AND skipped) AS skipped_commands, count(*) FILTER (NOT success AND NOT skipped) AS failed, bool_or(required AND NOT success AND NOT skipped) AS broke"
SQL_FILE_COUNTS = "count(*) AS total_files, count(*) FILTER (errors = 0) AS valid_files, count(*) FILTER (errors > 0) AS invalid_files, sum(errors + warnings)::BIGINT AS total_issues, sum(errors)::BIGINT AS error_issues, sum(warnings)::BIGINT AS warning_issues"


def command_counts():
    ok, skipped = F.col("success"), F.col("skipped")
    broke = F.bool_or(F.col("required") & ~ok & ~skipped)
    return [F.count("*").alias("commands"), F.count_if(ok).alias("successful"), F.count_if(~ok & skipped).alias("skipped_commands"), F.count_if(~ok & ~skipped).alias("failed"), broke.alias("broke")]


def file_counts():
    n = F.col("errors")
    return [F.count("*").alias("total_files"), F.count_if(n == 0).alias("valid_files"), F.count_if(n > 0).alias("invalid_files"), F.sum(n + F.col("warnings")).alias("total_issues"), F.sum(n).alias("error_issues"), F.sum("warnings").alias("warning_issues")]


@query(sql(f", {SQL_CATALOGUE}, {SQL_RESULTS}, {SQL_ISSUES} SELECT * EXCLUDE (broke) FROM (SELECT {SQL_COMMAND_COUNTS} FROM results), (SELECT {SQL_FILE_COUNTS} FROM checked)", "conflicts"))
def validation_summary(spark, sf_dir):
    """Commands, files and issues of a run; one row from each side."""
    return results(spark, sf_dir).agg(*command_counts()).drop("broke").crossJoin(checked(spark, sf_dir).agg(*file_counts()))


@query(sql(f", {SQL_ISSUES} SELECT doc_id, path, errors AS markers FROM checked JOIN files USING (doc_id) WHERE errors > 0", "conflicts"))
def conflict_file_list(spark, sf_dir):
    """Files that still hold a marker."""
    return checked(spark, sf_dir).filter("errors > 0").join(V.files(spark, sf_dir).select("doc_id", "path"), "doc_id").select("doc_id", "path", F.col("errors").alias("markers"))


def by_project(spark, sf_dir):
    commands = results(spark, sf_dir).groupBy("project").agg(*command_counts())
    files = checked(spark, sf_dir).groupBy((F.col("doc_id") % PROJECTS).alias("project")).agg(*file_counts())
    both = files.join(commands, "project", "left").fillna(0, ["commands", "successful", "skipped_commands", "failed"])
    ok = ~F.coalesce("broke", F.lit(False)) & (F.col("invalid_files") == 0) & (F.col("error_issues") == 0)
    return both.withColumn("overall_success", ok)


SQL_PROJECTS = f"""f AS (SELECT doc_id % {PROJECTS} AS project, {SQL_FILE_COUNTS} FROM checked GROUP BY 1), c AS (SELECT project, {SQL_COMMAND_COUNTS} FROM results GROUP BY 1),
by_project AS (SELECT f.*, coalesce(commands, 0) AS commands, coalesce(successful, 0) AS successful, coalesce(skipped_commands, 0) AS skipped_commands, coalesce(failed, 0) AS failed, NOT coalesce(broke, false) AND invalid_files = 0 AND error_issues = 0 AS overall_success FROM f LEFT JOIN c USING (project))"""


@query(sql(f", {SQL_CATALOGUE}, {SQL_RESULTS}, {SQL_ISSUES}, {SQL_PROJECTS} SELECT project, overall_success FROM by_project", "conflicts"))
def overall_success(spark, sf_dir):
    """False where a required command failed, or any file is not free of conflicts."""
    return by_project(spark, sf_dir).select("project", "overall_success")


@query(sql(f", {SQL_CATALOGUE}, {SQL_RESULTS}, {SQL_ISSUES}, {SQL_PROJECTS} SELECT *, CASE WHEN overall_success THEN 'SUCCESS' WHEN commands = skipped_commands THEN 'SKIPPED' ELSE 'FAILED' END AS status FROM by_project", "conflicts"))
def project_validation_pipeline(spark, sf_dir):
    """Discovery, commands, files, counts and status of each project."""
    status = F.when(F.col("overall_success"), "SUCCESS").when(F.col("commands") == F.col("skipped_commands"), "SKIPPED").otherwise("FAILED")
    return by_project(spark, sf_dir).withColumn("status", status).drop("broke")


SIZES = "sizes AS (SELECT l_suppkey AS repo, sum(l_quantity)::BIGINT % {0} AS n FROM lineitem GROUP BY 1)"


def sizes(spark, sf_dir, most):
    """(repo, n): how many conflicts or files a repository has."""
    return V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("repo")).agg((F.sum("l_quantity").cast("long") % most).alias("n"))


@query(f"WITH {SIZES.format(800)} SELECT repo, n, CASE WHEN n > 500 THEN 5 WHEN n > 100 THEN 10 ELSE 25 END AS batch_size, n > 50 AS batch_mode FROM sizes")
def auto_batch_size(spark, sf_dir):
    n = F.col("n")
    return sizes(spark, sf_dir, 800).select("repo", "n", F.when(n > 500, 5).when(n > 100, 10).otherwise(25).alias("batch_size"), (n > 50).alias("batch_mode"))


@query(f"""WITH {SIZES.format(8000)} SELECT repo, n AS files, n > 500 AS streaming, CASE WHEN n > 5000 THEN 10 WHEN n > 1000 THEN 25 ELSE 50 END AS batch, CASE WHEN n > 5000 THEN 1 WHEN n > 1000 THEN 2 ELSE 4 END AS workers,
CASE WHEN n > 5000 THEN 128 WHEN n > 1000 THEN 256 ELSE 512 END AS memory_mb, CASE WHEN n > 1000 THEN 3 ELSE 5 END AS context_lines FROM sizes""")
def large_repo_config(spark, sf_dir):
    n = F.col("n")
    by = lambda huge, large, other: F.when(n > 5000, huge).when(n > 1000, large).otherwise(other)
    return sizes(spark, sf_dir, 8000).select("repo", n.alias("files"), (n > 500).alias("streaming"), by(10, 25, 50).alias("batch"), by(1, 2, 4).alias("workers"), by(128, 256, 512).alias("memory_mb"), by(3, 3, 5).alias("context_lines"))


LOG = """CASE event_id % 4 WHEN 0 THEN 'ok resolved conflict confidence: 0.' || (event_id % 90 + 10) WHEN 1 THEN 'failed to resolve' WHEN 2 THEN 'resolved resolved' ELSE 'note' END"""


@query(f"""WITH l AS (SELECT event_id, user_id, {LOG} AS line FROM events) SELECT user_id, sum(len(regexp_extract_all(line, 'resolved')))::BIGINT AS resolved, sum(len(regexp_extract_all(line, 'failed')))::BIGINT AS failed,
arg_max(regexp_extract(line, 'confidence: ([0-9.]+)', 1), event_id) FILTER (contains(line, 'confidence')) AS last_confidence FROM l GROUP BY user_id""")
def ci_log_scrape(spark, sf_dir):
    i = F.col("event_id")
    line = F.when(i % 4 == 0, F.concat(F.lit("ok resolved conflict confidence: 0."), (i % 90 + 10).cast("string"))).when(i % 4 == 1, "failed to resolve").when(i % 4 == 2, "resolved resolved").otherwise("note")
    rows = V.table(spark, sf_dir, "events").select("event_id", "user_id", line.alias("line"))
    last = F.max_by(F.regexp_extract("line", "confidence: ([0-9.]+)", 1), F.when(F.contains("line", F.lit("confidence")), F.col("event_id")))
    count = lambda p: F.sum(F.regexp_count("line", F.lit(p))).cast("long")
    return rows.groupBy("user_id").agg(count("resolved").alias("resolved"), count("failed").alias("failed"), last.alias("last_confidence"))
