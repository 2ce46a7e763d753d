"""Status listings, paths, extensions, languages, batches of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import text as T
from ..operators import order, parse
from ..sources import shared
from ..sources import views as V
from ..sources.views import quoted, sql
from .registry import query

EXT = r"regexp_extract(path, '(\.[^./]*)$', 1)"


def sql_any(column: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"


def sql_map(ext: str, table: dict[str, list[str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN list_contains({quoted(v)}, {ext}) THEN '{k}'" for k, v in table.items()) + f" ELSE {other} END"


DETECT_LANG = sql_map(f"lower({EXT})", dims.DETECT_LANGUAGE, "'text'")
PAYLOAD_LANG = sql_map(f"lower({EXT})", dims.PAYLOAD_LANGUAGE, "CASE WHEN ends_with(lower(path), 'dockerfile') THEN 'dockerfile' WHEN ends_with(lower(path), 'makefile') THEN 'makefile' ELSE 'text' END")
APPLY_LANG = sql_map(f"lower({EXT})", dims.APPLY_LANGUAGE, "''")
PAYLOAD_EXCLUDED = f"({sql_any('path', dims.PAYLOAD_EXCLUDED)} OR list_contains({quoted(dims.BINARY_EXTENSIONS)}, lower({EXT})))"
IS_CONFLICT = f"list_contains({quoted(dims.CONFLICT_STATUS)}, line[1:2])"


def status_rows(lines):
    """(status, path) of the lines of a status listing that are long enough."""
    return lines.filter(F.length("line") >= 3).select(F.substring("line", 1, 2).alias("status"), F.trim(F.substring(F.col("line"), F.lit(4), F.length("line"))).alias("path"))


@query(sql(f"SELECT line[1:2] AS status, trim(line[4:]) AS path FROM status WHERE length(line) >= 3 AND {IS_CONFLICT}", "status"))
def conflict_status_filter(spark, sf_dir):
    return status_rows(V.status(spark, sf_dir)).filter(F.col("status").isin(dims.CONFLICT_STATUS))


@query(sql(f"SELECT coalesce(bool_or({IS_CONFLICT}), false) AS in_merge_state, count(*) FILTER ({IS_CONFLICT}) AS conflicted FROM status", "status"))
def merge_state(spark, sf_dir):
    hit = F.col("status").isin(dims.CONFLICT_STATUS)
    return status_rows(V.status(spark, sf_dir)).agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("in_merge_state"), F.count_if(hit).alias("conflicted"))


@query(sql(f"SELECT doc_id, path FROM files WHERE {sql_any('lower(path)', dims.DETECT_EXCLUDED)}", "files"))
def excluded_files(spark, sf_dir):
    """The report without what was kept, as an anti join."""
    report = V.files(spark, sf_dir).select("doc_id", "path")
    return report.join(report.filter(~T.detect_excluded(F.col("path"))).select("doc_id"), "doc_id", "left_anti")


@query(sql(f"SELECT doc_id, path FROM files WHERE {PAYLOAD_EXCLUDED}", "files"))
def payload_excluded_files(spark, sf_dir):
    return V.files(spark, sf_dir).select("doc_id", "path").filter(T.payload_excluded(F.col("path")))


@query(sql(f", x AS (SELECT {EXT} AS ext, {DETECT_LANG} AS detect_language, {PAYLOAD_LANG} AS payload_language, {APPLY_LANG} AS apply_language FROM files) SELECT ext, detect_language, payload_language, apply_language, count(*) AS files FROM x WHERE detect_language <> payload_language OR detect_language <> apply_language GROUP BY ALL", "files"))
def language_map_disagreement(spark, sf_dir):
    path = F.col("path")
    rows = V.files(spark, sf_dir).select(T.extension(path).alias("ext"), T.detect_language(path).alias("detect_language"), T.payload_language(path).alias("payload_language"), T.apply_language(path).alias("apply_language"))
    return rows.filter("detect_language <> payload_language OR detect_language <> apply_language").groupBy("ext", "detect_language", "payload_language", "apply_language").agg(F.count("*").alias("files"))


NAMED = "CASE doc_id % 7 WHEN 0 THEN 'docs/README' WHEN 1 THEN 'Makefile' WHEN 2 THEN '.gitignore' WHEN 3 THEN 'a.b/LICENSE' ELSE path END"


@query(sql(rf", n AS (SELECT doc_id, {NAMED} AS path FROM files) SELECT doc_id, path FROM n WHERE CASE WHEN contains(path, '.') THEN list_contains({quoted(dims.TEXT_EXTENSIONS)}, regexp_extract(path, '(\.[^.]*)$', 1)) ELSE list_contains({quoted(dims.TEXT_NAMES)}, regexp_extract(path, '([^/]*)$', 1)) END", "files"))
def text_file_filter(spark, sf_dir):
    i = F.col("doc_id") % 7
    path = F.when(i == 0, "docs/README").when(i == 1, "Makefile").when(i == 2, ".gitignore").when(i == 3, "a.b/LICENSE").otherwise(F.col("path"))
    return V.files(spark, sf_dir).select("doc_id", path.alias("path")).filter(T.text_file(F.col("path")))


PATHS = """, paths AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '../' || page_id WHEN 1 THEN 'src/a b' || page_id WHEN 2 THEN '/etc/p' || page_id WHEN 3 THEN 'src/x' || page_id || '.go' WHEN 4 THEN 'a;b' || page_id ELSE url END AS path FROM pages) """


def paths(spark, sf_dir):
    i = F.col("page_id")
    s = i.cast("string")
    path = F.when(i % 6 == 0, F.concat(F.lit("../"), s)).when(i % 6 == 1, F.concat(F.lit("src/a b"), s)).when(i % 6 == 2, F.concat(F.lit("/etc/p"), s))
    path = path.when(i % 6 == 3, F.concat(F.lit("src/x"), s, F.lit(".go"))).when(i % 6 == 4, F.concat(F.lit("a;b"), s)).otherwise(F.col("url"))
    return V.table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


@query(
    "WITH "
    + PATHS[2:]
    + rf"""SELECT page_id, path, regexp_matches(path, '^[a-zA-Z0-9._/-]+$') AND NOT contains(path, '..') AND NOT starts_with(path, '/') AS strict_ok,
  length(path) > 0 AND NOT regexp_matches(path, '[;|&`$]') AS git_ok, NOT {sql_any('path', dims.UNSAFE_TOKENS)} AND NOT ({" OR ".join(f"starts_with(lower(path), '{p}')" for p in dims.UNSAFE_PREFIXES)})
  AND strlen(path) BETWEEN 1 AND 499 AND path <> '/' AS payload_ok, strlen(path) BETWEEN 1 AND 999 AND NOT regexp_matches(path, '[;|&`$]') AS repo_ok,
  regexp_matches(regexp_extract(path, '([^/]*)$', 1), '^[a-zA-Z0-9_-]+$') AS revision_ok, NOT contains(path, '..') AND NOT regexp_matches(path, '[;|&`$]') AS json_ok FROM paths"""
)
def path_guard(spark, sf_dir):
    p = F.col("path")
    return paths(spark, sf_dir).select(
        "page_id", "path", T.strict_path(p).alias("strict_ok"), T.shell_safe(p).alias("git_ok"), T.payload_path(p).alias("payload_ok"), T.repo_path(p).alias("repo_ok"), T.revision(T.base_name(p)).alias("revision_ok"), T.json_path(p).alias("json_ok")
    )


@query(
    """WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, n, md5(coalesce(string_agg(line, chr(10)) OVER before, '')) AS pre_md5, md5(coalesce(string_agg(line, chr(10)) OVER after, '')) AS post_md5 FROM l
WINDOW before AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), after AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)"""
)
def hunk_context_window(spark, sf_dir):
    """Three lines on either side of each line, as frames."""
    rows = V.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("p", "line")).withColumn("n", (F.col("p") + 1).cast("long"))
    w = Window.partitionBy("doc_id").orderBy("n")
    around = lambda a, b: F.md5(F.array_join(F.collect_list("line").over(w.rowsBetween(a, b)), "\n"))
    return rows.select("doc_id", "n", around(-3, -1).alias("pre_md5"), around(1, 3).alias("post_md5"))


#: Names of payload languages in order, which break ties between batches.
NAMES = sorted({*dims.PAYLOAD_LANGUAGE, "text"})
COUNTED = f"counted AS (SELECT c.doc_id, c.path, {PAYLOAD_LANG} AS language, coalesce(k.n, 0) AS n FROM conflicts c LEFT JOIN (SELECT doc_id, count(*) AS n FROM hunks GROUP BY 1) k USING (doc_id) WHERE NOT {PAYLOAD_EXCLUDED})"


def counted(spark, sf_dir):
    """(doc_id, path, language, n) of the files of a payload, with their number of hunks."""
    rows = V.conflicts(spark, sf_dir).filter(~T.payload_excluded(F.col("path")))
    return rows.select("doc_id", "path", T.payload_language(F.col("path")).alias("language"), F.size(parse.hunks(F.col("lines"))).cast("long").alias("n"))


@query(
    sql(
        f""", {COUNTED}, x AS (SELECT *, floor((row_number() OVER (PARTITION BY language ORDER BY doc_id) - 1) / 10)::BIGINT AS chunk FROM counted),
b AS (SELECT language, chunk, count(*) AS n_files, min(doc_id) AS first_doc, max(doc_id) AS last_doc, sum(n)::BIGINT AS total_conflicts FROM x GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY total_conflicts DESC, language, chunk) - 1 AS place FROM b""",
        "hunks",
    )
)
def batches_by_language(spark, sf_dir):
    """Ten files to a batch within each language; batches with the most hunks come first, ties by language and chunk.

    The files are parsed once: what is put in order are slim rows, written to the shared folder."""
    placed = order.ordinal(shared.kept(counted(spark, sf_dir).select("doc_id", "language", "n")), "doc_id", within="language")
    batches = placed.withColumn("chunk", F.floor(F.col("ordinal") / 10).cast("long")).groupBy("language", "chunk")
    batches = batches.agg(F.count("*").alias("n_files"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.sum("n").alias("total_conflicts"))
    name = F.array_position(F.array(*map(F.lit, NAMES)), F.col("language"))
    key = -F.col("total_conflicts") * F.lit(1 << 40) + name * F.lit(1 << 32) + F.col("chunk")
    return order.ordinal(shared.kept(batches.withColumn("__key", key)), "__key", "place").drop("__key")


@query(sql(f", {COUNTED}, i AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS file_index, * FROM counted) SELECT file_index, doc_id, n AS priority, 'file:' || path AS criteria, row_number() OVER (ORDER BY n DESC, file_index) - 1 AS place FROM i", "hunks"))
def batches_by_file(spark, sf_dir):
    """One file to a batch, its hunks as the priority; the largest come first, ties by the place in the input, which is the batch's id."""
    rows = order.ordinal(shared.kept(counted(spark, sf_dir)), "doc_id", "file_index").select("file_index", "doc_id", F.col("n").alias("priority"), F.concat(F.lit("file:"), "path").alias("criteria"))
    return order.ordinal(rows.withColumn("__key", -F.col("priority") * F.lit(1 << 40) + F.col("file_index")), "__key", "place").drop("__key")


@query(sql(", x AS (SELECT doc_id, floor((row_number() OVER (ORDER BY doc_id) - 1) / 25)::BIGINT AS batch FROM files) SELECT batch, count(*) AS n_files, min(doc_id) AS first_doc FROM x GROUP BY batch", "files"))
def batches_sequential(spark, sf_dir):
    rows = order.ordinal(V.files(spark, sf_dir).select("doc_id"), "doc_id")
    return rows.groupBy(F.floor(F.col("ordinal") / 25).cast("long").alias("batch")).agg(F.count("*").alias("n_files"), F.min("doc_id").alias("first_doc"))


TOKENS = "(strlen(path) // 4 + list_sum(list_transform(string_split(content, chr(10)), lambda x: strlen(x) // 4)))::BIGINT"


def tokens():
    return (F.floor(F.octet_length("path") / 4) + T.line_tokens(T.lines(F.col("content")))).cast("long")


@query(sql(f"SELECT doc_id, {TOKENS} AS tokens FROM files", "files"))
def estimate_tokens(spark, sf_dir):
    return V.files(spark, sf_dir).select("doc_id", tokens().alias("tokens"))


@query(
    sql(
        f""", t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, {TOKENS} AS tokens FROM files),
p(n, batch, used, held) AS (SELECT 0::BIGINT, 0, 0::BIGINT, 0
  UNION ALL SELECT t.n, CASE WHEN t.tokens > 3000 THEN 1 ELSE 0 END + CASE WHEN p.used + t.tokens > 3000 AND p.held > 0 THEN p.batch + 1 ELSE p.batch END,
    CASE WHEN t.tokens > 3000 THEN 0 WHEN p.used + t.tokens > 3000 AND p.held > 0 THEN t.tokens ELSE p.used + t.tokens END,
    CASE WHEN t.tokens > 3000 THEN 0 WHEN p.used + t.tokens > 3000 AND p.held > 0 THEN 1 ELSE p.held + 1 END FROM p JOIN t ON t.n = p.n + 1)
SELECT t.doc_id, (p.batch - CASE WHEN t.tokens > 3000 THEN 1 ELSE 0 END)::BIGINT AS batch, t.tokens FROM p JOIN t ON t.n = p.n""",
        "files",
    )
)
def batches_by_size(spark, sf_dir):
    """Greedy packing to 3000 tokens a batch, one sequence over all files."""
    rows = V.files(spark, sf_dir).select("doc_id", tokens().alias("tokens"))
    return order.packed(rows, "doc_id", "tokens", 3000).select("doc_id", "batch", "tokens")


REGISTRY = " UNION ALL ".join(f"SELECT {k} AS ordinal, '{n}' AS formatter, unnest({quoted(e)}) AS ext" for k, (n, e) in enumerate(dims.FORMATTERS))


def registry(spark):
    rows = [(k, n, e) for k, (n, es) in enumerate(dims.FORMATTERS) for e in es]
    return spark.createDataFrame(rows, "ordinal int, formatter string, ext string")


#: Options of a formatting run: its name, the formatters it prefers and those it excludes.
OPTIONS = [("plain", [], ["eslint"]), ("preferring", ["prettier", "rustfmt", "eslint"], ["eslint"]), ("falling back", ["eslint"], ["eslint"])]


def eligible(spark, options: str, prefer: list[str], exclude: list[str]):
    """The registry's formatters for a run: the preferred ones that are not excluded, or all that are not excluded where that leaves none."""
    allowed = registry(spark).filter(~F.col("formatter").isin(exclude or [""])).withColumn("preferred", F.col("formatter").isin(prefer or [""]))
    some = allowed.agg(F.bool_or("preferred").alias("some"))
    return allowed.crossJoin(F.broadcast(some)).filter("preferred OR NOT some").select(F.lit(options).alias("options"), "ext", "formatter", "ordinal")


SQL_OPTIONS = " UNION ALL ".join(f"SELECT '{o}' AS options, {quoted(p)}::VARCHAR[] AS prefer, {quoted(e)}::VARCHAR[] AS exclude" for o, p, e in OPTIONS)


@query(sql(f""", reg AS ({REGISTRY}), opts AS ({SQL_OPTIONS}), allowed AS (SELECT options, ext, formatter, ordinal, list_contains(prefer, formatter) AS preferred FROM opts, reg WHERE NOT list_contains(exclude, formatter)),
elig AS (SELECT * FROM allowed QUALIFY preferred OR NOT bool_or(preferred) OVER (PARTITION BY options)), best AS (SELECT options, ext, arg_min(formatter, ordinal) AS formatter FROM elig GROUP BY ALL)
SELECT doc_id, path, o.options, coalesce(formatter, 'none') AS formatter FROM files CROSS JOIN opts o LEFT JOIN best b ON b.options = o.options AND b.ext = lower(substr({EXT}, 2))""", "files"))
def formatter_selection(spark, sf_dir):
    """The first formatter in the registry's order that a run may use, for each file's extension and each run's options."""
    best = reduce(lambda a, b: a.unionByName(b), [eligible(spark, *o) for o in OPTIONS]).groupBy("options", "ext").agg(F.min_by("formatter", "ordinal").alias("formatter"))
    rows = V.files(spark, sf_dir).select("doc_id", "path", F.lower(T.suffix(F.col("path"))).alias("ext"), F.explode(F.array(*[F.lit(o) for o, *_ in OPTIONS])).alias("options"))
    return rows.join(F.broadcast(best), ["options", "ext"], "left").select("doc_id", "path", "options", F.coalesce("formatter", F.lit("none")).alias("formatter"))


@query(sql(f""", reg AS ({REGISTRY}), best AS (SELECT ext, arg_min(formatter, ordinal) AS formatter FROM reg GROUP BY ext)
SELECT doc_id, path, coalesce(formatter, '') AS formatter, CASE WHEN formatter IS NULL THEN 'no formatter for .' || lower(substr({EXT}, 2)) WHEN doc_id % 2 = 0 THEN 'would run ' || formatter ELSE '' END AS message, formatter IS NOT NULL AND doc_id % 2 = 1 AS runs, true AS success
FROM files LEFT JOIN best ON best.ext = lower(substr({EXT}, 2))""", "files"))
def format_plan(spark, sf_dir):
    """What a run does with each file: nothing where no formatter knows it, nothing but a message where it is dry, both of which are successes; else a command."""
    best = registry(spark).groupBy("ext").agg(F.min_by("formatter", "ordinal").alias("formatter"))
    rows = V.files(spark, sf_dir).select("doc_id", "path", F.lower(T.suffix(F.col("path"))).alias("ext")).join(F.broadcast(best), "ext", "left")
    known, dry = F.col("formatter").isNotNull(), F.col("doc_id") % 2 == 0
    message = F.when(~known, F.concat(F.lit("no formatter for ."), "ext")).when(dry, F.concat(F.lit("would run "), "formatter")).otherwise("")
    return rows.select("doc_id", "path", F.coalesce("formatter", F.lit("")).alias("formatter"), message.alias("message"), (known & ~dry).alias("runs"), F.lit(True).alias("success"))


#: Extensions that a run takes only, and those it leaves out; as the user wrote them, so one with a dot matches nothing.
FILTERS = [("all", [], []), ("included", ["go", ".py", "js", "md"], ["md"]), ("excluded", [], ["tsx", "json"])]
SQL_FILTERS = " UNION ALL ".join(f"SELECT '{n}' AS options, {quoted(i)}::VARCHAR[] AS inc, {quoted(e)}::VARCHAR[] AS exc" for n, i, e in FILTERS)


@query(sql(f""", reg AS (SELECT DISTINCT ext FROM ({REGISTRY})), f AS (SELECT doc_id, path, lower(substr({EXT}, 2)) AS ext FROM files)
SELECT doc_id, path, options FROM f JOIN reg USING (ext) CROSS JOIN ({SQL_FILTERS}) WHERE (len(inc) = 0 OR list_contains(inc, ext)) AND NOT list_contains(exc, ext)""", "files"))
def formattable_files(spark, sf_dir):
    """Files whose extension a formatter supports and a run's lists let through."""
    known = registry(spark).select("ext").distinct()
    rows = V.files(spark, sf_dir).select("doc_id", "path", F.lower(T.suffix(F.col("path"))).alias("ext")).join(F.broadcast(known), "ext", "left_semi")
    lets = [F.when((F.col("ext").isin(inc) if inc else F.lit(True)) & (~F.col("ext").isin(exc) if exc else F.lit(True)), F.lit(n)) for n, inc, exc in FILTERS]
    return rows.select("doc_id", "path", F.explode(F.array_compact(F.array(*lets))).alias("options"))


@query("""WITH c AS (SELECT source, doc_id, unnest([CASE WHEN doc_id % 11 = 0 AND source IN ('src0', 'src1') THEN 0 END, CASE WHEN doc_id % 7 = 0 AND source IN ('src1', 'src2', 'src3') THEN 1 END, 2]) AS rank FROM documents WHERE doc_id % 13 <> 5)
SELECT source, doc_id, ['explicit', 'recent', 'all'][rank + 1] AS kind FROM c WHERE rank IS NOT NULL QUALIFY rank = min(rank) OVER (PARTITION BY source)""")
def file_list_choice(spark, sf_dir):
    """The files of a run that are there: the ones it names, else the recent ones, else all."""
    i, s = F.col("doc_id"), F.col("source")
    named, recent = F.when((i % 11 == 0) & s.isin("src0", "src1"), 0), F.when((i % 7 == 0) & s.isin("src1", "src2", "src3"), 1)
    rows = V.table(spark, sf_dir, "documents").filter("doc_id % 13 <> 5").select("source", "doc_id", F.explode(F.array_compact(F.array(named, recent, F.lit(2)))).alias("rank"))
    first = rows.groupBy("source").agg(F.min("rank").alias("first"))
    kind = F.element_at(F.array(F.lit("explicit"), F.lit("recent"), F.lit("all")), F.col("rank") + 1)
    return rows.join(first, "source").filter("rank = first").select("source", "doc_id", kind.alias("kind"))


@query(sql(f""", reg AS ({REGISTRY}), known AS (SELECT ext, arg_min(formatter, ordinal) AS formatter, count(*) AS formatters FROM reg GROUP BY ext), there AS (SELECT lower(substr({EXT}, 2)) AS ext, count(*) AS files FROM files GROUP BY 1)
SELECT ext, coalesce(files, 0) AS files, formatter, coalesce(formatters, 0) AS formatters, formatter IS NOT NULL AS supported FROM there FULL JOIN known USING (ext)""", "files"))
def supported_extensions(spark, sf_dir):
    """The extensions of the files there are beside those that the formatters know: how many files, which formatter comes first, how many there are."""
    known = registry(spark).groupBy("ext").agg(F.min_by("formatter", "ordinal").alias("formatter"), F.count("*").alias("formatters"))
    there = V.files(spark, sf_dir).groupBy(F.lower(T.suffix(F.col("path"))).alias("ext")).agg(F.count("*").alias("files"))
    zero = F.lit(0).cast("long")
    return there.join(known, "ext", "full").select("ext", F.coalesce("files", zero).alias("files"), "formatter", F.coalesce("formatters", zero).alias("formatters"), F.col("formatter").isNotNull().alias("supported"))


@query(sql(f""", reg AS ({REGISTRY}), f AS (SELECT doc_id, doc_id % 13 = 0 AS broke, lower(substr({EXT}, 2)) IN (SELECT ext FROM reg) AS known FROM files)
SELECT count(*) AS processed, count(*) FILTER (NOT (broke AND known)) AS formatted, count(*) FILTER (broke AND known) AS failed, count(*) FILTER (broke AND known) = 0 AS success FROM f""", "files"))
def format_rollup(spark, sf_dir):
    known = registry(spark).select("ext").distinct().withColumn("known", F.lit(True))
    rows = V.files(spark, sf_dir).select("doc_id", F.lower(T.suffix(F.col("path"))).alias("ext")).join(F.broadcast(known), "ext", "left")
    failed = (F.col("doc_id") % 13 == 0) & F.coalesce("known", F.lit(False))
    return rows.agg(F.count("*").alias("processed"), F.count_if(~failed).alias("formatted"), F.count_if(failed).alias("failed"), (F.count_if(failed) == 0).alias("success"))


@query("""WITH r AS (SELECT o_custkey, max(o_orderdate::DATE) AS day FROM orders WHERE o_orderdate::DATE >= DATE '1998-01-01' - INTERVAL 400 DAY AND o_custkey % 3 <> 0 GROUP BY 1)
SELECT 'src/o_' || o_custkey || '.go' AS path, day::VARCHAR AS last_change, row_number() OVER (ORDER BY day DESC, o_custkey) - 1 AS place FROM r""")
def recent_files(spark, sf_dir):
    """Distinct files changed in the 400 days before a fixed day that still exist, in the order in which a log from the newest change on names them first."""
    changed = V.table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")).filter(F.col("day") >= F.date_sub(F.lit("1998-01-01").cast("date"), 400))
    present = V.table(spark, sf_dir, "orders").select("o_custkey").filter("o_custkey % 3 <> 0").distinct()
    changed = changed.join(present, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.max("day").alias("day"))
    placed = order.ordinal(changed.withColumn("key", -F.unix_date("day").cast("long") * F.lit(1 << 40) + F.col("o_custkey")), "key", "place")
    return placed.select(F.concat(F.lit("src/o_"), F.col("o_custkey").cast("string"), F.lit(".go")).alias("path"), F.col("day").cast("string").alias("last_change"), "place")


MARKER = "(" + quoted([m for m, _ in dims.PROJECT_MARKERS]) + ")"
MARKERS = " UNION ALL ".join(f"SELECT {k} AS priority, '{m}' AS file, '{t}' AS type" for k, (m, t) in enumerate(dims.PROJECT_MARKERS))


@query(f"""WITH m AS ({MARKERS}), listing AS (SELECT doc_id % 40 AS repo, {MARKER}[doc_id % 9 + 1] AS file FROM documents WHERE doc_id % 7 < 4)
SELECT repo, arg_min(type, priority) AS type, count(DISTINCT file) AS config_files FROM listing JOIN m USING (file) GROUP BY repo""")
def project_discovery(spark, sf_dir):
    i = F.col("doc_id")
    listing = V.table(spark, sf_dir, "documents").filter(i % 7 < 4).select((i % 40).alias("repo"), V.picked([m for m, _ in dims.PROJECT_MARKERS], i % 9).alias("file"))
    markers = spark.createDataFrame([(k, m, t) for k, (m, t) in enumerate(dims.PROJECT_MARKERS)], "priority int, file string, type string")
    return listing.join(F.broadcast(markers), "file").groupBy("repo").agg(F.min_by("type", "priority").alias("type"), F.countDistinct("file").alias("config_files"))


@query(f"""WITH l AS (SELECT doc_id, unnest(list_concat(['test: all', '# build: no', 'lint :', 'other: x', 'check:' || doc_id, 'plain']::VARCHAR[], string_split(text, chr(10)))) AS line FROM documents),
t AS (SELECT doc_id, trim(string_split(line, ':')[1]) AS target FROM l WHERE contains(line, ':') AND NOT starts_with(line, '#')) SELECT target, count(*) AS n FROM t WHERE list_contains({quoted(dims.MAKE_TARGETS)}, target) GROUP BY target""")
def npm_make_targets(spark, sf_dir):
    lines = F.concat(F.array(F.lit("test: all"), F.lit("# build: no"), F.lit("lint :"), F.lit("other: x"), F.concat(F.lit("check:"), F.col("doc_id").cast("string")), F.lit("plain")), T.lines(F.col("text")))
    rows = V.table(spark, sf_dir, "documents").select(F.explode(lines).alias("line"))
    return make_targets(rows).groupBy("target").agg(F.count("*").alias("n"))


def make_targets(rows):
    """The known targets that lines of make files name."""
    rows = rows.filter(F.contains("line", F.lit(":")) & ~F.startswith("line", F.lit("#")))
    return rows.withColumn("target", F.trim(F.split("line", ":")[0])).filter(F.col("target").isin(dims.MAKE_TARGETS))


PACKAGE = """CASE doc_id % 4 WHEN 0 THEN '{"name":"a","scripts":{"lint":"a","test":"b","deploy":"c"}}' WHEN 1 THEN '{"scripts":{"build":"a"}}' WHEN 2 THEN '{"scripts":{"start":"a"}}' ELSE '{"scripts":{"format":"a","type-check":"b","build":"c"},"private":true}' END"""


def package_text(i):
    """The package file of a number, as JSON."""
    text = F.when(i % 4 == 0, '{"name":"a","scripts":{"lint":"a","test":"b","deploy":"c"}}').when(i % 4 == 1, '{"scripts":{"build":"a"}}').when(i % 4 == 2, '{"scripts":{"start":"a"}}')
    return text.otherwise('{"scripts":{"format":"a","type-check":"b","build":"c"},"private":true}')


def scripts(text):
    """The known scripts of a package file, in their fixed order."""
    names = F.map_keys(F.from_json(text, "struct<scripts:map<string,string>>")["scripts"])
    return F.array_intersect(F.array(*map(F.lit, dims.NPM_SCRIPTS)), names)


@query(f"WITH s AS (SELECT doc_id, json_keys({PACKAGE}, '$.scripts') AS names FROM documents) SELECT doc_id, array_to_string(list_filter({quoted(dims.NPM_SCRIPTS)}, lambda x: list_contains(names, x)), ',') AS scripts FROM s")
def scripts_allow_list(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", F.array_join(scripts(package_text(F.col("doc_id"))), ",").alias("scripts"))


WALKED = r"SELECT doc_id, CASE doc_id % 9 WHEN 4 THEN regexp_replace(path, '([^/]*)$', '.\1') WHEN 5 THEN '.cfg/' || path ELSE path END AS path FROM files"


def walked(spark, sf_dir):
    """(doc_id, path): a tree in which some files have hidden names and some are in a hidden folder."""
    k, path = F.col("doc_id") % 9, F.col("path")
    return V.files(spark, sf_dir).select("doc_id", F.when(k == 4, F.regexp_replace(path, r"([^/]*)\z", r".$1")).when(k == 5, F.concat(F.lit(".cfg/"), path)).otherwise(path).alias("path"))


def hidden(path):
    """Whether a file's own name is hidden; the folders it is in don't matter."""
    return F.startswith(T.base_name(path), F.lit("."))


@query(sql(f"SELECT doc_id, path FROM ({WALKED}) WHERE list_contains({quoted(dims.VALIDATED_EXTENSIONS)}, {EXT}) AND NOT {sql_any('path', dims.SKIPPED_FOLDERS)} AND NOT starts_with(regexp_extract(path, '([^/]*)$', 1), '.')", "files"))
def validation_walk_filter(spark, sf_dir):
    p = F.col("path")
    return walked(spark, sf_dir).filter(T.extension(p).isin(dims.VALIDATED_EXTENSIONS) & ~T.contains_any(p, dims.SKIPPED_FOLDERS) & ~hidden(p))


@query(sql(f"SELECT doc_id, path FROM ({WALKED}) WHERE NOT starts_with(regexp_extract(path, '([^/]*)$', 1), '.')", "files"))
def directory_walk(spark, sf_dir):
    """All files of a tree but those whose own names are hidden."""
    return walked(spark, sf_dir).filter(~hidden(F.col("path")))


@query(sql("SELECT doc_id, path FROM files WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 1)", "files"))
def tracked_existing_files(spark, sf_dir):
    listing = V.table(spark, sf_dir, "documents").filter("doc_id % 4 <> 1").select("doc_id")
    return V.files(spark, sf_dir).select("doc_id", "path").join(listing, "doc_id", "left_semi")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, md5(array_to_string(CASE WHEN len(l) > 10 THEN l[1:5] ELSE l END, chr(10))) AS before_md5, md5(array_to_string(CASE WHEN len(l) > 10 THEN l[-5:] ELSE [] END, chr(10))) AS after_md5 FROM l""")
def context_head_tail(spark, sf_dir):
    rows = V.table(spark, sf_dir, "documents").select("doc_id", T.lines(F.col("text")).alias("l"))
    long = F.size("l") > 10
    return rows.select("doc_id", F.md5(F.array_join(F.when(long, F.slice("l", 1, 5)).otherwise(F.col("l")), "\n")).alias("before_md5"), F.md5(F.array_join(F.when(long, F.slice("l", -5, 5)).otherwise(F.array()), "\n")).alias("after_md5"))


@query("""SELECT n.doc_id, md5(n.text) AS ours_md5, md5(t.text) AS theirs_md5, b.doc_id IS NOT NULL AS has_base FROM documents n JOIN documents t ON t.doc_id = n.doc_id + 1 LEFT JOIN documents b ON b.doc_id = n.doc_id + 2 AND b.doc_id % 5 <> 0 WHERE n.doc_id % 3 = 0""")
def three_way_versions(spark, sf_dir):
    """Ours with theirs, and with the base where there is one."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("m"))
    ours = d.filter("doc_id % 3 = 0").select("doc_id", F.col("m").alias("ours_md5"))
    theirs = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("m").alias("theirs_md5"))
    base = d.filter("doc_id % 5 <> 0").select((F.col("doc_id") - 2).alias("doc_id"), F.lit(True).alias("has_base"))
    return ours.join(theirs, "doc_id").join(base, "doc_id", "left").select("doc_id", "ours_md5", "theirs_md5", F.coalesce("has_base", F.lit(False)).alias("has_base"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'go-' || page_id WHEN 1 THEN 'rm -rf' WHEN 2 THEN 'npm;ls' ELSE 'cargo_x' END AS command, page_id % 4 IN (0, 3) AS safe FROM pages")
def command_name_guard(spark, sf_dir):
    i = F.col("page_id")
    rows = V.table(spark, sf_dir, "pages").select("page_id", F.when(i % 4 == 0, F.concat(F.lit("go-"), i.cast("string"))).when(i % 4 == 1, "rm -rf").when(i % 4 == 2, "npm;ls").otherwise("cargo_x").alias("command"))
    return rows.withColumn("safe", F.col("command").rlike(r"^[a-zA-Z0-9_-]+\z"))
