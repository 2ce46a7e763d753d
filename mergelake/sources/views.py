"""Inputs derived from the tables, in Spark and as DuckDB CTEs.

The tables hold no version-control data, so files, files with conflicts, resolutions, status listings and run logs
are made from them by rule, the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import order, parse

# Extensions by document id, and status codes by order key.
EXTENSIONS = [".go", ".js", ".tsx", ".py", ".h", ".kt", ".md", ".json", ".png", ".lock", ".min.js", ".org"]
CODES = ["UU", "AA", "DD", "AU", "UA", "DU", "UD", "M ", "??", " A"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(values: list[str], index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, path, content)"""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", path_of().alias("path"), F.col("text").alias("content"))


def path_of() -> Column:
    """A document's path, from its source and id."""
    return F.concat(F.lit("src/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), picked(EXTENSIONS, F.col("doc_id") % 12))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, path, content, after): each file with the text of the next one of its source."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("content"))
    f = order.following(d, "doc_id", "content", "after", within="source")
    return f.select("doc_id", "source", path_of().alias("path"), "content", F.coalesce("after", F.lit("no next")).alias("after"))


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, lines): the whole text of each document against that of the next one of its source, in two or three hunks.

    Some have a base, a nested marker, an empty side, a carriage return in a marker or no end.  Documents are paired by their place in the source, so a large source is no one task."""
    f = pairs(spark, sf_dir)
    a, b = F.split("content", "\n", -1), F.split("after", "\n", -1)
    f = f.select("doc_id", "path", a.alias("a"), b.alias("b")).withColumns({"ha": F.ceil(F.size("a") / 2).cast("int"), "hb": F.ceil(F.size("b") / 2).cast("int")})
    some = lambda cond, *xs: F.when(cond, F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs])).otherwise(F.array().cast("array<string>"))
    i = F.col("doc_id")
    lines = F.concat(
        F.array(F.concat(F.lit("header "), i.cast("string")), F.lit("<<<<<<< HEAD")),
        some(i % 7 == 0, "<<<<<<< inner"),
        F.slice("a", F.lit(1), F.col("ha")),
        some(i % 3 == 0, "||||||| base", "old line", F.col("a")[0]),
        F.array(F.when(i % 23 == 0, F.lit("=======\r")).otherwise(F.lit("======="))),
        F.slice("b", F.lit(1), F.col("hb")),
        F.array(F.lit(">>>>>>> branch"), F.lit("between"), F.lit("<<<<<<< HEAD")),
        F.slice("a", F.col("ha") + 1, F.size("a")),
        F.array(F.lit("=======")),
        F.when(i % 11 == 0, F.array().cast("array<string>")).otherwise(F.slice("b", F.col("hb") + 1, F.size("b"))),
        some(i % 17 != 0, ">>>>>>> branch"),
        F.array(F.lit("tail")),
        some(i % 5 == 0, "<<<<<<< HEAD", "x = 1", "=======", "x = 2", ">>>>>>> branch"),
    )
    return f.select("doc_id", "path", lines.alias("lines"))


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, idx, file_path, start_line, end_line, confidence, reasoning, resolved_lines): one for each parsed hunk, some malformed, some reaching into the next hunk or past the file."""
    h = parse.hunk_rows(conflicts(spark, sf_dir))
    i, k = F.col("doc_id"), F.col("idx")
    side = F.when((i + k) % 2 == 0, F.col("ours")).otherwise(F.col("theirs"))
    new = F.when(i % 41 == 0, F.array(F.lit("  <<<<<<< HEAD"))).when(i % 43 == 0, F.array().cast("array<string>")).otherwise(F.concat(F.array(F.concat(F.lit("resolved "), i.cast("string"))), side))
    return h.select(
        "doc_id",
        "idx",
        F.when(i % 31 == 0, "").otherwise(F.col("path")).alias("file_path"),
        F.when((i % 29 == 0) & (k == 0), 0).otherwise(F.col("start_line")).cast("long").alias("start_line"),
        F.when((i % 19 == 0) & (k == 0), F.col("end_line") + 3).otherwise(F.col("end_line")).cast("long").alias("end_line"),
        F.when(i % 37 == 0, 1.2).otherwise(((i * 37 + k * 11) % 101) / 100.0).alias("confidence"),
        F.when((i + k) % 4 == 0, "").otherwise(F.concat(F.lit("reason "), i.cast("string"))).alias("reasoning"),
        new.alias("resolved_lines"),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, base, ours, theirs): a file's text, each line with its number and a line feed, and two versions of it in which lines are gone, changed or followed by new ones; some changes are the same in both, and some files only one side changed."""
    f = files(spark, sf_dir)
    doc = F.col("doc_id")
    numbered = F.transform(F.split(F.coalesce("content", F.lit("")), "\n", -1), lambda x, i: F.concat(i.cast("string"), F.lit(" "), x))

    text = lambda lines: F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")

    def side(name: str, a: int, b: int, m: int, quiet):
        def change(x, i):
            k = (doc * a + i * b) % m
            same = (doc + i) % 23 == 0
            none = F.array().cast("array<string>")
            own = F.when(k == 0, none).when(k == 1, F.array(F.concat(x, F.lit(f" {name}")))).when(k == 2, F.array(x, F.concat(F.lit(f"{name} after "), i.cast("string")))).otherwise(F.array(x))
            return F.when(same, F.array(F.concat(x, F.lit(" both")))).when(quiet, F.array(x)).otherwise(own)

        return text(F.flatten(F.transform("lines", change))).alias(name)

    return f.select("doc_id", "path", numbered.alias("lines")).select("doc_id", "path", text(F.col("lines")).alias("base"), side("ours", 1, 3, 17, F.lit(False)), side("theirs", 2, 5, 11, doc % 6 == 0))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit, parents, rank): a history in which every order is a commit with one to three parents among the earlier ones."""
    k = F.col("o_orderkey")
    name = lambda c: F.md5(c.cast("string"))
    numbers = F.array(F.when(k > 0, F.floor(k / 2)), F.when((k > 2) & (k % 5 == 0), F.floor(k / 3)), F.when((k > 3) & (k % 7 == 0), F.floor(k / 2) - 1))
    return table(spark, sf_dir, "orders").select(name(k).alias("commit"), F.transform(F.filter(numbers, lambda p: p.isNotNull()), name).alias("parents"), k.cast("long").alias("rank"))


def commit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair, ours, theirs): each commit with one not far before it."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.cast("long").alias("pair"), F.md5(k.cast("string")).alias("ours"), F.md5(F.greatest(k - F.col("o_custkey") % 97, F.lit(0)).cast("string")).alias("theirs"))


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line): a status listing, a two-letter code and a path."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.concat(picked(CODES, k % 10), F.lit(" src/o_"), k.cast("string"), F.lit(".go")).alias("line"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch_id, ms, ok, conflicts, confidence): a log of batches."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"), (F.col("l_partkey") % 900 + F.col("l_linenumber")).cast("long").alias("ms"), (F.col("l_returnflag") != "R").alias("ok"),
        F.floor("l_quantity").cast("long").alias("conflicts"), (F.col("l_discount") * 10).alias("confidence"),
    )


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lines): small pieces of code with planted faults, then the document's whole text as comments."""
    i = F.col("doc_id")
    s = i.cast("string")
    pick = lambda n, a, b: F.when(i % n == 0, F.lit(a)).otherwise(F.lit(b))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.array(
            pick(2, "package main", "package tools"), F.lit('import "fmt"'), F.concat(F.lit("func work"), s, F.lit("(a int) error "), pick(7, "", "{")), pick(5, "  out, err := call(a)", "  out := call(a)"),
            pick(3, "  if err != nil {", "  use(out)"), pick(11, "  var = 3", "  keep(out)"), pick(3, "  return err }", "  return nil"), pick(13, "  done()", "}"),
            pick(6, "type Thing struct {", "// none"), pick(6, "}", "// end"), F.concat(F.lit("func "), F.when(i % 19 == 0, F.concat(F.lit("work"), s)).otherwise(F.concat(F.lit("other"), s)), F.lit("(b int) {")), F.lit("}"),
        ), F.when(i % 4 == 0, F.array(F.lit("import ("), F.lit('  "os"'), F.lit("  // none"), F.lit(""), F.lit('  log "logs"'), F.lit(")"))).otherwise(F.array().cast("array<string>")),
        F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.concat(F.lit("// "), x))).alias("lines"),
    )


def quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


CTES = {
    "files": f"""files AS (SELECT doc_id, source, 'src/' || source || '/doc_' || doc_id || ({quoted(EXTENSIONS)})[doc_id % 12 + 1] AS path, text AS content FROM documents)""",
    "conflicts": """pairs AS (SELECT doc_id, path, string_split(coalesce(content, ''), chr(10)) AS a, string_split(coalesce(lead(coalesce(content, '')) OVER (PARTITION BY source ORDER BY doc_id), 'no next'), chr(10)) AS b FROM files),
halves AS (SELECT *, (len(a) + 1) // 2 AS ha, (len(b) + 1) // 2 AS hb FROM pairs),
conflicts AS (SELECT doc_id, path, flatten([['header ' || doc_id, '<<<<<<< HEAD'], CASE WHEN doc_id % 7 = 0 THEN ['<<<<<<< inner'] ELSE [] END, a[1:ha], CASE WHEN doc_id % 3 = 0 THEN ['||||||| base', 'old line', a[1]] ELSE [] END,
  [CASE WHEN doc_id % 23 = 0 THEN '=======' || chr(13) ELSE '=======' END], b[1:hb], ['>>>>>>> branch', 'between', '<<<<<<< HEAD'], a[ha + 1:], ['======='], CASE WHEN doc_id % 11 = 0 THEN [] ELSE b[hb + 1:] END,
  CASE WHEN doc_id % 17 <> 0 THEN ['>>>>>>> branch'] ELSE [] END, ['tail'], CASE WHEN doc_id % 5 = 0 THEN ['<<<<<<< HEAD', 'x = 1', '=======', 'x = 2', '>>>>>>> branch'] ELSE [] END]) AS lines FROM halves)""",
    # The section after each line, as one letter a line.
    "hunks": """sections AS (SELECT doc_id, path, lines, list_reduce(lines, lambda s, x: s || CASE WHEN right(s, 1) = 'O' AND starts_with(x, '<<<<<<<') THEN 'A' WHEN right(s, 1) = 'A' AND starts_with(x, '|||||||') THEN 'B'
  WHEN right(s, 1) IN ('A', 'B') AND x = '=======' THEN 'T' WHEN right(s, 1) = 'T' AND starts_with(x, '>>>>>>>') THEN 'O' ELSE right(s, 1) END, 'O') AS s FROM conflicts),
st0 AS (SELECT doc_id, path, unnest(range(1, len(lines) + 1)) AS n, unnest(lines) AS line, s FROM sections), st1 AS (SELECT doc_id, path, n, line, s[n] AS before, s[n + 1] AS after FROM st0),
st AS (SELECT *, max(CASE WHEN before = 'O' AND after = 'A' THEN n END) OVER (PARTITION BY doc_id ORDER BY n) AS start FROM st1),
hunk0 AS (SELECT doc_id, path, start AS start_line, max(CASE WHEN before = 'T' AND after = 'O' THEN n END) AS end_line,
  coalesce(list(line ORDER BY n) FILTER (before = 'A' AND after = 'A'), []) AS ours, coalesce(list(line ORDER BY n) FILTER (before = 'T' AND after = 'T'), []) AS theirs,
  coalesce(list(line ORDER BY n) FILTER (before = 'B' AND after = 'B'), []) AS base
  FROM st WHERE start IS NOT NULL GROUP BY doc_id, path, start),
hunks AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_line) - 1 AS idx FROM hunk0 WHERE end_line IS NOT NULL)""",
    "res": """res AS (SELECT doc_id, idx, CASE WHEN doc_id % 31 = 0 THEN '' ELSE path END AS file_path, (CASE WHEN doc_id % 29 = 0 AND idx = 0 THEN 0 ELSE start_line END)::BIGINT AS start_line,
  (CASE WHEN doc_id % 19 = 0 AND idx = 0 THEN end_line + 3 ELSE end_line END)::BIGINT AS end_line,
  CASE WHEN doc_id % 37 = 0 THEN 1.2::DOUBLE ELSE ((doc_id * 37 + idx * 11) % 101)::DOUBLE / 100.0::DOUBLE END AS confidence, CASE WHEN (doc_id + idx) % 4 = 0 THEN '' ELSE 'reason ' || doc_id END AS reasoning,
  CASE WHEN doc_id % 41 = 0 THEN ['  <<<<<<< HEAD'] WHEN doc_id % 43 = 0 THEN []::VARCHAR[] ELSE list_concat(['resolved ' || doc_id], CASE WHEN (doc_id + idx) % 2 = 0 THEN ours ELSE theirs END) END AS resolved_lines FROM hunks)""",
    "versions": """numbered_lines AS (SELECT doc_id, path, unnest(range(0, len(ls))) AS i, unnest(ls) AS x FROM (SELECT doc_id, path, string_split(coalesce(content, ''), chr(10)) AS ls FROM files)),
with_text AS (SELECT doc_id, path, i, i || ' ' || x AS base, (doc_id + i) % 23 = 0 AS same, (doc_id + i * 3) % 17 AS ko, (doc_id * 2 + i * 5) % 11 AS kt FROM numbered_lines),
versions AS (SELECT doc_id, path, i, base, CASE WHEN same THEN [base || ' both'] WHEN ko = 0 THEN [] WHEN ko = 1 THEN [base || ' ours'] WHEN ko = 2 THEN [base, 'ours after ' || i] ELSE [base] END AS ours,
  CASE WHEN same THEN [base || ' both'] WHEN doc_id % 6 = 0 THEN [base] WHEN kt = 0 THEN [] WHEN kt = 1 THEN [base || ' theirs'] WHEN kt = 2 THEN [base, 'theirs after ' || i] ELSE [base] END AS theirs FROM with_text)""",
    "commits": """edges AS (SELECT DISTINCT o_orderkey AS k, unnest(list_filter([CASE WHEN o_orderkey > 0 THEN o_orderkey // 2 END, CASE WHEN o_orderkey > 2 AND o_orderkey % 5 = 0 THEN o_orderkey // 3 END, CASE WHEN o_orderkey > 3 AND o_orderkey % 7 = 0 THEN o_orderkey // 2 - 1 END], lambda p: p IS NOT NULL)) AS parent FROM orders),
commit_pairs AS (SELECT o_orderkey AS pair, o_orderkey AS ours, greatest(o_orderkey - o_custkey % 97, 0) AS theirs FROM orders)""",
    "status": f"""status AS (SELECT ({quoted(CODES)})[o_orderkey % 10 + 1] || ' src/o_' || o_orderkey || '.go' AS line FROM orders)""",
    "runs": """runs AS (SELECT l_orderkey AS batch_id, l_partkey % 900 + l_linenumber AS ms, l_returnflag <> 'R' AS ok, floor(l_quantity)::BIGINT AS conflicts, l_discount * 10 AS confidence FROM lineitem)""",
    "code": """code AS (SELECT doc_id, flatten([[CASE WHEN doc_id % 2 = 0 THEN 'package main' ELSE 'package tools' END, 'import "fmt"', 'func work' || doc_id || '(a int) error ' || CASE WHEN doc_id % 7 = 0 THEN '' ELSE '{' END,
  CASE WHEN doc_id % 5 = 0 THEN '  out, err := call(a)' ELSE '  out := call(a)' END, CASE WHEN doc_id % 3 = 0 THEN '  if err != nil {' ELSE '  use(out)' END, CASE WHEN doc_id % 11 = 0 THEN '  var = 3' ELSE '  keep(out)' END,
  CASE WHEN doc_id % 3 = 0 THEN '  return err }' ELSE '  return nil' END, CASE WHEN doc_id % 13 = 0 THEN '  done()' ELSE '}' END, CASE WHEN doc_id % 6 = 0 THEN 'type Thing struct {' ELSE '// none' END,
  CASE WHEN doc_id % 6 = 0 THEN '}' ELSE '// end' END, 'func ' || CASE WHEN doc_id % 19 = 0 THEN 'work' || doc_id ELSE 'other' || doc_id END || '(b int) {', '}'],
  CASE WHEN doc_id % 4 = 0 THEN ['import (', '  "os"', '  // none', '', '  log "logs"', ')'] ELSE [] END, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: '// ' || x)]) AS lines FROM documents)""",
}
NEEDS = {"conflicts": ["files"], "versions": ["files"], "hunks": ["conflicts"], "res": ["hunks"]}


def sql(body: str, *names: str) -> str:
    """A statement with the CTEs it names, and theirs, in front; body may begin with further CTEs after a comma."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    return "WITH RECURSIVE " + ",\n".join(CTES[n] for n in order) + ("" if body.lstrip().startswith(",") else "\n") + body if order else body
