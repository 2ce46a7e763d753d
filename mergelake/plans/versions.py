"""Versions of files: diffs, patches and three-way merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, parse, versions
from ..sources import shared
from ..sources import views as V
from ..sources.views import sql
from .registry import query

CONTEXT = 3


@query("""SELECT doc_id, len(string_split(text, chr(10))) AS old_lines, len(string_split(after, chr(10))) AS new_lines, md5(after) AS new_md5, text = after AS same
FROM (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER (PARTITION BY source ORDER BY doc_id), 'no next') AS after FROM documents)""")
def diff_consecutive(spark, sf_dir):
    """Each document and the next one of its source: their diff, applied to the first, gives the second byte for byte."""
    pairs = V.pairs(spark, sf_dir).withColumn("diff", versions.diff("path", "content", "after", CONTEXT))
    lines = lambda c: F.size(F.split(c, "\n", -1)).cast("long")
    return pairs.select("doc_id", lines("content").alias("old_lines"), lines("after").alias("new_lines"), F.md5(versions.patch("content", "diff")).alias("new_md5"), (F.col("diff") == "").alias("same"))


# A line that stays, with what comes after it; the changed stretches that fewer than seven lines part are one hunk.
SQL_HUNKS = f"""places AS (SELECT doc_id, i, len(ours) > 0 AND ours[1] = base AS kept, len(ours) AS k, sum(len(ours)) OVER (PARTITION BY doc_id ORDER BY i) - len(ours) AS j, max(i) OVER (PARTITION BY doc_id) + 1 AS n FROM versions),
touched AS (SELECT *, CASE WHEN kept THEN i + 1 ELSE i END AS a0, i + 1 AS a1, (NOT kept)::INT AS removed, k - kept::INT AS added FROM places WHERE NOT kept OR k > 1),
cut AS (SELECT *, CASE WHEN a0 - lag(a1) OVER (PARTITION BY doc_id ORDER BY i) <= {2 * CONTEXT} THEN 0 ELSE 1 END AS opens FROM touched),
grouped AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS hunk_no FROM cut),
spans AS (SELECT doc_id, hunk_no, greatest(min(a0) - {CONTEXT}, 0) AS i0, least(max(a1) + {CONTEXT}, any_value(n)) AS i1, sum(added) AS added, sum(removed) AS removed FROM grouped GROUP BY ALL),
shifted AS (SELECT s.*, p.j AS j0 FROM spans s JOIN places p ON p.doc_id = s.doc_id AND p.i = s.i0)"""


@query(sql(f""", {SQL_HUNKS} SELECT doc_id, hunk_no::BIGINT AS hunk_no, (CASE WHEN i1 > i0 THEN i0 + 1 ELSE i0 END)::BIGINT AS old_start, (i1 - i0)::BIGINT AS old_lines,
(CASE WHEN i1 - i0 + added - removed > 0 THEN j0 + 1 ELSE j0 END)::BIGINT AS new_start, (i1 - i0 + added - removed)::BIGINT AS new_lines, added::BIGINT AS added, removed::BIGINT AS removed FROM shifted""", "versions"))
def diff_hunks(spark, sf_dir):
    """Each file's base against our version: the hunks of its diff, as the diff's own parser reads them."""
    v = V.versions(spark, sf_dir)
    diffs = v.select("doc_id", versions.diff("path", "base", "ours", CONTEXT).alias("text")).filter("text <> ''")
    return parse.diff_rows(diffs).select("doc_id", "hunk_no", "old_start", "old_lines", "new_start", "new_lines", "added", "removed")


SQL_MERGE = """marked AS (SELECT *, len(ours) > 0 AND ours[1] = base AND len(theirs) > 0 AND theirs[1] = base AS stable FROM versions),
numbered AS (SELECT *, sum(stable::INT) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM marked),
chunks AS (SELECT doc_id, path, c, max(CASE WHEN stable THEN base END) AS stays, flatten(list(CASE WHEN stable THEN ours[2:] ELSE ours END ORDER BY i)) AS o, flatten(list(CASE WHEN stable THEN theirs[2:] ELSE theirs END ORDER BY i)) AS t,
  flatten(list(CASE WHEN stable THEN [] ELSE [base] END ORDER BY i)) AS b FROM numbered GROUP BY doc_id, path, c),
pieces AS (SELECT *, NOT (o = t OR t = b OR o = b) AS clash, CASE WHEN o = t OR t = b THEN o WHEN o = b THEN t
  ELSE flatten([['<<<<<<< ours'], o, CASE WHEN len(b) > 0 THEN list_concat(['||||||| base'], b) ELSE [] END, ['======='], t, ['>>>>>>> theirs']]) END AS piece FROM chunks),
whole AS (SELECT *, list_concat(CASE WHEN stays IS NULL THEN [] ELSE [stays] END, piece) AS ls FROM pieces),
placed AS (SELECT *, sum(len(ls)) OVER (PARTITION BY doc_id ORDER BY c) AS upto FROM whole)"""


@query(sql(f""", {SQL_MERGE} SELECT doc_id, path, md5(array_to_string(list_transform(flatten(list(ls ORDER BY c)), lambda x: x || chr(10)), '')) AS merged_md5, sum(clash::INT)::INT AS n_conflicts, sum((NOT clash AND (len(o) > 0 OR len(t) > 0 OR len(b) > 0))::INT)::INT AS n_taken, true AS parses_alike
FROM placed GROUP BY doc_id, path""", "versions"))
def merge_versions(spark, sf_dir):
    """Three versions of each file merged: the text, its conflicts, and whether the marker parser reads the same ones from it."""
    v = V.versions(spark, sf_dir).select("doc_id", "path", versions.merge("base", "ours", "theirs").alias("m"))
    alike = F.to_json(parse.hunks(F.split("m.text", "\n", -1))) == F.to_json("m.hunks")
    return v.select("doc_id", "path", F.md5("m.text").alias("merged_md5"), "m.n_conflicts", "m.n_taken", alike.alias("parses_alike"))


@query(sql(f""", {SQL_MERGE} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY c) - 1 AS idx, (upto - len(piece) + 1)::INT AS start_line, upto::INT AS end_line, md5(array_to_string(o, chr(10))) AS ours_md5, md5(array_to_string(t, chr(10))) AS theirs_md5, md5(array_to_string(b, chr(10))) AS base_md5
FROM placed WHERE clash""", "versions"))
def merge_conflicts(spark, sf_dir):
    """The real conflicts of three versions, parsed from the merged text."""
    v = V.versions(spark, sf_dir).select("doc_id", "path", F.split(versions.merge("base", "ours", "theirs")["text"], "\n", -1).alias("lines"))
    text = lambda c: F.md5(F.array_join(c, "\n")).alias(f"{c}_md5")
    return parse.hunk_rows(v).select("doc_id", "idx", "start_line", "end_line", text("ours"), text("theirs"), text("base"))


@query(sql(""", ancestors AS (SELECT pair, 1 AS side, ours AS k FROM commit_pairs UNION SELECT pair, 2, theirs FROM commit_pairs UNION SELECT a.pair, a.side, e.parent FROM ancestors a JOIN edges e ON e.k = a.k),
shared_ AS (SELECT pair, k FROM ancestors GROUP BY pair, k HAVING count(*) = 2),
covered AS (SELECT DISTINCT b.pair, e.parent AS k FROM shared_ b JOIN edges e ON e.k = b.k)
SELECT pair::BIGINT AS pair, md5(k::VARCHAR) AS base FROM shared_ WHERE (pair, k) NOT IN (SELECT (pair, k) FROM covered)""", "commits"))
def merge_bases(spark, sf_dir):
    """The merge bases of each commit and one not far before it."""
    return history.merge_bases(V.commits(spark, sf_dir), V.commit_pairs(spark, sf_dir), shared.kept)
