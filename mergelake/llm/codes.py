"""Vector code compression: parts of vectors as indexes into codebooks, trained and applied over a lexicographic trie.

A vector of whole numbers is cut into equal parts; each part position has a codebook.  The distinct parts of a position, sorted, are the leaves
of a trie whose levels are dimensions.  It is walked depth-first: a node's squared distances to all entries are those of its parent plus one
dimension's, so parts with a common prefix share them.  A leaf takes the nearest entry and adds its vector, times how often it occurs, to that entry's sums.
The walk goes over blocks of neighbouring leaves, level by level within a block, and carries the last path into the next block.

Distinct parts are counted once, dealt by ranges so that neighbours share a task, and written; each round reads them, with the codebooks
(entries times dimensions, whatever the input) sent along, and returns one sum for each entry and task.  Rows are encoded in place, by a trie of each batch's parts: no join, so
a vector that a third of all rows hold is no hot key.

Edge cases: null vectors, empty ones, and those with null, non-finite or missing entries are dropped (``vectors.scaled``); values beyond
2**27 are held to it; dimensions that the parts don't divide are filled up with zeros; fewer rows than entries give smaller codebooks; among equal ids the smaller vector comes first, and
null ids come last; equal distances take the lower index; an unused entry stays as it is; an empty table gives no rows.  Columns other than the id, the vector and the label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_small, stored
from .vectors import matrix, most, scaled

LIMIT = 1 << 27
BLOCK = 512
#: Distinct parts that a task of a round walks.
TASK_PARTS = 100_000


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part and its squared distance; sorted parts share the distances of common prefixes."""
    exact_as_float = (most(parts) + most(book)) ** 2 * parts.shape[1] < 1 << 53
    parts, book = (a.astype(np.float64 if exact_as_float else np.int64) for a in (parts, book))
    n, dims = parts.shape
    entry, distance = np.empty(n, np.int64), np.empty(n, np.int64)
    path = np.zeros((dims + 1, len(book)), book.dtype)  # the distances along the last path walked
    for a in range(0, n, BLOCK):
        x = parts[a : a + BLOCK]
        differs = np.ones(x.shape, bool)
        differs[1:] = x[1:] != x[:-1]
        if a:
            differs[0] = x[0] != parts[a - 1]
        leaves = np.logical_or.accumulate(differs, axis=1)  # from which level on a part has a path of its own
        sums, node = path[0][None], np.zeros(len(x), np.int64)
        for level in range(dims):
            new = np.flatnonzero(leaves[:, level])
            step = x[new, level][:, None] - book[:, level]
            sums = np.concatenate([path[level + 1][None], sums[node[new]] + step * step])
            node = np.cumsum(leaves[:, level])
            path[level + 1] = sums[node[-1]]
        entry[a : a + BLOCK] = sums.argmin(axis=1)[node]
        distance[a : a + BLOCK] = sums.min(axis=1)[node]
    return entry, distance


def sorted_distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, and which of them each row is."""
    order = np.lexsort(rows.T[::-1])
    new = np.r_[True, (rows[order[1:]] != rows[order[:-1]]).any(axis=1)][: len(rows)]
    which = np.empty(len(rows), np.int64)
    which[order] = np.cumsum(new) - 1
    return rows[order][new], which


def summed(parts: DataFrame, books: np.ndarray) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """By position and entry: how many parts are nearest to it, and their sum."""
    dims = books.shape[2]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((*books.shape[:2], dims + 1), np.int64)
        for batch in batches:
            at, x, n = batch.column(0).to_numpy(), matrix(batch.column(1), dims), batch.column(2).to_numpy()
            for p in np.unique(at).tolist():
                own = at == p
                entry, _ = nearest(x[own], books[p])
                np.add.at(total[p], entry, np.c_[n[own], x[own] * n[own][:, None]])
        p, e = np.nonzero(total[:, :, 0])
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["at", "entry", "sums"])

    sums = parts.mapInArrow(walk, "at int, entry int, sums array<long>").groupBy("at", "entry").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(dims + 1)])
    return {(r[0], r[1]): (r[2], list(r[3:])) for r in sums.collect()}


def train(kept: DataFrame, dims: int, n: int, n_parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (position, entry, dimension) of rows (id, x)."""
    width = dims // n_parts
    first = kept.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books = np.array([r.x for r in first], np.int64).reshape(len(first), n_parts, width).transpose(1, 0, 2).copy()
    cut = F.transform(F.sequence(F.lit(0), F.lit(n_parts - 1)), lambda p: F.slice("x", p * width + 1, width))
    parts = kept.select(F.posexplode(cut).alias("at", "part")).groupBy("at", "part").agg(F.count("*").alias("n"))
    tasks = max(int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * n_parts // TASK_PARTS)
    parts = stored(parts.repartitionByRange(tasks, "at", "part").sortWithinPartitions("at", "part"))
    for _ in range(rounds):
        for (p, e), (count, total) in summed(parts, books).items():
            books[p, e] = [s // count for s in total]
    return books


def encode(kept: DataFrame, books: np.ndarray, *keep: str) -> DataFrame:
    """(keep..., code, error) of rows with x."""
    n_parts, _, width = books.shape

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(len(keep)), n_parts * width)
            codes, error = np.zeros((len(x), n_parts), np.int64), np.zeros(len(x), np.int64)
            for p in range(n_parts):
                leaves, which = sorted_distinct(x[:, p * width : (p + 1) * width])
                entry, distance = nearest(leaves, books[p])
                codes[:, p] = entry[which]
                error += distance[which]
            digits = [c.tobytes().hex() for c in codes.astype(np.uint8)] if books.shape[1] <= 256 else [",".join(map(str, c)) for c in codes.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(digits, pa.string()), pa.array(error)], [*keep, "code", "error"])

    fields = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in keep)
    return kept.select(*keep, "x").mapInArrow(walk, f"{fields}, code string, error long")


def compress(
    rows: DataFrame, n_parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row per kept row: the id, code (indexes in part order, two hex digits each; decimal and comma-joined with over 256 entries), error (squared distance, summed over parts),
    label_error (error summed over equal labels, null among them; null where it is beyond a long) and codebooks_sha256."""
    kept, dims, n = scaled(rows, scale, vector_col, LIMIT, id=id_col, label=label_col)
    width = max(1, -(-dims // n_parts))
    if width * n_parts > dims:
        kept = kept.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), width * n_parts - dims)))
    books = train(kept, width * n_parts, n, n_parts, entries, rounds) if n else np.zeros((n_parts, 1, width), np.int64)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode() if n else b"").hexdigest()
    found = stored(encode(kept, books, "id", "label"))
    errors = found.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    return join_small(found, errors, "label").select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle(rounds: int = 4) -> str:
    """The same in DuckDB's SQL: 4 parts, 256 entries; a pair of CTEs for each round."""

    def near(k: int) -> str:
        square = "list_sum(list_transform(range(1, len(d.part) + 1), lambda i: (d.part[i] - b.part[i]) * (d.part[i] - b.part[i])))"
        pairs = f"SELECT d.p, d.part, d.n, b.e, {square}::BIGINT AS dist FROM leaves d JOIN book{k} b ON b.p = d.p"
        return f"near{k} AS MATERIALIZED (SELECT p, part, any_value(n) AS n, arg_min(e, (dist, e)) AS e, min(dist) AS dist FROM ({pairs}) GROUP BY p, part)"

    def book(k: int) -> str:
        sums = f"SELECT p, e, i, sum(part[i] * n) AS s, sum(n) AS n FROM (SELECT *, unnest(range(1, len(part) + 1)) AS i FROM near{k}) GROUP BY p, e, i"
        means = f"SELECT p, e, list(floor(s::DOUBLE / n)::BIGINT ORDER BY i) AS part FROM ({sums}) GROUP BY p, e"
        return f"book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.part, b.part) AS part FROM book{k} b LEFT JOIN ({means}) m ON m.p = b.p AND m.e = b.e)"

    steps = ",\n".join(x for k in range(rounds) for x in (near(k), book(k)))
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row_no, vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS MATERIALIZED (SELECT row_no, vec_id, label, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS part FROM kept, (SELECT unnest(range(4)) AS p)),
leaves AS MATERIALIZED (SELECT p, part, count(*) AS n FROM parts GROUP BY p, part),
book0 AS MATERIALIZED (SELECT p, e, part FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id, row_no) - 1 AS e, part FROM parts) WHERE e < 256),
{steps},
{near(rounds)},
coded AS (SELECT row_no, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error
  FROM parts JOIN near{rounds} USING (p, part) GROUP BY row_no),
digest AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, digest
"""


ORACLE = _oracle()
