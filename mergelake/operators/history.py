"""Merge bases over a graph of commits: for each pair of commits the common ancestors that are no ancestor of another common one.

Both commits of a pair are painted, each in its colour, and what is painted paints its parents.  A commit of both colours is common, and what it paints is stale: an ancestor of a common one.

With ranks, a pair holds only the commits that wait to pass their paint on.  One that ranks above every parent of those that wait can't be painted again: it passes its paint on and is forgotten, and is a
base if it is common and not stale.  A pair ends once no common commit waits and one side has no colour of its own left, for nothing more can become common then: it costs what its two sides have apart, not their history.
Pairs near in rank walk through the same commits, so they are dealt in chunks by rank.  In every round a chunk asks once for the parents of each commit that any of its pairs needs, as a join of all chunks' questions with
the edges of those ranks, and its pairs walk on as far as the answers go.  A chunk whose pairs wait for many commits is split; nothing is collected but how many questions are open and their ranks.

Without ranks (a commit with parents has none, or one not above theirs) every painted commit of a pair is kept, all pairs take a step together, and walks go to the roots.

Edge cases: a commit is its own ancestor, so a pair of equals has itself as its base, and so has a pair of which one is the other's ancestor; a parent that is not in the table is a commit without parents;
several bases are several rows, and no common ancestor is none; a pair with a null side has none; repeated rows of a commit are one, and those of a pair; a graph with a cycle ends, too.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OURS, THEIRS, STALE = 1, 2, 4
#: Pairs of a chunk at first, and waiting commits of all its pairs at most, as far as more than one pair is left.
CHUNK_PAIRS, CHUNK_ROWS = 1 << 14, 1 << 20
#: The rank of a commit that is not in the table, and the highest rank of the parents where there are none.
UNRANKED, NO_PARENTS = -(1 << 62), -(1 << 63)
STATE, QUESTION, BASE = 0, 1, 2
#: Tables of bases that are read as one at most.
MOST_TABLES = 24


def merge_bases(commits: DataFrame, pairs: DataFrame, kept: Callable[[DataFrame], DataFrame], most_rounds: int = 1_000_000) -> DataFrame:
    """(pair, base) of commits (commit, parents, rank) and pairs (pair, ours, theirs).

    A rank is a number larger than those of all parents, such as a generation number; it may be null.  ``kept`` writes a table to a folder that all executors share, and reads it again."""
    seed = lambda side, colour: pairs.filter("ours IS NOT NULL AND theirs IS NOT NULL").select("pair", F.col(side).alias("commit"), F.lit(colour).alias("paint"))
    seeds = seed("ours", OURS).union(seed("theirs", THEIRS))
    commits = commits.filter("commit IS NOT NULL").withColumn("rank", F.col("rank").cast("long"))
    number, names = _numbered(commits, seeds, kept)
    own = commits.select(number("commit").alias("id"), "rank", F.explode_outer("parents").alias("parent"))
    nodes = own.groupBy("id").agg(F.max("rank").alias("rank"), F.collect_set(number("parent")).alias("parents"))
    ranks = nodes.select(F.col("id").alias("parent"), F.col("rank").alias("parent_rank"))
    edges = nodes.select("id", "rank", F.explode("parents").alias("parent")).join(ranks, "parent", "left").withColumn("parent_rank", F.coalesce("parent_rank", F.lit(UNRANKED)))
    edges = kept(edges)
    if not edges.filter("rank IS NULL OR rank <= parent_rank").isEmpty():
        return _unranked(commits, seeds, kept, most_rounds)
    lows = edges.groupBy("id").agg(F.max("parent_rank").alias("low"))
    edges = edges.join(lows.withColumnsRenamed({"id": "parent", "low": "parent_low"}), "parent", "left").withColumn("parent_low", F.coalesce("parent_low", F.lit(NO_PARENTS)))
    edges = kept(edges.select("id", "rank", "parent", "parent_rank", "parent_low").repartitionByRange("rank").sortWithinPartitions("rank"))
    # A pair goes to the chunk of its highest rank.
    seeds = seeds.groupBy("pair", number("commit").alias("id")).agg(F.bit_or("paint").alias("paint")).join(nodes.select("id", "rank"), "id", "left").join(lows, "id", "left")
    seeds = seeds.select("pair", "id", F.coalesce("rank", F.lit(UNRANKED)).alias("rank"), F.coalesce("low", F.lit(NO_PARENTS)).alias("low"), "paint")
    seeds = seeds.withColumn("top", F.max("rank").over(Window.partitionBy("pair")))
    n_chunks = -(-pairs.count() // CHUNK_PAIRS) or 1
    seeds = seeds.repartitionByRange(n_chunks, "top", "pair").withColumn("chunk", F.spark_partition_id().cast("string")).drop("top")
    sent = T.StructType().add("chunk", "string").add("kind", "integer").add("pair", pairs.schema["pair"].dataType).add("id", "long").add("rank", "long").add("payload", "binary")
    now, found = kept(seeds.groupBy("chunk").applyInArrow(_first, sent)), []
    for _ in range(most_rounds):
        said = now.groupBy("kind").agg(F.count("*").alias("n"), F.min("rank").alias("least"), F.max("rank").alias("most"))
        said = {r["kind"]: r for r in said.collect()}
        if BASE in said:
            found.append(now.filter(F.col("kind") == BASE).select("pair", "id"))
            if len(found) > MOST_TABLES:
                found = [kept(reduce(DataFrame.union, found))]
        if QUESTION not in said:
            bases = reduce(DataFrame.union, found) if found else now.limit(0).select("pair", "id")
            return bases.join(names, "id").select("pair", "base")
        asked = edges.filter(F.col("rank").between(said[QUESTION]["least"], said[QUESTION]["most"])).drop("rank")
        answers = now.filter(F.col("kind") == QUESTION).select(F.col("chunk").alias("asking"), "id").join(asked, "id")
        now = kept(now.filter(F.col("kind") == STATE).select("chunk", "payload").groupBy("chunk").cogroup(answers.groupBy("asking")).applyInArrow(_further, sent))
    raise RuntimeError("the walks did not end")


def _numbered(commits: DataFrame, seeds: DataFrame, kept: Callable[[DataFrame], DataFrame]):
    """A number for every name, and the table (id, base) of both; no two names share one."""
    every = commits.select("commit").union(commits.select(F.explode("parents"))).union(seeds.select("commit")).filter("commit IS NOT NULL")
    for salt in range(100):
        number = lambda c, salt=salt: F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(salt), c))
        names = kept(every.groupBy(number("commit").alias("id")).agg(F.min("commit").alias("base"), F.max("commit").alias("other")))
        if names.filter("base <> other").isEmpty():
            return number, names.select("id", "base")
    raise RuntimeError("names share numbers")


def _first(key, rows):
    """A chunk's pairs at their own commits."""
    pair = rows["pair"].combine_chunks().dictionary_encode(null_encoding="encode")
    waiting = [pair.indices.to_numpy(), *(rows[c].to_numpy() for c in ("id", "rank", "low", "paint"))]
    return _walked(key[0].as_py(), pair.dictionary, _merged([w.astype(np.int64) for w in waiting]), [np.zeros(0, np.int64)] * 4)


def _further(key, state, answers):
    """A chunk's pairs walk on over the edges that it asked for."""
    order = np.argsort(answers["id"].to_numpy(), kind="stable")
    return _walked(key[0].as_py(), *_unpacked(state["payload"][0].as_py()), [answers[c].to_numpy()[order] for c in ("id", "parent", "parent_rank", "parent_low")])


def _walked(chunk: str, pairs: pa.Array, waiting: list[np.ndarray], edges: list[np.ndarray]) -> pa.Table:
    """The bases found, what still waits, and the commits whose parents it needs.  Waiting rows are the pair's number, id, rank, highest rank of the parents and paint, in order of the first two."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while True:
        waiting = _searching(waiting)
        pair, id_, rank, low, paint = waiting
        starts, of = _groups(pair)
        goes = rank > np.maximum.reduceat(low, starts)[of] if len(pair) else np.zeros(0, bool)
        base = goes & (paint == (OURS | THEIRS))
        if base.any():
            found.append((pair[base], id_[base]))
            waiting[4] = np.where(base, OURS | THEIRS | STALE, paint)
            continue
        begin, end = np.searchsorted(edges[0], id_, "left"), np.searchsorted(edges[0], id_, "right")
        asks = goes & (low > NO_PARENTS)  # also what is known in this round, for answers are not held
        lacks = asks & (begin == end)
        stuck = np.logical_or.reduceat(lacks, starts)[of] if len(pair) else lacks
        if stuck.all():
            break
        goes &= ~stuck
        sizes = np.where(goes, end - begin, 0)
        child = np.repeat(np.arange(len(pair)), sizes)
        edge = np.arange(len(child)) - np.repeat(np.cumsum(sizes) - sizes - begin, sizes)
        passed = np.where(paint < (OURS | THEIRS), paint, OURS | THEIRS | STALE)
        parents = [pair[child], edges[1][edge], edges[2][edge], edges[3][edge], passed[child]]
        waiting = _merged([np.r_[w[~goes], p] for w, p in zip(waiting, parents, strict=True)])
    numbers, ids = (np.concatenate(x) for x in zip(*found, strict=True))
    out = [_rows(chunk, BASE, len(ids), pairs.type, pair=pairs.take(pa.array(numbers)), id=ids)]
    # Too many rows are dealt to several chunks, each with whole pairs.
    n_parts = min(len(starts), -(-len(pair) // CHUNK_ROWS))
    part = of * n_parts // max(1, len(starts))
    for k in range(n_parts):
        own, name = part == k, chunk if n_parts == 1 else f"{chunk}.{k}"
        asked, at = np.unique(id_[own & asks], return_index=True)
        out.append(_rows(name, STATE, 1, pairs.type, payload=[_packed(pairs, [w[own] for w in waiting])]))
        out.append(_rows(name, QUESTION, len(asked), pairs.type, id=asked, rank=rank[own & asks][at]))
    return pa.concat_tables(out)


def _groups(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each pair's rows begin, and each row's pair by its place among them."""
    new = np.r_[True, pair[1:] != pair[:-1]][: len(pair)]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _searching(waiting: list[np.ndarray]) -> list[np.ndarray]:
    """The rows of pairs that may still find a base: a common commit waits, or one of either colour alone."""
    pair, paint = waiting[0], waiting[4]
    if not len(pair):
        return waiting
    starts, of = _groups(pair)
    any_of = [np.logical_or.reduceat(paint == p, starts) for p in (OURS, THEIRS, OURS | THEIRS)]
    stays = (any_of[0] & any_of[1] | any_of[2])[of]
    return [w[stays] for w in waiting]


def _merged(waiting: list[np.ndarray]) -> list[np.ndarray]:
    """One row for each pair and commit, in order, with all of its paint."""
    order = np.lexsort((waiting[1], waiting[0]))
    waiting = [w[order] for w in waiting]
    pair, id_ = waiting[:2]
    if not len(pair):
        return waiting
    first = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (id_[1:] != id_[:-1])])
    return [*(w[first] for w in waiting[:4]), np.bitwise_or.reduceat(waiting[4], first)]


def _packed(pairs: pa.Array, waiting: list[np.ndarray]) -> bytes:
    """What waits, each of its pairs and commits once."""
    own, pair = np.unique(waiting[0], return_inverse=True)
    ids, at, commit = np.unique(waiting[1], return_index=True, return_inverse=True)
    tables = (
        {"pairs": pairs.take(pa.array(own))},
        {"id": ids, "rank": waiting[2][at], "low": waiting[3][at]},
        {"pair": pair.astype(np.int32), "commit": commit.astype(np.int32), "paint": waiting[4].astype(np.int8)},
    )
    sink = pa.BufferOutputStream()
    for table in map(pa.table, tables):
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(payload: bytes) -> tuple[pa.Array, list[np.ndarray]]:
    source = pa.BufferReader(payload)
    pairs, commits, rows = (pa.ipc.open_stream(source).read_all() for _ in range(3))
    commit = rows["commit"].to_numpy()
    waiting = [rows["pair"].to_numpy(), *(commits[c].to_numpy()[commit] for c in ("id", "rank", "low")), rows["paint"].to_numpy()]
    return pairs["pairs"].combine_chunks(), [w.astype(np.int64) for w in waiting]


def _rows(chunk: str, kind: int, n: int, pair_type: pa.DataType, **columns) -> pa.Table:
    types = {"pair": pair_type, "id": pa.int64(), "rank": pa.int64(), "payload": pa.binary()}
    own = {c: pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types.items()}
    return pa.table({"chunk": pa.array([chunk] * n, pa.string()), "kind": pa.array([kind] * n, pa.int32())} | own)


def _unranked(commits: DataFrame, seeds: DataFrame, kept: Callable[[DataFrame], DataFrame], most_rounds: int) -> DataFrame:
    """The same without ranks to go by: a commit of one colour waits while a common or stale one of a higher rank, where they have ranks, has not passed its paint on, for that may be about to make it stale."""
    edges = commits.select("commit", F.explode("parents").alias("parent")).filter("parent IS NOT NULL").distinct()
    ranks = commits.groupBy("commit").agg(F.max("rank").alias("rank"))
    edges = kept(edges.join(ranks.withColumnsRenamed({"commit": "parent", "rank": "parent_rank"}), "parent", "left"))
    now = kept(_painted(seeds.join(ranks, "commit", "left").select("pair", "commit", "rank", "paint", F.lit(0).alias("had"))))
    for _ in range(most_rounds):
        walking = now.filter("goes")
        if walking.isEmpty():
            return now.filter(F.col("paint") == (OURS | THEIRS)).select("pair", F.col("commit").alias("base"))
        passed = F.when(F.col("paint").isin(OURS, THEIRS), F.col("paint")).otherwise(OURS | THEIRS | STALE)
        further = walking.select("pair", "commit", passed.alias("paint")).join(edges, "commit").select("pair", F.col("parent").alias("commit"), F.col("parent_rank").alias("rank"), "paint", F.lit(0).alias("had"))
        now = kept(_painted(now.select("pair", "commit", "rank", "paint", F.when(F.col("goes"), F.col("paint")).otherwise(F.col("had")).alias("had")).union(further)))
    raise RuntimeError("the walks did not end")


def _painted(rows: DataFrame) -> DataFrame:
    """One row for each pair and commit: its paint, what of it was passed on (had), and whether it goes on now."""
    each = rows.repartition("pair").groupBy("pair", "commit").agg(F.max("rank").alias("rank"), F.bit_or("paint").alias("paint"), F.max("had").alias("had"))
    of, both, rank = Window.partitionBy("pair"), OURS | THEIRS, F.col("rank")
    waiting = F.col("paint") != F.col("had")
    single = waiting & (F.col("paint") < both)
    each = each.withColumns({
        "__searching": F.max(single).over(of),
        "__lowest": F.min(F.when(F.col("paint") == both, F.coalesce("rank", F.lit(-(1 << 62))))).over(of),
        "__above": F.max(F.when(waiting & (F.col("paint") >= both), rank)).over(of),
    })
    first = rank.isNull() | F.col("__above").isNull() | (rank >= F.col("__above"))
    matters = F.col("__searching") | rank.isNull() | (rank > F.col("__lowest"))
    return each.withColumn("goes", waiting & F.when(single, first).otherwise(matters)).drop("__searching", "__lowest", "__above")


def generations(commits: DataFrame, kept: Callable[[DataFrame], DataFrame], most_rounds: int = 1_000_000) -> DataFrame:
    """(commit, rank): 1 for a commit without parents, else one more than its highest parent's; as many rounds as the longest chain."""
    edges = commits.select("commit", F.explode("parents").alias("parent")).filter("parent IS NOT NULL").distinct()
    now = kept(commits.select("commit").union(edges.select("parent")).distinct().withColumns({"rank": F.lit(1).cast("long"), "new": F.lit(True)}))
    for _ in range(most_rounds):
        if now.filter("new").isEmpty():
            return now.select("commit", "rank")
        raised = now.filter("new").select(F.col("commit").alias("parent"), (F.col("rank") + 1).alias("rank")).join(edges, "parent").select("commit", "rank", F.lit(True).alias("new"))
        both = now.select("commit", "rank", F.lit(False).alias("new")).union(raised).groupBy("commit").agg(F.max("rank").alias("top"), F.max(F.when(~F.col("new"), F.col("rank"))).alias("had"))
        now = kept(both.select("commit", F.col("top").alias("rank"), (F.col("top") > F.col("had")).alias("new")))
    raise RuntimeError("the graph has a cycle")
