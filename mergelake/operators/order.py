"""Places in a global order, and packing, without one task for all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cuts are looked up in two steps of at most so many comparisons.
FINE = 64
#: Items that one task packs.
PACK_BLOCK = 100_000


def below(cuts: list, key: Column) -> Column:
    """How many of the sorted cuts are below a key."""
    if not cuts:
        return F.lit(0)
    array = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<bigint>")
    coarse = F.size(F.filter(array(cuts[FINE - 1 :: FINE]), lambda c: c < key))
    return coarse * FINE + F.size(F.filter(F.slice(array(cuts), coarse * FINE + 1, FINE), lambda c: c < key))


def quantiles(df: DataFrame, key: str) -> list:
    """Distinct cuts of a whole-number key, in order, into as many buckets as a shuffle has partitions."""
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sorted(set(df.agg(F.percentile_approx(key, F.array(*[F.lit(k / buckets) for k in range(1, max(buckets, 2))]), 10_000)).first()[0] or []))


def following(df: DataFrame, key: str, value: str, name: str, within: str) -> DataFrame:
    """(within, key, value, name): each row's value and that of the next one in the order of a unique integer key among those of equal ``within``; null for the last one.

    Rows are cut into buckets as in ``ordinal``, and values are shuffled once: the next row is in the same bucket, but for the last one of each, which takes the first value of the bucket after it.
    Only those first values meet in one task, as many as there are buckets."""
    cuts = F.array(*[F.lit(c) for c in quantiles(df, key)]).cast("array<bigint>")
    # A key's place among the cuts, without a lambda: of an alias with one Spark 4.1 infers a filter for a join's other side, which hasn't the key.  A group is a struct, so that null is a group like others.
    bucket = F.coalesce(F.array_position(F.sort_array(F.concat(cuts, F.array(F.col(key).cast("long")))), F.col(key).cast("long")), F.lit(0))
    placed = df.select(F.struct(within).alias("__w"), bucket.alias("__b"), key, value)
    here, later = Window.partitionBy("__w", "__b").orderBy(key), Window.partitionBy("__p").orderBy("__q")
    edge = lambda f: f(F.lit(1)).over(here).isNull()
    seen = placed.withColumns({"__next": F.lead(value).over(here), "__last": edge(F.lead), "__first": edge(F.lag)})
    firsts = seen.filter("__first").select(F.col("__w").alias("__p"), F.col("__b").alias("__q"), F.col(value).alias("__v"))
    firsts = firsts.withColumn("__o", F.lag("__q").over(later)).filter("__o IS NOT NULL").drop("__q")
    both = seen.join(firsts, (F.col("__w") == F.col("__p")) & (F.col("__b") == F.col("__o")), "left")
    return both.select(F.col("__w")[within].alias(within), key, value, F.when(F.col("__last"), F.col("__v")).otherwise(F.col("__next")).alias(name))


def ordinal(df: DataFrame, key: str, name: str = "ordinal", within: str | None = None) -> DataFrame:
    """df with each row's place from 0 in the order of a unique integer key, among all rows or those of equal ``within``.

    Rows are cut into buckets at quantiles; places are counted in each, and the sizes of those before it are added:
    only as many rows as there are buckets meet in one task, and a value of within is in as many tasks as its rows have buckets."""
    placed = df.withColumn("__bucket", below(quantiles(df, key), F.col(key)))
    placed = placed.withColumn("__within", F.col(within) if within else F.lit(0))
    sizes = placed.groupBy("__within", "__bucket").agg(F.count("*").alias("__n"))
    before = sizes.select(F.col("__within").alias("__w"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(Window.partitionBy("__within").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    here = Window.partitionBy("__within", "__bucket").orderBy(key)
    # Joined on the bucket as the window gives it: of an alias of an expression with lambdas Spark 4.1 infers a filter for the other side, which hasn't the key.
    placed = placed.withColumns({"__own": F.row_number().over(here) - 1, "__in": F.first("__bucket").over(here)})
    same = (F.col("__in") == F.col("__b")) & F.col("__within").eqNullSafe(F.col("__w"))
    return placed.join(before, same).withColumn(name, (F.col("__before") + F.col("__own")).cast("long")).drop("__bucket", "__in", "__within", "__own", "__b", "__w", "__before")


def chains(tokens: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a batch that begins at each of a block's items: where the next one begins (the block's size: not in it), how many batches begin from there on, and what the last one holds at the end (-1: it is closed)."""
    n = len(tokens)
    upto = np.r_[0, np.cumsum(tokens)]
    after = np.maximum(np.searchsorted(upto, upto[:-1] + most, "right") - 1, np.arange(n) + 1)
    count, held = np.ones(n, np.int64), np.empty(n, np.int64)
    for i in range(n - 1, -1, -1):
        j = after[i]
        if j < n:
            count[i], held[i] = count[j] + 1, held[j]
        else:
            held[i] = -1 if tokens[i] > most else upto[n] - upto[i]
    return after, count, held


def first_start(tokens: np.ndarray, most: int, held: int) -> int:
    """Where the first batch of a block begins, if the one before holds so much (-1: none is open); the block's size if it takes all."""
    if held < 0:
        return 0
    full = held + np.cumsum(tokens) > most
    return int(full.argmax()) if full.any() else len(tokens)


def packed(df: DataFrame, key: str, tokens: str, most: int, block: int = PACK_BLOCK) -> DataFrame:
    """df with batch: greedy packing to most tokens in the order of a unique integer key, one sequence over all rows.  An item that is too large has a batch of its own.

    How a block of items is packed depends on what came before only by where its first batch begins, which is at one of its first few items:
    up to where a batch from the very first ends.  Each block lists the outcome of each, these lists are chained in order (rows: blocks times items of a batch),
    and each block is then packed with what enters it."""
    placed = ordinal(df, key, "__at").withColumn("__block", F.floor(F.col("__at") / block).cast("long"))
    schema = df.select(key, tokens).schema
    ways = "__block long, start long, least long, count long, held long"

    def outcomes(key_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        t = rows.sort_values("__at")["__t"].to_numpy()
        after, count, held = chains(t, most)
        last = min(int(after[0]), len(t) - 1)
        upto = np.cumsum(t)
        # A batch begins at item s if what is held then exceeds the room before s, and not that before s - 1.
        out = [(key_[0], s, most - int(upto[s]), int(count[s]), int(held[s])) for s in range(last + 1)]
        out.append((key_[0], len(t), int(upto[-1]), 0, 0))
        return pd.DataFrame(out, columns=["__block", "start", "least", "count", "held"])

    def chained(rows: pd.DataFrame) -> pd.DataFrame:
        out, held, batch = [], -1, -1
        for block_, part in rows.sort_values(["__block", "start"]).groupby("__block"):
            out.append((block_, held, batch))
            *starts, whole = part.itertuples(index=False)
            way = starts[0] if held < 0 else next((w for w in starts if held > w.least), None)
            if way is None:
                held += whole.least
            else:
                held, batch = way.held, batch + way.count
        return pd.DataFrame(out, columns=["__block", "held", "batch"])

    def filled(rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__at")
        t, batch = rows["__t"].to_numpy(), int(entry["batch"].iloc[0]) if len(entry) else -1
        at = first_start(t, most, int(entry["held"].iloc[0]))
        out, after = np.full(len(t), batch), chains(t, most)[0]
        while at < len(t):
            batch += 1
            out[at : after[at]] = batch
            at = int(after[at])
        return pd.DataFrame({"__k": rows["__k"], "__batch": out})

    slim = placed.select("__block", "__at", F.col(key).alias("__k"), F.col(tokens).cast("long").alias("__t"))
    by_block = slim.groupBy("__block")
    entries = by_block.applyInPandas(outcomes, ways).withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(chained, "__block long, held long, batch long")
    batches = by_block.cogroup(entries.groupBy("__block")).applyInPandas(filled, f"__k {schema[key].dataType.simpleString()}, __batch long")
    return df.join(batches.withColumnRenamed("__k", key).withColumnRenamed("__batch", "batch"), key)
