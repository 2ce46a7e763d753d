"""Mixing sources to target weights by Poisson replication.

A source's rate is how often each of its documents should appear, on average, for
the source to have its target share of the mixture.  A document's count is the
inverse of the Poisson distribution with that rate at a number hashed from the seed
and the whole row, so a rerun repeats it.  Each document is exploded by its count and
the copies are dealt to partitions, and ordered within them, by another hash.

Rows that are equal in every column are told apart by an occurrence number, so each has a draw and places of its own.  They are
counted first and become one row with its number of occurrences, so a third of all rows being equal is no hot key; other rows are not gathered.

Edge cases: a null source is a source of its own; null and empty texts have no size,
and a source of no size, or of weight 0, has rate 0; null and shared ids are rows like others, for the id is only
one of the columns that are hashed; an empty table gives an empty one.
The columns of the input come back, with copy_no and n_copies (an input column of either name is replaced), or with a struct of both under a name of the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_small

#: A rate above this is drawn as the sum of several draws; up to it so many terms hold all but 2**-53 of the distribution.
PART_RATE, TERMS = 16.0, 96


def uniform(*parts: str | Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: DataFrame | None = None, power: float = 0.7, epochs: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """source, size, weight and rate; weights (source, weight) default to size ** power.  The mixture has epochs times the input's size."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(power)))
    else:
        w = weights.select(F.col("source").alias("__s"), F.col("weight").cast("double").alias("weight"))
        sizes = sizes.join(w, sizes["source"].eqNullSafe(w["__s"]), "left").drop("__s").fillna(0.0, ["weight"])
    all_of = sizes.agg(F.sum("size").alias("all_size"), F.sum(F.when(F.col("size") > 0, F.col("weight"))).alias("all_weight"))
    share = F.col("weight") / F.col("all_weight") * F.col("all_size") * F.lit(epochs) / F.col("size")
    return sizes.crossJoin(F.broadcast(all_of)).select("source", "size", "weight", F.when((F.col("size") > 0) & (F.col("all_weight") > 0), share).otherwise(F.lit(0.0)).alias("rate"))


def distribution(rate: Column) -> Column:
    """The cumulative Poisson probabilities of 0, 1, 2, ..."""
    first = F.exp(-rate)
    state = F.struct(first.alias("p"), F.array(first).alias("c"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), state, step)["c"]


def row_key(docs: DataFrame) -> Column:
    """128 bits, in hex, that stand for a row's columns in order."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.md5(docs[c].cast("string")), F.lit("null")) for c in docs.columns]))


def numbered(docs: DataFrame) -> DataFrame:
    """(__doc, __key, __nth): each row as a struct, its key, and which of its equals it is, from 1."""
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__doc"), row_key(docs).alias("__key"))
    equal = whole.groupBy("__key").agg(F.count("*").alias("__n")).filter("__n > 1")
    told = join_small(whole, equal.withColumnRenamed("__key", "__of"), "__key", "__of")
    once = told.filter("__n IS NULL").select("__doc", "__key", F.lit(1).cast("long").alias("__nth"))
    often = told.filter("__n IS NOT NULL").groupBy("__key").agg(F.first("__doc").alias("__doc"), F.first("__n").alias("__n"))
    return once.union(often.select("__doc", "__key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("__nth")))


def replicate(
    docs: DataFrame, weights: DataFrame | None = None, power: float = 0.7, epochs: float = 1.0, seed: str = "mix", source_col: str = "source", text_col: str = "text", results: str | None = None
) -> DataFrame:
    """The mixture: each document as often as its draw says, in a globally random order.

    With results, a name that the input has not, all columns of the input stay and the results are one struct of that name."""
    table = rates(docs, weights, power, epochs, source_col, text_col)
    table = table.select("source", F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1)).cast("int").alias("__parts"), "rate")
    table = table.select(F.col("source").alias("__source"), "__parts", distribution(F.col("rate") / F.col("__parts")).alias("__cdf"))
    nth = F.col("__nth").cast("string")
    draws = F.transform(F.sequence(F.lit(1), F.col("__parts")), lambda i: F.size(F.filter("__cdf", lambda c: c <= uniform(F.lit(seed), i.cast("string"), F.col("__key"), nth))))
    drawn = join_small(numbered(docs).withColumn("__of", F.col("__doc")[source_col]), table, "__of", "__source")
    drawn = drawn.select("__doc", "__key", "__nth", F.aggregate(draws, F.lit(0), lambda a, b: a + b).cast("long").alias("n_copies")).filter("n_copies > 0")
    copies = drawn.select("__doc", "__key", "__nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))).alias("copy_no"), "n_copies")
    place = copies.withColumn("__place", F.md5(F.concat_ws("|", F.lit(seed), F.lit("place"), F.col("__key"), nth, F.col("copy_no").cast("string"))))
    place = place.repartition("__place").sortWithinPartitions("__place")
    if results:
        return place.select("__doc.*", F.struct("copy_no", "n_copies").alias(results))
    return place.select(*[F.col("__doc")[c].alias(c) for c in docs.columns if c not in ("copy_no", "n_copies")], "copy_no", "n_copies")


#: The same in DuckDB's SQL, for the default weights.
ORACLE = """
WITH sizes AS (SELECT source, coalesce(sum(length(text)), 0)::DOUBLE AS size FROM documents GROUP BY source),
weighted AS (SELECT source, size, pow(size, 0.7) AS weight FROM sizes),
rated AS (SELECT source, CASE WHEN size > 0 THEN weight / sum(CASE WHEN size > 0 THEN weight END) OVER () * sum(size) OVER () / size ELSE 0 END AS rate FROM weighted),
parts AS (SELECT source, rate, greatest(ceil(rate / 16.0), 1)::BIGINT AS n FROM rated),
pmf AS (SELECT source, k, CASE WHEN rate > 0 THEN exp(-rate / n + k * ln(rate / n) - lgamma(k + 1)) ELSE (k = 0)::INT END AS p
        FROM (SELECT *, unnest(range(97)) AS k FROM parts)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
lists AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
keyed AS (SELECT *, md5(concat_ws('|', coalesce(md5(doc_id::VARCHAR), 'null'), coalesce(md5(text), 'null'), coalesce(md5(lang), 'null'), coalesce(md5(source), 'null'), coalesce(md5(n_chars::VARCHAR), 'null'))) AS row_key FROM documents),
rows_ AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY row_key) AS nth FROM keyed),
parted AS (SELECT d.row_key, d.nth, unnest(generate_series(1, p.n)) AS i, l.cs FROM rows_ d
           JOIN parts p ON coalesce(d.source, chr(0)) = coalesce(p.source, chr(0)) JOIN lists l ON coalesce(l.source, chr(0)) = coalesce(p.source, chr(0))),
draws AS (SELECT row_key, nth, cs, ('0x' || substr(md5('mix|' || i || '|' || row_key || '|' || nth), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM parted),
counts AS (SELECT row_key, nth, sum(len(list_filter(cs, lambda c: c <= u)))::BIGINT AS n_copies FROM draws GROUP BY row_key, nth)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, unnest(generate_series(1, c.n_copies)) AS copy_no, c.n_copies
FROM rows_ d JOIN counts c ON c.row_key = d.row_key AND c.nth = d.nth
"""
