"""Joins of ranges of whole numbers within a group, without a product of the group's rows.

A range belongs to the width class of its length, the least of 64, 64**2, 64**3, ... that is not below it, and in that class touches two bins at most.
What looks for it asks in each class for the bin it is in.  Ranges that don't overlap one another, such as the conflicts of a file, are 66 at most in a bin of their
class, so the rows that meet are a fixed number for each one that asks, however many ranges a group has.

Edge cases: a range with a null end or an end before its start meets nothing; null groups are one group; equal ranges are rows of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The last class takes all that is longer.
WIDTHS = [64**k for k in range(1, 7)] + [1 << 62]


def width_class(start: Column, end: Column) -> Column:
    """Which of the widths is the least that is not below a range's length."""
    length = end - start + 1
    return reduce(lambda out, k: F.when(length <= WIDTHS[k], k).otherwise(out), reversed(range(len(WIDTHS) - 1)), F.lit(len(WIDTHS) - 1))


def bins(df: DataFrame, start: str, end: str, above: int | None) -> DataFrame:
    """Ranges with __k and __bin, a row for each bin they touch: in their own class alone (None), or in all classes from so many above it."""
    own = width_class(F.col(start), F.col(end))
    every = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).cast("long").alias("w")) for k, w in enumerate(WIDTHS)])
    chosen = F.filter(every, lambda c: c["k"] == own if above is None else c["k"] >= own + above)
    rows = df.filter(F.col(start) <= F.col(end)).withColumn("__c", F.explode(chosen))
    touched = F.array_distinct(F.array(F.floor(F.col(start) / F.col("__c")["w"]), F.floor(F.col(end) / F.col("__c")["w"])))
    return rows.withColumn("__bin", F.explode(touched)).withColumn("__k", F.col("__c")["k"]).drop("__c")


def _meeting(own: DataFrame, own_range: tuple[str, str], other: DataFrame, other_range: tuple[str, str], above: int) -> DataFrame:
    """Pairs of overlapping ranges of equal __g, the first in its own class and the second not in a larger one (in a smaller one if above is 1); a pair meets in the bin where the overlap begins."""
    a = bins(own, *own_range, None)
    b = bins(other, *other_range, above).withColumnsRenamed({"__g": "__og", "__k": "__ok", "__bin": "__ob"})
    w = F.element_at(F.array(*[F.lit(w).cast("long") for w in WIDTHS]), F.col("__k") + 1)
    begins = F.floor(F.greatest(F.col(own_range[0]), F.col(other_range[0])) / w) == F.col("__bin")
    overlap = (F.col(own_range[0]) <= F.col(other_range[1])) & (F.col(other_range[0]) <= F.col(own_range[1]))
    meet = a["__g"].eqNullSafe(b["__og"]) & (F.col("__k") == F.col("__ok")) & (F.col("__bin") == F.col("__ob"))
    return a.join(b, meet & begins & overlap).drop("__k", "__bin", "__og", "__ok", "__ob")


def overlapping(left: DataFrame, right: DataFrame, group: str, right_group: str | None = None) -> DataFrame:
    """left with the rows of right of its group, ranges (start, end) that overlap its own as r_start and r_end; each pair once."""
    a = left.withColumn("__g", F.col(group))
    b = right.withColumnsRenamed({right_group or group: "__g", "start": "r_start", "end": "r_end"})
    longer = _meeting(a, ("start", "end"), b, ("r_start", "r_end"), 0)
    shorter = _meeting(b, ("r_start", "r_end"), a, ("start", "end"), 1)
    return longer.unionByName(shorter).drop("__g")


def containing(inner: DataFrame, outer: DataFrame, group: str, outer_group: str | None = None) -> DataFrame:
    """inner with the rows of outer of its group, ranges (start, end) that contain its own as o_start and o_end; it asks at its start, once in each class."""
    kept = bins(outer.withColumnsRenamed({outer_group or group: "__g", "start": "o_start", "end": "o_end"}), "o_start", "o_end", None)
    every = F.array(*[F.struct(F.lit(k).alias("k"), F.floor(F.col("start") / F.lit(w)).alias("bin")) for k, w in enumerate(WIDTHS)])
    asked = inner.filter(F.col("start") <= F.col("end")).withColumn("__a", F.explode(every))
    meet = asked[group].eqNullSafe(kept["__g"]) & (F.col("__a")["k"] == F.col("__k")) & (F.col("__a")["bin"] == F.col("__bin"))
    return asked.join(kept, meet & (F.col("o_start") <= F.col("start")) & (F.col("o_end") >= F.col("end"))).drop("__a", "__g", "__k", "__bin")
