"""Stabbing joins: which intervals hold a point, by dyadic cells.

The integers of an interval are cut into cells [i * 2**k, (i + 1) * 2**k), at most two of each size; a point lies in one cell of each size.  An interval and
a point in it share exactly one cell, so an equality join finds each pair once, and a long interval costs the logarithm of its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(first: Column, last: Column) -> Column:
    """array<struct<level, cell>> of the cells of [first, last], longs; empty where first > last."""
    end = last + 1
    top = F.ceil(F.log2(F.greatest(last - first, F.lit(0)).cast("double") + 2)).cast("int")

    def at(level: Column) -> Column:
        low, high = -F.call_function("shiftright", -first, level), F.call_function("shiftright", end, level)
        odd = lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 1
        one = lambda x: F.struct(level.alias("level"), x.alias("cell"))
        return F.array(F.when((low < high) & odd(low), one(low)), F.when((low < high) & odd(high), one(high - 1)))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), top), at)), lambda c: c.isNotNull())


def stab(points: DataFrame, intervals: DataFrame, by: str, point: str, first: str, last: str) -> DataFrame:
    """Rows of `points` beside each row of `intervals` of the same `by` whose [first, last] holds the point; other columns must not clash.

    Null points, bounds and keys meet nothing.
    """
    cut = intervals.select("*", F.explode(cells(F.col(first), F.col(last))).alias("__c")).select("*", F.col("__c.level").alias("__level"), F.col("__c.cell").alias("__cell")).drop("__c")
    sizes = cut.groupBy(by).agg(F.array_sort(F.collect_set("__level")).alias("__levels"))  # at most 64 numbers
    spread = points.join(sizes, by).withColumn("__level", F.explode("__levels")).withColumn("__cell", F.call_function("shiftright", F.col(point), F.col("__level"))).drop("__levels")
    return spread.join(cut, [by, "__level", "__cell"]).drop("__level", "__cell")
