"""Running values over the rows of a key in order, however many rows a key has.

Rows are dealt into range partitions by (key, order), so a key of a third of all rows lies in a third of the partitions, each a segment of its order.  Running values are taken
within the segments; the value at a segment's end, one row a segment, is carried on to the segments after it, and joined back.  All that is combined so is
associative (sums, maxima, last values), so the result is that of one pass over the whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelframe.session import shared_folder

#: kind of running value -> the function over a window.
KINDS = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}


def segments(rows: DataFrame, keys: list[str], order: list[str | Column], *, name: str = "segment", count: int | None = None) -> DataFrame:
    """`rows` with the number of their segment: range partitions by key and order, written down once, as a second sampling could cut elsewhere."""
    spark = rows.sparkSession
    count = count or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = shared_folder(spark, "segments")
    cut = rows.repartitionByRange(count, *keys, *order).withColumn(name, F.spark_partition_id())
    cut.write.parquet(folder)
    return spark.read.schema(cut.schema).parquet(folder)


def running(rows: DataFrame, keys: list[str], order: list[str | Column], values: dict[str, tuple[str, Column]], *, count: int | None = None) -> DataFrame:
    """`rows` with running values up to and including each row: out -> (sum, max or last, value).  `last` is the last value that is not null.

    `order` must tell the rows of a key apart, or equal ones share an arbitrary order.  A null key is a key; an empty table stays empty.
    """
    cut = segments(rows, keys, order, name="__segment", count=count)
    inside = W.partitionBy("__segment", *keys).orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    part = cut.select("*", F.row_number().over(inside).alias("__place"), *(KINDS[kind](value).over(upto).alias(f"__{out}") for out, (kind, value) in values.items()))
    ends = part.groupBy("__segment", *keys).agg(*(F.max_by(f"__{out}", "__place").alias(f"__{out}") for out in values))
    earlier = W.partitionBy(*keys).orderBy("__segment").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(F.col("__segment").alias("__s"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(KINDS[kind](f"__{out}").over(earlier).alias(f"__c{out}") for out, (kind, _) in values.items()))
    same = F.col("__segment") == F.col("__s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = part.join(carried, same)

    def whole(out: str, kind: str) -> Column:
        here, before = F.col(f"__{out}"), F.col(f"__c{out}")
        return {"sum": F.coalesce(here + before, here, before), "max": F.greatest(here, before), "last": F.coalesce(here, before)}[kind].alias(out)

    return joined.select(*rows.columns, *(whole(out, kind) for out, (kind, _) in values.items()))
