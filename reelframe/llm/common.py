"""What the operators of this subpackage share: tables, the checkpoint folder, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the cluster's shared checkpoint folder (spark.checkpoint.dir); lineage ends there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint()


def crc_mod(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k: the folds that the labels are split by."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(k)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", *, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge; empty without edges.

    Alternates the large-star and small-star steps: each is one minimum by key and one join with it, so no
    neighbourhood is ever collected, and a hub only costs as many rows as it has edges.  Null ends are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = checkpointed(e)
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
