"""A training corpus from raw documents: quality, near duplicates, repeated passages, benchmark leaks, packed sequences.

Stages keep every column of their input, whatever it is named, null texts count as empty ones, and an empty table passes as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import crc_mod, table
from reelframe.llm.decontamination import decontaminated
from reelframe.llm.jaccard_join import jaccard_components
from reelframe.llm.packing import pack
from reelframe.llm.quality_classifier import fit_quality, score_quality
from reelframe.llm.suffix_dedup import remove_repeats
from reelframe.session import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier keeps; labels come from the training folds, texts from the raw table."""
    model = fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 4) != 2)
    own = {c: f"{c} of the input" for c in ("score", "predicted") if c in docs.columns}  # a column named as one of the scores stays what it is
    kept = score_quality(docs.withColumnsRenamed(own), model).where("predicted = 1").drop("score", "predicted")
    return kept.withColumnsRenamed({v: k for k, v in own.items()}).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of links; of several rows of an id that with the least text stays, rows without id all stay."""
    stay = jaccard_components(docs).where("component_id = doc_id").select("doc_id")
    rows = docs.where("doc_id IS NOT NULL").join(stay, "doc_id", "left_semi").select("doc_id", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    one = rows.groupBy("doc_id").agg(F.min_by("row", F.struct(F.col("row.text").isNull(), "row.text")).alias("row"))
    return one.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns)).unionByName(docs.where("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that an earlier document holds; a character cut in two goes whole, and so does a text of which nothing is left."""
    cut = remove_repeats(docs, keep_text=True)
    rows = cut.withColumn("text", F.when(F.col("n_removed") == 0, F.col("kept").cast("string")).otherwise(whole_characters(F.col("kept"))))
    columns = [F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return rows.where("n_bytes = 0 OR n_removed < n_bytes").select(*columns)


def whole_characters(data):
    """Bytes as text without the parts of characters that the cut has left."""
    return F.replace(F.make_valid_utf8(data.cast("string")), F.lit("\ufffd"), F.lit(""))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", leaks),
    ("packing", packing),
]

#: The classifier and the packing search can't be written in SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    base = shared_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
