"""The pipeline's first stage leaves columns that are named as its scores as they are; its second compares near copies alone."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from reelframe.llm import jaccard_join


def test_quality_keeps_clashing_columns(spark, tmp_path):
    rng = random.Random(4)
    good = ["the river runs past the old mill and the people of the town walk beside it", "a careful reader finds the plain answer in the second chapter of the book"]
    rows = [(k, (rng.choice(good) + f" {k} ") * 4 if k % 2 else "".join(rng.choices("@#$%xqzj 0189", k=300))) for k in range(120)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("score", F.lit(-7)).withColumn("predicted", F.lit(5)).withColumn("row", F.col("doc_id") * 2)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.quality(spark, read, str(tmp_path))
    assert kept.columns == read.columns and kept.schema == read.schema
    found = {r.doc_id: r for r in kept.collect()}
    assert all((r.score, r.predicted, r.row, r.lang) == (-7, 5, 2 * r.doc_id, "en") for r in found.values())
    assert sum(k % 2 == 1 for k in found) >= 58 and sum(k % 2 == 0 for k in found) <= 3
    texts = dict(rows)
    assert all(r.text == texts[k] for k, r in found.items())


def test_near_duplicates_compare_near_copies_alone(spark, monkeypatch):
    """Of texts made of passages that each shares with four others, the stage sends the two near copies to be compared and no other; all but one of these stay."""
    words = {i: [f"p{min(x)}_{max(x)}_{k}" for x in ((i, (i + d) % 50) for d in (-2, -1, 1, 2)) for k in range(40)] for i in range(50)}
    words[70] = ["other", *words[3][1:]]
    sent, links = [], jaccard_join.group_links
    monkeypatch.setattr(jaccard_join, "group_links", lambda rows, docs, **a: sent.extend(r.rep for r in rows.collect()) or links(rows, docs, **a))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in words.items()], "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == list(range(50))
    assert sorted(sent) == [3, 70]
