"""Nulls in any column, empty and repeated rows, ties, empty tables, and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reelframe.llm import chat_format, decontamination, html_extraction, jaccard_join, packing, quality_classifier, quality_rules, suffix_dedup, toxicity, url_filters
from reelframe.llm.common import table

LONG = "some plain words that make up a text of a fair length so that rules and windows have a thing to look at here " * 3
ROWS = [(1, LONG), (1, LONG), (2, ""), (3, None), (None, LONG), (None, None), (4, LONG + "end"), (5, "\x00\t\n"), (6, "x")]
#: Names that operators use inside, as extra columns of the input.
EXTRA = ("words", "score", "predicted", "segments", "settled", "open", "row", "kept", "bucket", "entries", "n", "sid", "rep", "family", "part", "host", "low", "salt", "b", "component_id", "y", "h", "u", "v", "text2", "failed_rule", "n_words")
LABELS = [(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (4, 1, 0), (4, 0, 1), (6, 0, 1)]


def docs_of(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(None).cast("long"))
    for name in EXTRA:
        df = df.withColumn(name, F.lit("extra"))
    return df


def labels_of(spark, rows=LABELS):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("label")).withColumn("n", F.lit(1))


def bench_of(spark, rows=((1, "never seen anywhere in this small table of texts"), (2, None), (None, "x y z"))):
    return spark.createDataFrame(list(rows), "item_id long, text string").withColumn("doc_id", F.lit(9))


EVERY = {
    "rules": lambda s, d: quality_rules.quality_cascade(d),
    "packing": lambda s, d: packing.pack(d),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels_of(s), F.lit(True))),
    "quality": lambda s, d: quality_classifier.score_quality(d, quality_classifier.fit_quality(d, labels_of(s), F.lit(True))),
    "jaccard": lambda s, d: jaccard_join.jaccard_components(d),
    "suffix": lambda s, d: suffix_dedup.remove_repeats(d),
    "suffix_rows": lambda s, d: suffix_dedup.remove_repeats(d, keep_text=True),
    "leaks": lambda s, d: decontamination.contaminated(d, bench_of(s)),
    "clean": lambda s, d: decontamination.decontaminated(d, bench_of(s)),
}


@pytest.mark.parametrize("name", sorted(EVERY))
def test_documents_with_odd_rows(spark, name):
    rows = EVERY[name](spark, docs_of(spark)).collect()
    if name not in ("packing", "leaks"):
        assert sorted((r.doc_id for r in rows), key=str) == sorted((d for d, _ in ROWS), key=str)


@pytest.mark.parametrize("name", sorted(EVERY))
def test_empty_documents(spark, name):
    assert EVERY[name](spark, docs_of(spark, [])).collect() == []


MANY = "many plain words in one very long text of a document that no one would read " * 20_000
LENGTHY = [(1, MANY), (2, "one short text of a few plain words"), (3, MANY), (4, "w" * 300_000), (5, "\n" * 200_000), (6, None)]


def test_very_long_texts(spark):
    """Every operator takes them whole; one task each."""
    d = spark.createDataFrame(LENGTHY, "doc_id long, text string").repartition(2)
    rules = {r.doc_id: r for r in quality_rules.quality_cascade(d).collect()}
    n = len(MANY.split())
    assert rules[1].n_words == rules[1].n_repeat_words == n and rules[4].word_chars == 300_000 and rules[5].n_words == rules[5].n_dup_lines == 0
    pieces = packing.pack(d).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r.doc_id for r in pieces} == set(range(1, 7)) and all(r.n == r["all"] for r in pieces)
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    toxic = {r.doc_id: r.score for r in toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels, F.lit(True))).collect()}
    good = {r.doc_id: r.score for r in quality_classifier.score_quality(d, quality_classifier.fit_quality(d, labels, F.lit(True))).collect()}
    assert toxic[1] == toxic[3] and good[1] == good[3] and all(0 <= x <= 1 for x in (*toxic.values(), *good.values()))
    bench = spark.createDataFrame([(7, MANY[:2000]), (8, "w" * 300_000 + " a b c d")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(d, bench).collect()} == {(1, 7), (3, 7)}
    pages = spark.createDataFrame([(1, "http://h/" + "x" * 100_000, f"<article><p>{MANY}</p></article>"), (2, "http://h/y", "<p>" * 50_000 + "t")], "page_id long, url string, html string")
    text = {r.page_id: r.text for r in html_extraction.extract_text(pages).collect()}
    assert text == {1: MANY.strip(), 2: "t"}
    assert {r.page_id: len(r.path) for r in url_filters.url_filter(pages, url_filters.labelled_urls(spark)).collect()} == {1: 100_001, 2: 2}
    talk = spark.createDataFrame([(1, 0, "user", MANY), (2, 0, "user", MANY), (2, 1, "assistant", MANY)], "conv_id long, turn long, role string, text string")
    assert [(r.conv_id, len(r.rendered) > 2 * len(MANY)) for r in chat_format.collapse_and_render(talk).collect()] == [(2, True)]


def test_ties_have_one_result(spark):
    """Equal rows in any order and partition give equal results."""
    rows = [(k, LONG + str(k % 2)) for k in range(12)]
    seen = set()
    for n in (1, 3):
        d = spark.createDataFrame(rows[::-1] if n == 1 else rows, "doc_id long, text string").repartition(n)
        comp = tuple(sorted((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(d).collect()))
        cut = tuple(sorted((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(d).collect()))
        labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(12)], "doc_id long, quality int, toxic int")
        score = tuple(sorted((r.doc_id, round(r.score, 9)) for r in quality_classifier.score_quality(d, quality_classifier.fit_quality(d, labels, F.lit(True))).collect()))
        seen.add((comp, cut, score))
    assert len(seen) == 1


def test_rows_of_one_id_are_learnt_from_once(spark):
    """A third of all rows may carry one id: the fitted sample still holds one text of it, the least."""
    from reelframe.llm.labelled import labelled_sample

    d = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "other")], "doc_id long, text string")
    rows = labelled_sample(d, labels_of(spark, [(1, 1, 1), (2, 0, 0)]), "toxic", F.lit(True), per_class=5).collect()
    assert sorted((r.doc_id, r.text, r.y) for r in rows) == [(1, "text 0", 1), (2, "other", 0)]


def test_pipeline_stages_by_hand(spark, sf):
    """The classifier, decontamination and packing stages against what their operators say of each row."""
    from tests.llm.test_llm_brute import leaks_by_hand

    docs, stages = table(spark, sf, "documents"), dict(corpus_pipeline.STAGES)
    model = quality_classifier.fit_quality(docs, table(spark, sf, "labels"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    measure = model.measure()
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {d for d, t in texts.items() if measure.scores([t])[0] >= 0.7}
    assert {r.doc_id for r in stages["quality_classifier"](spark, docs, sf).collect()} == good
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    leaky = {d for d, _ in leaks_by_hand(list(texts.items()), items)}
    assert {r.doc_id for r in stages["benchmark_decontamination"](spark, docs, sf).collect()} == set(texts) - leaky
    packed = stages["packing"](spark, docs, sf).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r.doc_id for r in packed} == set(texts) and all(r.n == r["all"] for r in packed)


def test_pipeline_keeps_one_text_of_an_id(spark):
    rows = [(1, "b" + LONG), (1, "a" + LONG), (2, None), (2, None), (None, "x"), (None, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("extra")).withColumn("component_id", F.lit(5))
    got = corpus_pipeline.near_duplicates(spark, d, "")
    assert got.columns == d.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, "a" + LONG), (2, None), (None, "x"), (None, "x")], key=str)


def test_defined_results_of_odd_rows(spark):
    comp = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in EVERY["jaccard"](spark, docs_of(spark)).collect()), key=str)
    assert (2, 0, 2) in comp and (3, 0, 3) in comp and comp.count((1, comp[0][1], 1)) == 2 and {c for d, _, c in comp if d is None} == {None}
    cut = sorted(((r.doc_id, r.n_removed) for r in EVERY["suffix"](spark, docs_of(spark)).collect()), key=str)
    assert cut == [(1, 0), (1, 0), (2, 0), (3, 0), (4, len(LONG)), (5, 0), (6, 0), (None, 0), (None, 0)]
    kept = {r.doc_id: r.kept for r in EVERY["rules"](spark, docs_of(spark)).collect()}
    assert not kept[2] and not kept[3] and not kept[6]
    pieces = {r.doc_id: r.doc_tokens for r in EVERY["packing"](spark, docs_of(spark)).collect()}
    assert pieces[2] == pieces[3] == 1
    scores = {r.doc_id: r.score for r in EVERY["quality"](spark, docs_of(spark)).collect()}
    assert scores[2] == scores[3] and all(0 <= x <= 1 for x in scores.values())


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, None, None)]])
def test_labels_without_both_classes(spark, labels):
    d = docs_of(spark)
    t = toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels_of(spark, labels), F.lit(True))).collect()
    q = quality_classifier.score_quality(d, quality_classifier.fit_quality(d, labels_of(spark, labels), F.lit(True))).collect()
    assert {r.score for r in t} == {0.5} and {r.score for r in q} == {0.5}


@pytest.mark.parametrize("items", [(), ((1, None),), ((1, ""), (1, "a b"))])
def test_benchmarks_without_words(spark, items):
    assert decontamination.contaminated(docs_of(spark), bench_of(spark, items)).count() == 0


PAGES = [(1, "http://A.Example.NET/en/x?q#f", "<p>t</p>"), (1, "http://A.Example.NET/en/x?q#f", "<p>t</p>"), (2, None, None), (3, "no scheme", ""), (4, "x://", "<p"), (None, "http://b.org/fr/", "<article>é</article>"), (5, "http://net/", "t"), (6, "http://net", "t"), (7, "https://u:p@Cheap-Pills.example.com:80/de/1", "")]


def pages_of(spark, rows=PAGES):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in (*EXTRA, "path", "rule", "verdict", "label"):
        df = df.withColumn(name, F.lit("extra"))
    return df


def test_pages_with_odd_rows(spark):
    got = {r.page_id: r for r in url_filters.url_filter(pages_of(spark), url_filters.labelled_urls(spark)).collect()}
    assert [(got[k].host, got[k].path, got[k].rule) for k in (1, 2, 3, 4, 5, 6)] == [("a.example.net", "/en/x", "example.net/en/"), ("", "", None), ("", "", None), ("", "", None), ("net", "/", "net/"), ("net", "", None)]
    assert got[None].rule == "org/fr/" and got[2].verdict == got[3].verdict == "allow"
    texts = [(r.page_id, r.text, r.n_chars) for r in html_extraction.extract_text(pages_of(spark)).collect()]
    assert sorted(texts, key=str) == sorted([(1, "t", 1), (1, "t", 1), (2, "", 0), (3, "", 0), (4, "", 0), (None, "é", 1), (5, "t", 1), (6, "t", 1), (7, "", 0)], key=str)
    assert html_extraction.extract_text(pages_of(spark, [])).count() == url_filters.url_filter(pages_of(spark, []), url_filters.labelled_urls(spark)).count() == 0


def test_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo <|end|>"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo <|end|>"), (4, None, None, None), (4, 0, "tool", "x"), (4, 0, "tool", "x"), (None, 0, "user", "lost"), (5, 1, "user", "b"), (5, 1, "user", "a")]
    df = spark.createDataFrame(rows, schema)
    for name in ("n", "a", "b", "h", "turns", "prefixes", "x"):
        df = df.withColumn(name, F.lit("extra"))
    got = {r.conv_id: (r.n_turns, r.rendered) for r in chat_format.collapse_and_render(df).collect()}
    assert got == {
        2: (2, "<|user|>\nhi<|end|>\n<|assistant|>\nyo < |end|><|end|>\n"),
        4: (2, "<|user|>\n<|end|>\n<|user|>\nx<|end|>\n"),
        5: (2, "<|user|>\na<|end|>\n<|user|>\nb<|end|>\n"),
    }
    assert chat_format.collapse_and_render(spark.createDataFrame([], schema)).count() == 0


def _folder(spark, path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "a passage of the benchmark")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs


@pytest.mark.parametrize("rows", [[], [(d, t, None, None, None) for d, t in ROWS]])
def test_pipeline_stages_on_odd_rows(spark, tmp_path, rows):
    path = str(tmp_path)
    docs = _folder(spark, path, rows)
    for name, stage in corpus_pipeline.STAGES:
        if name == "quality_classifier":
            continue  # with labels of one class every score is a neutral 0.5, which keeps nothing
        out = stage(spark, docs, path)
        if name != "packing":
            assert out.dtypes == docs.dtypes
            out.write.parquet(f"{path}/{name}")
            docs = spark.read.parquet(f"{path}/{name}")
        else:
            assert (out.count() > 0) == bool(rows)


def test_pipeline_keeps_clean_documents(spark, sf):
    """Each stage against a plain reading of what it must keep."""
    from tests.llm.models import components, without_repeats

    docs = table(spark, sf, "documents")
    stages = dict(corpus_pipeline.STAGES)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    keep = {c for _, c in components(rows).values()}
    near = stages["ngram_jaccard_join"](spark, docs, sf).cache()
    assert {r.doc_id for r in near.collect()} == keep and near.columns == docs.columns
    want = without_repeats([(d, t) for d, t in rows if d in keep])
    cut = {r.doc_id: r for r in stages["suffix_array_dedup"](spark, near, sf).collect()}
    texts = dict(rows)
    assert set(cut) == {d for d, (n, gone, _, _) in want.items() if n == 0 or gone < n}
    assert all(cut[d].text == texts[d] for d, (_, gone, _, _) in want.items() if not gone)
    assert all(len(r.text.encode()) <= want[d][0] - want[d][1] and r.n_chars == len(r.text) for d, r in cut.items())
    assert corpus_pipeline.run(spark, sf).count() > 0
