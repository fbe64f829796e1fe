"""Quality rules as a short-circuit cascade, native DataFrame functions only.

The cascade times each rule and counts its rejections on a sample, then asks the rules in order of rejections per second.  A CASE expression evaluates its branches lazily, so a document that a cheap rule rejects never pays for a
dear one.  The order changes cost and the name of the first failed rule, never a verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Words in a window whose repetition counts.
WINDOW = 8


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found at least twice in the text.

    Windows are compared by a 64-bit hash within one text.  Texts without a repeated window stop after one hash set.
    """

    def covered(at: Column) -> Column:
        gap = F.transform(at, lambda x, i: F.coalesce(F.least(F.lit(WINDOW).cast("long"), F.get(at, i + 1) - x), F.lit(WINDOW).cast("long")))
        return F.aggregate(gap, F.lit(0).cast("long"), lambda a, b: a + b)

    def positions(ranked: Column) -> Column:
        same = lambda x, other: F.coalesce(F.get(ranked, other)["h"] == x["h"], F.lit(False))
        twice = F.filter(ranked, lambda x, i: (F.when(i > 0, same(x, i - 1)).otherwise(False)) | same(x, i + 1))
        return bind(F.sort_array(F.transform(twice, lambda x: x["p"])), covered)

    def of_windows(win: Column) -> Column:
        ranked = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("p"))))
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(bind(ranked, positions))

    def of_hashes(codes: Column) -> Column:
        win = F.transform(F.sequence(F.lit(1), F.size(codes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(codes, i, F.lit(WINDOW))))
        return bind(win, of_windows)

    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(bind(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def dup_lines(text: Column) -> Column:
    """Lines (cut at \\n) that hold a word and equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))
    return bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def letters(text: Column, kind: str) -> Column:
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[^\p{{{kind}}}]", ""))


def adjacent_repeats(words: Column) -> Column:
    """Words equal to the word before them."""
    return F.size(F.filter(F.transform(words, lambda w, i: F.when(i > 0, F.get(words, i - 1) == w).otherwise(False)), lambda x: x))


@dataclass(frozen=True)
class Rule:
    """A document is rejected where `rejects` is true; it may use the columns of `measured` and text and words."""

    name: str
    rejects: Callable[[], Column]


RULES = (
    Rule("symbol_share", lambda: F.col("n_symbols") * 20 > F.col("word_chars")),
    Rule("long_words", lambda: F.col("word_chars") > F.col("n_words") * 25),
    Rule("duplicate_lines", lambda: (F.col("n_dup_lines") >= 3) & (F.col("n_dup_lines") * 10 > F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)) * 3)),
    Rule("shouting", lambda: letters(F.col("text"), "Lu") * 2 > letters(F.col("text"), "L")),
    Rule("exclamations", lambda: (F.char_length(F.coalesce("text", F.lit(""))) - F.char_length(F.translate(F.coalesce("text", F.lit("")), "!", ""))) * 5 > F.col("n_words")),
    Rule("stutter", lambda: adjacent_repeats(F.col("words")) * 10 > F.col("n_words") * 3),
)


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, words and the base measures, one row a document and no shuffle."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), words_of(F.col(text)).alias("words"))
    filled = F.coalesce("text", F.lit(""))
    return base.select(
        "doc_id",
        "text",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace(filled, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.char_length(filled) - F.char_length(F.translate(filled, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dup_lines(F.col("text")).alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, sample_rows: int = 100, sample_chars: int = 100_000, asked_chars: int = 500_000) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a document, share rejected) by falling rejections per second.

    The sample is the first `sample_rows` documents in every fourth value of the id's hash, of at most `sample_chars` characters;
    Spark reads only as many partitions as it takes to find them.  Each rule is asked of the whole sample, as often as it takes to read about `asked_chars` characters, and what the
    same job takes without a rule is deducted.  The bounds only limit what the order is learnt from; an empty table keeps the given order.
    """
    texts = docs.select("doc_id", "text").where(F.length(F.coalesce("text", F.lit(""))) <= sample_chars)
    rows = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).take(sample_rows) or texts.take(sample_rows)
    if not rows:
        return [(r, 0.0, 0.0) for r in rules]
    repeats = min(1000, 1 + asked_chars // max(1, sum(len(r["text"] or "") for r in rows)))
    sample = measured(docs.sparkSession.createDataFrame(rows, texts.schema).coalesce(1)).drop("n_repeat_words").cache()
    asked = sample.withColumn("time", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    conditions = [F.col("time") > 0, *(r.rejects() for r in rules)]
    jobs = [asked.agg(F.count_if(F.coalesce(c, F.lit(False))).alias("n")) for c in conditions]
    with ThreadPoolExecutor(len(jobs)) as pool:  # the first runs compile, side by side
        hits = list(pool.map(lambda job: job.first()["n"], jobs))
    seconds = []
    for job in jobs:
        began = time.perf_counter()
        job.first()
        seconds.append(time.perf_counter() - began)
    asks = repeats * len(rows)
    found = [(rule, max(s - seconds[0], 1e-4) / asks, n / asks) for rule, s, n in zip(rules, seconds[1:], hits[1:], strict=True)]
    sample.unpersist()
    return sorted(found, key=lambda x: -x[2] / x[1])


def quality_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, sample_rows: int = 100) -> DataFrame:
    """The measures of each document, `base_failed`, `failed_rule` (the first in cascade order, else null) and `kept`.

    Null and empty texts have no words, so they fail the base rule; a very long text is measured whole, in one row; repeated rows
    give repeated results.  Rules with equal gain keep their given order.  Columns other than doc_id and text are ignored, whatever
    their names.  An empty table gives no rows.
    """
    rows = measured(docs)
    base_failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    cascade = F.when(F.col("base_failed"), F.lit("base"))
    for rule, _, _ in rule_order(docs.select("doc_id", "text"), rules, sample_rows=sample_rows):
        cascade = cascade.when(F.coalesce(rule.rejects(), F.lit(False)), F.lit(rule.name))
    return (
        rows.withColumn("base_failed", base_failed)
        .withColumn("failed_rule", cascade)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rule", F.col("failed_rule").isNull().alias("kept"))
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade(table(spark, sf_dir, "documents")).drop("failed_rule")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS q FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, q FROM wins GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(8)) AS k FROM wins SEMI JOIN twice USING (doc_id, q)) GROUP BY doc_id),
m AS (SELECT d.doc_id, t, w, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
 (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
 coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR n_symbols * 20 > word_chars OR word_chars > n_words * 25 OR (n_dup_lines >= 3 AND n_dup_lines * 10 > len(string_split(t, chr(10))) * 3)
 OR length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) * 2 > length(regexp_replace(t, '[^\p{L}]', '', 'g'))
 OR (length(t) - length(replace(t, '!', ''))) * 5 > n_words
 OR len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) * 10 > n_words * 3) AS kept FROM f
"""
