"""Chat formatting with cumulative-snapshot collapse, native DataFrame functions only.

A client that logs a conversation after each turn leaves snapshots that prefix one another.  Rolling hashes of turn
prefixes find them: a conversation whose whole hash is the hash of a proper prefix elsewhere goes, by an anti-join; of equal
conversations the smallest id stays.  Only what stays is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import table
from reelframe.llm.quality_rules import bind

ROLES = ("system", "user", "assistant")


def gathered(turns: DataFrame) -> DataFrame:
    """conv_id, turns (in order) and prefixes (the rolling hash pair after each turn)."""
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("x"))
    once = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("all"))
    once = once.select("conv_id", F.filter("all", lambda x, i: (i == 0) | ~x.eqNullSafe(F.get("all", F.greatest(i - 1, F.lit(0))))).alias("turns"))

    def step(acc: Column, x: Column) -> Column:
        before = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.struct(F.xxhash64(before["a"], x["role"], x["text"]).alias("a"), F.xxhash64(x["text"], x["role"], before["b"]).alias("b"))))

    start = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b")))
    return once.withColumn("prefixes", F.slice(F.aggregate("turns", start, step), F.lit(2), F.size("turns")))


def rendered(turns: Column) -> Column:
    """<|role|>, line feed, text, <|end|>, line feed for each turn; a <| in a text is written < | so that no text can forge a mark."""
    clean = lambda t: F.replace(t, F.lit("<|"), F.lit("< |"))
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit("<|"), F.when(x["role"].isin(*ROLES), x["role"]).otherwise("user"), F.lit("|>\n"), clean(x["text"]), F.lit("<|end|>\n"))), "")


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered of each maximal conversation.

    Turns go by (turn, role, text), a null turn first; exact repeats of a row count once; null roles and texts are
    empty, and an unknown role renders as user; texts are kept whole, however long.  Of equal conversations the smallest id stays.  Rows without
    conv_id belong to no conversation; an empty table gives no rows.  Extra columns are ignored, whatever their names.  A conversation is one row, so
    one of very many turns is held, and its prefix hashes built, by one task.
    """
    convs = gathered(turns)
    whole = convs.select("conv_id", F.size("turns").alias("n"), F.element_at("prefixes", -1).alias("h")).select("conv_id", "n", "h.a", "h.b")
    inner = convs.select(F.explode(F.slice("prefixes", F.lit(1), F.size("prefixes") - 1)).alias("h")).select("h.a", "h.b").distinct()
    first = whole.groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    kept = first.join(inner, ["a", "b"], "left_anti").select("conv_id")
    return convs.join(kept, "conv_id", "left_semi").select("conv_id", F.size("turns").cast("long").alias("n_turns"), rendered(F.col("turns")).alias("rendered"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
p AS (SELECT conv_id, k, n, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY k) AS pre FROM r),
w AS (SELECT min(conv_id) AS conv_id, n, pre FROM p WHERE k = n GROUP BY n, pre),
s AS (SELECT conv_id FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.k = w.n AND p.pre = w.pre))
SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg('<|' || CASE WHEN role IN ('system', 'user', 'assistant') THEN role ELSE 'user' END || '|>' || chr(10)
 || replace(text, '<|', '< |') || '<|end|>' || chr(10), '' ORDER BY k) AS rendered FROM r SEMI JOIN s USING (conv_id) GROUP BY conv_id
"""
