"""Chapters: cleaning, titles, where a position lies and where a step leads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelframe.operators.seeks import asof
from reelframe.plans.registry import query


def sanitize_chapters(chapters: DataFrame, *, cap: int = 512) -> DataFrame:
    """The first `cap` chapters as given, without negative or missing starts, in order of start (stable); ends and titles may be missing."""
    given = F.row_number().over(W.partitionBy("clip_id").orderBy("pos"))
    rows = chapters.withColumn("given", given).where((F.col("given") <= cap) & (F.col("start_s") >= 0))
    place = F.row_number().over(W.partitionBy("clip_id").orderBy("start_s", "given"))
    return rows.select("clip_id", place.cast("long").alias("place"), "start_s", "end_s", "title")


def normalize_chapters(chapters: DataFrame) -> DataFrame:
    """Display titles: chapters without a title, or with an empty one, are named by their place, counted over all; others stay as they are, blanks included."""
    place = F.row_number().over(W.partitionBy("clip_id").orderBy("start_s", "pos"))
    rows = chapters.where("start_s >= 0").withColumn("place", place)
    return rows.select("clip_id", "pos", "start_s", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.concat(F.lit("Chapter "), F.col("place").cast("string"))).alias("title"))


def chapter_at(positions: DataFrame, chapters: DataFrame) -> DataFrame:
    """The chapter of each position: the last that starts at or before it, null before the first."""
    right = chapters.where("start_s >= 0").select("clip_id", F.col("start_s").alias("at"), F.col("pos").alias("chapter"), F.col("pos").alias("tie"))
    return asof(positions.select("clip_id", "event_id", "pos_s"), right, "clip_id", "pos_s", "at", ["chapter"], ties=["tie"], segmented=True)


def chapter_step(positions: DataFrame, chapters: DataFrame, *, delta: int, restart_s: float = 3.0) -> DataFrame:
    """Target of stepping one chapter back (`delta` -1) or on (1).

    Back: the current chapter's start if more than `restart_s` in, else the one before, 0 in the first; null before the first.  On: null past the last.
    """
    order = W.partitionBy("clip_id").orderBy("start_s", "pos")
    rows = chapters.where("start_s >= 0").withColumn("before", F.lag("start_s").over(order)).withColumn("after", F.lead("start_s").over(order)).withColumn("first", F.min("start_s").over(W.partitionBy("clip_id")))
    right = rows.select("clip_id", F.col("start_s").alias("at"), F.col("pos").alias("tie"), F.struct("start_s", "before", "after").alias("c"))
    found = asof(positions.select("clip_id", "event_id", "pos_s"), right, "clip_id", "pos_s", "at", ["c"], ties=["tie"], segmented=True)
    if delta < 0:
        target = F.when(F.col("c").isNull(), F.lit(None).cast("double")).when(F.col("pos_s") - F.col("c.start_s") > restart_s, F.col("c.start_s")).otherwise(F.coalesce("c.before", F.lit(0.0)))
        return found.select("clip_id", "event_id", target.alias("target_s"))
    first = rows.groupBy("clip_id").agg(F.min("start_s").alias("first"))
    return found.join(first, "clip_id", "left").select("clip_id", "event_id", F.when(F.col("c").isNull(), F.col("first")).otherwise(F.col("c.after")).alias("target_s"))


def default_tracks(tracks: DataFrame) -> DataFrame:
    """Tracks that a player selects: the first audio, and the first default subtitle or else the first."""
    audio = F.min_by("pos", F.when(F.col("type") == "audio", F.col("pos")))
    sub = F.min_by("pos", F.when(F.col("type") == "sub", F.struct(~F.col("is_default"), "pos")))
    return tracks.groupBy("file").agg(audio.alias("audio"), sub.alias("subtitle"))


_NEXT = """WITH c AS (SELECT clip_id, pos, start_s, lag(start_s) OVER w AS before, lead(start_s) OVER w AS after FROM v_chapters WHERE start_s >= 0 WINDOW w AS (PARTITION BY clip_id ORDER BY start_s, pos)),
l AS (SELECT p.clip_id, p.event_id, p.pos_s, (SELECT arg_max({'s': c.start_s, 'b': c.before, 'a': c.after, 'p': c.pos}, {'s': c.start_s, 'p': c.pos}) FROM c WHERE c.clip_id = p.clip_id AND c.start_s <= p.pos_s) AS x FROM v_positions p)"""
query("sanitize_chapters", "v_chapters", sanitize_chapters, """SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY start_s, given) AS place, start_s, end_s, title
FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY pos) AS given FROM v_chapters) WHERE given <= 512 AND start_s >= 0""")
query("normalize_chapters", "v_chapters", normalize_chapters, "SELECT clip_id, pos, start_s, coalesce(nullif(title, ''), 'Chapter ' || row_number() OVER (PARTITION BY clip_id ORDER BY start_s, pos)) AS title FROM v_chapters WHERE start_s >= 0")
query("chapter_at", "v_positions v_chapters", chapter_at, _NEXT + " SELECT clip_id, event_id, pos_s, x.p AS chapter FROM l")
query("chapter_step_back", "v_positions v_chapters", lambda p, c: chapter_step(p, c, delta=-1), _NEXT + " SELECT clip_id, event_id, CASE WHEN x IS NULL THEN NULL WHEN pos_s - x.s > 3 THEN x.s ELSE coalesce(x.b, 0) END AS target_s FROM l")
query("chapter_step", "v_positions v_chapters", lambda p, c: chapter_step(p, c, delta=1), _NEXT + " SELECT clip_id, event_id, CASE WHEN x IS NULL THEN (SELECT min(c.start_s) FROM c WHERE c.clip_id = l.clip_id) ELSE x.a END AS target_s FROM l")
query("default_tracks", "v_tracks", default_tracks, """SELECT file, min(CASE WHEN type = 'audio' THEN pos END) AS audio,
 coalesce(min(CASE WHEN type = 'sub' AND is_default THEN pos END), min(CASE WHEN type = 'sub' THEN pos END)) AS subtitle FROM v_tracks GROUP BY file""")
