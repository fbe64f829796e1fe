"""Seeks: where they land, what is decoded and dropped for them, and what arrives first.

As-of joins run as one union of both sides and a running last value, so each needs one shuffle by session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelframe.functions.exprs import whole
from reelframe.functions.intervals import stab
from reelframe.functions.scan import running
from reelframe.plans.registry import query

SEEK = ("session_id", "epoch", "seek_seq", "seek_us", "target_pts", "threshold_s")


def asof(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, values: list[str], *, forward: bool = False, ties: list[str] | None = None, segmented: bool = False) -> DataFrame:
    """`left` with the values of the last right row at or before it (`forward`: the first at or after it) within `by`; null where none is.

    Among right rows of one stamp the last by `ties` counts (`forward`: the first).  `segmented` is for keys that may hold a large share of all rows: their rows
    are scanned by many tasks.
    """
    ties = ties or []
    tag = lambda df, side, on: df.select(F.col(by), F.col(on).alias("__at"), F.lit(side).alias("__side"), *(F.col(t).alias(f"__t{i}") if side == r else F.lit(None).cast(dict(right.dtypes)[t]).alias(f"__t{i}") for i, t in enumerate(ties)), (F.struct(*df.columns) if side != r else F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType)).alias("__left"), (F.struct(*values) if side == r else F.lit(None).cast(right.select(F.struct(*values).alias("x")).schema["x"].dataType)).alias("__right"))
    r = 1 if forward else 0
    rows = tag(left, 1 - r, left_on).unionByName(tag(right, r, right_on))
    order = ["__at", "__side", *(f"__t{i}" for i in range(len(ties)))]
    keys = [F.desc(c) for c in order] if forward else [F.asc(c) for c in order]
    if segmented:
        found = running(rows, [by], keys, {"__found": ("last", F.col("__right"))})
    else:
        found = rows.withColumn("__found", F.last("__right", ignorenulls=True).over(W.partitionBy(by).orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)))
    found = found.where(F.col("__left").isNotNull())
    return found.select("__left.*", *(F.col(f"__found.{v}").alias(v) for v in values))


def seek_keyframe(seeks: DataFrame, packets: DataFrame) -> DataFrame:
    """The keyframe that each seek lands on, and how far it lies before the target."""
    keys = packets.where("keyframe AND pts IS NOT NULL").select("session_id", F.col("pts").alias("keyframe_pts"))
    found = asof(seeks.select(*SEEK), keys, "session_id", "target_pts", "keyframe_pts", ["keyframe_pts"])
    return found.withColumn("gap_s", (F.col("target_pts") - F.col("keyframe_pts")) / 1000)


def seek_first_frame(seeks: DataFrame, packets: DataFrame) -> DataFrame:
    """The first video frame at or after each target."""
    frames = packets.where("kind = 'video' AND pts IS NOT NULL").select("session_id", F.col("pts").alias("first_pts"))
    return asof(seeks.select(*SEEK), frames, "session_id", "target_pts", "first_pts", ["first_pts"], forward=True)


def seek_discard_window(seeks: DataFrame, packets: DataFrame, *, frame_ms: float = 14.5, landed: DataFrame | None = None) -> DataFrame:
    """Frames between the keyframe and the target: decoded and dropped, with the time they cost.

    A window's frames are those before its end less those before its begin, and both numbers are running counts: no window is ever joined with its frames,
    however long it is.  `landed` is the result of `seek_keyframe`, where the caller has it.
    """
    landed = seek_keyframe(seeks, packets) if landed is None else landed
    window = landed.where("keyframe_pts < target_pts").select("session_id", "seek_seq", F.explode(F.array(F.struct(F.col("keyframe_pts").alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("target_pts").alias("at"), F.lit(1).alias("sign")))).alias("x"))
    marks = window.select("session_id", F.col("x.at").alias("at"), F.lit(0).alias("frame"), "seek_seq", "x.sign")  # before the frames of its stamp
    frames = packets.where("kind = 'video' AND pts IS NOT NULL").select("session_id", F.col("pts").alias("at"), F.lit(1).alias("frame"))
    order = W.partitionBy("session_id").orderBy("at", "frame").rowsBetween(W.unboundedPreceding, 0)
    counted = marks.unionByName(frames, allowMissingColumns=True).withColumn("n", F.sum("frame").over(order)).where("frame = 0")
    hits = counted.groupBy("session_id", "seek_seq").agg(F.sum(F.col("n") * F.col("sign")).alias("frames"))
    skipped = F.col("threshold_s").isNotNull() & (F.col("gap_s") > F.col("threshold_s"))
    n = F.when(skipped, 0).otherwise(F.coalesce("frames", F.lit(0)))
    return landed.join(hits, ["session_id", "seek_seq"], "left").select("session_id", "seek_seq", n.cast("long").alias("frames"), (n * frame_ms).alias("decode_ms"))


def _seek_segments(packets: DataFrame, seeks: DataFrame) -> DataFrame:
    """Packets with the latest seek at or before them."""
    right = seeks.select("session_id", F.col("seek_seq").alias("at"), F.struct("seek_seq", "target_pts", "threshold_s").alias("seek"))
    return asof(packets, right, "session_id", "seq", "at", ["seek"]).where("seek IS NOT NULL")


def seek_discard(packets: DataFrame, seeks: DataFrame) -> DataFrame:
    """Video packets that survive an accurate seek: from the first that reaches the target on, all pass; those without pts pass."""
    landed = seek_keyframe(seeks, packets).select("session_id", "seek_seq", "gap_s")
    rows = _seek_segments(packets.where("kind = 'video'").select("session_id", "seq", "pts"), seeks).select("session_id", "seq", "pts", "seek.*").join(landed, ["session_id", "seek_seq"])
    reached = F.max(F.coalesce(F.col("pts") >= F.col("target_pts"), F.lit(False))).over(W.partitionBy("session_id", "seek_seq").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    keyframe_mode = F.coalesce(F.col("gap_s") > F.col("threshold_s"), F.lit(False))
    return rows.withColumn("reached", reached).where(F.col("reached") | F.col("pts").isNull() | keyframe_mode).select("session_id", "seek_seq", "seq", "pts")


def aux_preroll(packets: DataFrame, seeks: DataFrame, *, preroll_s: float = 0.25) -> DataFrame:
    """Auxiliary packets after each seek without those that end before the target; audio begins `preroll_s` earlier."""
    rows = _seek_segments(packets.where("kind <> 'video'").select("session_id", "seq", "kind", "pts", "duration"), seeks).select("session_id", "seq", "kind", "pts", "duration", "seek.*")
    end = F.col("pts") + F.coalesce("duration", F.lit(0))
    early = (F.col("pts") < F.col("target_pts") - F.when(F.col("kind") == "audio", int(preroll_s * 1000)).otherwise(0)) & (end <= F.col("target_pts"))
    return rows.where(F.col("pts").isNull() | ~early).select("session_id", "seek_seq", "seq", "kind", "pts")


def effective_aux_start(seeks: DataFrame, packets: DataFrame) -> DataFrame:
    """Start of auxiliary tracks: the keyframe where the seek stays on it, else the target."""
    early = F.coalesce(F.col("gap_s") > F.col("threshold_s"), F.lit(False))
    return seek_keyframe(seeks, packets).select("session_id", "seek_seq", (F.when(early, F.col("keyframe_pts")).otherwise(F.col("target_pts")) / 1000).alias("aux_start_s"))


def aux_overlap(seeks: DataFrame, packets: DataFrame) -> DataFrame:
    """Subtitle events on screen at each target, however long they stay: those that begin before it and end after it."""
    events = packets.where("kind = 'subtitle' AND pts IS NOT NULL").select("session_id", "seq", "pts", (F.col("pts") + 1).alias("first"), (F.col("pts") + F.col("duration") - 1).alias("last"))
    points = seeks.select("session_id", "seek_seq", "target_pts")
    return stab(points, events, "session_id", "target_pts", "first", "last").select("session_id", "seek_seq", "target_pts", "seq", "pts")


def seek_first_packet(seeks: DataFrame, packets: DataFrame, *, within_s: int = 60) -> DataFrame:
    """Time from each seek to the first packet of its epoch or a later one; null if none comes within `within_s`.

    Epochs only rise, so this is the first later packet that is not stale: a join by session and bucket of `within_s` seconds.
    """
    fresh = packets.where("NOT is_seek").select("session_id", F.col("seq").alias("at"), F.struct("seq", "epoch", "ts_us").alias("packet"))
    pairs = seeks.select("session_id", "seek_seq", "seek_us", "epoch")
    bucket = lambda c: whole(F.col(c) / (within_s * 1_000_000))
    left = pairs.withColumn("bucket", F.explode(F.array(bucket("seek_us"), bucket("seek_us") + 1)))
    right = fresh.select("session_id", "packet.*").withColumnRenamed("epoch", "packet_epoch").withColumn("bucket", bucket("ts_us"))
    hit = left.join(right, ["session_id", "bucket"]).where((F.col("packet_epoch") >= F.col("epoch")) & F.col("ts_us").between(F.col("seek_us"), F.col("seek_us") + within_s * 1_000_000))
    first = hit.groupBy("session_id", "seek_seq").agg(F.min("ts_us").alias("first_us"))
    return pairs.join(first, ["session_id", "seek_seq"], "left").select("session_id", "seek_seq", (F.col("first_us") - F.col("seek_us")).alias("latency_us"))


def seek_flush(seeks: DataFrame, packets: DataFrame) -> DataFrame:
    """Time from each seek to the next packet of its session, stale or not: when the flush has been seen; null where none follows."""
    order = W.partitionBy("session_id").orderBy("seq")
    after = packets.select("session_id", "seq", F.lead("ts_us").over(order).alias("next_us"))
    found = seeks.select("session_id", "seek_seq", "seek_us").join(after.withColumnRenamed("seq", "seek_seq"), ["session_id", "seek_seq"], "left")
    return found.select("session_id", "seek_seq", (F.col("next_us") - F.col("seek_us")).alias("flush_us"))


def seek_report(seeks: DataFrame, packets: DataFrame) -> DataFrame:
    """One row per seek: keyframe gap, mode, frames dropped and their cost, when the flush was seen, first frame and first packet."""
    keyframe_mode = F.coalesce(F.col("gap_s") > F.col("threshold_s"), F.lit(False))
    landed = seek_keyframe(seeks, packets)
    report = landed.select("session_id", "seek_seq", "target_pts", "keyframe_pts", "gap_s", F.when(keyframe_mode, "keyframe").otherwise("accurate").alias("mode"))
    for part in (seek_discard_window(seeks, packets, landed=landed), seek_first_frame(seeks, packets).select("session_id", "seek_seq", "first_pts"), seek_flush(seeks, packets), seek_first_packet(seeks, packets)):
        report = report.join(part, ["session_id", "seek_seq"])
    return report


def seek_coalesce(seeks: DataFrame, *, storm_s: float = 2) -> DataFrame:
    """The winning seek of each storm: a seek that another follows within `storm_s` is superseded."""
    order = W.partitionBy("session_id").orderBy("seek_seq")
    return seeks.withColumn("gap", F.lead("seek_us").over(order) - F.col("seek_us")).where(F.col("gap").isNull() | (F.col("gap") > int(storm_s * 1e6))).select("session_id", "seek_seq", "epoch", "target_pts")


def seek_ticks(seeks: DataFrame, packets: DataFrame) -> DataFrame:
    """Progress ticks of slow seeks every 500 ms from 750 ms on, until a packet of the epoch or a newer seek; the tick after a minute gives the seek up and is the last."""
    order = W.partitionBy("session_id").orderBy("seek_seq")
    ends = seeks.select("session_id", "seek_seq", (F.lead("seek_us").over(order) - F.col("seek_us")).alias("newer"))
    rows = ends.join(seek_first_packet(seeks, packets, within_s=61), ["session_id", "seek_seq"])
    last = F.least(F.lit(60_250).cast("long"), F.coalesce(whole((F.least("latency_us", "newer") - 1) / 1000), F.lit(60_250).cast("long")))
    ticks = rows.withColumn("last", last).where("last >= 750")
    return ticks.select("session_id", "seek_seq", F.explode(F.sequence(F.lit(750).cast("long"), F.col("last"), F.lit(500).cast("long"))).alias("tick_ms")).withColumn("gave_up", F.col("tick_ms") > 60_000)


_KEY = "(SELECT s.*, (SELECT max(p.pts) FROM v_packets p WHERE p.session_id = s.session_id AND p.keyframe AND p.pts <= s.target_pts) AS keyframe_pts FROM v_seeks s)"
_GAP = f"(SELECT *, CAST(target_pts - keyframe_pts AS DOUBLE) / 1000 AS gap_s FROM {_KEY})"
_FIRST = "(SELECT min(p.pts) FROM v_packets p WHERE p.session_id = s.session_id AND p.kind = 'video' AND p.pts >= s.target_pts)"
_FRAMES = f"""CASE WHEN threshold_s IS NOT NULL AND gap_s > threshold_s THEN 0 ELSE (SELECT count(*) FROM v_packets p WHERE p.session_id = s.session_id AND p.kind = 'video' AND p.pts >= s.keyframe_pts AND p.pts < s.target_pts) END"""
_PACKET = "(SELECT min(p.ts_us) FROM v_packets p WHERE p.session_id = s.session_id AND NOT p.is_seek AND p.epoch >= s.epoch AND p.ts_us BETWEEN s.seek_us AND s.seek_us + 60000000)"
_LAST = "SELECT p.*, s.seek_seq, s.target_pts, s.threshold_s FROM v_packets p ASOF JOIN v_seeks s ON p.session_id = s.session_id AND p.seq >= s.seek_seq"
query("seek_keyframe", "v_seeks v_packets", seek_keyframe, f"SELECT session_id, epoch, seek_seq, seek_us, target_pts, threshold_s, keyframe_pts, gap_s FROM {_GAP}")
query("seek_first_frame", "v_seeks v_packets", seek_first_frame, f"SELECT session_id, epoch, seek_seq, seek_us, target_pts, threshold_s, {_FIRST} AS first_pts FROM v_seeks s")
query("seek_discard_window", "v_seeks v_packets", seek_discard_window, f"SELECT session_id, seek_seq, frames, CAST(frames AS DOUBLE) * CAST(14.5 AS DOUBLE) AS decode_ms FROM (SELECT session_id, seek_seq, CAST({_FRAMES} AS BIGINT) AS frames FROM {_GAP} s)")
query(
    "seek_discard",
    "v_packets v_seeks",
    seek_discard,
    f"""WITH l AS ({_LAST} WHERE p.kind = 'video'),
r AS (SELECT *, bool_or(coalesce(pts >= target_pts, false)) OVER (PARTITION BY session_id, seek_seq ORDER BY seq ROWS UNBOUNDED PRECEDING) AS reached FROM l)
SELECT r.session_id, r.seek_seq, r.seq, r.pts FROM r JOIN {_GAP} g ON r.session_id = g.session_id AND r.seek_seq = g.seek_seq WHERE reached OR pts IS NULL OR coalesce(g.gap_s > g.threshold_s, false)""",
)
query(
    "aux_preroll",
    "v_packets v_seeks",
    aux_preroll,
    f"""WITH l AS ({_LAST} WHERE p.kind <> 'video')
SELECT session_id, seek_seq, seq, kind, pts FROM l WHERE pts IS NULL OR NOT (pts < target_pts - CASE WHEN kind = 'audio' THEN 250 ELSE 0 END AND pts + coalesce(duration, 0) <= target_pts)""",
)
query("effective_aux_start", "v_seeks v_packets", effective_aux_start, f"SELECT session_id, seek_seq, CAST(CASE WHEN coalesce(gap_s > threshold_s, false) THEN keyframe_pts ELSE target_pts END AS DOUBLE) / 1000 AS aux_start_s FROM {_GAP}")
query("aux_overlap", "v_seeks v_packets", aux_overlap, "SELECT s.session_id, s.seek_seq, s.target_pts, p.seq, p.pts FROM v_seeks s JOIN v_packets p ON p.session_id = s.session_id AND p.kind = 'subtitle' AND p.pts < s.target_pts AND p.pts + p.duration > s.target_pts")
query("seek_first_packet", "v_seeks v_packets", seek_first_packet, f"SELECT session_id, seek_seq, {_PACKET} - seek_us AS latency_us FROM v_seeks s")
query(
    "seek_report",
    "v_seeks v_packets",
    seek_report,
    f"""SELECT session_id, seek_seq, target_pts, keyframe_pts, gap_s, CASE WHEN coalesce(gap_s > threshold_s, false) THEN 'keyframe' ELSE 'accurate' END AS mode, frames, CAST(frames AS DOUBLE) * CAST(14.5 AS DOUBLE) AS decode_ms, first_pts, flush_us, latency_us
FROM (SELECT s.*, (SELECT min(p.ts_us) FROM v_packets p WHERE p.session_id = s.session_id AND p.seq = s.seek_seq + 1) - seek_us AS flush_us, CAST({_FRAMES} AS BIGINT) AS frames, {_FIRST} AS first_pts, {_PACKET} - seek_us AS latency_us FROM {_GAP} s)""",
)
query("seek_coalesce", "v_seeks", seek_coalesce, "SELECT session_id, seek_seq, epoch, target_pts FROM (SELECT *, lead(seek_us) OVER (PARTITION BY session_id ORDER BY seek_seq) - seek_us AS gap FROM v_seeks) WHERE gap IS NULL OR gap > 2000000")
query(
    "seek_ticks",
    "v_seeks v_packets",
    seek_ticks,
    f"""WITH f AS (SELECT session_id, seek_seq, {_PACKET.replace('60000000', '61000000')} - seek_us AS lat, lead(seek_us) OVER (PARTITION BY session_id ORDER BY seek_seq) - seek_us AS newer FROM v_seeks s),
m AS (SELECT *, least(60250, coalesce((least(lat, newer) - 1) // 1000, 60250)) AS ms FROM f)
SELECT session_id, seek_seq, tick_ms, tick_ms > 60000 AS gave_up FROM (SELECT session_id, seek_seq, unnest(range(750, ms + 1, 500)) AS tick_ms FROM m WHERE ms >= 750)""",
)
