"""Packet tables: stale epochs, empty packets, merging, order, segments, and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelframe.plans.registry import query

# Flag bits of a packet.
KEYFRAME, DISCONTINUITY, EOS = 1, 2, 4


def upto(*keys: str):
    """Rows of a session up to and including the current one, in arrival order."""
    return W.partitionBy(*keys).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)


def drop_stale_epochs(packets: DataFrame) -> DataFrame:
    """Packets of the epoch that seeks so far have set, or later; only a seek raises the current epoch."""
    current = F.coalesce(F.max(F.when(F.col("is_seek"), F.col("epoch"))).over(upto("session_id")), F.lit(0))
    return packets.withColumn("current", current).where("epoch >= current").drop("current")


def drop_empty_packets(packets: DataFrame) -> DataFrame:
    """Without the end markers of a demultiplexer: no payload and no pts (auxiliary streams: nor dts)."""
    return packets.where(~((F.col("size") == 0) & F.col("pts").isNull() & ((F.col("kind") == "video") | F.col("dts").isNull())))


def merge_av(packets: DataFrame) -> DataFrame:
    """Video and auxiliary packets in merged order.

    A merge never reorders one stream, so the key is the largest stamp of the stream so far, then video first, then arrival.  The stamp
    is dts, else pts, else after everything.
    """
    stamp = F.coalesce("dts", "pts", F.lit(9223372036854775807))
    rows = packets.withColumn("aux", F.col("kind") != "video").withColumn("stamp", stamp)
    rows = rows.withColumn("key", F.max("stamp").over(upto("session_id", "aux")))
    order = W.partitionBy("session_id").orderBy("key", "aux", "seq")
    return rows.select("session_id", "seq", "kind", F.row_number().over(order).cast("long").alias("place"))


def epoch_segments(packets: DataFrame, *, newest_only: bool = False) -> DataFrame:
    """Container segments numbered by the discontinuity flag."""
    flag = (F.col("flags").bitwiseAND(DISCONTINUITY) != 0).cast("long")
    rows = packets.withColumn("segment", F.sum(flag).over(upto("session_id")))
    if newest_only:
        rows = rows.withColumn("newest", F.max("segment").over(W.partitionBy("session_id"))).where("segment = newest").drop("newest")
    return rows.select("session_id", "seq", "segment")


def epoch_gap(packets: DataFrame, *, stall_s: float = 30) -> DataFrame:
    """Pauses of at least `stall_s` before a packet."""
    gap = F.col("ts_us") - F.lag("ts_us").over(W.partitionBy("session_id").orderBy("seq"))
    return packets.withColumn("gap_us", gap).where(F.col("gap_us") >= int(stall_s * 1_000_000)).select("session_id", "seq", "gap_us")


def pts_monotonic(packets: DataFrame) -> DataFrame:
    """Video packets whose pts repeats or goes back within their epoch."""
    rows = packets.where("kind = 'video' AND pts IS NOT NULL")
    rows = rows.withColumn("before", F.lag("pts").over(W.partitionBy("session_id", "epoch").orderBy("seq")))
    return rows.where("pts <= before").select("session_id", "epoch", "seq", "pts", "before")


def pts_sort(packets: DataFrame) -> DataFrame:
    """Packets in presentation order, with their place; those without pts are left out."""
    order = W.partitionBy("session_id").orderBy("pts", "seq")
    return packets.where("pts IS NOT NULL").select("session_id", "seq", "pts", F.row_number().over(order).cast("long").alias("place"))


def packet_flags(packets: DataFrame) -> DataFrame:
    bit = lambda b: F.col("flags").bitwiseAND(b) != 0
    return packets.select("session_id", "seq", bit(KEYFRAME).alias("is_keyframe"), bit(DISCONTINUITY).alias("is_discontinuity"), bit(EOS).alias("is_eos"))


def pts_seconds(packets: DataFrame, *, num: int = 1, den: int = 1000) -> DataFrame:
    """Ticks as seconds, and back again (cut towards zero)."""
    seconds = F.col("pts") * num / den
    return packets.select("session_id", "seq", seconds.alias("seconds"), (seconds / (num / den)).cast("long").alias("ticks"))


def packet_counts(packets: DataFrame, *, rate: float | None = 25) -> DataFrame:
    """Per session: packets with pts, largest pts, and the duration up to the end of the last frame."""
    end = F.max("pts") / 1000 + (0.0 if rate is None else 1 / rate)
    return packets.groupBy("session_id").agg(F.count("pts").alias("n"), F.max("pts").alias("max_pts"), F.round(end, 6).alias("duration_s"))


def session_summary(packets: DataFrame) -> DataFrame:
    """Per session: rows in and out of the stale filter and the last packet's pts and epoch."""
    kept = drop_stale_epochs(packets).groupBy("session_id").agg(F.count("*").alias("n_out"))
    last = packets.groupBy("session_id").agg(F.count("*").alias("n_in"), F.max_by("epoch", "seq").alias("last_epoch"), F.max("pts").alias("last_pts"))
    return last.join(kept, "session_id", "left").select("session_id", "n_in", F.coalesce("n_out", F.lit(0)).alias("n_out"), "last_epoch", "last_pts")


def storage_share(packets: DataFrame) -> DataFrame:
    """Bytes of each kind of stream and their share of all."""
    by = packets.groupBy("kind").agg(F.sum("size").alias("bytes"))
    return by.select("kind", "bytes", F.round(F.col("bytes") / F.sum("bytes").over(W.partitionBy()), 6).alias("share"))  # three rows


def epoch_complete(packets: DataFrame) -> DataFrame:
    """Per epoch: whether its end of stream arrived while it was current, and its packets."""
    return drop_stale_epochs(packets).groupBy("session_id", "epoch").agg(F.bool_or("eos").alias("complete"), F.count("*").alias("n"))


def video_descriptor(streams: DataFrame) -> DataFrame:
    """Wire form of video streams: codec, extradata (null where empty), size, time base and average rate (null where unknown), and the duration in seconds.

    The duration is the stream's, else the container's (microseconds); 0 counts as missing in both.
    """
    pair = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.concat(F.lit("["), F.col(a).cast("string"), F.lit(","), F.col(b).cast("string"), F.lit("]")))
    own = F.nullif(F.col("duration"), F.lit(0)) * F.col("tb_num") / F.col("tb_den")
    extradata = F.when(F.octet_length("extradata") > 0, F.base64(F.col("extradata").cast("binary")))
    return streams.select("stream_id", "codec", extradata.alias("extradata_b64"), "width", "height", pair("tb_num", "tb_den").alias("time_base"), pair("rate_num", "rate_den").alias("avg_rate"), F.coalesce(own, F.nullif(F.col("container_us"), F.lit(0)) / 1_000_000).alias("duration_s"))


def pts_verify(expected: DataFrame, actual: DataFrame, *, tol: float = 0.002) -> DataFrame:
    """Timestamps of each clip before and after, matched by place in presentation order.

    Fails where the counts differ or the worst difference is above `tol` seconds.
    """
    a, b = pts_sort(expected).select("session_id", "place", "pts"), pts_sort(actual).select("session_id", "place", F.col("pts").alias("pts2"))
    both = a.join(b, ["session_id", "place"], "full")
    worst = F.coalesce(F.max(F.abs(F.col("pts") - F.col("pts2"))), F.lit(0)) / 1000
    by = both.groupBy("session_id").agg(F.count("pts").alias("n_expected"), F.count("pts2").alias("n_actual"), worst.alias("worst_s"))
    return by.withColumn("ok", (F.col("n_expected") == F.col("n_actual")) & (F.col("worst_s") <= tol))


def shifted(packets: DataFrame) -> DataFrame:
    """A second take of the packets: stamps up to 3 ms later, one row in a hundred missing."""
    return packets.where("seq % 100 <> 99").withColumn("pts", F.col("pts") + F.col("seq") % 4)


def drift_worst(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Largest timestamp difference of each clip over packets of one arrival number; 0 where none match."""
    a, b = expected.select("session_id", "seq", "pts"), actual.select("session_id", "seq", F.col("pts").alias("pts2"))
    return a.join(b, ["session_id", "seq"], "left").groupBy("session_id").agg(F.round(F.coalesce(F.max(F.abs(F.col("pts") - F.col("pts2"))) / 1000, F.lit(0.0)), 6).alias("worst_s"))


def fps_window(packets: DataFrame, *, width_s: int = 2) -> DataFrame:
    """Frames a second in aligned windows of `width_s` (the batch form)."""
    start = F.floor(F.col("ts_us") / (width_s * 1_000_000)).cast("long") * width_s
    return packets.where("kind = 'video'").groupBy("session_id", start.alias("start_s")).agg((F.count("*") / width_s).alias("fps"))


_CUR = "(SELECT *, coalesce(max(CASE WHEN is_seek THEN epoch END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS cur FROM v_packets)"
_ALL = "session_id, seq, ts_us, k, is_seek, epoch, kind, pts, dts, keyframe, eos, size, flags, duration"
_B = "(SELECT session_id, seq, pts + seq % 4 AS pts FROM v_packets WHERE seq % 100 <> 99)"
query("drop_stale_epochs", "v_packets", drop_stale_epochs, f"SELECT {_ALL} FROM {_CUR} WHERE epoch >= cur")
query("drop_empty_packets", "v_packets", drop_empty_packets, f"SELECT {_ALL} FROM v_packets WHERE NOT (size = 0 AND pts IS NULL AND (kind = 'video' OR dts IS NULL))")
query(
    "merge_av",
    "v_packets",
    merge_av,
    """WITH s AS (SELECT *, CASE WHEN kind = 'video' THEN 0 ELSE 1 END AS aux, coalesce(dts, pts, 9223372036854775807) AS stamp FROM v_packets),
m AS (SELECT *, max(stamp) OVER (PARTITION BY session_id, aux ORDER BY seq ROWS UNBOUNDED PRECEDING) AS key FROM s)
SELECT session_id, seq, kind, row_number() OVER (PARTITION BY session_id ORDER BY key, aux, seq) AS place FROM m""",
)
query("epoch_segments", "v_packets", epoch_segments, "SELECT session_id, seq, CAST(sum((flags // 2) % 2) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM v_packets")
query(
    "epoch_segments_newest",
    "v_packets",
    lambda p: epoch_segments(p, newest_only=True),
    """WITH s AS (SELECT session_id, seq, CAST(sum((flags // 2) % 2) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM v_packets)
SELECT session_id, seq, segment FROM s WHERE segment = (SELECT max(segment) FROM s t WHERE t.session_id = s.session_id)""",
)
query("epoch_gap", "v_packets", epoch_gap, "SELECT session_id, seq, gap_us FROM (SELECT session_id, seq, ts_us - lag(ts_us) OVER (PARTITION BY session_id ORDER BY seq) AS gap_us FROM v_packets) WHERE gap_us >= 30000000")
query("pts_monotonic", "v_packets", pts_monotonic, "SELECT session_id, epoch, seq, pts, before FROM (SELECT *, lag(pts) OVER (PARTITION BY session_id, epoch ORDER BY seq) AS before FROM v_packets WHERE kind = 'video' AND pts IS NOT NULL) WHERE pts <= before")
query("pts_sort", "v_packets", pts_sort, "SELECT session_id, seq, pts, row_number() OVER (PARTITION BY session_id ORDER BY pts, seq) AS place FROM v_packets WHERE pts IS NOT NULL")
query("packet_flags", "v_packets", packet_flags, "SELECT session_id, seq, flags % 2 = 1 AS is_keyframe, (flags // 2) % 2 = 1 AS is_discontinuity, (flags // 4) % 2 = 1 AS is_eos FROM v_packets")
query("pts_seconds", "v_packets", pts_seconds, "SELECT session_id, seq, CAST(pts * 1 AS DOUBLE) / 1000 AS seconds, CAST(trunc((CAST(pts AS DOUBLE) / 1000) / CAST(0.001 AS DOUBLE)) AS BIGINT) AS ticks FROM v_packets")
query("packet_counts", "v_packets", packet_counts, "SELECT session_id, count(pts) AS n, max(pts) AS max_pts, round(max(pts) / CAST(1000 AS DOUBLE) + CAST(0.04 AS DOUBLE), 6) AS duration_s FROM v_packets GROUP BY session_id")
query(
    "session_summary",
    "v_packets",
    session_summary,
    f"""WITH o AS (SELECT session_id, count(*) AS n_out FROM {_CUR} WHERE epoch >= cur GROUP BY session_id)
SELECT session_id, count(*) AS n_in, coalesce(max(n_out), 0) AS n_out, arg_max(epoch, seq) AS last_epoch, max(pts) AS last_pts FROM v_packets LEFT JOIN o USING (session_id) GROUP BY session_id""",
)
query("storage_share", "v_packets", storage_share, "SELECT kind, CAST(sum(size) AS BIGINT) AS bytes, round(CAST(sum(size) AS DOUBLE) / CAST(sum(sum(size)) OVER () AS DOUBLE), 6) AS share FROM v_packets GROUP BY kind")
query("epoch_complete", "v_packets", epoch_complete, f"SELECT session_id, epoch, bool_or(eos) AS complete, count(*) AS n FROM {_CUR} WHERE epoch >= cur GROUP BY session_id, epoch")
query(
    "video_descriptor",
    "v_streams",
    video_descriptor,
    """SELECT stream_id, codec, CASE WHEN length(extradata) > 0 THEN base64(CAST(extradata AS BLOB)) END AS extradata_b64, width, height, '[' || tb_num || ',' || tb_den || ']' AS time_base,
 CASE WHEN rate_num IS NOT NULL THEN '[' || rate_num || ',' || rate_den || ']' END AS avg_rate, coalesce(CAST(nullif(duration, 0) * tb_num AS DOUBLE) / tb_den, CAST(nullif(container_us, 0) AS DOUBLE) / 1000000) AS duration_s FROM v_streams""",
)
query(
    "pts_verify",
    "v_packets",
    lambda p: pts_verify(p, shifted(p)),
    f"""WITH a AS (SELECT session_id, pts, row_number() OVER (PARTITION BY session_id ORDER BY pts, seq) AS place FROM v_packets WHERE pts IS NOT NULL),
b AS (SELECT session_id, pts AS pts2, row_number() OVER (PARTITION BY session_id ORDER BY pts, seq) AS place FROM {_B} WHERE pts IS NOT NULL),
g AS (SELECT session_id, count(pts) AS n_expected, count(pts2) AS n_actual, CAST(coalesce(max(abs(pts - pts2)), 0) AS DOUBLE) / 1000 AS worst_s FROM a FULL JOIN b USING (session_id, place) GROUP BY session_id)
SELECT *, n_expected = n_actual AND worst_s <= CAST(0.002 AS DOUBLE) AS ok FROM g""",
)
query("drift_worst", "v_packets", lambda p: drift_worst(p, shifted(p)), f"SELECT session_id, round(coalesce(CAST(max(abs(a.pts - b.pts)) AS DOUBLE) / 1000, 0), 6) AS worst_s FROM v_packets a LEFT JOIN {_B} b USING (session_id, seq) GROUP BY session_id")
query("fps_window", "v_packets", fps_window, "SELECT session_id, ts_us // 2000000 * 2 AS start_s, CAST(count(*) AS DOUBLE) / 2 AS fps FROM v_packets WHERE kind = 'video' GROUP BY session_id, ts_us // 2000000 * 2")
