"""Structured Streaming forms of the session jobs.

Lateness is defined by epochs: a seek raises a session's epoch, and packets of an older one are dropped wherever they appear.  Watermarks
and timers only bound state.  Every job runs on an unbounded stream; `drained` runs one over what is there and returns the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.operators.sessions import STATS_SQL
from reelframe.plans.registry import ORACLES, QUERIES
from reelframe.plans.views import ansi_with, view
from reelframe.session import shared_folder
from reelframe.sources.files import parse_server_log, write_log
from reelframe.streaming import lifecycle


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of files, with typed columns and a timestamp that watermarks accept."""
    raw = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    return raw.select("event_id", "user_id", "event_type", "value", k.alias("k"), us.alias("ts_us"), F.timestamp_micros(us).alias("at"))


def arriving(rows: DataFrame, name: str) -> DataFrame:
    """Rows with session_id, seq and ts_us as a stream of files, with `at` for watermarks.

    The server's clock (session -1) speaks once more, an hour after the last row, so that what waits for silence is told.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark, name)
    rows.write.parquet(folder)
    quiet = [F.lit(False).cast(kind) if kind == "boolean" else F.lit(None).cast(kind) for _, kind in rows.dtypes]
    named = {"session_id": F.lit(-1).cast("long"), "seq": F.lit(0).cast("long"), "epoch": F.lit(0).cast("long"), "ts_us": F.max("ts_us") + 3_600_000_000}
    clock = spark.read.parquet(folder).agg(*(named.get(c, x).alias(c) for c, x in zip(rows.columns, quiet, strict=True)))
    clock.where("ts_us IS NOT NULL").write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder).withColumn("at", F.timestamp_micros("ts_us"))


def packet_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = view(spark, sf_dir, "v_packets")
    return arriving(packets.select("session_id", "seq", "ts_us", "epoch", "is_seek", (F.col("kind") == "video").alias("is_video")), "packets")


def message_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets and buffer reports of all sessions as one stream; a seek reports an empty buffer."""
    packets = view(spark, sf_dir, "v_packets")
    none, full = F.lit(None).cast("long").alias("buffered_ms"), F.lit(True).alias("playing")
    rows = packets.select("session_id", "seq", "ts_us", F.lit(True).alias("is_packet"), none, full)
    rows = rows.unionByName(packets.where("is_seek").select("session_id", "seq", "ts_us", F.lit(False).alias("is_packet"), F.lit(0).cast("long").alias("buffered_ms"), full))
    reports = view(spark, sf_dir, "v_reports").select("session_id", F.col("event_id").alias("seq"), "ts_us", F.lit(False).alias("is_packet"), "buffered_ms", "playing")
    return arriving(rows.unionByName(reports), "messages").where("session_id >= 0 OR is_packet = false").withColumn("buffered_ms", F.coalesce("buffered_ms", F.lit(0)))


def open_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arriving(view(spark, sf_dir, "v_opens").select(F.col("client").alias("session_id"), F.col("event_id").alias("seq"), "ts_us"), "opens")


def seeks_of(packets: DataFrame) -> DataFrame:
    """The seeks of a stream of packets, and the clock."""
    return packets.where("is_seek OR session_id < 0").select("session_id", F.col("seq").alias("seek_seq"), "epoch", F.col("ts_us").alias("seek_us"), F.col("at").alias("seek_at"))


#: The state store that timers and state variables need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(stream: DataFrame, *, mode: str = "append") -> DataFrame:
    """Run a streaming job over everything that is available and return what it wrote, as a batch DataFrame.

    The sink is a Parquet folder beside the checkpoint, in the folder that spark.checkpoint.dir names; in complete mode each batch replaces what the last one wrote.
    """
    spark = stream.sparkSession
    base = shared_folder(spark, "stream")
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, STORE)
    try:
        if mode == "append":
            query = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{base}/out")
        elif mode == "complete":
            write = lambda df, batch: df.write.mode("overwrite").parquet(f"{base}/out")
            query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
        else:
            raise ValueError(f"no result of mode {mode}: append or complete")
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def first_seen(connections: DataFrame, *, horizon: str = "1 hour") -> DataFrame:
    """Clients not seen within the horizon; the watermark forgets older ones."""
    return connections.withWatermark("at", horizon).dropDuplicatesWithinWatermark(["ip"]).select("ip", "ts_us")


def fps_window(packets: DataFrame, *, width: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """Frames in aligned windows, once the watermark has passed them."""
    by = packets.withWatermark("at", late).where(F.when(F.col("is_video"), F.col("at")).isNotNull()).groupBy("session_id", F.window("at", width).alias("w"))
    return by.agg(F.count("*").alias("frames")).select("session_id", F.unix_micros("w.start").alias("start_us"), "frames")


def stats_rollup(lines: DataFrame, *, width: str = "1 minute", slide: str = "30 seconds", late: str = "5 minutes") -> DataFrame:
    """Rolling performance of each session in sliding windows, from the lines (value) of a server's log; lines that are no stats line don't count."""
    stats = parse_server_log(lines).where("event = 'stats'").withWatermark("ts", late)
    by = stats.groupBy("session", F.window("ts", width, slide).alias("w"))
    return by.agg(
        F.count("*").alias("n"), F.round(F.avg("fps"), 6).alias("fps"), F.round(F.avg("infer_fps"), 6).alias("infer_fps"), F.max("in_flight").alias("most_cached"), F.min("buffered_ms").alias("least_buffered_ms"), F.count_if(F.col("pacing") == "PAUSED").alias("paused")
    ).select("session", F.unix_micros("w.start").alias("start_us"), "n", "fps", "infer_fps", "most_cached", "least_buffered_ms", "paused")


def session_windows(messages: DataFrame, *, gap: str = "240 seconds") -> DataFrame:
    """Runs of messages of a client without a silence longer than the gap."""
    by = messages.withWatermark("at", "1 minute").groupBy(F.session_window("at", gap).alias("w"), F.col("session_id"))
    return by.agg(F.count("*").alias("n")).select(F.col("session_id").alias("client"), F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("stop_us"), "n")


def stats_sink(samples: DataFrame) -> DataFrame:
    """Snapshots of sessions that are neither closed nor without a pipeline, appended as they come."""
    return samples.where("event_type <> 'error' AND k % 10 <> 9").select(F.col("user_id").alias("session_id"), "ts_us", "value")


def _connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_stream(spark, sf_dir).select(F.concat(F.lit("10.0.0."), (F.col("user_id") % 50).cast("string")).alias("ip"), "ts_us", "at")


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of all sessions as a stream of files."""
    at = shared_folder(spark, "logs")
    write_log(view(spark, sf_dir, "v_samples"), at)
    return spark.readStream.text(at)


QUERIES.update(
    {
        "epoch_guard": lambda s, d: drained(lifecycle.epoch_guard(packet_stream(s, d))).where("session_id >= 0"),
        "fps_anchored": lambda s, d: drained(lifecycle.fps_anchored(packet_stream(s, d))),
        "backpressure_stream": lambda s, d: drained(lifecycle.backpressure(message_stream(s, d))),
        "first_seen_stream": lambda s, d: drained(first_seen(_connections(s, d))),
        "fps_window_stream": lambda s, d: drained(fps_window(packet_stream(s, d))),
        "stats_rollup": lambda s, d: drained(stats_rollup(_log_lines(s, d)), mode="complete"),
        "seek_first_packet_stream": lambda s, d: drained(lifecycle.seek_first_packet(seeks_of(p := packet_stream(s, d)), p)).where("session_id >= 0"),
        "seek_ticks_stream": lambda s, d: drained(lifecycle.seek_ticks(packet_stream(s, d))),
        "open_inactivity_stream": lambda s, d: drained(session_windows(open_stream(s, d))).where("client >= 0"),
        "inactivity_alarm": lambda s, d: drained(lifecycle.inactivity_alarm(open_stream(s, d))).where("session_id >= 0"),
        "sink_stats_stream": lambda s, d: drained(stats_sink(event_stream(s, d))),
    }
)

#: Jobs whose result doesn't depend on how far a watermark came: the clock closes all windows, or they are drained in complete mode.
ORACLES.update(
    {
        "epoch_guard": ansi_with(("v_packets",))
        + """ SELECT session_id, seq, epoch FROM (SELECT *, coalesce(max(CASE WHEN is_seek THEN epoch END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS cur FROM v_packets) WHERE epoch >= cur""",
        "backpressure_stream": ORACLES["backpressure"],
        "seek_first_packet_stream": ORACLES["seek_first_packet"],
        "seek_ticks_stream": ORACLES["seek_ticks"],
        "inactivity_alarm": ansi_with(("v_opens",))
        + """ SELECT client AS session_id, event_id AS seq, ts_us AS since_us FROM (SELECT *, lead(ts_us) OVER (PARTITION BY client ORDER BY ts_us, event_id) - ts_us AS gap FROM v_opens) WHERE gap IS NULL OR gap > 240000000""",
        "fps_window_stream": ansi_with(("v_packets",))
        + """ SELECT session_id, ts_us // 2000000 * 2000000 AS start_us, count(*) AS frames FROM v_packets WHERE kind = 'video' GROUP BY 1, 2""",
        "stats_rollup": ansi_with(("v_samples",))
        + f""", p AS (SELECT ts_us, {STATS_SQL} FROM v_samples WHERE event_id % 20 > 5), w AS (SELECT *, unnest([0, 1]) AS back FROM p)
 SELECT session, (ts_us // 1000 * 1000 // 30000000 - back) * 30000000 AS start_us, count(*) AS n, round(avg(fps), 6) AS fps, round(avg(infer_fps), 6) AS infer_fps, max(in_flight) AS most_cached, min(buffered_ms) AS least_buffered_ms,
 count(*) FILTER (WHERE pacing = 'PAUSED') AS paused FROM w GROUP BY 1, 2""",
        "open_inactivity_stream": ansi_with(("v_opens",))
        + """, g AS (SELECT client, ts_us AS us, coalesce(ts_us - lag(ts_us) OVER w >= 240000000, true) AS fresh FROM v_opens WINDOW w AS (PARTITION BY client ORDER BY ts_us, event_id)),
 r AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY client ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT * FROM g ORDER BY client, us, NOT fresh))
 SELECT client, min(us) AS start_us, max(us) + 240000000 AS stop_us, count(*) AS n FROM r GROUP BY client, run""",
        "sink_stats_stream": ansi_with(("v_events",)) + " SELECT user_id AS session_id, epoch_us(ts) AS ts_us, value FROM v_events WHERE event_type <> 'error' AND k % 10 <> 9",
    }
)
