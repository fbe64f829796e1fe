"""Streams fed batch by batch: late, missing and superseded packets, silence, closing, and what state is left."""

import pytest
from pyspark.sql import functions as F

from reelframe.operators import seeks as batch
from reelframe.session import shared_folder
from reelframe.streaming import lifecycle, sessions

S = 1_000_000
#: Streams begin here: a time of 0 is behind the first watermark.
BEGIN = 1_000 * S
KINDS = {"session_id": "long", "seq": "long", "epoch": "long", "is_seek": "boolean", "is_video": "boolean", "closed": "boolean", "ts_us": "long"}
SCHEMA = ", ".join(f"{k} {v}" for k, v in KINDS.items())


def row(session, seq, at_s, *, epoch=0, seek=False, closed=False):
    return (session, seq, epoch, seek, not seek, closed, BEGIN + int(at_s * S))


def clock(at_s):
    return row(-1, 0, at_s)


class Feed:
    """A job over a folder of files: each `push` is one micro-batch and the empty ones that its watermark brings."""

    def __init__(self, spark, job):
        self.spark, self.folder, self.base = spark, shared_folder(spark, "feed"), shared_folder(spark, "job")
        spark.createDataFrame([], SCHEMA).write.parquet(self.folder)
        self.out = job(spark.readStream.schema(SCHEMA).parquet(self.folder).withColumn("at", F.timestamp_micros("ts_us")))

    def push(self, *rows):
        setting = "spark.sql.streaming.stateStore.providerClass"
        before = self.spark.conf.get(setting)
        self.spark.conf.set(setting, sessions.STORE)
        try:
            self.spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)
            job = self.out.writeStream.format("parquet").option("checkpointLocation", f"{self.base}/checkpoint").trigger(availableNow=True).start(f"{self.base}/out")
            job.awaitTermination()
        finally:
            self.spark.conf.set(setting, before)
        return self.rows()

    def rows(self):
        return sorted((tuple(r) for r in self.spark.read.schema(self.out.schema).parquet(f"{self.base}/out").collect()), key=repr)

    def state(self, name):
        return self.spark.read.format("statestore").option("stateVarName", name).load(f"{self.base}/checkpoint").count()


def test_first_packet_as_a_join_of_two_streams(spark):
    feed = Feed(spark, lambda packets: lifecycle.seek_first_packet(sessions.seeks_of(packets), packets))
    first = [row(1, 1, 0), row(1, 2, 10, epoch=1, seek=True), row(2, 1, 10, epoch=1, seek=True), row(2, 2, 11, epoch=2, seek=True), row(3, 1, 12, epoch=1, seek=True), row(4, 1, 13, epoch=1, seek=True)]
    second = [row(1, 3, 10.5), row(1, 5, 14, epoch=1), row(2, 3, 13, epoch=2), row(3, 2, 73, epoch=1)]  # stale, fresh, of the newer seek, too late for the alarm
    late = [row(1, 4, 13.5, epoch=1), clock(20)]  # out of order, within the watermark's delay
    assert feed.push(*first) == []  # nothing is told before its time
    feed.push(*late)
    feed.push(*second)
    told = feed.push(clock(200))
    everything = spark.createDataFrame(first + late + second, SCHEMA)
    seeks = everything.where("is_seek").select("session_id", "epoch", F.col("seq").alias("seek_seq"), F.col("ts_us").alias("seek_us"))
    want = {tuple(r) for r in batch.seek_first_packet(seeks, everything).collect()}
    assert {r for r in told if r[0] > 0} == want == {(1, 2, 3_500_000), (2, 1, 3_000_000), (2, 2, 2_000_000), (3, 1, None), (4, 1, None)}
    # what comes behind the watermark is too late for a seek that was told
    assert {r for r in feed.push(row(4, 2, 20, epoch=1), clock(201)) if r[0] > 0} == want


def test_guard_forgets_silent_and_closed_sessions(spark):
    feed = Feed(spark, lambda packets: lifecycle.epoch_guard(packets, idle_s=60))
    feed.push(row(1, 1, 0), row(1, 2, 1, epoch=3, seek=True), row(1, 3, 2, epoch=2), row(2, 1, 2), row(3, 1, 2, epoch=1, seek=True))
    assert feed.state("session") == 3
    feed.push(row(1, 4, 3, epoch=2), row(1, 5, 3, epoch=3), row(2, 2, 4, closed=True))  # the epoch is kept from batch to batch
    assert feed.state("session") == 2
    feed.push(clock(200))
    feed.push(clock(201))
    assert feed.state("session") == 1  # the clock alone
    assert [r for r in feed.rows() if r[0] > 0] == [(1, 1, 0), (1, 2, 3), (1, 5, 3), (2, 1, 0), (2, 2, 0), (3, 1, 1)]


def test_ticks_while_nothing_arrives(spark):
    feed = Feed(spark, lifecycle.seek_ticks)
    feed.push(row(1, 1, 0, epoch=1, seek=True), row(2, 1, 0, epoch=1, seek=True), row(3, 1, 0, epoch=1, seek=True), row(4, 1, 0, epoch=1, seek=True))
    told = feed.push(clock(3.1))  # sessions stay silent, time goes on: two seconds of ticks
    assert told == [(s, 1, t, False) for s in (1, 2, 3, 4) for t in (1250, 1750, 750)]
    assert feed.state("seek") == 4
    told = feed.push(row(1, 2, 3.5), row(1, 3, 3.6, epoch=1), row(2, 2, 3.6, epoch=2, seek=True), row(3, 2, 3.6, closed=True))  # a stale and a fresh packet; a newer seek; the end
    of = lambda s, q=1: [t for x, k, t, gone in told if (x, k) == (s, q)]
    assert sorted(of(1)) == sorted(of(2)) == sorted(of(3)) == [750, 1250, 1750, 2250, 2750, 3250]
    feed.push(row(2, 3, 4.6, epoch=2))
    feed.push(clock(100))
    told = feed.push(clock(101))
    assert sorted(of(2, 2)) == [750] and len(of(1)) == 6 and len(of(3)) == 6
    assert sorted(of(4)) == list(range(750, 60_251, 500)) and [r for r in told if r[3]] == [(4, 1, 60_250, True)]
    assert feed.state("seek") == 0


def test_alarm_during_the_silence(spark):
    feed = Feed(spark, lambda m: lifecycle.inactivity_alarm(m, gap_s=240))
    feed.push(row(1, 1, 0), row(1, 2, 300), row(2, 1, 290), row(3, 1, 295, closed=True))
    assert [r for r in feed.rows() if r[0] > 0] == [(1, 1, BEGIN)]
    feed.push(clock(600))
    told = feed.push(clock(601))
    assert [r for r in told if r[0] > 0] == [(1, 1, BEGIN), (1, 2, BEGIN + 300 * S), (2, 1, BEGIN + 290 * S)]  # told though nothing came; the closed one is not
    assert feed.state("session") == 1


def test_rates_and_pauses_across_batches(spark):
    feed = Feed(spark, lambda p: lifecycle.fps_anchored(p, min_s=2, idle_s=30))
    feed.push(*(row(1, i, i * 0.1) for i in range(15)))
    feed.push(*(row(1, i, i * 0.1) for i in range(15, 40)))
    assert feed.rows() == [(1, BEGIN, pytest.approx(21 / 2))]
    feed.push(clock(100))
    feed.push(clock(101))
    assert feed.state("session") == 1


def test_a_mode_without_a_result(spark):
    with pytest.raises(ValueError, match="append or complete"):
        sessions.drained(spark.readStream.format("rate").load(), mode="update")
