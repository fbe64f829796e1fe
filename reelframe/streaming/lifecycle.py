"""Streams with a life cycle: state that ends with its session, timers that fire while nothing arrives, and a join of two streams.

Lateness is defined by epochs: a seek raises a session's epoch, and packets of an older one are dropped wherever they appear.  Watermarks bound
state: a session that stays silent for `idle_s`, or that is closed, leaves nothing behind, and comes back as a new one.  Rows of a micro-batch
are taken in the order of their times, so results don't depend on where batches are cut, as long as batches themselves come in order; rows behind the watermark are dropped.  A filter before the watermark, or one that Catalyst may move there, would hold time still
while nothing passes it: filters here name the watermark's column.

Inputs have the columns session_id, seq, epoch, is_seek, ts_us and `at` (the timestamp that watermarks take); `is_video` and `closed` where a job needs them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Progress ticks of a seek: the first, their distance, and the last time one may have (milliseconds after the seek).
TICK_FIRST, TICK_EVERY, TICK_LAST = 750, 500, 60_000


def _ordered(rows: Iterator[pd.DataFrame], *more: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(["ts_us", *more, "seq"], kind="stable")


class _Session(StatefulProcessor):
    """One value of state a session, cleared when the session is closed or has been silent for `idle_s` of event time."""

    schema = ""

    def __init__(self, idle_s: float):
        self.idle_ms = int(idle_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", self.schema)

    def keep(self, value: tuple | None, rows: pd.DataFrame) -> None:
        """Put the value down until the session is idle; without one, or where it was closed last, forget it."""
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if value is None or ("closed" in rows and bool(rows["closed"].iloc[-1])):
            self.state.clear()
        else:
            self.state.update(value)
            self.handle.registerTimer(int(rows["ts_us"].max()) // 1000 + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _by_session(rows: DataFrame, late: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    return rows.withWatermark("at", late).groupBy("session_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="EventTime")


class _EpochGuard(_Session):
    schema = "epoch long"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = _ordered(rows)
        held = self.state.get() if self.state.exists() else (0,)
        current = rows["epoch"].where(rows["is_seek"]).cummax().ffill().fillna(0).clip(lower=held[0])
        self.keep((int(current.iloc[-1]),), rows)
        yield rows[rows["epoch"] >= current][["session_id", "seq", "epoch"]]


def epoch_guard(packets: DataFrame, *, idle_s: float = 1800, late: str = "10 seconds") -> DataFrame:
    """Packets that are not older than their session's epoch when they arrive; state is one number a live session."""
    return _by_session(packets, late, _EpochGuard(idle_s), "session_id long, seq long, epoch long")


class _Anchored(_Session):
    schema = "start_us long, n long"

    def __init__(self, idle_s: float, min_s: float):
        super().__init__(idle_s)
        self.min_us = min_s * 1e6

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = _ordered(rows)
        start, n = self.state.get() if self.state.exists() else (-1, 0)
        out = []
        for t in rows["ts_us"][rows["is_video"]].tolist():
            start = t if n == 0 else start
            n += 1
            if t - start >= self.min_us:
                out.append((key[0], start, n / ((t - start) / 1e6)))
                n = 0
        self.keep((start, n) if n else None, rows)
        yield pd.DataFrame(out, columns=["session_id", "start_us", "fps"])


def fps_anchored(packets: DataFrame, *, min_s: float = 2.0, idle_s: float = 60, late: str = "10 seconds") -> DataFrame:
    """Frame rate in windows that begin at a session's first frame and close at the first frame `min_s` later or more; a window that stays open for `idle_s` is forgotten."""
    return _by_session(packets, late, _Anchored(idle_s, min_s), "session_id long, start_us long, fps double")


class _Backpressure(_Session):
    schema = "buffered_ms long, playing boolean, report_us long, paused boolean"

    def __init__(self, idle_s: float, high: int, resume: int):
        super().__init__(idle_s)
        self.high, self.resume = high, resume

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = _ordered(rows, "is_packet")  # reports of an instant come before its packets
        level, playing, since, paused = self.state.get() if self.state.exists() else (0, False, -1, False)
        out = []
        columns = (rows[c].tolist() for c in ("ts_us", "seq", "is_packet", "buffered_ms", "playing"))
        for at, seq, is_packet, buffered, plays in zip(*columns, strict=True):
            if not is_packet:
                if at != since or (buffered, plays) < (level, playing):  # of reports of an instant the least counts
                    level, playing, since = int(buffered), bool(plays), at
                continue
            if since >= 0:
                estimate = level - ((at - since) // 1000 if playing else 0)
                now = True if estimate > self.high else False if estimate <= self.resume else paused
                if now != paused:
                    out.append((key[0], seq, at, now))
                paused = now
        self.keep((level, playing, since, paused), rows)
        yield pd.DataFrame(out, columns=["session_id", "seq", "ts_us", "paused"])


def backpressure(messages: DataFrame, *, high: int = 10_000, resume: int = 9_500, idle_s: float = 1800, late: str = "10 seconds") -> DataFrame:
    """Pauses and resumptions at packets, as the decayed buffer estimate crosses the two thresholds.

    `messages` has packets (is_packet) and buffer reports (buffered_ms, playing); a seek is a report of 0 beside its packet.
    """
    return _by_session(messages, late, _Backpressure(idle_s, high, resume), "session_id long, seq long, ts_us long, paused boolean")


class _Ticks(StatefulProcessor):
    """The seek that a session waits for: told by ticks until its packet, a newer seek or the end of the session."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seek", "seek_seq long, seek_us long, epoch long, tick_ms long")

    def _due(self, key: tuple, until_us: int) -> list[tuple]:
        """Ticks before an instant; the one after the last says that the seek is given up, and ends it."""
        if not self.state.exists():
            return []
        seq, began, epoch, tick = self.state.get()
        out = []
        while began + tick * 1000 < until_us:
            out.append((key[0], seq, tick, tick > TICK_LAST))
            tick += TICK_EVERY
            if out[-1][3]:
                self.state.clear()
                return out
        self.state.update((seq, began, epoch, tick))
        return out

    def _arm(self) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if self.state.exists():
            _, began, _, tick = self.state.get()
            self.handle.registerTimer(-(-(began + tick * 1000) // 1000) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows, out = _ordered(rows), []
        closed = rows["closed"].tolist() if "closed" in rows else [False] * len(rows)
        for at, seq, epoch, is_seek, ends in zip(rows["ts_us"].tolist(), rows["seq"].tolist(), rows["epoch"].tolist(), rows["is_seek"].tolist(), closed, strict=True):
            out += self._due(key, at)
            if ends:
                self.state.clear()
            elif is_seek:
                self.state.update((seq, at, epoch, TICK_FIRST))
            elif self.state.exists() and epoch >= self.state.get()[2]:
                self.state.clear()
        self._arm()
        yield pd.DataFrame(out, columns=["session_id", "seek_seq", "tick_ms", "gave_up"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._due(key, timerValues.getCurrentWatermarkInMs() * 1000)
        self._arm()
        yield pd.DataFrame(out, columns=["session_id", "seek_seq", "tick_ms", "gave_up"])

    def close(self) -> None:
        pass


def seek_ticks(packets: DataFrame, *, late: str = "1 second") -> DataFrame:
    """Progress ticks of slow seeks while nothing arrives: every 500 ms from 750 ms on, until a packet of the epoch, a newer seek or the end of the session; the tick after a minute gives the seek up.

    Timers follow the watermark, so a tick comes `late` after its time at the latest, as long as any session's packets arrive.  Only sessions that wait have state.
    """
    return _by_session(packets, late, _Ticks(), "session_id long, seek_seq long, tick_ms long, gave_up boolean")


class _Inactivity(_Session):
    schema = "last_us long, seq long"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = _ordered(rows)
        out = []
        last = self.state.get() if self.state.exists() else None
        for at, seq in zip(rows["ts_us"].tolist(), rows["seq"].tolist(), strict=True):
            if last is not None and at - last[0] > self.idle_ms * 1000:
                out.append((key[0], last[1], last[0]))
            last = at, seq
        self.keep(last, rows)
        yield pd.DataFrame(out, columns=["session_id", "seq", "since_us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, seq = self.state.get()
        self.state.clear()
        yield pd.DataFrame([(key[0], seq, last)], columns=["session_id", "seq", "since_us"])


def inactivity_alarm(messages: DataFrame, *, gap_s: float = 240, late: str = "10 seconds") -> DataFrame:
    """An alarm for every silence of more than `gap_s`, told during the silence: the last message before it.  A closed session is silent for good and raises none."""
    return _by_session(messages, late, _Inactivity(gap_s), "session_id long, seq long, since_us long")


def seek_first_packet(seeks: DataFrame, packets: DataFrame, *, within_s: int = 60, late: str = "10 seconds") -> DataFrame:
    """(session_id, seek_seq, latency_us): time from each seek to the first packet of its epoch or a later one; null, the alarm, where none comes within `within_s`.

    A left outer join of two streams by session and a range of times: both sides forget rows once no partner can come, and the null side is told as the
    watermark passes the end of the range.  Seeks have seek_seq, seek_us and seek_at, packets ts_us and at.
    """
    left = seeks.withWatermark("seek_at", late).alias("s")
    right = packets.withWatermark("at", late).where(F.when(~F.col("is_seek"), F.col("at")).isNotNull()).alias("p")
    met = F.expr(f"s.session_id = p.session_id AND p.epoch >= s.epoch AND p.at >= s.seek_at AND p.at <= s.seek_at + INTERVAL {within_s} SECONDS")
    joined = left.join(right, met, "leftOuter").select("s.session_id", "s.seek_seq", "s.seek_us", "s.seek_at", "p.ts_us")
    first = joined.groupBy(F.window("seek_at", "1 second"), "session_id", "seek_seq", "seek_us").agg(F.min("ts_us").alias("first_us"))
    return first.select("session_id", "seek_seq", (F.col("first_us") - F.col("seek_us")).alias("latency_us"))
