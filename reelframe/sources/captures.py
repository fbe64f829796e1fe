"""Packet captures of any size: a data source that reads a file by byte ranges, and a stream of growing files.

A capture is a run of packets, each a head and a payload, perhaps behind the handshake of its connection.  Nothing in it marks where a packet begins, so
a task that is given a range finds the first head in it by what heads look like: a chain of plausible heads, one at the end of the other.  The guess is
proved afterwards: `scan_packets` first learns only where each range begins and ends, takes a file by ranges only where each ends at the very head that the next one
begins with, and reads other files (a payload that holds captures itself can mislead a range) from the front.

Files are opened by pyarrow's file systems: local paths and file, s3, gs and hdfs addresses.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from reelframe.session import shared_folder
from reelframe.sources.listing import listing, located, tasks_for

# Head of a packet, little-endian (payload length, flags, epoch, pts, dts), the stamp that means none, and the handshake before the first packet.
HEADER, NO_STAMP = struct.Struct("<IBIqq"), -(2**63)
MAGIC, HANDSHAKE, DIRECTIONS = b"UPRLY1", 41, (1, 2)

#: Bytes of a range, bytes read at once, heads that a chain must have, and the longest payload and highest flags that a head may state to be guessed at.
CHUNK, READ, CHAIN = 64 << 20, 1 << 20, 8
#: Bytes of the ranges that share a task, about.
TASK = 32 << 20
LIKELY_SIZE, LIKELY_FLAGS = 1 << 26, 7
COLUMNS = "path string, split int, place long, at long, next long, size long, flags long, epoch long, pts long, dts long, corrupt boolean, payload binary"
_TYPES = [pa.string(), pa.int32(), *[pa.int64()] * 8, pa.bool_(), pa.binary()]
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def listed(address: str) -> list[tuple[str, int]]:
    """Captures at an address (a file, or all files below a folder) and their lengths; names that begin with . or _ are no captures."""
    system, path = located(address)
    info = system.get_file_info(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((x.path, x.size) for x in found if x.is_file and not x.base_name.startswith((".", "_")))


class Bytes:
    """A file as bytes at any place, read a block at a time."""

    def __init__(self, system: fs.FileSystem, path: str, length: int):
        self.file, self.length, self.begin, self.held = system.open_input_file(path), length, 0, b""

    def read(self, at: int, n: int) -> bytes:
        """n bytes, or as many as there are."""
        n = min(n, self.length - at)
        if n <= 0:
            return b""
        if at < self.begin or at + n > self.begin + len(self.held):
            self.file.seek(at)
            self.begin, self.held = at, self.file.read(min(max(n, READ), self.length - at))
        return self.held[at - self.begin : at - self.begin + n]

    def first_head(self) -> int:
        start = self.read(0, HANDSHAKE)
        return HANDSHAKE if len(start) == HANDSHAKE and start.startswith(MAGIC) and start[len(MAGIC)] in DIRECTIONS else 0

    def chained(self, at: int) -> bool:
        """Whether a chain of likely heads begins here: CHAIN of them, or as many as lead to the end of the file or past it."""
        for _ in range(CHAIN):
            head = self.read(at, HEADER.size)
            if len(head) < HEADER.size:
                return True
            n, flags, *_ = HEADER.unpack(head)
            if n > LIKELY_SIZE or flags > LIKELY_FLAGS:
                return False
            at += HEADER.size + n
        return True

    def next_head(self, at: int, stop: int) -> int:
        """The first place from `at` on where a chain of heads begins; `stop` if none lies before it."""
        while at < stop:
            raw = np.frombuffer(self.read(at, READ), np.uint8)
            n = min(len(raw) - HEADER.size + 1, stop - at)
            if n <= 0:
                return stop
            size = raw[: n + 3].astype(np.uint32)
            size = size[:n] | size[1 : n + 1] << 8 | size[2 : n + 2] << 16 | size[3 : n + 3] << 24
            for k in np.flatnonzero((raw[4 : n + 4] <= LIKELY_FLAGS) & (size <= LIKELY_SIZE)).tolist():
                if self.chained(at + k):
                    return at + k
            at += n
        return stop

    def packets(self, at: int, stop: int, payload: bool) -> Iterator[tuple]:
        """(at, next, size, flags, epoch, pts, dts, corrupt, payload) of each packet whose head lies before `stop`; a packet that is cut off is the last and corrupt."""
        while at < stop:
            head = self.read(at, HEADER.size)
            n, flags, epoch, pts, dts = HEADER.unpack(head) if len(head) == HEADER.size else (self.length, 0, 0, 0, 0)
            end = at + HEADER.size + n
            if end > self.length:
                yield at, self.length, None, None, None, None, None, True, None
                return
            yield at, end, n, flags, epoch, None if pts == NO_STAMP else pts, None if dts == NO_STAMP else dts, False, self.read(at + HEADER.size, n) if payload else None
            at = end


def batches(path: str, split: int, rows: Iterator[tuple], before: int = 0, *, most: int = 65_536, most_bytes: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    held, size, place = [], 0, before

    def batch() -> pa.RecordBatch:
        columns = list(zip(*held, strict=True))
        front = [pa.array([path] * len(held)), pa.array([split] * len(held), pa.int32()), pa.array(range(place - len(held) + 1, place + 1), pa.int64())]
        return pa.RecordBatch.from_arrays([*front, *(pa.array(c, k) for c, k in zip(columns, _TYPES[3:], strict=True))], _NAMES)

    for row in rows:
        held.append(row)
        place += 1
        size += len(row[-1] or b"")
        if len(held) >= most or size >= most_bytes:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


@dataclass
class Ranges(InputPartition):
    """Byte ranges (path, split, start, stop, length) of one task."""

    ranges: list[tuple[str, int, int, int, int]]


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.address, self.chunk = options["path"], int(options.get("chunkbytes", CHUNK))
        self.payload = options.get("payload", "false").lower() == "true"

    def partitions(self) -> list[Ranges]:
        """Ranges of at most `chunkBytes`; small files share a task."""
        out, held, size = [], [], 0
        for path, length in listed(self.address):
            for split, start in enumerate(range(0, length, self.chunk)):
                stop = min(start + self.chunk, length)
                if held and size + stop - start > self.chunk:
                    out.append(Ranges(held))
                    held, size = [], 0
                held.append((path, split, start, stop, length))
                size += stop - start
        return out + [Ranges(held)] if held else out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = located(self.address)
        for path, split, start, stop, length in partition.ranges:
            data = Bytes(system, path, length)
            yield from batches(path, split, data.packets(data.first_head() if start == 0 else data.next_head(start, stop), stop, self.payload))


class CaptureStream(DataSourceStreamReader):
    """Growing captures: an offset says for each file how many of its bytes hold whole packets."""

    def __init__(self, options: dict[str, str]):
        self.address, self.payload = options["path"], options.get("payload", "false").lower() == "true"
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Up to the last whole packet of each file: only heads that are new since the last call are looked at."""
        system, _ = located(self.address)
        for path, length in listed(self.address):
            at = self.known.get(path, 0)
            if length > at:
                data = Bytes(system, path, length)
                for _, end, *_, corrupt, _ in data.packets(at or data.first_head(), length, False):
                    if not corrupt:
                        at = end
                self.known[path] = at
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        return [Ranges([(path, 0, start.get(path, 0), stop, stop)]) for path, stop in sorted(end.items()) if stop > start.get(path, 0)] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = located(self.address)
        for path, split, start, stop, length in partition.ranges:
            data = Bytes(system, path, length)
            yield from batches(path, split, data.packets(start or data.first_head(), stop, self.payload))

    def commit(self, end: dict) -> None:
        pass


class PacketCaptures(DataSource):
    """spark.read.format("packet_captures"): options path, chunkBytes and payload (true: with the payloads' bytes)."""

    @classmethod
    def name(cls) -> str:
        return "packet_captures"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(dict(self.options))

    def streamReader(self, schema) -> CaptureStream:
        return CaptureStream(dict(self.options))


RANGES = "path string, split int, start long, stop long, length long, first long, last long, n long"


def _ends(address: str):
    """A function of batches of ranges: where the first head of each lies, where its last packet ends, and its number of packets."""

    def run(ranges: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = located(address)
        for batch in ranges:
            told = []
            for path, split, start, stop, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = Bytes(system, path, length)
                first = last = data.first_head() if start == 0 else data.next_head(start, stop)
                n = 0
                for _, last, *_ in data.packets(first, stop, False):  # noqa: B007
                    n += 1
                told.append((first, last, n))
            if told:
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in zip(*told, strict=True))], [*batch.schema.names, "first", "last", "n"])

    return run


def _rows_of(address: str, payload: bool):
    """A function of batches of ranges with their first heads (none: the front of a file): their packets, numbered on from `before`."""

    def run(ranges: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = located(address)
        for batch in ranges:
            for path, split, stop, length, first, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = Bytes(system, path, length)
                yield from batches(path, split, data.packets(data.first_head() if first is None else first, stop, payload), before)

    return run


def scan_packets(spark: SparkSession, address: str, *, chunk_bytes: int = CHUNK, payload: bool = False) -> DataFrame:
    """path, seq (from 1), at (the head's byte), size, flags, epoch, pts, dts, corrupt and payload of every packet of the captures at an address.

    Large files are read by many tasks, and many small files by one; a handshake before the first packet is skipped; a file cut off within a packet gives a last
    row marked corrupt.  The rows are those of a reader that goes through each file from the front, whatever the payloads hold.  Files are listed, cut into ranges
    and proved as tables of ranges, so neither the driver holds them nor are packets ever joined with them.
    """
    files = listing(spark, address, hidden_folders=True).where("length > 0 AND NOT startswith(regexp_extract(path, '[^/]*$', 0), '_')")
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(chunk_bytes).cast("long"))).alias("start")
    ranges = files.select("path", "length", cut).select("path", F.expr(f"CAST(start DIV {chunk_bytes} AS INT)").alias("split"), "start", F.least(F.col("start") + chunk_bytes, "length").alias("stop"), "length")
    count, total = ranges.agg(F.count("*"), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()
    tasks = max(1, min(count, max(tasks_for(spark, count), total // TASK)))
    told = shared_folder(spark, "ranges")
    ranges.repartition(tasks).mapInArrow(_ends(address), RANGES).write.parquet(told)
    parts = spark.read.schema(RANGES).parquet(told).where("n > 0")
    order = W.partitionBy("path").orderBy("split")
    joins = F.coalesce(F.lag("last").over(order) == F.col("first"), F.col("split") == 0)
    parts = parts.withColumn("joins", joins).withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.withColumn("proved", F.min("joins").over(W.partitionBy("path")))
    known = ["path", "split", "stop", "length", "first", "before"]
    whole = parts.where("NOT proved").select("path", "length").distinct().select("path", F.lit(0).alias("split"), F.col("length").alias("stop"), "length", F.lit(None).cast("long").alias("first"), F.lit(0).cast("long").alias("before"))
    rows = parts.where("proved").select(*known).unionByName(whole).repartition(tasks).mapInArrow(_rows_of(address, payload), COLUMNS)
    return rows.select("path", F.col("place").alias("seq"), "at", "size", "flags", "epoch", "pts", "dts", "corrupt", "payload")


def packet_stream(spark: SparkSession, address: str, *, payload: bool = False) -> DataFrame:
    """The packets of captures that grow, as they are written: path, at, size, flags, epoch, pts, dts and payload; a packet is told once it is whole."""
    spark.dataSource.register(PacketCaptures)
    stream = spark.readStream.format("packet_captures").option("path", address).option("payload", str(payload).lower()).load()
    return stream.select("path", "at", "size", "flags", "epoch", "pts", "dts", "payload")


def packed(flags: int, epoch: int, pts: int | None, dts: int | None, payload: bytes) -> bytes:
    """A packet as bytes."""
    return HEADER.pack(len(payload), flags, epoch, NO_STAMP if pts is None else pts, NO_STAMP if dts is None else dts) + payload


def write_captures(packets: DataFrame, address: str, *, block: int = 1_000_000, payload: Column | None = None) -> DataFrame:
    """Write packets (session_id, seq, flags, epoch, pts, dts, payload) as captures <session>-<block>.cap of at most `block` packets; returns path and n of what was written.

    A `payload` that is given is made of the packets' columns once they are in their place, so that it isn't shuffled.

    A file appears whole, under its name, when its last packet is written, so a task that is run again replaces it.  The first block of a
    session begins with a handshake.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = located(address)
        system.create_dir(folder, recursive=True)
        name, out, temporary, n, told = None, None, "", 0, []

        def close() -> None:
            if out is not None:
                out.close()
                system.move(temporary, f"{folder}/{name}")
                told.append((name, n))

        for batch in parts:
            for row in batch.to_pylist():
                of = f"{row['session_id']}-{row['block']}.cap"
                if of != name:
                    close()
                    name, n, temporary = of, 0, f"{folder}/.{uuid.uuid4().hex}"
                    out = system.open_output_stream(temporary)
                    if row["block"] == 0:
                        out.write(MAGIC + bytes([DIRECTIONS[0]]) + b"0" * (HANDSHAKE - len(MAGIC) - 1))
                out.write(packed(row["flags"], row["epoch"], row["pts"], row["dts"], row["payload"] or b""))
                n += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in told], pa.string()), pa.array([x[1] for x in told], pa.int64())], ["path", "n"])

    rows = packets.withColumn("block", F.floor((F.col("seq") - 1) / block).cast("long")).repartition("session_id", "block").sortWithinPartitions("session_id", "block", "seq")
    body = F.col("payload") if payload is None else payload.alias("payload")
    return rows.select("session_id", "block", "seq", "flags", "epoch", "pts", "dts", body).mapInArrow(run, "path string, n long")
