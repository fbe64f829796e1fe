"""Captures read by ranges, against a reader that goes through the bytes from the front; captures that grow."""

import random

import pytest
from pyspark.sql import functions as F

from reelframe.sources import captures
from reelframe.sources.captures import HANDSHAKE, HEADER, MAGIC, NO_STAMP, packed


def packets_of(data):
    """(seq, at, size, flags, epoch, pts, dts, corrupt), the plain way."""
    at, out = HANDSHAKE if data.startswith(MAGIC) else 0, []
    while at < len(data):
        n, flags, epoch, pts, dts = HEADER.unpack_from(data, at) if at + HEADER.size <= len(data) else (len(data), 0, 0, 0, 0)
        if at + HEADER.size + n > len(data):
            out.append((len(out) + 1, at, None, None, None, None, None, True))
            break
        out.append((len(out) + 1, at, n, flags, epoch, None if pts == NO_STAMP else pts, None if dts == NO_STAMP else dts, False))
        at += HEADER.size + n
    return out


def capture(rng, n, payload):
    return b"".join(packed(rng.randrange(8), rng.randrange(4), rng.choice([None, rng.randrange(10**6)]), None, payload(rng)) for _ in range(n))


def noise(most):
    return lambda rng: rng.randbytes(rng.randrange(most))


def scanned(spark, folder, chunk):
    rows = captures.scan_packets(spark, str(folder), chunk_bytes=chunk).collect()
    found = {}
    for r in rows:
        found.setdefault(r.path.rsplit("/", 1)[1], []).append((r.seq, r["at"], r["size"], r.flags, r.epoch, r.pts, r.dts, r.corrupt))
    return {k: sorted(v) for k, v in found.items()}


def test_ranges_equal_a_reader_from_the_front(spark, tmp_path):
    rng = random.Random(5)
    hand = MAGIC + bytes([2]) + b"f" * 34
    inner = capture(rng, 60, noise(40))  # a payload that is a capture itself: its heads look right from anywhere
    files = {
        "plain": capture(rng, 3000, noise(300)),
        "handshake": hand + capture(rng, 200, noise(2000)),
        "cut": capture(rng, 300, noise(500))[:-7],
        "cut_head": capture(rng, 20, noise(500)) + b"\x01\x00",
        "large": capture(rng, 5, lambda r: r.randbytes(100_000)),  # packets longer than a range
        "zeros": capture(rng, 50, lambda r: bytes(r.randrange(5000))),
        "nested": capture(rng, 40, lambda r: r.choice([inner, r.randbytes(3000)])),
        "garbage": capture(rng, 100, noise(500)) + rng.randbytes(60_000) + capture(rng, 100, noise(500)),
        "empty": b"",
        "only_handshake": hand,
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "_SUCCESS").write_bytes(b"")
    want = {k: packets_of(v) for k, v in files.items() if packets_of(v)}
    for chunk in (4096, 30_000, 1 << 20):
        assert scanned(spark, tmp_path, chunk) == want, chunk


def test_one_capture_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(6)
    (tmp_path / "one.cap").write_bytes(capture(rng, 20_000, noise(1000)))
    spark.dataSource.register(captures.PacketCaptures)
    rows = spark.read.format("packet_captures").option("path", str(tmp_path)).option("chunkBytes", 1 << 20).load()
    by = rows.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert rows.rdd.getNumPartitions() == len(by) == 10 and max(r["count"] for r in by) < 3000


def test_payloads_and_addresses(spark, tmp_path):
    data = [b"", b"abc", bytes(range(256)) * 20]
    (tmp_path / "p").write_bytes(b"".join(packed(1, 0, k, k, x) for k, x in enumerate(data)))
    rows = captures.scan_packets(spark, f"file://{tmp_path}", payload=True).orderBy("seq").collect()
    assert [bytes(r.payload) for r in rows] == data
    with pytest.raises(ValueError, match="absolute"):
        captures.located("here/there")


def test_captures_that_grow(spark, tmp_path):
    """Whole packets are told once, whenever the file is looked at and wherever it ends then; also after the job was started again."""
    rng = random.Random(7)
    folder, base = tmp_path / "live", tmp_path / "job"
    folder.mkdir()
    whole = MAGIC + bytes([1]) + b"0" * 34 + capture(rng, 200, noise(300))

    def run():
        job = captures.packet_stream(spark, str(folder)).writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/out")
        job.awaitTermination()
        return sorted((r["at"], r["size"], r.flags, r.epoch, r.pts) for r in spark.read.parquet(f"{base}/out").collect())

    for cut in (9_001, 20_000, len(whole)):
        (folder / "a.cap").write_bytes(whole[:cut])
        want = [x[1:6] for x in packets_of(whole[:cut]) if not x[-1]]
        assert run() == want
    (folder / "b.cap").write_bytes(whole[:5000])
    assert len(run()) == 200 + sum(not x[-1] for x in packets_of(whole[:5000]))


def test_writing_again_replaces(spark, tmp_path):
    rows = [(s, k, k % 8, 1, None if k % 3 == 0 else k * 40, k, b"x" * (k % 50)) for s in (1, 2) for k in range(1, 101)]
    df = spark.createDataFrame(rows, "session_id long, seq long, flags int, epoch long, pts long, dts long, payload binary")
    for _ in range(2):
        assert {(r.path, r.n) for r in captures.write_captures(df, str(tmp_path), block=40).collect()} == {(f"{s}-{b}.cap", n) for s in (1, 2) for b, n in ((0, 40), (1, 40), (2, 20))}
    found = scanned(spark, tmp_path, 512)
    assert len(found) == 6 and [x[2:5] for x in found["2-1.cap"]] == [(k % 50, k % 8, 1) for k in range(41, 81)]


def test_small_captures_share_tasks(spark, tmp_path):
    """Many small files: no packet is joined with its file, a task takes many ranges, and the driver holds no list of files."""
    rng = random.Random(8)
    for k in range(400):
        (tmp_path / f"{k}.cap").write_bytes(capture(rng, 20, noise(600)))
    rows = captures.scan_packets(spark, str(tmp_path), chunk_bytes=4096)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "packet_captures" not in plan
    assert rows.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism
    want = {p.name: packets_of(p.read_bytes()) for p in tmp_path.iterdir()}
    assert scanned(spark, tmp_path, 4096) == want
