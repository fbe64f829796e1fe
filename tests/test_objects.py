"""The object store under failures and side by side runs; sketches; requests; sinks that refuse."""

import hashlib
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reelframe.operators.attachments import authorized_objects
from reelframe.operators.sessions import client_sketches, clients_over
from reelframe.sources.objects import read_store, sink_object_store


def bodies(spark, n, *, spoilt=()):
    rows = [(hashlib.sha256(b"body %d" % k).hexdigest(), len(b"body %d" % k) + (k in spoilt), b"body %d" % k) for k in range(n)]
    return spark.createDataFrame(rows, "sha256 string, size long, data binary").repartition(6)


def files(folder):
    return sorted(p.name for p in Path(folder).rglob("*") if p.is_file() and not p.name.startswith("."))


def test_runs_side_by_side_publish_each_hash_once(spark, tmp_path):
    at, df = str(tmp_path / "store"), bodies(spark, 60, spoilt={3, 4})

    def run():
        own = bodies(spark, 60, spoilt={3, 4})  # made here, so that this thread has a session
        sink_object_store(own.unionByName(own), at)

    threads = [threading.Thread(target=run) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    want = sorted(hashlib.sha256(b"body %d" % k).hexdigest() for k in range(60) if k not in (3, 4))
    assert files(at) == want and sorted(r.sha256 for r in read_store(spark, at).collect()) == want
    assert all(hashlib.sha256(p.read_bytes()).hexdigest() == p.name for p in (tmp_path / "store").rglob("*") if p.is_file() and not p.name.startswith("."))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*") if p.is_file()}
    assert sink_object_store(df, at, store=read_store(spark, at)).count() == 58
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*") if p.is_file()} == before


def test_a_failed_run_leaves_whole_objects(spark, tmp_path):
    at = str(tmp_path / "store")
    fails = F.when(F.col("size") > 6, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("data"))
    with pytest.raises(Exception, match="lost"):
        sink_object_store(bodies(spark, 40).withColumn("data", fails), at)
    assert all(hashlib.sha256(p.read_bytes()).hexdigest() == p.name for p in Path(at).rglob("*") if p.is_file() and not p.name.startswith("."))
    assert sink_object_store(bodies(spark, 40), at).count() == 40 and len(files(at)) == 40
    with pytest.raises(Exception, match="appended"):
        bodies(spark, 1).write.format("object_store").mode("overwrite").save(at)


def test_sketches_of_hours_merge(spark):
    hour = 3_600_000_000
    rows = spark.range(200_000).select(F.concat(F.lit("10."), F.col("id") % 40_000).alias("ip"), (F.col("id") % 48 * hour + 5).alias("ts_us"))
    sketches = client_sketches(rows)
    assert sketches.count() == 48 and sketches.agg(F.max(F.length("sketch"))).first()[0] < 20_000
    for every in (1, 24, 48):
        for r in clients_over(sketches, every_h=every).collect():
            inside = rows.where((F.col("ts_us") >= r.start_h * hour) & (F.col("ts_us") < (r.start_h + every) * hour)).agg(F.countDistinct("ip"), F.count("*")).first() if every > 1 or r.start_h in (0, 47) else None
            if inside:
                assert abs(r.clients - inside[0]) <= 0.03 * inside[0] and r.n == inside[1]


def test_requests_of_every_kind(spark):
    good, other = "a" * 64, "b" * 64
    sessions = spark.createDataFrame([("s1", "t1", "playing"), ("s2", "t2", "closed"), ("s3", "t3", "open")], "session_id string, token string, state string")
    manifest = spark.createDataFrame([("s1", good, 1), ("s2", good, 1), ("s3", other, 1)], "session_id string, sha256 string, pos long")
    cases = [(None, good, 401), ("Basic t1", good, 401), ("Bearer t1", "short", 404), ("Bearer nobody", "short", 404), ("Bearer t1", None, 404), ("Bearer nobody", good, 401), ("Bearer t2", good, 401), ("Bearer t3", good, 404), ("Bearer  t1 ", good.upper(), 200)]
    requests = spark.createDataFrame([(k, a, d) for k, (a, d, _) in enumerate(cases)], "pos long, auth string, digest string")
    assert {r.pos: r.status for r in authorized_objects(requests, sessions, manifest).collect()} == {k: s for k, (_, _, s) in enumerate(cases)}
