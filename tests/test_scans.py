"""Segmented scans and dyadic intervals against plain loops."""

import random
import statistics

from pyspark.sql import functions as F

from reelframe.functions.intervals import cells, stab
from reelframe.functions.scan import running, segments
from reelframe.operators import attachments, seeks


def test_running_values_over_segments(spark):
    rng = random.Random(1)
    keys = ["hot"] * 5 + ["a", "b", None]
    rows = [(rng.choice(keys), rng.randrange(400), k, rng.choice([None, rng.randrange(-50, 50)])) for k in range(3000)]
    df = spark.createDataFrame(rows, "key string, at long, id long, x long").repartition(5)
    values = {"total": ("sum", F.col("x")), "n": ("sum", F.lit(1).cast("long")), "top": ("max", F.col("x")), "last": ("last", F.col("x"))}
    found = running(df, ["key"], [F.desc("at"), "id"], values, count=13).collect()
    want, state = {}, {}
    for key, _, i, x in sorted(rows, key=lambda r: (-r[1], r[2])):
        total, n, top, last = state.get(key, (None, 0, None, None))
        if x is not None:
            total, top, last = (total or 0) + x, x if top is None else max(top, x), x
        state[key] = want[i] = total, n + 1, top, last
    assert len(found) == len(rows) and {r.id: (r.total, r.n, r.top, r["last"]) for r in found} == want
    assert running(df.where("false"), ["key"], ["at"], values).collect() == []


def test_a_hot_store_is_scanned_by_many_tasks(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 500)).alias("store"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"), (F.col("id") * 7919 % 1000).alias("mtime"), F.lit(10).cast("long").alias("size"))
    parts = segments(rows, ["store"], ["mtime", "size", "sha256"], count=24)
    sizes = [r["count"] for r in parts.groupBy("segment", "store").count().where("store = 'hot'").collect()]
    every = [r["count"] for r in parts.groupBy("segment").count().collect()]
    assert len(sizes) >= 6 and max(every) <= 2 * statistics.median(every)
    gone = attachments.lru_evict(rows.withColumn("protected", F.col("mtime") == 5), limit_bytes=100_000)
    assert gone.where("store = 'hot'").count() == 10_000  # 200 kB, of which 100 kB may stay
    assert gone.where("store <> 'hot'").count() == 0


def test_as_of_join_of_a_hot_key(spark):
    rng = random.Random(2)
    left = [(rng.choice("aab"), rng.randrange(300), k) for k in range(800)]
    right = [(rng.choice("aab"), rng.randrange(300), k) for k in range(200)]
    a, b = spark.createDataFrame(left, "key string, at long, id long"), spark.createDataFrame(right, "key string, t long, v long")
    plain = {tuple(r) for r in seeks.asof(a, b, "key", "at", "t", ["v"], ties=["v"]).collect()}
    assert {tuple(r) for r in seeks.asof(a, b, "key", "at", "t", ["v"], ties=["v"], segmented=True).collect()} == plain
    assert plain == {(k, t, i, max(((u, v) for x, u, v in right if x == k and u <= t), default=(0, None))[1]) for k, t, i in left}


def test_cells_of_intervals(spark):
    rng = random.Random(3)
    bounds = [(rng.randrange(-1000, 1000), rng.randrange(0, 1 << rng.randrange(1, 30))) for _ in range(300)] + [(0, 0), (-1, 1), (7, -1), (5, -9), (-(1 << 40), 1 << 41)]
    rows = spark.createDataFrame([(a, a + n) for a, n in bounds], "a long, b long").select("a", "b", cells(F.col("a"), F.col("b")).alias("c")).collect()
    for r in rows:
        spans = sorted((c.cell << c.level, ((c.cell + 1) << c.level) - 1) for c in r.c)
        assert len(spans) <= 2 * max(1, (r.b - r.a + 2).bit_length())
        if r.a > r.b:
            assert not spans
        else:
            assert spans[0][0] == r.a and spans[-1][1] == r.b and all(x[1] + 1 == y[0] for x, y in zip(spans, spans[1:]))  # exactly the interval, no cell twice


def test_stabbing(spark):
    rng = random.Random(4)
    events = [(rng.choice("xy"), k, a, a + rng.choice([-1, 0, 3, 500, 10**7])) for k, a in ((k, rng.randrange(-2000, 2000)) for k in range(200))] + [(None, 900, 0, 9), ("x", 901, None, 5)]
    points = [(rng.choice("xyz"), k, rng.randrange(-2500, 2500)) for k in range(200)] + [(None, 900, 1), ("x", 901, None)]
    found = stab(spark.createDataFrame(points, "k string, p long, at long"), spark.createDataFrame(events, "k string, e long, a long, b long"), "k", "at", "a", "b").select("p", "e").collect()
    want = [(p, e) for k, p, t in points for x, e, a, b in events if k == x and None not in (k, t, a, b) and a <= t <= b]
    assert sorted(map(tuple, found)) == sorted(want) and want
