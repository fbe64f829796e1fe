"""Literal cases, and jobs against short sequential models."""


import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelframe.functions.exprs import infer_scale, safe_name
from reelframe.operators import attachments, catalog, chapters, frames, packets, seeks, sessions, sizes
from reelframe.plans.views import view
from reelframe.streaming import lifecycle
from reelframe.streaming import sessions as streams

FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.mark.parametrize(
    ("name", "scale"),
    [("2x_Clear", 2), ("realesr-x4plus", 4), ("conv3x3", 2), ("clip-1080x1920", 2), ("plain", 2), ("4xSharp", 4), ("net_x3_v2", 3)],
)
def test_scale_in_a_name(spark, name, scale):
    assert spark.createDataFrame([(name,)], "m string").select(infer_scale(F.col("m"))).first()[0] == scale


@pytest.mark.parametrize(("raw", "want"), [("a/b\\c.ttf", "c.ttf"), ("x\x01 y!!.otf", "x_y_.otf"), (" ._ ", "none"), (None, "none"), ("q" * 200, "q" * 128)])
def test_safe_name(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "n string").select(safe_name(F.col("n"), F.lit("none"))).first()[0] == want


def _sizes(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "size_id long, w long, h long, tw long, th long, align long")


def test_fit_and_cover_sizes(spark):
    df = _sizes(spark, [(1920, 1080, 2960, 1848, 2), (640, 480, 1920, 1080, 2), (1920, 800, 1280, 720, 2), (1280, 720, 1280, 720, 2)])
    assert [(r.out_w, r.out_h) for r in sizes.fit_dims(df).orderBy("size_id").collect()] == [(2960, 1664), (1440, 1080), (1280, 534), (1280, 720)]
    for s, r in zip(df.orderBy("size_id").collect(), sizes.cover_dims(df).orderBy("size_id").collect(), strict=True):
        assert r.out_w >= s.tw and r.out_h >= s.th


@FEW
@given(st.integers(1, 300), st.integers(1, 300))
def test_tiles_cover_a_frame_once(spark, w, h):
    df = spark.createDataFrame([(0, w, h)], "size_id long, w long, h long")
    seen = np.zeros((h, w), int)
    for t in sizes.tile_grid(df, tile=64, overlap=8).collect():
        seen[t.y0 + t.top : t.y0 + t.th - t.bottom, t.x0 + t.left : t.x0 + t.tw - t.right] += 1
    assert (seen >= 1).all()


PACKETS = "session_id long, seq long, ts_us long, is_seek boolean, epoch long, kind string, pts long, dts long, size long, flags long, eos boolean, keyframe boolean, duration long"


def _packets(spark, rows):
    base = {"session_id": 1, "ts_us": 0, "is_seek": False, "epoch": 0, "kind": "video", "pts": None, "dts": None, "size": 1, "flags": 0, "eos": False, "keyframe": False, "duration": None}
    names = [c.split()[0] for c in PACKETS.split(", ")]
    return spark.createDataFrame([tuple({**base, "seq": i, **r}[n] for n in names) for i, r in enumerate(rows)], PACKETS)


def test_only_seeks_raise_the_epoch(spark):
    df = _packets(spark, [{"epoch": 5}, {"epoch": 0}, {"epoch": 1, "is_seek": True}, {"epoch": 0}, {"epoch": 1}, {"epoch": 2}])
    assert [r.seq for r in packets.drop_stale_epochs(df).orderBy("seq").collect()] == [0, 1, 2, 4, 5]


@FEW
@given(st.lists(st.tuples(st.booleans(), st.one_of(st.none(), st.integers(0, 9))), min_size=1, max_size=30))
def test_merge_equals_a_two_way_merge(spark, raw):
    df = _packets(spark, [{"kind": "audio" if aux else "video", "pts": p} for aux, p in raw])
    stamp = lambda p: float("inf") if p is None else p
    video = [(stamp(p), i) for i, (aux, p) in enumerate(raw) if not aux]
    aux = [(stamp(p), i) for i, (a, p) in enumerate(raw) if a]
    want = []
    while video or aux:
        take = video if not aux or (video and video[0][0] <= aux[0][0]) else aux
        want.append(take.pop(0)[1])
    assert [r.seq for r in packets.merge_av(df).orderBy("place").collect()] == want


@FEW
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 9), st.booleans()), min_size=1, max_size=20), st.integers(0, 60))
def test_eviction_equals_the_loop(spark, raw, limit):
    rows = [(f"{i:03d}", size, mtime, kept, "s") for i, (mtime, size, kept) in enumerate(raw)]
    total, want = sum(r[1] for r in rows), []
    for name, size, _, kept, _ in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        if total > limit and not kept:
            want.append(name)
            total -= size
    df = spark.createDataFrame(rows, "sha256 string, size long, mtime long, protected boolean, store string")
    assert sorted(r.sha256 for r in attachments.lru_evict(df, limit_bytes=limit).collect()) == sorted(want)


def test_discard_is_drop_while(spark):
    rows = [{"seq": 0, "keyframe": True, "pts": 0}, {"seq": 1, "is_seek": True, "epoch": 1, "pts": 40}, {"pts": 80}, {"pts": None}, {"pts": 200}, {"pts": 160}]
    df = _packets(spark, rows)
    s = spark.createDataFrame([(1, 1, 1, 0, 200, None)], "session_id long, epoch long, seek_seq long, seek_us long, target_pts long, threshold_s double")
    assert [r.seq for r in seeks.seek_discard(df, s).orderBy("seq").collect()] == [3, 4, 5]


def test_chapter_steps(spark):
    c = spark.createDataFrame([(1, 0, 0.0, "a"), (1, 1, 10.0, None), (1, 2, 20.0, "c")], "clip_id long, pos long, start_s double, title string")
    p = spark.createDataFrame([(1, i, x) for i, x in enumerate((1.0, 11.0, 15.0, 25.0))], "clip_id long, event_id long, pos_s double")
    back = [r.target_s for r in chapters.chapter_step(p, c, delta=-1).orderBy("event_id").collect()]
    on = [r.target_s for r in chapters.chapter_step(p, c, delta=1).orderBy("event_id").collect()]
    assert back == [0.0, 0.0, 10.0, 20.0] and on == [10.0, 20.0, 20.0, None]
    assert [r.title for r in chapters.normalize_chapters(c).orderBy("start_s").collect()] == ["a", "Chapter 2", "c"]


def test_page_arguments(spark, sf):
    c = view(spark, sf, "v_catalog")
    for bad in ({"limit": 0}, {"offset": -1}, {"sort": "size"}):
        with pytest.raises(ValueError):
            catalog.library_page(c, **bad)


def test_backpressure_follows_the_thresholds(spark, sf):
    p, r = view(spark, sf, "v_packets"), view(spark, sf, "v_reports")
    level = sessions.buffer_estimate(p, r).orderBy("session_id", "seq").collect()
    want, state = [], {}
    for x in level:
        before = state.get(x.session_id, False)
        now = before if x.estimate_ms is None else True if x.estimate_ms > 10_000 else False if x.estimate_ms <= 9_500 else before
        if now != before:
            want.append((x.session_id, x.seq, now))
        state[x.session_id] = now
    assert [(x.session_id, x.seq, x.paused) for x in sessions.backpressure(p, r).orderBy("session_id", "seq").collect()] == want


def share(rows, condition):
    return rows.agg((F.count_if(condition) / F.count("*")).alias("x")).first()["x"]


def test_fixtures_reach_both_sides_of_every_threshold(spark):
    """Each outcome of the operators with thresholds in seconds has a fair share of the rows."""
    of = lambda *names: (view(spark, "/root/testdata/sf0.01", n) for n in names)
    s, p, r = of("v_seeks", "v_packets", "v_reports")
    latency = seeks.seek_first_packet(s, p).cache()
    for outcome in (F.col("latency_us").isNull(), F.col("latency_us") < 750_000, F.col("latency_us") >= 750_000):
        assert share(latency, outcome) >= 0.05
    n = s.count()
    assert 0.05 * n <= seeks.seek_coalesce(s).count() <= 0.95 * n
    ticks = seeks.seek_ticks(s, p).groupBy("session_id", "seek_seq").agg(F.bool_or("gave_up").alias("gave_up"))
    assert 0.05 <= share(ticks, F.col("gave_up")) <= 0.95
    report = seeks.seek_report(s, p)
    assert report.where("flush_us > latency_us").count() == 0 and share(report, F.col("flush_us") < F.col("latency_us")) >= 0.05
    estimate = sessions.buffer_estimate(p, r).join(r.select("session_id", "ts_us").distinct().withColumn("here", F.lit(True)), ["session_id", "ts_us"], "left")
    assert share(estimate, F.col("here").isNull()) >= 0.5
    pauses = sessions.backpressure(p, r)
    assert 0.05 <= share(pauses, F.col("paused")) <= 0.95
    assert share(packets.fps_window(p), F.col("fps") > 2) >= 0.05
    total = p.count()
    assert 0.05 * total <= packets.epoch_gap(p).count() <= 0.5 * total
    assert 0.05 * total <= sessions.report_gaps(r).count() <= 0.5 * total
    opens = next(of("v_opens"))
    assert 0.05 * total <= sessions.open_inactivity(opens).count() <= 0.5 * total


def test_anchored_frame_rates(spark, sf):
    """Against a loop over each session's frames."""
    want, state = [], {}
    for session, t in sorted((r.session_id, r.ts_us) for r in view(spark, sf, "v_packets").where("kind = 'video'").collect()):
        start, n = state.get(session, (t, 0))
        state[session] = (start, n + 1)
        if t - start >= 2_000_000:
            want.append((session, start, (n + 1) / ((t - start) / 1e6)))
            del state[session]
    got = streams.drained(lifecycle.fps_anchored(streams.packet_stream(spark, sf))).collect()
    assert want and sorted(map(tuple, got)) == sorted(want)


def test_frames_against_plain_versions(spark, sf):
    """Stages, doubling and checks of the given clips, one frame after the other."""
    clips = {}
    for r in sorted(frames.frames_from_embeddings(view(spark, sf, "embeddings")).collect(), key=lambda r: (r.clip_id, r.pts)):
        clips.setdefault(r.clip_id, []).append((r.pts, np.frombuffer(r.rgb, np.uint8).reshape(r.h, r.w, 3)))
    source = frames.frames_from_embeddings(view(spark, sf, "embeddings")).repartition(3).cache()
    staged = {(r.clip_id, r.pts): bytes(r.rgb) for r in frames.frame_stage(source, frames.PairMean).collect()}
    want = {}
    for clip, rows in clips.items():
        for (p, a), (_, b) in zip(rows[::2], rows[1::2]):
            want[clip, p] = ((a.astype(int) + b) // 2).astype(np.uint8).tobytes()
        if len(rows) % 2:
            want[clip, rows[-1][0]] = rows[-1][1].tobytes()
    assert staged == want
    doubled = {(r.clip_id, r.pts): np.frombuffer(r.rgb, np.uint8).reshape(16, 16, 3) for r in frames.upscale_frames(source).collect()}
    for clip, rows in clips.items():
        for p, x in rows[:5]:
            edge = np.pad(x.astype(float), ((1, 1), (1, 1), (0, 0)), "edge")
            for i, j in ((0, 0), (3, 8), (15, 15), (7, 2)):
                y, z = 1 + (i // 2), 1 + (j // 2)
                near = lambda k, at: (at - 1, 0.25, at, 0.75) if k % 2 == 0 else (at, 0.75, at + 1, 0.25)
                a, fa, b, fb = near(i, y)
                c, fc, d, fd = near(j, z)
                value = fa * (fc * edge[a, c] + fd * edge[a, d]) + fb * (fc * edge[b, c] + fd * edge[b, d])
                assert np.abs(doubled[clip, p][i, j] - value).max() <= 0.51
    checked = {r.clip_id: (r.n_before, r.n_after, r.ok) for r in frames.frame_verify(source, frames.frame_stage(source, frames.PairMean)).collect()}
    assert checked == {c: (len(r), (len(r) + 1) // 2, len(r) == 1) for c, r in clips.items()}


@pytest.mark.parametrize("algorithm", sessions.ALGORITHMS)
def test_resampling_keeps_flat_frames_and_means(algorithm):
    flat = np.full((9, 7, 3), 77.0)
    assert np.allclose(frames.resample(flat, 5, 20, algorithm), 77)
    ramp = np.repeat(np.arange(40.0)[None, :, None], 3, 2).repeat(6, 0)
    assert np.abs(frames.resample(ramp, 6, 80, algorithm)[:, 30:50].mean() - ramp.mean()) < 0.5


def test_chapters_beyond_the_cap(spark):
    rows = [(1, i, float(1000 - i) if i % 5 else -1.0, float(2000 - i) if i % 2 else None, None) for i in range(600)]
    got = chapters.sanitize_chapters(spark.createDataFrame(rows, "clip_id long, pos long, start_s double, end_s double, title string")).orderBy("place").collect()
    want = sorted((r[2], r[3]) for r in rows[:512] if r[2] >= 0)
    assert [(r.start_s, r.end_s) for r in got] == want


def test_limits_of_attachments(spark):
    mb = 1024 * 1024
    rows = [("s", i, f"{i:064x}", size * mb, "font/ttf") for i, size in enumerate((64, 64, 64, 60))] + [("t", 0, "a" * 64, 65 * mb, "font/ttf")]
    df = spark.createDataFrame(rows, "session_id string, pos int, sha256 string, size long, mimetype string")
    assert {(r.session_id, r.accepted) for r in attachments.validate_manifest(df).collect()} == {("s", True), ("t", False)}
    assert {r.session_id: r.cacheable for r in attachments.attachment_totals(df).collect()} == {"s": True, "t": False}


def test_shared_folders(spark, monkeypatch):
    from reelframe import session

    assert session.shared_folder(spark, "x") != session.shared_folder(spark, "x")

    class Elsewhere:
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: {"spark.master": "spark://host:7077"}.get(k, d))})

    with pytest.raises(RuntimeError):
        session.shared_folder(Elsewhere(), "x")


def test_tiles_equal_the_whole_frame(spark):
    clips = spark.createDataFrame([(1,)], "clip_id long")
    f = frames.synth_frames(clips, n=2, h=40, w=50).cache()
    whole = {r.pts: np.frombuffer(r.rgb, np.uint8) for r in frames.upscale_frames(f).collect()}
    tiled = {r.pts: np.frombuffer(r.rgb, np.uint8) for r in frames.upscale_tiled(f, tile=24, overlap=8).collect()}
    assert whole.keys() == tiled.keys() and all(np.abs(whole[p].astype(int) - tiled[p]).max() <= 1 for p in whole)


def test_frame_arguments(spark):
    f = frames.synth_frames(spark.createDataFrame([(1,)], "clip_id long"), n=1, h=8, w=8)
    with pytest.raises(ValueError):
        frames.fit_frames(f, w=4, h=4, algorithm="nearest")
    assert frames.fit_frames(f, w=4, h=4).first().w == 4
    with pytest.raises(ValueError):
        frames.upscale_tiled(f, tile=8, overlap=3)


def test_big_joins_have_no_cross_product(spark, sf):
    from reelframe import catalogue

    for name in ("seek_report", "aux_overlap", "chapter_at", "buffer_estimate", "validate_open_requests"):
        plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_model_files(spark, tmp_path):
    from reelframe.sources.files import scan_catalog, scan_models

    root = tmp_path / "root"
    (root / "a").mkdir(parents=True)
    for name in ("net-x4", "plain", "bad", "null"):
        (root / "a" / f"{name}.onnx").write_bytes(b"w")
    (root / "a" / "plain.json").write_text('﻿{"scale_factor": 3}')
    (root / "a" / "bad.json").write_text("no json")
    (root / "a" / "null.json").write_text('{"scale_factor": null}')
    assert {r.model: r.scale for r in scan_models(spark, str(root)).collect()} == {"net-x4": 4, "plain": 3, "null": None}
    names = {(r.path, r.is_dir) for r in scan_catalog(spark, str(root)).collect()}
    assert ("a", True) in names and ("a/plain.onnx", False) in names and len(names) == 8


def test_file_queries_hold_every_row(spark, sf):
    from reelframe import catalogue

    files = view(spark, sf, "v_catalog").where("NOT is_dir").groupBy("parent").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
    found = catalogue.QUERIES["scan_catalog"](spark, sf)
    assert sorted(found.where("NOT is_dir").select("parent", "n", "bytes").collect()) == sorted(files.collect())
    assert found.where("is_dir").agg(F.sum("n")).first()[0] == files.count()
    models = {f"{r.model}_id{r.model_id}": r for r in view(spark, sf, "v_models").collect()}
    scales = {r.model: r.scale for r in catalogue.QUERIES["scan_models"](spark, sf).collect()}
    broken = {k for k, r in models.items() if r.has_sidecar and r.model_id % 30 == 0}
    assert broken and set(scales) == set(models) - broken
    assert all(scales[k] == r.sidecar_scale for k, r in models.items() if r.has_sidecar and k not in broken)
