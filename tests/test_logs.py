"""Logs read in blocks by many tasks, and control messages of every kind."""

import random

from pyspark.sql import functions as F

from reelframe.operators.sessions import scan_control
from reelframe.sources.files import HEAD, numbered_lines, scan_server_log


def log_of(rng, n, start=0):
    """Lines, and for each the record that it belongs to."""
    lines, of, record = [], [], None
    for k in range(1, n + 1):
        if k > start and rng.random() < 0.3:
            lines.append(f"2026-07-12 10:49:{k % 60:02d},{k % 1000:03d} ERROR media.server: request {k} failed {'x' * rng.randrange(200)}")
            record = k
        else:
            lines.append(rng.choice(["Traceback (most recent call last):", '  File "a.py", line 1, in <module>', "", "ValueError: no"]))
        of.append(record)
    return lines, of


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    rng = random.Random(3)
    files = {"a.log": log_of(rng, 3000), "b.log": log_of(rng, 40, start=30), "c.log": (["no record at all"] * 500, [None] * 500), "one.log": log_of(rng, 1)}
    for name, (lines, _) in files.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size, bound in (("20000", 1_000_000), ("700", 0), ("128m", 1_000_000)):  # blocks within a file, blocks without a record, many files a task; with and without a broadcast
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "10")
            found = {}
            for r in numbered_lines(spark, str(tmp_path), broadcast_blocks=bound).collect():
                found.setdefault(r.file.rsplit("/", 1)[1], []).append((r.line_no, r.value, r.record_no))
            for name, (lines, of) in files.items():
                assert sorted(found[name]) == [(k + 1, x, o) for k, (x, o) in enumerate(zip(lines, of, strict=True))], (name, size)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_traceback_and_trace_lines(spark, tmp_path):
    (tmp_path / "server.log").write_text(
        "boot\n"
        "2026-07-12 10:49:01,005 ERROR asyncio: Task exception was never retrieved\n"
        "Traceback (most recent call last):\n"
        "ValueError: no\n"
        "2026-07-12 10:49:02,000 INFO media.pipeline: seek epoch=3 target_pts=-40 mode=accurate: flush_seen=4ms keyframe_gap=1.25s discarded=31 frames (450ms decode) first_frame=+500ms first_packet=+560ms\n"
        "2026-07-12 10:49:02,500 INFO media.pipeline: seek epoch=4 target_pts=80 mode=keyframe: flush_seen=4ms keyframe_gap=n/a discarded=0 frames (0ms decode) first_frame=+5ms first_packet=+6ms\n"
        "2026-07-12 10:49:03,000 INFO media.stats: session ab12cd playing FINAL epoch=2 source=uplink | pipeline  23.5 fps | onnx  41.2 fps | decode=3.1ms infer=24.3ms fit=1.0ms encode=8.8ms | output=1920x1080 codec=hevc\n"
    )
    rows = {r.line_no: r for r in scan_server_log(spark, str(tmp_path)).collect()}
    assert [(k, rows[k].event, rows[k].record_no) for k in range(1, 8)] == [
        (1, "continuation", None), (2, "other", 2), (3, "continuation", 2), (4, "continuation", 2), (5, "seek_trace", 5), (6, "seek_trace", 6), (7, "stats", 7),
    ]
    assert rows[5].fields["keyframe_gap_s"] == "1.25" and rows[5].fields["first_packet_ms"] == "560" and rows[6].fields["keyframe_gap_s"] is None and rows[5].fields["target_pts"] == "-40"
    assert rows[7].stage_ms == {"decode": 3.1, "infer": 24.3, "fit": 1.0, "encode": 8.8} and rows[7].infer_ms == 24.3 and rows[7].epoch == 2
    assert rows[2].ts.microsecond == 5000 and HEAD.startswith("^")


CONTROL = [
    ('{"type": "seek", "target_pts": 40, "epoch": 2}', ("seek", None, 40, 2, None)),
    ('{"type": "seek", "target_pts": "40", "epoch": 2.0, "x": [1, {"y": null}], "why": null}', ("seek", None, 40, 2, {"x": '[1,{"y":null}]', "why": None})),
    ('{"type": "seek", "target_pts": {"a": 1}}', ("seek", None, None, None, None)),
    ('{"type": "later", "news": true}', ("later", None, None, None, {"news": "true"})),
    ('{"type": null, "epoch": 1}', ("error", "bad_message", None, None, None)),
    ('{"epoch": 1}', ("error", "bad_message", None, None, None)),
    ("[1, 2]", ("error", "bad_message", None, None, None)),
    ("7", ("error", "bad_message", None, None, None)),
    ('{"type": "seek"', ("error", "bad_message", None, None, None)),
    ("", ("error", "bad_message", None, None, None)),
    (None, ("error", "bad_message", None, None, None)),
]


def test_control_messages(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CONTROL)], "id long, text string")
    found = {r.id: (r.type, r.error, r.target_pts, r.epoch, r.rest) for r in scan_control(rows).drop("message").collect()}
    assert found == {k: want for k, (_, want) in enumerate(CONTROL)}
    kept = scan_control(rows).where("id = 1").select(F.variant_get("message", "$.x[1]", "string")).first()[0]
    assert kept == '{"y":null}'
    opened = spark.createDataFrame([('{"type": "open_session", "source": {"type": "server_file", "path": "a/b.mkv"}}',), ('{"type": "open_session", "source": "uplink"}',)], "body string")
    assert [(r.source_kind, r.source_path) for r in scan_control(opened, "body").collect()] == [("server_file", "a/b.mkv"), ("uplink", None)]
