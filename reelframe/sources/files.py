"""Sources and sinks of files: catalogues, models, packet captures, logs, status snapshots and object stores.

Each registered query first writes its input files with Spark from a derived view, then scans them back, so its work grows with the tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelframe.functions.exprs import infer_scale
from reelframe.operators.sessions import STAGES_SQL, STATS_FIELDS, STATS_SQL, sample_line, stage_times, stats_fields
from reelframe.plans.registry import ORACLES, QUERIES
from reelframe.plans.views import ansi_with, view
from reelframe.session import shared_folder
from reelframe.sources.captures import scan_packets, write_captures
from reelframe.sources.listing import contents, listing, located, tasks_for
from reelframe.sources.objects import publish, read_store, sink_object_store


def scan_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Every file below a root and every directory on the way to one; bodies are not read."""
    return catalog_of(listing(spark, root).select(F.col("below").alias("path"), "length", "mtime_us"))


def catalog_of(files: DataFrame) -> DataFrame:
    """Files (path below a root, length, mtime_us) and every directory on the way to one."""
    rows = files.select("path", F.lit(False).alias("is_dir"), "length", "mtime_us")
    parts = F.split("path", "/")
    dirs = rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("path"), F.size(parts).alias("n"))
    dirs = dirs.where("n > 1").select("path").distinct().select("path", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("long").alias("mtime_us"))
    both = rows.unionByName(dirs)
    return both.withColumn("parent", F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise("")).withColumn("name", F.substring_index("path", "/", -1))


def with_sidecars(models: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Scale of each model from its sidecar's JSON, else from its name; a sidecar that is no JSON object drops the model."""
    side = sidecars.select("model", F.from_json("json", "scale_factor long").alias("m"), F.col("json").rlike(r"(?s)^\s*\{.*\}\s*$").alias("fine"))
    rows = models.join(side, "model", "left").where("fine IS NULL OR fine")
    return rows.select("model", F.when(F.col("fine"), F.col("m.scale_factor")).otherwise(infer_scale(F.col("model"))).alias("scale"))


def stem(path: str | Column) -> Column:
    """A file's name without its suffix."""
    return F.regexp_extract(path, r"/([^/]*)\.[^./]*$", 1)


def scan_models(spark: SparkSession, root: str) -> DataFrame:
    """Models below a root with their sidecars of the same stem; a byte-order mark before the JSON is skipped."""
    files = listing(spark, root)
    models = files.where(F.col("path").endswith(".onnx")).select(stem("path").alias("model"))
    text = contents(files.where(F.col("path").endswith(".json")), root).select("path", F.col("content").cast("string").alias("value"))
    sidecars = text.select(stem("path").alias("model"), F.regexp_replace("value", "^\ufeff", "").alias("json"))
    return with_sidecars(models, sidecars.hint("merge"))  # Spark takes the sidecars for as small as the table of their paths, so it would broadcast them


def _run_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the lines of each block of a file from 1, and give each the number of the block's last record so far; a task's lines come in the order of their blocks."""
    at, line, record = None, 0, 0
    for batch in batches:
        file, block = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        lines, records = [], []
        for key, starts in zip(zip(file, block, strict=True), batch.column(3).to_pylist(), strict=True):
            if key != at:
                at, line, record = key, 0, 0
            line += 1
            record = line if starts else record
            lines.append(line)
            records.append(record or None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lines, pa.int64()), pa.array(records, pa.int64())], ["value", "file", "block", "line", "record"])


HEAD = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3}) (\w+) ([\w.]+): (.*)$"


def numbered_lines(spark: SparkSession, glob: str, *, broadcast_blocks: int = 1_000_000) -> DataFrame:
    """value, file, line_no (from 1) and record_no of every line of the logs: the line of the record that it belongs to, null before a file's first record.

    Large files are read in blocks by many tasks.  Each numbers its own lines; the blocks' sizes and last records, one row a block, are then summed up and carried
    from block to block of a file, so neither lines nor files are ever sorted or shuffled.
    """
    rows = spark.read.option("recursiveFileLookup", True).text(glob).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").rlike(HEAD).alias("starts"))
    inside = rows.mapInArrow(_run_on, "value string, file string, block long, line long, record long")
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = inside.groupBy("file", "block").agg(F.count("*").alias("n"), F.max("record").alias("last"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("ends", F.col("last") + F.col("before"))
    blocks = blocks.select("file", "block", "before", F.last("ends", ignorenulls=True).over(earlier).alias("carried"))
    table = shared_folder(spark, "blocks")
    blocks.write.parquet(table)  # read twice
    blocks = spark.read.parquet(table)
    small = blocks.count() <= broadcast_blocks  # the bound is checked
    joined = inside.join(F.broadcast(blocks) if small else blocks, ["file", "block"])
    return joined.select("value", "file", (F.col("line") + F.col("before")).alias("line_no"), F.coalesce(F.col("record") + F.col("before"), "carried").alias("record_no"))


def scan_server_log(spark: SparkSession, glob: str) -> DataFrame:
    """Log lines as typed rows with file, line_no and record_no; a line without a timestamp (a traceback) continues the record of its record_no and has none."""
    return parse_server_log(numbered_lines(spark, glob), "file", "line_no", "record_no")


def parse_server_log(lines: DataFrame, *keys: str) -> DataFrame:
    """Lines (value, and keys that stay) as ts, level, logger, event, the fields of a stats line and its stage times, and what other events say as a map `fields`; batch or stream.

    Events: stats, state (session, to), seek (session, target_pts), seek_trace (epoch, target_pts, mode and its times in ms), closed (tier, encoder, duration_s), continuation and other.
    """
    part = lambda p, i=1: F.nullif(F.regexp_extract("value", p, i), F.lit(""))
    rows = lines.select(*keys, "value", F.try_to_timestamp(part(HEAD), F.lit("yyyy-MM-dd HH:mm:ss,SSS")).alias("ts"), part(HEAD, 2).alias("level"), part(HEAD, 3).alias("logger"), F.coalesce(part(HEAD, 4), "value").alias("message"))
    says = F.col("message")
    patterns = {
        "state": (r"^session (\w+) -> (\w+)", ("session", "to")),
        "seek": (r"^session (\w+): seek to (-?\d+)", ("session", "target_pts")),
        "seek_trace": (
            r"^seek epoch=(\d+) target_pts=(-?\d+) mode=(\w+): flush_seen=(\d+)ms keyframe_gap=(?:n/a|([\d.]+)s) discarded=(\d+) frames \((\d+)ms decode\) first_frame=\+(\d+)ms first_packet=\+(\d+)ms",
            ("epoch", "target_pts", "mode", "flush_seen_ms", "keyframe_gap_s", "frames_discarded", "discard_decode_ms", "first_frame_ms", "first_packet_ms"),
        ),
        "closed": (r"^pipeline close complete tier=(\S+) encoder=(\S+) duration=([\d.]+)s", ("tier", "encoder", "duration_s")),
    }
    event = F.when(F.col("ts").isNull(), "continuation").when(says.rlike(r"^session \S+ [a-z]+( FINAL)? epoch="), "stats")
    fields = F.lit(None).cast("map<string, string>")
    for name, (pattern, groups) in patterns.items():
        event = event.when(says.rlike(pattern), name)
        fields = F.when(says.rlike(pattern), F.create_map(*(x for i, g in enumerate(groups) for x in (F.lit(g), F.nullif(F.regexp_extract(says, pattern, i + 1), F.lit("")))))).otherwise(fields)
    rows = rows.withColumn("event", event.otherwise("other"))
    stats = F.when(F.col("event") == "stats", says)
    return rows.select(*keys, "ts", "level", "logger", "event", *stats_fields(stats), stage_times(stats).alias("stage_ms"), F.when(F.col("event") != "continuation", fields).alias("fields"), "message")


STATUS = "sessions array<struct<id: string, state: string, pipeline: struct<fps: double, stage_ms: map<string, double>>>>"


def scan_status(snapshots: DataFrame) -> DataFrame:
    """Status snapshots (column json) as one row per distinct session, of clashing ones the least; a session may have no pipeline."""
    rows = snapshots.select(F.explode(F.from_json("json", STATUS)["sessions"]).alias("s")).select("s.id", "s.state", F.col("s.pipeline.fps").alias("fps"), F.col("s.pipeline.stage_ms.infer").alias("infer_ms"))
    return rows.groupBy("id").agg(F.min(F.struct("state", "fps", "infer_ms")).alias("s")).select("id", "s.*")


#: Packets of a capture file at most.
BLOCK = 1_000_000


def _packets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write each session's packets, with payloads of up to a kilobyte, as captures; scan those by ranges of a quarter of a megabyte."""
    at = shared_folder(spark, "captures")
    payload = F.expr("substring(repeat(CAST(seq % 1000 AS STRING), 1024), 1, CAST(size % 1024 AS INT))").cast("binary")
    packets = view(spark, sf_dir, "v_packets").select("session_id", "seq", "flags", "epoch", "pts", "dts", "size")
    written = write_captures(packets, at, block=BLOCK, payload=payload)
    written.agg(F.sum("n")).first()
    of = lambda i: F.regexp_extract("path", r"/(-?\d+)-(\d+)\.cap$", i).cast("long")
    rows = scan_packets(spark, at, chunk_bytes=1 << 18)
    return rows.select(of(1).alias("session_id"), (F.col("seq") + of(2) * BLOCK).alias("seq"), "size", "flags", "epoch", "pts", "dts", "corrupt")


def write_log(samples: DataFrame, at: str) -> None:
    """Session snapshots as a server's logs: each session opens with a state line, then come stats lines with state, seek, trace and close lines and tracebacks in between, in order of time."""
    stamp = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd HH:mm:ss,SSS")
    number = lambda c: F.col(c).cast("double")
    gap = F.when(F.col("queued") == 0, "n/a").otherwise(F.format_string("%.2fs", number("queued") / 4))
    trace = F.format_string(
        "seek epoch=%d target_pts=%d mode=%s: flush_seen=%.0fms keyframe_gap=%s discarded=%d frames (%.0fms decode) first_frame=+%.0fms first_packet=+%.0fms",
        "queued", "event_id", F.when(F.col("chunks") % 2 == 0, "keyframe").otherwise("accurate"), number("chunks"), gap, "queued", number("queued") * 14, number("queued") * 20, number("queued") * 20 + number("chunks"),
    )
    kind = F.col("event_id") % 20
    line = (
        F.when(kind == 0, F.concat(F.lit("Traceback "), F.col("event_id").cast("string")))
        .when(kind == 1, F.format_string("%s INFO media.session: session %d -> paused", stamp, "session_id"))
        .when(kind == 2, F.format_string("%s WARNING media.session: session %d: seek to %d produced no downlink bytes in 60s", stamp, "session_id", "event_id"))
        .when(kind == 3, F.format_string("%s INFO media.pipeline: pipeline close complete tier=hevc-qp4 encoder=libx265 duration=%.3fs workers=all-stopped", stamp, F.col("queued").cast("double")))
        .when(kind == 4, F.concat(stamp, F.lit(" DEBUG media: session listing")))
        .when(kind == 5, F.concat(stamp, F.lit(" INFO media.pipeline: "), trace))
        .otherwise(F.concat(stamp, F.lit(" INFO media.stats: "), sample_line()))
    )
    first = F.row_number().over(W.partitionBy("session_id").orderBy("ts_us", "event_id")) == 1
    opened = F.format_string("%s INFO media.session: session %d -> open", stamp, "session_id")
    rows = samples.select("session_id", "ts_us", "event_id", F.when(first, F.array(opened, line)).otherwise(F.array(line)).alias("lines"))
    rows.sortWithinPartitions("session_id", "ts_us", "event_id").select(F.explode("lines").alias("value")).write.text(at)


SAID = ("session", "to", "epoch", "target_pts", "mode", "flush_seen_ms", "keyframe_gap_s", "frames_discarded", "discard_decode_ms", "first_frame_ms", "first_packet_ms", "tier", "encoder", "duration_s")


def _log_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines, and of each traceback the time of the record that it belongs to."""
    at = shared_folder(spark, "logs")
    write_log(view(spark, sf_dir, "v_samples"), at)
    rows = scan_server_log(spark, at)
    records = rows.where("event <> 'continuation'").select("file", F.col("line_no").alias("record_no"), F.unix_millis("ts").alias("of_ms"))
    return rows.join(records, ["file", "record_no"], "left").select(
        F.unix_millis("ts").alias("ts_ms"), "of_ms", "level", "logger", "event", *(name for name, _, _ in STATS_FIELDS), *(F.col("stage_ms")[k].alias(f"{k}_ms") for k in ("decode", "encode")), *(F.col("fields")[k].alias(f"said_{k}") for k in SAID)
    )


def _status_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "v_states").groupBy("session_id").agg(F.max_by("state", F.struct("ts_us", "event_id")).alias("state"))
    stage = F.map_from_arrays(F.array(F.lit("infer")), F.array((F.col("session_id") % 50).cast("double")))
    pipeline = F.when(F.col("session_id") % 5 != 0, F.struct((F.col("session_id") % 30).cast("double").alias("fps"), stage.alias("stage_ms")))
    one = F.struct(F.col("session_id").cast("string").alias("id"), "state", pipeline.alias("pipeline"))
    at = shared_folder(spark, "status")
    s.select(F.to_json(F.struct(F.array(one, one, one).alias("sessions"))).alias("value")).write.text(at)
    return scan_status(spark.read.text(at).withColumnRenamed("value", "json"))


def write_files(files: DataFrame, at: str) -> int:
    """Write each row (path below `at`, content as binary) as a file of its own; how many were written.  A task that is run again writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(at)
        known = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                folder = f"{root}/{path}".rpartition("/")[0]
                if folder not in known:
                    system.create_dir(folder, recursive=True)
                    known.add(folder)
                with system.open_output_stream(f"{root}/{path}") as out:
                    out.write(content.as_py() or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


#: Models of a folder, about.
FOLDER = 1000


def _models_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every model and sidecar as a file, in folders of about a thousand models, and scan them; one sidecar in ten is broken."""
    m = view(spark, sf_dir, "v_models")
    folder = F.concat(F.lit("models/"), F.pmod(F.xxhash64("model_id"), F.lit(m.count() // FOLDER + 1)).cast("string"))
    m = m.select(folder.alias("folder"), F.concat(folder, F.lit("/"), "model", F.lit("_id"), F.col("model_id").cast("string")).alias("at"), "has_sidecar", "sidecar_scale", "model_id")
    json = F.concat(F.when(F.col("model_id") % 2 == 0, "\ufeff").otherwise(""), F.lit("{\"scale_factor\": "), F.coalesce(F.col("sidecar_scale").cast("string"), F.lit("null")), F.lit("}"))
    body = F.when(F.col("model_id") % 30 == 0, "broken").otherwise(json)
    models = m.select("folder", F.concat("at", F.lit(".onnx")).alias("path"), F.lit("weights").cast("binary").alias("content"))
    sidecars = m.where("has_sidecar").select("folder", F.concat("at", F.lit(".json")).alias("path"), body.cast("binary").alias("content"))
    at = shared_folder(spark, "models")
    write_files(models.unionByName(sidecars).repartition(tasks_for(spark, 1 << 20), "folder"), at)
    return scan_models(spark, at)


def _catalog_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every file of the catalogue with a body of its length and scan the folder."""
    c = view(spark, sf_dir, "v_catalog").where("NOT is_dir")
    at = shared_folder(spark, "media")
    write_files(c.repartition(tasks_for(spark, 1 << 20), "path").select("path", F.expr("repeat('.', CAST(length AS INT))").cast("binary").alias("content")), at)
    return scan_catalog(spark, at).groupBy("parent", "is_dir").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def _store_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = view(spark, sf_dir, "documents").where("text IS NOT NULL")
    data = F.col("text").cast("binary")
    bodies = docs.select(F.when(F.col("doc_id") % 97 == 0, F.lit("0")).otherwise(F.sha2("text", 256)).alias("sha256"), (F.octet_length("text") + F.when(F.col("doc_id") % 89 == 0, 1).otherwise(0)).cast("long").alias("size"), data.alias("data"))
    at = shared_folder(spark, "objects")
    publish(bodies.where("size % 2 = 0"), at)
    return sink_object_store(bodies, at, store=read_store(spark, at))


QUERIES.update({"scan_packets": _packets_query, "scan_server_log": _log_query, "scan_status": _status_query, "scan_models": _models_query, "scan_catalog": _catalog_query, "sink_object_store": _store_query})
ORACLES.update(
    {
        "scan_packets": ansi_with(("v_packets",)) + " SELECT session_id, seq, size % 1024 AS size, flags, epoch, pts, dts, false AS corrupt FROM v_packets",
        "scan_server_log": ansi_with(("v_samples",))
        + f""", f AS (SELECT event_id % 20 AS e, event_id, session_id AS sid, queued AS q, chunks AS c, ts_us, ts_us // 1000 AS ms, {STATS_SQL}, {STAGES_SQL} FROM v_samples),
 g AS (SELECT *, coalesce(last_value(CASE WHEN e > 0 THEN ms END IGNORE NULLS) OVER (PARTITION BY sid ORDER BY ts_us ROWS UNBOUNDED PRECEDING), min(ms) OVER (PARTITION BY sid)) AS of_ms FROM f),
 l AS (SELECT *, e > 5 AS st FROM g)
 SELECT CASE WHEN e > 0 THEN ms END AS ts_ms, of_ms, CASE WHEN e = 0 THEN NULL WHEN e = 2 THEN 'WARNING' WHEN e = 4 THEN 'DEBUG' ELSE 'INFO' END AS level,
 CASE WHEN e = 0 THEN NULL WHEN e IN (1, 2) THEN 'media.session' WHEN e IN (3, 5) THEN 'media.pipeline' WHEN e = 4 THEN 'media' ELSE 'media.stats' END AS logger,
 CASE e WHEN 0 THEN 'continuation' WHEN 1 THEN 'state' WHEN 2 THEN 'seek' WHEN 3 THEN 'closed' WHEN 4 THEN 'other' WHEN 5 THEN 'seek_trace' ELSE 'stats' END AS event,
 {", ".join(f"CASE WHEN st THEN {name} END AS {name}" for name in [*(n for n, _, _ in STATS_FIELDS), "decode_ms", "encode_ms"])},
 CASE WHEN e IN (1, 2) THEN CAST(sid AS VARCHAR) END AS said_session, CASE WHEN e = 1 THEN 'paused' END AS said_to, CASE WHEN e = 5 THEN CAST(q AS VARCHAR) END AS said_epoch, CASE WHEN e IN (2, 5) THEN CAST(event_id AS VARCHAR) END AS said_target_pts,
 CASE WHEN e = 5 THEN CASE WHEN c % 2 = 0 THEN 'keyframe' ELSE 'accurate' END END AS said_mode, CASE WHEN e = 5 THEN CAST(c AS VARCHAR) END AS said_flush_seen_ms,
 CASE WHEN e = 5 AND q > 0 THEN printf('%.2f', CAST(q AS DOUBLE) / 4) END AS said_keyframe_gap_s, CASE WHEN e = 5 THEN CAST(q AS VARCHAR) END AS said_frames_discarded, CASE WHEN e = 5 THEN CAST(q * 14 AS VARCHAR) END AS said_discard_decode_ms,
 CASE WHEN e = 5 THEN CAST(q * 20 AS VARCHAR) END AS said_first_frame_ms, CASE WHEN e = 5 THEN CAST(q * 20 + c AS VARCHAR) END AS said_first_packet_ms,
 CASE WHEN e = 3 THEN 'hevc-qp4' END AS said_tier, CASE WHEN e = 3 THEN 'libx265' END AS said_encoder, CASE WHEN e = 3 THEN printf('%.3f', CAST(q AS DOUBLE)) END AS said_duration_s FROM l
 UNION ALL BY NAME SELECT min(ms) AS ts_ms, min(ms) AS of_ms, 'INFO' AS level, 'media.session' AS logger, 'state' AS event, CAST(sid AS VARCHAR) AS said_session, 'open' AS said_to FROM f GROUP BY sid""",
        "scan_status": ansi_with(("v_states",))
        + """ SELECT CAST(session_id AS VARCHAR) AS id, arg_max(state, {'a': ts_us, 'b': event_id}) AS state, CASE WHEN session_id % 5 <> 0 THEN CAST(session_id % 30 AS DOUBLE) END AS fps, CASE WHEN session_id % 5 <> 0 THEN CAST(session_id % 50 AS DOUBLE) END AS infer_ms
 FROM v_states GROUP BY session_id""",
        "scan_models": ansi_with(("v_models",))
        + """, m AS (SELECT *, model || '_id' || CAST(model_id AS VARCHAR) AS stem FROM v_models) SELECT stem AS model, CASE WHEN has_sidecar THEN sidecar_scale
 ELSE coalesce(CAST(nullif(regexp_extract(' ' || stem || ' ', '[^0-9]([1-9][0-9]*)[xX][^0-9]', 1), '') AS BIGINT), CAST(nullif(regexp_extract(' ' || stem || ' ', '[^0-9][xX]([1-9][0-9]*)[^0-9]', 1), '') AS BIGINT), 2) END AS scale
 FROM m WHERE NOT (has_sidecar AND model_id % 30 = 0)""",
        "scan_catalog": ansi_with(("v_catalog",))
        + """ SELECT parent, false AS is_dir, count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes FROM v_catalog WHERE NOT is_dir GROUP BY parent
 UNION ALL SELECT '', true, count(DISTINCT parent), CAST(0 AS BIGINT) FROM v_catalog WHERE NOT is_dir HAVING count(*) > 0""",
        "sink_object_store": "SELECT DISTINCT sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL AND doc_id % 97 <> 0 AND doc_id % 89 <> 0",
    }
)
