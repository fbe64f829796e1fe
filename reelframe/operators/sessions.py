"""Sessions: negotiation, states, buffers, positions, silence and clients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelframe.functions.exprs import playable, whole
from reelframe.operators.seeks import asof
from reelframe.plans.registry import query

# Names of resize algorithms.
ALGORITHMS = ("fast-bilinear", "bilinear", "bicubic", "area", "bicublin", "gaussian", "sinc", "lanczos", "spline")


def validate_open_requests(requests: DataFrame, catalog: DataFrame, *, embed_limit: int = 4 * 1024 * 1024) -> DataFrame:
    """First failing rule of each open request, else what was negotiated for auxiliary tracks and attachments."""
    files = catalog.where(~F.col("is_dir") & ~F.col("is_symlink")).select(F.col("parent").alias("path_dir"), F.regexp_extract("name", r"_(\d+)\.", 1).cast("long").alias("path_id"), "name")
    rows = requests.join(files, ["path_dir", "path_id"], "left")
    aux, attachments = F.coalesce("aux_tracks", F.lit("external")), F.coalesce("aux_attachments", F.lit("embedded"))
    served = F.col("source") == "server_file"
    error = (
        F.when(~F.col("source").isin("uplink", "server_file"), "invalid source")
        .when(~aux.isin("external", "muxed"), "invalid aux_tracks")
        .when(~served & (aux == "muxed"), "muxed needs server_file")
        .when(~attachments.isin("embedded", "cached"), "invalid aux_attachments")
        .when((attachments == "cached") & (aux != "muxed"), "cached needs muxed")
        .when(served & (F.col("name").isNull() | ~playable(F.col("name"))), "bad path")
        .when(~served & ~F.col("has_video"), "missing video")
        .when(F.col("model") != "passthrough", "unknown model")
        .when(~F.col("fit_mode").isin("fit", "cover"), "invalid fit_mode")
        .when(~F.col("resize_algorithm").isin(*ALGORITHMS), "unknown resize algorithm")
    )
    cached = (attachments == "cached") & F.col("cacheable") & (F.col("attachment_bytes") > 0)
    muxed = (aux == "muxed") & (cached | (F.col("attachment_bytes") <= embed_limit))
    rows = rows.withColumn("error", error)
    fine = F.col("error").isNull()
    return rows.select("event_id", "error", F.when(fine, F.when(muxed, "muxed").otherwise("external")).alias("aux_tracks"), F.when(fine, F.when(muxed & cached, "cached").otherwise("embedded")).alias("aux_attachments"))


def session_states(states: DataFrame) -> DataFrame:
    """State changes; `started` marks a first move from open to playing."""
    before = F.lag("state").over(W.partitionBy("session_id").orderBy("ts_us", "event_id"))
    rows = states.withColumn("before", before).where("before IS NULL OR before <> state")
    return rows.select("session_id", "event_id", "before", "state", ((F.coalesce("before", F.lit("")) == "open") & (F.col("state") == "playing")).alias("started"))


def distinct_sessions(states: DataFrame) -> DataFrame:
    """One row per session registered under three keys."""
    keys = F.explode(F.array(*(F.concat(F.lit(f"{k}:"), F.col("session_id").cast("string")) for k in ("id", "token", "media"))))
    return states.select("session_id", keys.alias("key")).dropDuplicates(["session_id"]).select("session_id")


def buffer_estimate(packets: DataFrame, reports: DataFrame) -> DataFrame:
    """Estimated client buffer at each packet: the last report, less the time since where the client plays; a seek reports 0."""
    seeks = packets.where("is_seek").select("session_id", "ts_us", F.lit(0).cast("long").alias("buffered_ms"), F.lit(True).alias("playing"), F.col("seq").alias("tie"))
    all_reports = reports.select("session_id", "ts_us", "buffered_ms", "playing", F.col("event_id").alias("tie")).unionByName(seeks)
    one = all_reports.groupBy("session_id", "ts_us").agg(F.min(F.struct("buffered_ms", "playing")).alias("r"))  # reports of one instant: the least counts
    right = one.select("session_id", F.col("ts_us").alias("at"), "r.*").withColumn("report_us", F.col("at"))
    found = asof(packets.select("session_id", "seq", "ts_us"), right, "session_id", "ts_us", "at", ["buffered_ms", "playing", "report_us"])
    spent = F.when(F.col("playing"), whole((F.col("ts_us") - F.col("report_us")) / 1000)).otherwise(0)
    return found.select("session_id", "seq", "ts_us", (F.col("buffered_ms") - spent).alias("estimate_ms"))


def backpressure(packets: DataFrame, reports: DataFrame, *, high: int = 10_000, resume: int = 9_500) -> DataFrame:
    """Whether the sender pauses at each packet: on above `high`, off at or below `resume`, as before in between."""
    rows = buffer_estimate(packets, reports)
    crossed = F.when(F.col("estimate_ms") > high, True).when(F.col("estimate_ms") <= resume, False)
    state = F.last(crossed, ignorenulls=True).over(W.partitionBy("session_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("paused", F.coalesce(state, F.lit(False)))
    change = F.coalesce(F.lag("paused").over(W.partitionBy("session_id").orderBy("seq")), F.lit(False)) != F.col("paused")
    return rows.withColumn("change", change).where("change").select("session_id", "seq", "ts_us", "paused")


def report_gaps(reports: DataFrame, *, expected_ms: int = 500) -> DataFrame:
    """Pauses between buffer reports of more than twice the expected time."""
    gap = F.col("ts_us") - F.lag("ts_us").over(W.partitionBy("session_id").orderBy("ts_us", "event_id"))
    return reports.withColumn("gap_us", gap).where(F.col("gap_us") > 2000 * expected_ms).select("session_id", "event_id", "gap_us", whole(F.col("gap_us") / (1000 * expected_ms)).alias("missed"))


def rebuffer_events(samples: DataFrame) -> DataFrame:
    """Runs of rebuffering: start, end (the first sample after it, null if none) and samples; the player begins outside one."""
    order = W.partitionBy("session_id").orderBy("ts_us", "event_id")
    rows = samples.withColumn("before", F.coalesce(F.lag("paused_for_cache").over(order), F.lit(False))).withColumn("next_us", F.lead("ts_us").over(order))
    rows = rows.withColumn("run", F.sum((F.col("paused_for_cache") & ~F.col("before")).cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.where("paused_for_cache").groupBy("session_id", "run").agg(F.min("ts_us").alias("start_us"), F.max_by("next_us", F.struct("ts_us", "event_id")).alias("end_us"), F.count("*").alias("samples"))


def throughput_mbps(samples: DataFrame) -> DataFrame:
    """Receive rate between samples; less than a millisecond counts as one."""
    order = W.partitionBy("session_id").orderBy("ts_us", "event_id")
    s = F.greatest(F.lit(0.001), (F.col("ts_us") - F.lag("ts_us").over(order)) / 1_000_000)
    return samples.select("session_id", "event_id", F.round((F.col("total_bytes") - F.lag("total_bytes").over(order)) * 8 / 1_000_000 / s, 6).alias("mbps"))


def client_buffer_ms(samples: DataFrame) -> DataFrame:
    """Player cache and bytes still before it; each part is cut to whole milliseconds."""
    ms = (F.col("cache_s") * 1000).cast("long") + ((F.col("queued") + F.col("chunks")) / F.greatest(F.lit(1.0), "fps") * 1000).cast("long")
    return samples.select("session_id", "event_id", ms.alias("buffered_ms"))


def stats_line(session, state, epoch, fps, infer_ms, decode_ms, encode_ms, decoded, upscaled, down, buffered_ms, paused) -> Column:
    """The line that a server logs of a session: state, rates, stages, caches and pacing; without an inference time its rate and stages read n/a, halves go to even."""
    measured = infer_ms > 0
    rate = F.when(measured, F.format_string("%5.1f", F.rint(10_000 / infer_ms) / 10)).otherwise("  n/a")
    stages = F.when(measured, F.format_string("decode=%.1fms infer=%.1fms encode=%.1fms", decode_ms, infer_ms, encode_ms)).otherwise("stages=n/a")
    return F.format_string(
        "session %s %s epoch=%d source=server_file | pipeline %5.1f fps | onnx %s fps | %s | output=%dx%d codec=%s encoder=%s tier=%s | cached frames: in-flight=%d (dec=%d up=%d down=%d) uplink-pkts=%d"
        " | client buffer %5d ms (est %5d) | %s | frames %d in / %d out",
        session, state, epoch, fps, rate, stages, F.lit(1920), F.lit(1080), F.lit("hevc"), F.lit("hevc_nvenc"), F.lit("hevc-qp18"), decoded + upscaled + down, decoded, upscaled, down, F.lit(0), buffered_ms, buffered_ms,
        F.when(paused, "PAUSED(watermark)").otherwise("flowing"), epoch * 24, epoch * 23,
    )


#: Fields of a stats line: name, pattern, type.  What a line lacks, or gives as n/a, is null.
STATS_FIELDS = (
    ("session", r"^session (\S+) ", "string"),
    ("state", r"^session \S+ ([a-z]+)", "string"),
    ("epoch", r" epoch=(\d+)", "long"),
    ("source", r" source=(\S+)", "string"),
    ("fps", r"pipeline +([\d.]+) fps", "double"),
    ("infer_fps", r"onnx +([\d.]+) fps", "double"),
    ("infer_ms", r" infer=([\d.]+)ms", "double"),
    ("width", r" output=(\d+)x", "long"),
    ("height", r" output=\d+x(\d+)", "long"),
    ("codec", r" codec=(\S+)", "string"),
    ("encoder", r" encoder=(\S+)", "string"),
    ("tier", r" tier=(\S+)", "string"),
    ("in_flight", r"in-flight=(\d+)", "long"),
    ("decoded", r"\(dec=(\d+)", "long"),
    ("upscaled", r" up=(\d+)", "long"),
    ("down", r" down=(\d+)\)", "long"),
    ("uplink", r"uplink-pkts=(\d+)", "long"),
    ("buffered_ms", r"client buffer +(-?\d+) ms", "long"),
    ("estimate_ms", r"\(est +(-?\d+)\)", "long"),
    ("pacing", r" \| (PAUSED|flowing)", "string"),
    ("frames_in", r"frames (\d+) in", "long"),
    ("frames_out", r" in / (\d+) out", "long"),
)


def stats_fields(line: Column) -> list[Column]:
    return [F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).cast(kind).alias(name) for name, pattern, kind in STATS_FIELDS]


def stage_times(line: Column) -> Column:
    """Milliseconds of each stage that a stats line names; null where it has none."""
    found = F.regexp_extract_all(F.regexp_extract(line, r"\| ([^|]*) \| output=", 1), F.lit(r"\S+=[\d.]+ms"), F.lit(0))
    entry = lambda x: F.struct(F.substring_index(x, "=", 1), F.regexp_extract(x, r"=([\d.]+)ms$", 1).cast("double"))
    return F.when(F.size(found) > 0, F.map_from_entries(F.transform(found, entry)))


def sample_line() -> Column:
    """The stats line of a row of v_samples."""
    return stats_line(
        F.col("session_id").cast("string"), F.lit("playing"), F.col("queued"), F.col("fps"), F.col("infer_ms"), F.col("queued") / 2, F.col("chunks").cast("double"), F.col("queued"), F.col("chunks"), F.lit(1),
        (F.col("cache_s") * 1000).cast("long"), F.col("paused_for_cache"),
    )


def log_line_fields(samples: DataFrame) -> DataFrame:
    """Session snapshots written as stats lines and read back, every field; a missing or zero inference time is null."""
    rows = samples.select("event_id", sample_line().alias("line")).withColumn("stage_ms", stage_times(F.col("line")))
    return rows.select("event_id", *stats_fields(F.col("line")), *(F.col("stage_ms")[k].alias(f"{k}_ms") for k in ("decode", "encode")))


def client_sketches(connections: DataFrame) -> DataFrame:
    """(hour, sketch, n): a HyperLogLog sketch of the clients of each hour, and its connections; of fixed size, so hours can be kept and merged for good."""
    hour = F.floor(F.col("ts_us") / 3_600_000_000).cast("long")
    return connections.groupBy(hour.alias("hour")).agg(F.hll_sketch_agg("ip", F.lit(14)).alias("sketch"), F.count("*").alias("n"))


def clients_over(sketches: DataFrame, *, every_h: int = 24) -> DataFrame:
    """(start_h, n, clients): connections and estimated distinct clients in ranges of `every_h` hours, from the sketches of hours alone; the standard error is 0.8 %."""
    start = (F.floor(F.col("hour") / every_h) * every_h).cast("long")
    return sketches.groupBy(start.alias("start_h")).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("clients"))


def client_counts(connections: DataFrame, *, every_h: int = 24) -> DataFrame:
    """The estimate of each range beside the exact count, and whether it is within 3 % of it (four standard errors)."""
    start = (F.floor(F.col("ts_us") / (3_600_000_000 * every_h)) * every_h).cast("long")
    exact = connections.groupBy(start.alias("start_h")).agg(F.countDistinct("ip").alias("exact"))
    both = clients_over(client_sketches(connections), every_h=every_h).join(exact, "start_h")
    return both.select("start_h", "n", "exact", (F.abs(F.col("clients") - F.col("exact")) <= F.col("exact") * 0.03).alias("close"))


def distinct_clients(connections: DataFrame) -> DataFrame:
    return connections.groupBy("ip").agg(F.min("ts_us").alias("first_seen_us"))


def first_seen(connections: DataFrame, *, horizon_s: int = 3600) -> DataFrame:
    """Notifications of clients not seen for `horizon_s`: what a stream that forgets after the horizon would tell."""
    gap = F.col("ts_us") - F.lag("ts_us").over(W.partitionBy("ip").orderBy("ts_us"))
    return connections.distinct().withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") > horizon_s * 1_000_000)).select("ip", "ts_us")


def open_inactivity(messages: DataFrame, *, gap_s: int = 240) -> DataFrame:
    """Silences of more than `gap_s` within a client's messages."""
    gap = F.lead("ts_us").over(W.partitionBy("client").orderBy("ts_us", "event_id")) - F.col("ts_us")
    return messages.withColumn("silent_us", gap).where(F.col("silent_us") > gap_s * 1_000_000).select("client", "event_id", "silent_us")


def position_hold(positions: DataFrame, seeks: DataFrame, *, near_s: float = 5.0, max_s: float = 15.0) -> DataFrame:
    """Positions shown after a seek: held back until one lies near the target or the hold has lasted `max_s`."""
    right = seeks.select(F.col("session_id").alias("clip_id"), F.col("seek_us").alias("at"), F.struct("seek_seq", "seek_us", "target_pts").alias("seek"))
    rows = asof(positions, right, "clip_id", "ts_us", "at", ["seek"], ties=[])
    free = (F.abs(F.col("pos_s") - F.col("seek.target_pts") / 1000) <= near_s) | (F.col("ts_us") - F.col("seek.seek_us") >= int(max_s * 1e6)) | F.col("seek").isNull()
    order = W.partitionBy("clip_id", "seek.seek_seq").orderBy("ts_us", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("free", F.max(free).over(order)).where("free").select("clip_id", "event_id", "pos_s")


#: Known fields of control messages by name, path and type; what else a message says stays in `rest`.
CONTROL_FIELDS = (
    ("protocol_version", "$.protocol_version", "int"),
    ("client_name", "$.client_name", "string"),
    ("source_kind", "$.source.type", "string"),
    ("source_path", "$.source.path", "string"),
    ("model", "$.model", "string"),
    ("quality_tier", "$.quality_tier", "string"),
    ("display_w", "$.display.w", "long"),
    ("display_h", "$.display.h", "long"),
    ("target_pts", "$.target_pts", "long"),
    ("epoch", "$.epoch", "long"),
    ("buffered_ms", "$.buffered_ms", "long"),
    ("playing_pts", "$.playing_pts", "long"),
)


def scan_control(messages: DataFrame, text: str = "text") -> DataFrame:
    """Control messages from JSON text, beside their other columns: type, the known fields, the whole message as a variant, and what no field knows.

    A field of another kind than expected is null (a `source` that is a plain name is its kind).  A text that is no JSON object, or has no type, is an error row: type `error`,
    error `bad_message`, nothing else.  `rest` maps the names of unknown fields to their JSON, null without any.
    """
    rows = messages.withColumn("message", F.try_parse_json(text))
    of = lambda path, kind: F.try_variant_get("message", path, kind)
    kind = of("$.type", "string")
    is_object = F.schema_of_variant("message").startswith("OBJECT")
    fine = F.coalesce(is_object & kind.isNotNull(), F.lit(False))
    known = {path.split(".")[1] for _, path, _ in CONTROL_FIELDS} | {"type"}
    every = F.from_json(text, "map<string, string>")
    rest = F.map_filter(every, lambda name, _: ~name.isin(*sorted(known)))
    fields = [F.when(fine, F.coalesce(of(path, as_), of("$.source", "string")) if name == "source_kind" else of(path, as_)).alias(name) for name, path, as_ in CONTROL_FIELDS]
    others = [F.col(c) for c in messages.columns if c != text]
    return rows.select(
        *others, F.when(fine, kind).otherwise("error").alias("type"), F.when(~fine, F.lit("bad_message")).alias("error"), *fields, F.when(fine, F.col("message")).alias("message"), F.when(fine & (F.size(rest) > 0), rest).alias("rest")
    )


_PLAY = "lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) IN ('.mkv', '.mp4', '.m4v', '.avi', '.mov', '.ts', '.webm')"
query("validate_open_requests", "v_opens v_catalog", validate_open_requests, f"""WITH r AS (SELECT o.*, c.name, coalesce(o.aux_tracks, 'external') AS a, o.aux_attachments AS t FROM v_opens o
 LEFT JOIN (SELECT parent, name, CAST(regexp_extract(name, '_([0-9]+)[.]', 1) AS BIGINT) AS id FROM v_catalog WHERE NOT is_dir AND NOT is_symlink) c ON c.parent = path_dir AND c.id = path_id),
e AS (SELECT *, CASE WHEN source NOT IN ('uplink', 'server_file') THEN 'invalid source' WHEN a NOT IN ('external', 'muxed') THEN 'invalid aux_tracks' WHEN source <> 'server_file' AND a = 'muxed' THEN 'muxed needs server_file'
 WHEN t NOT IN ('embedded', 'cached') THEN 'invalid aux_attachments' WHEN t = 'cached' AND a <> 'muxed' THEN 'cached needs muxed' WHEN source = 'server_file' AND (name IS NULL OR NOT {_PLAY}) THEN 'bad path'
 WHEN source <> 'server_file' AND NOT has_video THEN 'missing video' WHEN model <> 'passthrough' THEN 'unknown model' WHEN fit_mode NOT IN ('fit', 'cover') THEN 'invalid fit_mode'
 WHEN resize_algorithm NOT IN ('fast-bilinear', 'bilinear', 'bicubic', 'area', 'bicublin', 'gaussian', 'sinc', 'lanczos', 'spline') THEN 'unknown resize algorithm' END AS error,
 t = 'cached' AND cacheable AND attachment_bytes > 0 AS ca FROM r)
SELECT event_id, error, CASE WHEN error IS NULL THEN CASE WHEN a = 'muxed' AND (ca OR attachment_bytes <= 4194304) THEN 'muxed' ELSE 'external' END END AS aux_tracks,
 CASE WHEN error IS NULL THEN CASE WHEN a = 'muxed' AND ca THEN 'cached' ELSE 'embedded' END END AS aux_attachments FROM e""")
query("session_states", "v_states", session_states, """SELECT session_id, event_id, before, state, coalesce(before, '') = 'open' AND state = 'playing' AS started
FROM (SELECT *, lag(state) OVER (PARTITION BY session_id ORDER BY ts_us, event_id) AS before FROM v_states) WHERE before IS NULL OR before <> state""")
query("distinct_sessions", "v_states", distinct_sessions, "SELECT DISTINCT session_id FROM v_states")
_EST = """WITH a AS (SELECT session_id, ts_us, buffered_ms, playing FROM v_reports UNION ALL SELECT session_id, ts_us, 0, true FROM v_packets WHERE is_seek),
o AS (SELECT session_id, ts_us AS report_us, min({'b': buffered_ms, 'p': playing}) AS r FROM a GROUP BY session_id, ts_us),
e AS (SELECT p.session_id, p.seq, p.ts_us, r.b - CASE WHEN r.p THEN (p.ts_us - report_us) // 1000 ELSE 0 END AS estimate_ms FROM v_packets p ASOF LEFT JOIN o ON p.session_id = o.session_id AND p.ts_us >= o.report_us)"""
query("buffer_estimate", "v_packets v_reports", buffer_estimate, _EST + " SELECT * FROM e")
query("backpressure", "v_packets v_reports", backpressure, _EST + """,
c AS (SELECT *, CASE WHEN estimate_ms > 10000 THEN true WHEN estimate_ms <= 9500 THEN false END AS x FROM e),
s AS (SELECT *, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING), false) AS paused FROM c)
SELECT session_id, seq, ts_us, paused FROM (SELECT *, coalesce(lag(paused) OVER (PARTITION BY session_id ORDER BY seq), false) AS before FROM s) WHERE before <> paused""")
query("report_gaps", "v_reports", report_gaps, "SELECT session_id, event_id, gap_us, gap_us // 500000 AS missed FROM (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY session_id ORDER BY ts_us, event_id) AS gap_us FROM v_reports) WHERE gap_us > 1000000")
query("rebuffer_events", "v_samples", rebuffer_events, """WITH b AS (SELECT *, coalesce(lag(paused_for_cache) OVER w, false) AS before, lead(ts_us) OVER w AS next_us FROM v_samples WINDOW w AS (PARTITION BY session_id ORDER BY ts_us, event_id)),
r AS (SELECT *, CAST(sum(CASE WHEN paused_for_cache AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM b)
SELECT session_id, run, min(ts_us) AS start_us, CASE WHEN bool_or(next_us IS NULL) THEN NULL ELSE max(next_us) END AS end_us, count(*) AS samples FROM r WHERE paused_for_cache GROUP BY session_id, run""")
query("throughput_mbps", "v_samples", throughput_mbps, """SELECT session_id, event_id, round((total_bytes - lag(total_bytes) OVER w) * 8 / CAST(1000000 AS DOUBLE) / greatest(CAST(0.001 AS DOUBLE), (ts_us - lag(ts_us) OVER w) / CAST(1000000 AS DOUBLE)), 6) AS mbps
FROM v_samples WINDOW w AS (PARTITION BY session_id ORDER BY ts_us, event_id)""")
query("client_buffer_ms", "v_samples", client_buffer_ms, "SELECT session_id, event_id, CAST(trunc(cache_s * 1000) AS BIGINT) + CAST(trunc(CAST(queued + chunks AS DOUBLE) / greatest(CAST(1 AS DOUBLE), fps) * 1000) AS BIGINT) AS buffered_ms FROM v_samples")
STATS_SQL = """CAST(session_id AS VARCHAR) AS session, 'playing' AS state, queued AS epoch, 'server_file' AS source, fps, CASE WHEN infer_ms > 0 THEN CAST(printf('%.1f', CAST(1000 / infer_ms AS DOUBLE)) AS DOUBLE) END AS infer_fps, CASE WHEN infer_ms > 0 THEN infer_ms END AS infer_ms,
 CAST(1920 AS BIGINT) AS width, CAST(1080 AS BIGINT) AS height, 'hevc' AS codec, 'hevc_nvenc' AS encoder, 'hevc-qp18' AS tier, queued + chunks + 1 AS in_flight, queued AS decoded, chunks AS upscaled, CAST(1 AS BIGINT) AS down, CAST(0 AS BIGINT) AS uplink,
 CAST(trunc(cache_s * 1000) AS BIGINT) AS buffered_ms, CAST(trunc(cache_s * 1000) AS BIGINT) AS estimate_ms, CASE WHEN paused_for_cache THEN 'PAUSED' ELSE 'flowing' END AS pacing, queued * 24 AS frames_in, queued * 23 AS frames_out"""
STAGES_SQL = "CASE WHEN infer_ms > 0 THEN CAST(queued AS DOUBLE) / 2 END AS decode_ms, CASE WHEN infer_ms > 0 THEN CAST(chunks AS DOUBLE) END AS encode_ms"
query("log_line_fields", "v_samples", log_line_fields, f"SELECT event_id, {STATS_SQL}, {STAGES_SQL} FROM v_samples")
query("distinct_clients", "v_clients", distinct_clients, "SELECT ip, min(ts_us) AS first_seen_us FROM v_clients GROUP BY ip")
query("client_counts", "v_clients", client_counts, "SELECT CAST(floor(ts_us / 86400000000) AS BIGINT) * 24 AS start_h, count(*) AS n, count(DISTINCT ip) AS exact, true AS close FROM v_clients GROUP BY 1")
query("first_seen", "v_clients", first_seen, "SELECT ip, ts_us FROM (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY ip ORDER BY ts_us) AS gap FROM (SELECT DISTINCT * FROM v_clients)) WHERE gap IS NULL OR gap > 3600000000")
query("open_inactivity", "v_opens", open_inactivity, "SELECT client, event_id, silent_us FROM (SELECT *, lead(ts_us) OVER (PARTITION BY client ORDER BY ts_us, event_id) - ts_us AS silent_us FROM v_opens) WHERE silent_us > 240000000")
query("position_hold", "v_positions v_seeks", position_hold, """WITH j AS (SELECT p.*, s.seek_seq, s.seek_us, s.target_pts FROM v_positions p ASOF LEFT JOIN v_seeks s ON p.clip_id = s.session_id AND p.ts_us >= s.seek_us),
f AS (SELECT *, bool_or(coalesce(abs(pos_s - CAST(target_pts AS DOUBLE) / 1000) <= 5 OR ts_us - seek_us >= 15000000, true)) OVER (PARTITION BY clip_id, seek_seq ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS free FROM j)
SELECT clip_id, event_id, pos_s FROM f WHERE free""")
query(
    "scan_control",
    "v_messages",
    lambda m: scan_control(m.select("event_id", "text")).select("*", F.col("rest")["trace"].alias("rest_trace"), F.size("rest").alias("n_rest")).drop("message", "rest"),
    """SELECT event_id, CASE WHEN bad THEN 'error' ELSE kind END AS type, CASE WHEN bad THEN 'bad_message' END AS error, CASE WHEN kind = 'hello' AND NOT bad THEN CAST(1 AS INTEGER) END AS protocol_version,
 CASE WHEN kind = 'hello' AND NOT bad THEN 'client ' || CAST(k AS VARCHAR) END AS client_name, CASE WHEN kind = 'open_session' AND NOT bad THEN CASE WHEN k % 2 = 0 THEN 'uplink' ELSE 'server_file' END END AS source_kind,
 CASE WHEN kind = 'open_session' AND NOT bad AND k % 2 = 1 THEN 'a/' || CAST(k AS VARCHAR) || '.mkv' END AS source_path, CASE WHEN kind = 'open_session' AND NOT bad THEN 'net_x2' END AS model, CAST(NULL AS VARCHAR) AS quality_tier,
 CASE WHEN kind IN ('hello', 'open_session') AND NOT bad THEN CAST(1920 AS BIGINT) END AS display_w, CASE WHEN kind IN ('hello', 'open_session') AND NOT bad THEN CAST(1080 AS BIGINT) END AS display_h,
 CASE WHEN kind = 'seek' AND NOT bad THEN event_id END AS target_pts, CASE WHEN kind = 'seek' AND NOT bad THEN k END AS epoch, CASE WHEN kind = 'buffer_report' AND NOT bad THEN k * 100 END AS buffered_ms,
 CASE WHEN kind = 'buffer_report' AND NOT bad AND k % 3 = 0 THEN event_id END AS playing_pts, CASE WHEN NOT bad AND k % 5 = 0 THEN '{"id":' || CAST(k AS VARCHAR) || '}' END AS rest_trace,
 CASE WHEN NOT bad AND k % 5 = 0 THEN CAST(1 AS INTEGER) END AS n_rest FROM v_messages""",
)
