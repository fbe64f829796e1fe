"""The derived inputs of the operators, each once as SQL that both Spark and an ANSI engine run.

FIXTURES.md describes them.  Tables stand in braces; a few functions that engines spell differently are written @us, @sha256, @bytes and @hex.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_SPARK = {
    "@us": r"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', \1)",
    "@sha256": r"sha2(\1, 256)",
    "@bytes": r"octet_length(\1)",
}
_ANSI = {"@us": r"epoch_us(\1)", "@sha256": r"sha256(\1)", "@bytes": r"strlen(\1)"}

_EVENTS = "SELECT event_id, user_id, ts, event_type, value, props, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {events}"

#: name -> (views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_events": ((), _EVENTS),
    # Events in frame time: all sessions begin within five minutes, packets follow each other by about 40 ms, in bursts, after stalls of half a minute and more,
    # and after a seek as fast or slow as that seek is; a third of the seeks are followed by another one at once (a storm).
    "v_timed": (
        ("v_events",),
        """SELECT event_id, user_id, event_type, value, k, seq, is_seek, 1767225600000000 + user_id % 300 * 1000000 + CAST(sum(step_us) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS at_us
FROM (SELECT *, CASE WHEN seek_before AND is_seek THEN 300000 + k * 15000 WHEN seek_before THEN CASE k_before % 5 WHEN 0 THEN 180000 WHEN 1 THEN 640000 WHEN 2 THEN 1900000 WHEN 3 THEN 5300000 ELSE 66000000 END
 WHEN k % 20 = 7 THEN 31000000 + k * 100000 WHEN k % 4 = 1 THEN 2000 ELSE 40000 + k % 5 * 1000 END AS step_us
 FROM (SELECT *, coalesce(lag(is_seek) OVER (PARTITION BY user_id ORDER BY seq), false) AS seek_before, lag(k) OVER (PARTITION BY user_id ORDER BY seq) AS k_before
  FROM (SELECT *, asked OR (k % 3 = 0 AND coalesce(lag(asked) OVER (PARTITION BY user_id ORDER BY seq), false)) AS is_seek
   FROM (SELECT event_id, user_id, event_type, value, k, event_type = 'error' AND k < 20 AS asked, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq FROM {v_events}))))""",
    ),
    "v_packets": (
        ("v_timed",),
        """SELECT session_id, seq, ts_us, k, is_seek,
 CASE WHEN k % 7 = 0 AND epoch_now > 0 AND NOT is_seek THEN epoch_now - 1 ELSE epoch_now END AS epoch,
 CASE event_type WHEN 'purchase' THEN 'audio' WHEN 'signup' THEN 'subtitle' ELSE 'video' END AS kind,
 CASE WHEN k % 25 = 24 THEN NULL ELSE seq * 40 + (k % 3 - 1) * 40 END AS pts,
 CASE WHEN k % 25 = 24 OR k % 5 = 0 THEN NULL ELSE seq * 40 + (k % 3 - 1) * 40 - 40 END AS dts,
 event_type IN ('click', 'view') AND k % 6 = 0 AS keyframe, k = 99 AS eos,
 CASE WHEN k IN (24, 74) THEN 0 ELSE CAST(floor(value * 100) AS BIGINT) END AS size,
 CAST((CASE WHEN event_type IN ('click', 'view') AND k % 6 = 0 THEN 1 ELSE 0 END) + (CASE WHEN is_seek THEN 2 ELSE 0 END) + (CASE WHEN k = 99 THEN 4 ELSE 0 END) AS BIGINT) AS flags,
 CAST(CASE event_type WHEN 'purchase' THEN 40 WHEN 'signup' THEN 2000 END AS BIGINT) AS duration
FROM (SELECT user_id AS session_id, event_type, value, k, at_us AS ts_us, is_seek, seq,
 CAST(sum(CASE WHEN is_seek THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch_now FROM {v_timed})""",
    ),
    "v_seeks": (
        ("v_packets",),
        """SELECT session_id, epoch, seq AS seek_seq, ts_us AS seek_us, (seq + 5) * 40 AS target_pts,
 CASE k % 3 WHEN 1 THEN CAST(0.1 AS DOUBLE) WHEN 2 THEN CAST(30 AS DOUBLE) END AS threshold_s FROM {v_packets} WHERE is_seek""",
    ),
    # a client reports every half second, out of step with its packets
    "v_reports": (
        ("v_timed",),
        "SELECT user_id AS session_id, event_id, CAST(floor(at_us / 500000) AS BIGINT) * 500000 + user_id % 7 * 50000 AS ts_us, CAST(floor(value * 500) AS BIGINT) AS buffered_ms, event_type <> 'error' AS playing FROM {v_timed}",
    ),
    "v_states": (
        ("v_events",),
        """SELECT user_id AS session_id, event_id, @us(ts) AS ts_us,
 CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'playing' WHEN 'signup' THEN 'paused' WHEN 'error' THEN 'closed' ELSE 'playing' END AS state FROM {v_events}""",
    ),
    "v_catalog": (
        (),
        """SELECT source || '/' || name AS path, source AS parent, name, false AS is_dir, doc_id % 23 = 0 AS is_symlink, CAST(n_chars % 500 AS DOUBLE) AS mtime, n_chars AS length
 FROM (SELECT *, lang || '_' || CAST(doc_id AS VARCHAR(20)) || CASE doc_id % 10 WHEN 0 THEN '.mkv' WHEN 1 THEN '.MP4' WHEN 2 THEN '.m4v' WHEN 3 THEN '.avi' WHEN 4 THEN '.mov'
 WHEN 5 THEN '.ts' WHEN 6 THEN '.webm' WHEN 7 THEN '.txt' WHEN 8 THEN '.srt' ELSE '.MKV' END AS name FROM {documents})
UNION ALL SELECT source, '', source, true, false, CAST(max(n_chars) % 500 AS DOUBLE), CAST(0 AS BIGINT) FROM {documents} GROUP BY source""",
    ),
    "v_requests": (
        ("v_catalog",),
        """SELECT path AS request FROM {v_catalog} UNION ALL SELECT '../' || path FROM {v_catalog} WHERE length % 5 = 0
UNION ALL SELECT parent || chr(92) || name FROM {v_catalog} WHERE length % 5 = 1 UNION ALL SELECT '' FROM {v_catalog} WHERE length % 97 = 0 AND NOT is_dir
UNION ALL SELECT '/' || path FROM {v_catalog} WHERE length % 5 = 2 UNION ALL SELECT './' || path FROM {v_catalog} WHERE length % 5 = 3
UNION ALL SELECT parent || '/./' || name FROM {v_catalog} WHERE length % 5 = 4 AND NOT is_dir UNION ALL SELECT parent || '//' || name || '.gone' FROM {v_catalog} WHERE length % 7 = 0""",
    ),
    "v_attachments": (
        (),
        """SELECT source AS session_id, doc_id AS pos, CASE WHEN doc_id % 97 = 0 AND doc_id % 2 = 0 THEN 'xyz' ELSE @sha256(text) END AS sha256,
 CAST(CASE WHEN doc_id % 97 = 0 AND doc_id % 2 = 1 THEN -1 ELSE @bytes(text) END AS BIGINT) AS size, lang || ' font ' || CAST(doc_id % 7 AS VARCHAR(20)) || '.ttf' AS name,
 CASE doc_id % 4 WHEN 0 THEN 'font/ttf' WHEN 1 THEN 'font/otf' WHEN 2 THEN 'application/x-font-ttf' ELSE 'image/png' END AS mimetype FROM {documents}""",
    ),
    "v_store": (
        (),
        """SELECT sha256, size, mtime, protected, store FROM (SELECT @sha256(text) AS sha256, CAST(@bytes(text) AS BIGINT) AS size, n_chars AS mtime, doc_id % 11 = 0 AS protected, lang AS store,
 row_number() OVER (PARTITION BY @sha256(text) ORDER BY doc_id) AS rn FROM {documents} WHERE doc_id % 3 = 0) WHERE rn = 1""",
    ),
    "v_models": (
        (),
        """SELECT p_partkey AS model_id, replace(p_name, ' ', '_') || CASE p_size % 6 WHEN 0 THEN '-2x' WHEN 1 THEN '_x4' WHEN 2 THEN '3x3' WHEN 3 THEN '-1080x1920' WHEN 4 THEN '' ELSE '_X6' END AS model,
 p_partkey % 3 = 0 AS has_sidecar, CASE WHEN p_partkey % 3 = 0 AND p_size % 10 <> 0 THEN CAST(p_size % 4 + 1 AS BIGINT) END AS sidecar_scale FROM {part}""",
    ),
    "v_sizes": (
        (),
        """SELECT p_partkey AS size_id, CAST(p_size * 64 + p_partkey % 7 * 10 + 16 AS BIGINT) AS w, CAST(p_size * 36 + p_partkey % 5 * 6 + 16 AS BIGINT) AS h,
 CAST(CASE p_partkey % 4 WHEN 0 THEN 1280 WHEN 1 THEN 1920 WHEN 2 THEN 2960 ELSE 1080 END AS BIGINT) AS tw, CAST(CASE p_partkey % 4 WHEN 0 THEN 720 WHEN 1 THEN 1080 WHEN 2 THEN 1848 ELSE 2340 END AS BIGINT) AS th,
 CAST(CASE WHEN p_partkey % 3 = 0 THEN 16 ELSE 2 END AS BIGINT) AS align, CASE WHEN p_partkey % 2 = 0 THEN 'fit' ELSE 'cover' END AS fit_mode,
 CASE WHEN p_partkey % 13 <> 0 THEN CAST(p_size * 100 AS BIGINT) END AS free_mb, CAST(p_size % 4 + 1 AS BIGINT) AS scale FROM {part}""",
    ),
    "v_chapters": (
        (),
        """SELECT o_custkey AS clip_id, o_orderkey AS pos, CASE WHEN o_orderkey % 50 = 0 THEN -1.0 ELSE 1.0 END * (o_totalprice / 1000) AS start_s, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / 1000 + 5 END AS end_s,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN '  ' WHEN o_orderkey % 5 = 0 THEN ' Part ' || CAST(o_orderkey AS VARCHAR(20)) || ' ' ELSE 'Part ' || CAST(o_orderkey AS VARCHAR(20)) END AS title FROM {orders}""",
    ),
    "v_positions": (("v_timed",), "SELECT user_id AS clip_id, event_id, at_us AS ts_us, value AS pos_s FROM {v_timed}"),
    "v_stage_times": (
        (),
        """SELECT l_orderkey AS session_id, CASE l_returnflag WHEN 'A' THEN 'decode' WHEN 'N' THEN 'infer' ELSE 'encode' END AS stage, l_quantity AS ms FROM {lineitem}""",
    ),
    "v_bench": (
        (),
        """SELECT p_name AS model, CASE l_linenumber % 3 WHEN 0 THEN '720p' WHEN 1 THEN '1080p' ELSE '1440p' END AS size, CASE l_linestatus WHEN 'F' THEN 'hevc' ELSE 'ffv1' END AS tier,
 l_extendedprice / 1000 AS fps FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    ),
    "v_bench_calls": (
        (),
        """SELECT p_name AS model, CASE l_linenumber % 3 WHEN 0 THEN '720p' WHEN 1 THEN '1080p' ELSE '1440p' END AS size, l_orderkey * 8 + l_linenumber AS call, l_extendedprice / 1000 AS ms FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    ),
    "v_gpu": (
        (),
        """SELECT l_orderkey AS session_id, l_linenumber AS sample, l_orderkey % 7 <> 0 AS available, CASE WHEN l_orderkey % 7 <> 0 THEN CAST(floor(l_quantity * 2) AS BIGINT) END AS util, CASE WHEN l_orderkey % 7 <> 0 THEN CAST(floor(l_extendedprice / 4) AS BIGINT) END AS mem_mb FROM {lineitem}""",
    ),
    "v_candidates": (
        (),
        """SELECT CASE n_nationkey % 4 WHEN 0 THEN 'lossless-hevc' WHEN 1 THEN 'hevc-qp18' WHEN 2 THEN 'lossless-ffv1' ELSE 'hevc-qp4' END AS tier, CASE WHEN n_nationkey % 4 = 0 AND n_nationkey % 8 = 4 THEN 'nvenc-p7' ELSE 'auto' END AS profile,
 n_nationkey AS place, CASE WHEN n_nationkey % 4 = 2 THEN 'ffv1' WHEN n_nationkey < 12 THEN 'hevc_nvenc' ELSE 'libx265' END AS codec, 'opt' || CAST(n_nationkey AS VARCHAR(20)) AS options FROM {nation}""",
    ),
    "v_opens": (
        ("v_timed",),
        """SELECT event_id, user_id AS client, 1767225600000000 + (at_us - 1767225600000000) * 8 AS ts_us, CASE k % 9 WHEN 0 THEN 'bogus' WHEN 1 THEN 'uplink' ELSE 'server_file' END AS source,
 CASE k % 8 WHEN 0 THEN 'wrong' WHEN 1 THEN 'external' WHEN 2 THEN NULL ELSE 'muxed' END AS aux_tracks, CASE k % 6 WHEN 0 THEN 'cached' WHEN 1 THEN 'none' ELSE 'embedded' END AS aux_attachments,
 'src' || CAST(event_id % 20 AS VARCHAR(20)) AS path_dir, event_id % 1000 AS path_id, k % 11 <> 0 AS has_video, CASE k % 10 WHEN 0 THEN 'unknown' ELSE 'passthrough' END AS model,
 CASE k % 12 WHEN 0 THEN 'stretch' WHEN 1 THEN 'cover' ELSE 'fit' END AS fit_mode, CASE event_id % 11 WHEN 0 THEN 'fast-bilinear' WHEN 1 THEN 'bilinear' WHEN 2 THEN 'bicubic' WHEN 3 THEN 'area' WHEN 4 THEN 'bicublin' WHEN 5 THEN 'gaussian' WHEN 6 THEN 'sinc' WHEN 7 THEN 'lanczos' WHEN 8 THEN 'spline' WHEN 9 THEN 'point' ELSE 'gauss' END AS resize_algorithm,
 CAST(floor(value * 100000) AS BIGINT) AS attachment_bytes, k % 4 = 0 AS cacheable FROM {v_timed}""",
    ),
    # control messages as clients send them; one in ten is cut off, one in ten has no type (chr(123) and chr(125) are braces)
    "v_messages": (
        ("v_events",),
        """SELECT event_id, k, kind, k % 10 IN (3, 6) AS bad, CASE k % 10 WHEN 3 THEN chr(123) || '"type": "seek", "target' WHEN 6 THEN chr(123) || '"kind": "' || kind || '"' || chr(125) ELSE chr(123) || '"type": "' || kind || '"' || body ||
 CASE WHEN k % 5 = 0 THEN ', "trace": ' || chr(123) || '"id":' || CAST(k AS VARCHAR(20)) || chr(125) ELSE '' END || chr(125) END AS text
FROM (SELECT *, CASE kind WHEN 'hello' THEN ', "protocol_version": 1, "client_name": "client ' || CAST(k AS VARCHAR(20)) || '", "display": ' || chr(123) || '"w": 1920, "h": 1080' || chr(125)
 WHEN 'open_session' THEN CASE WHEN k % 2 = 0 THEN ', "source": "uplink"' ELSE ', "source": ' || chr(123) || '"type": "server_file", "path": "a/' || CAST(k AS VARCHAR(20)) || '.mkv"' || chr(125) END || ', "model": "net_x2", "display": ' || chr(123) || '"w": 1920, "h": 1080' || chr(125)
 WHEN 'seek' THEN ', "target_pts": ' || CAST(event_id AS VARCHAR(20)) || ', "epoch": ' || CAST(k AS VARCHAR(20))
 WHEN 'buffer_report' THEN ', "buffered_ms": ' || CAST(k * 100 AS VARCHAR(20)) || CASE WHEN k % 3 = 0 THEN ', "playing_pts": ' || CAST(event_id AS VARCHAR(20)) ELSE '' END ELSE '' END AS body
FROM (SELECT event_id, k, CASE event_type WHEN 'click' THEN 'seek' WHEN 'view' THEN 'buffer_report' WHEN 'signup' THEN 'hello' WHEN 'purchase' THEN 'open_session' ELSE 'pause' END AS kind FROM {v_events}))""",
    ),
    # what a host's encoders say when the candidates of the tier that it asks for are opened; null where one opens
    "v_probes": (
        ("v_hosts", "v_candidates"),
        """SELECT host, codec, options, CASE WHEN codec = 'hevc_nvenc' AND has_cuda THEN NULL WHEN codec = 'libx265' AND variant < 3 THEN NULL WHEN codec = 'ffv1' AND variant < 4 THEN NULL
 ELSE CASE (host + place) % 5 WHEN 0 THEN 'No free encode session' WHEN 1 THEN 'Option preset not found' WHEN 2 THEN 'unknown encoder ' || codec WHEN 3 THEN 'CUDA error 35' ELSE 'exit 1' END END AS error_text
FROM {v_hosts} h JOIN {v_candidates} c ON c.tier = CASE h.tier WHEN 'visually-lossless' THEN 'hevc-qp18' ELSE h.tier END AND c.profile = CASE WHEN h.tier = 'lossless-hevc' THEN h.profile ELSE 'auto' END""",
    ),
    "v_quality_requests": (
        ("v_events",),
        """SELECT event_id, CASE event_id % 11 WHEN 0 THEN 'lossless-hevc' WHEN 1 THEN 'hevc-qp2' WHEN 2 THEN 'hevc-qp4' WHEN 3 THEN 'hevc-qp6' WHEN 4 THEN 'hevc-qp10' WHEN 5 THEN 'hevc-qp18' WHEN 6 THEN 'lossless-ffv1'
 WHEN 7 THEN 'visually-lossless' WHEN 8 THEN 'visually-lossless' WHEN 9 THEN 'none of these' ELSE NULL END AS tier FROM {v_events}""",
    ),
    # live sessions by the token that clients send, and their requests for attachment bodies
    "v_tokens": (
        ("v_states",),
        """SELECT 'src' || CAST(n AS VARCHAR(20)) AS session_id, 'tok' || CAST(n * 7 % 20 AS VARCHAR(20)) AS token, state
FROM (SELECT session_id % 20 AS n, state, row_number() OVER (PARTITION BY session_id % 20 ORDER BY ts_us DESC, event_id DESC) AS rn FROM {v_states}) WHERE rn = 1""",
    ),
    "v_object_requests": (
        ("v_attachments",),
        """SELECT pos, CASE WHEN pos % 13 = 0 THEN NULL WHEN pos % 17 = 0 THEN 'Basic abc' WHEN pos % 3 = 0 THEN 'Bearer tok' || CAST(pos % 20 AS VARCHAR(20))
 ELSE 'Bearer  tok' || CAST(CAST(replace(session_id, 'src', '') AS BIGINT) * 7 % 20 AS VARCHAR(20)) || ' ' END AS auth, CASE WHEN pos % 7 = 0 THEN upper(sha256) ELSE sha256 END AS digest FROM {v_attachments}""",
    ),
    "v_streams": (
        (),
        """SELECT p_partkey AS stream_id, CASE p_size % 3 WHEN 0 THEN 'h264' WHEN 1 THEN 'hevc' ELSE 'av1' END AS codec, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_name END AS extradata, CAST(p_size * 64 AS BIGINT) AS width, CAST(p_size * 36 AS BIGINT) AS height,
 CAST(1 AS BIGINT) AS tb_num, CAST(CASE p_size % 2 WHEN 0 THEN 1000 ELSE 90000 END AS BIGINT) AS tb_den, CASE WHEN p_partkey % 5 <> 0 THEN CAST(24000 + p_size % 2 * 6000 AS BIGINT) END AS rate_num, CASE WHEN p_partkey % 5 <> 0 THEN CAST(1001 AS BIGINT) END AS rate_den,
 CASE WHEN p_partkey % 6 = 0 THEN CAST(0 AS BIGINT) WHEN p_partkey % 7 <> 0 THEN p_partkey * 1000 END AS duration, CASE WHEN p_partkey % 10 = 0 THEN CAST(0 AS BIGINT) WHEN p_partkey % 11 <> 0 THEN p_partkey * 1000000 END AS container_us FROM {part}""",
    ),
    "v_clients": (("v_events",), "SELECT '10.0.0.' || CAST(user_id % 50 AS VARCHAR(20)) AS ip, @us(ts) AS ts_us FROM {v_events}"),
    "v_hosts": (
        (),
        """SELECT s_suppkey AS host, s_suppkey % 8 AS variant, s_suppkey % 2 = 0 AS has_cuda, s_suppkey % 4 = 0 AS has_tensorrt, s_suppkey % 3 = 0 AS has_dml,
 CASE s_suppkey % 5 WHEN 0 THEN 'No free encode session' WHEN 1 THEN 'Option preset not found' WHEN 2 THEN 'unknown encoder hevc' WHEN 3 THEN 'CUDA error 35' ELSE 'exit 1' END AS error_text,
 CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 6 = 0 THEN 'CPUExecutionProvider' ELSE 'CUDAExecutionProvider' END AS active_provider, CASE WHEN s_suppkey % 9 = 0 THEN 'cpu' ELSE 'auto' END AS ep,
 CASE s_suppkey % 5 WHEN 0 THEN 'visually-lossless' WHEN 1 THEN 'lossless-hevc' WHEN 2 THEN 'lossless-ffv1' WHEN 3 THEN 'hevc-qp4' ELSE 'hevc-qp99' END AS tier, CASE WHEN s_suppkey % 2 = 0 THEN 'auto' ELSE 'nvenc-p7' END AS profile FROM {supplier}""",
    ),
    "v_samples": (
        ("v_timed",),
        """SELECT user_id AS session_id, event_id, at_us AS ts_us, CAST(sum(CAST(floor(value * 1000) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_bytes,
 value / 50 AS cache_s, k % 40 AS queued, k % 9 AS chunks, CAST(24 + k % 2 * 6 AS DOUBLE) AS fps, k < 10 AS paused_for_cache, CAST(k AS DOUBLE) AS infer_ms FROM {v_timed}""",
    ),
    "v_tracks": (
        (),
        """SELECT conv_id AS file, turn AS pos, CASE role WHEN 'user' THEN 'sub' WHEN 'assistant' THEN 'audio' ELSE 'video' END AS type, turn % 3 = 2 AS is_default,
 CASE WHEN turn % 2 = 0 THEN NULL ELSE 'Track ' || CAST(turn AS VARCHAR(20)) END AS title FROM {conversations}""",
    ),
}


def _dialect(sql: str, functions: dict[str, str]) -> str:
    for name, to in functions.items():
        sql = re.sub(rf"{name}\((\w+)\)", to, sql)
    return sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view, or a table, as a DataFrame over the given folder."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _dialect(VIEWS[name][1], _SPARK).replace("{", "{")
    needed = {n: view(spark, sf_dir, n) for n in dict.fromkeys(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **needed)


def ansi_with(names: tuple[str, ...]) -> str:
    """WITH clause that defines these views and all that they read."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in VIEWS[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', _dialect(VIEWS[n][1], _ANSI))})" for n in order) if order else ""
