"""Measurements and hosts: stage times, benchmark grids, encoder and provider choice, failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.plans.registry import query
from reelframe.session import shared_folder

# Quality options (id, codec, lossless, android_supported, p95_mbps).
QUALITY = (
    ("lossless-hevc", "hevc", True, True, None),
    ("hevc-qp2", "hevc", False, True, 350),
    ("hevc-qp4", "hevc", False, True, 250),
    ("hevc-qp6", "hevc", False, True, 200),
    ("hevc-qp10", "hevc", False, True, 100),
    ("hevc-qp14", "hevc", False, True, 50),
    ("hevc-qp18", "hevc", False, True, 50),
    ("lossless-ffv1", "ffv1", True, False, None),
)
# Old names of quality options.
ALIASES = {"visually-lossless": "hevc-qp18"}
# Execution providers in order of preference.
PROVIDERS = (("tensorrt", "TensorrtExecutionProvider"), ("cuda", "CUDAExecutionProvider"), ("dml", "DmlExecutionProvider"), ("cpu", "CPUExecutionProvider"))
# Categories of encoder failures by words of the message; the first that fits counts.
FAILURES = (
    ("session/resource exhaustion", ("no free", "resource", "session", "out of memory", "too many")),
    ("unsupported options", ("option", "invalid argument", "not supported")),
    ("missing encoder/driver", ("not found", "unknown encoder", "driver", "library")),
    ("device/driver failure", ("device", "cuda", "nvenc", "hardware")),
)


def stage_means(times: DataFrame) -> DataFrame:
    """Mean milliseconds of each stage to one decimal, halves to even."""
    return times.groupBy("session_id", "stage").agg((F.rint(F.sum("ms") / F.count("*") * 10) / 10).alias("mean_ms"))


def gpu_peaks(samples: DataFrame) -> DataFrame:
    """Peak utilisation and memory of each session as cells of a report; n/a where the sampler was not available."""
    by = samples.groupBy("session_id").agg(F.bool_and("available").alias("fine"), F.max("util").alias("util"), F.max("mem_mb").alias("mem"))
    return by.select("session_id", F.when(F.col("fine"), F.concat(F.col("util").cast("string"), F.lit("%"))).otherwise("n/a").alias("util_peak"), F.when(F.col("fine"), F.col("mem").cast("string")).otherwise("n/a").alias("vram_peak_mb"))


def bench_fps(calls: DataFrame) -> DataFrame:
    """Frames a second of each model and size: the calls after the first one (the warm-up) over their wall seconds; null without any."""
    by = calls.groupBy("model", "size").agg(F.count("*").alias("n"), F.sum("ms").alias("ms"), F.min_by("ms", F.struct("call", "ms")).alias("warm_up"))
    return by.select("model", "size", (F.col("n") - 1).alias("frames"), F.when(F.col("n") > 1, F.round((F.col("n") - 1) / ((F.col("ms") - F.col("warm_up")) / 1000), 4)).alias("fps"))


def bench_grid(models: DataFrame, sizes: DataFrame, tiers: DataFrame, results: DataFrame, *, broadcast_rows: int = 10_000) -> DataFrame:
    """Every model, size and tier with its best measurement as text, `unavailable` where there is none.

    Sizes by tiers are sent to every executor only where they are at most `broadcast_rows`; else they are dealt out like the models.
    """
    pairs = sizes.join(tiers).persist()
    grid = models.join(F.broadcast(pairs) if pairs.count() <= broadcast_rows else pairs)
    best = results.groupBy("model", "size", "tier").agg(F.max("fps").alias("fps"))
    return grid.join(best, ["model", "size", "tier"], "left").select("model", "size", "tier", F.coalesce(F.round("fps", 1).cast("string"), F.lit("unavailable")).alias("cell"))


def realtime_viability(results: DataFrame, *, headroom: float = 1.3, rates: tuple[int, ...] = (24, 30, 60)) -> DataFrame:
    """For each size and frame rate the fastest model that clears it with headroom."""
    by = results.groupBy("model", "size").agg(F.max("fps").alias("fps")).withColumn("rate", F.explode(F.array(*map(F.lit, rates))))
    return by.where(F.col("fps") >= F.col("rate") * headroom).groupBy("size", "rate").agg(F.max_by("model", F.struct("fps", "model")).alias("model"))


# Columns of the report.
SIZES = ("720p", "1080p", "1440p")


def bench_report(results: DataFrame) -> DataFrame:
    """One row per model with a column per size and the row as a line of Markdown; cells keep their text."""
    text = F.coalesce(F.round(F.max("fps"), 1).cast("string"), F.lit("n/a"))
    rows = results.groupBy("model").pivot("size", list(SIZES)).agg(text)
    rows = rows.select("model", *(F.coalesce(F.col(x), F.lit("n/a")).alias(f"p{x[:-1]}") for x in SIZES))
    return rows.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", "model", *(f"p{x[:-1]}" for x in SIZES)), F.lit(" |")))


def write_report(results: DataFrame, path: str) -> DataFrame:
    """The report written as a table (path/table) and as Markdown (path/markdown, a head and then the models in order); returns the lines read back with the table."""
    spark = results.sparkSession
    bench_report(results).write.parquet(f"{path}/table")
    rows = spark.read.parquet(f"{path}/table")
    head = spark.createDataFrame([(0, "| model | " + " | ".join(SIZES) + " |"), (1, "|" + "---|" * (len(SIZES) + 1))], "place int, line string")
    lines = head.select("place", F.lit("").alias("model"), "line").unionByName(rows.select(F.lit(2).alias("place"), "model", "line"))
    lines.orderBy("place", "model").select("line").write.text(f"{path}/markdown")
    read = spark.read.text(f"{path}/markdown").withColumnRenamed("value", "line")
    return rows.join(read, "line")


def quality_options(spark: SparkSession, requests: DataFrame, *, android: bool | None = None) -> DataFrame:
    """The quality options with how often requests (tier) ask for each; old names count for their new ones, unknown and missing ones for none."""
    options = spark.createDataFrame(list(QUALITY), "id string, codec string, lossless boolean, android_supported boolean, p95_mbps int")
    if android:
        options = options.where("android_supported")
    asked = F.col("tier")
    for old, new in ALIASES.items():
        asked = F.when(asked == old, new).otherwise(asked)
    counts = requests.groupBy(asked.alias("id")).agg(F.count("*").alias("asked"))
    return F.broadcast(options).join(counts, "id", "left").select("id", "codec", "lossless", "android_supported", "p95_mbps", F.coalesce("asked", F.lit(0)).alias("asked"))


def failure_category(message):
    text = F.lower(message)
    out = None
    for name, terms in FAILURES:
        hit = F.lit(False)
        for t in terms:
            hit = hit | text.contains(t)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("encoder open failure")


def failure_categories(failures: DataFrame) -> DataFrame:
    return failures.groupBy(failure_category(F.col("error_text")).alias("category")).agg(F.count("*").alias("n"))


def encoder_choice(hosts: DataFrame, candidates: DataFrame, probes: DataFrame) -> DataFrame:
    """The first candidate that opens on each host (host, tier, profile), else an error that names every candidate tried with the category of its own failure.

    Old names of tiers count for their new ones, and only lossless-hevc has profiles.  `probes` (host, codec, options, error_text) say what opening a
    candidate gave; one that was never tried there counts as an open failure without a message.
    """
    tier = F.col("tier")
    for old, new in ALIASES.items():
        tier = F.when(tier == old, new).otherwise(tier)
    asked = hosts.select("host", F.col("tier").alias("asked"), tier.alias("tier"), F.when(tier == "lossless-hevc", F.col("profile")).otherwise("auto").alias("profile"))
    said = probes.select("host", "codec", "options", "error_text", F.lit(True).alias("tried"))
    rows = asked.join(candidates, ["tier", "profile"], "left").join(said, ["host", "codec", "options"], "left")
    opens = F.col("tried") & F.col("error_text").isNull()
    failure = F.when(F.col("codec").isNotNull() & ~F.coalesce(opens, F.lit(False)), F.struct("place", F.concat("codec", F.lit(" ["), failure_category(F.coalesce("error_text", F.lit(""))), F.lit("]")).alias("text")))
    by = rows.groupBy("host", "asked").agg(F.min_by(F.concat_ws(" ", "codec", "options"), F.when(opens, F.col("place"))).alias("encoder"), F.array_sort(F.collect_list(failure)).alias("failures"))
    detail = F.array_join(F.transform("failures", lambda x: x["text"]), "; ")
    error = F.when(F.col("encoder").isNotNull(), None).when(F.size("failures") == 0, F.concat(F.lit("unknown quality tier "), F.col("asked"))).otherwise(F.concat(F.lit("no encoder available for tier "), "asked", F.lit("; "), detail))
    return by.select("host", "encoder", error.alias("error"))


def _available(hosts: DataFrame) -> DataFrame:
    has = (F.col("has_tensorrt"), F.col("has_cuda"), F.col("has_dml"), F.lit(True))
    return hosts.withColumn("available", F.array_compact(F.array(*(F.when(h, F.lit(name)) for h, (_, name) in zip(has, PROVIDERS, strict=True)))))


def provider_choice(hosts: DataFrame) -> DataFrame:
    """Execution providers of each host in order of preference; a named one is followed by the CPU."""
    chosen = F.when(F.col("ep") == "auto", F.col("available")).otherwise(F.filter("available", lambda x: x == "CPUExecutionProvider"))
    return _available(hosts).select("host", F.array_join(chosen, ",").alias("providers"))


def provider_gap(hosts: DataFrame, *, required: tuple[str, ...] = ("CUDAExecutionProvider", "TensorrtExecutionProvider")) -> DataFrame:
    missing = F.array_except(F.array(*map(F.lit, required)), "available")
    return _available(hosts).select("host", F.explode(missing).alias("missing"))


def gpu_fallback_audit(spark: SparkSession, hosts: DataFrame) -> DataFrame:
    """Hosts that ran on the CPU though they were not asked to; no known provider counts as a fallback."""
    gpu = spark.createDataFrame([(p,) for a, p in PROVIDERS if a != "cpu"], "active_provider string")
    return hosts.where("ep <> 'cpu'").join(F.broadcast(gpu), "active_provider", "left_anti").select("host", "active_provider")


query("stage_means", "v_stage_times", stage_means, "SELECT session_id, stage, CASE WHEN x - floor(x) = 0.5 THEN 2 * round(x / 2) ELSE round(x) END / 10 AS mean_ms FROM (SELECT session_id, stage, sum(ms) / count(*) * 10 AS x FROM v_stage_times GROUP BY session_id, stage)")
query("gpu_peaks", "v_gpu", gpu_peaks, """SELECT session_id, CASE WHEN bool_and(available) THEN max(util) || '%' ELSE 'n/a' END AS util_peak, CASE WHEN bool_and(available) THEN CAST(max(mem_mb) AS VARCHAR) ELSE 'n/a' END AS vram_peak_mb FROM v_gpu GROUP BY session_id""")
query("bench_fps", "v_bench_calls", bench_fps, """SELECT model, size, count(*) - 1 AS frames, CASE WHEN count(*) > 1 THEN round((count(*) - 1) / ((sum(ms) - arg_min(ms, {'a': call, 'b': ms})) / CAST(1000 AS DOUBLE)), 4) END AS fps FROM v_bench_calls GROUP BY model, size""")


def _grid(results: DataFrame) -> DataFrame:
    return bench_grid(results.select("model").distinct(), results.select("size").distinct(), results.select("tier").distinct(), results)


query("bench_grid", "v_bench", _grid, """WITH b AS (SELECT model, size, tier, max(fps) AS fps FROM v_bench GROUP BY ALL)
SELECT model, size, tier, coalesce(CAST(round(fps, 1) AS VARCHAR), 'unavailable') AS cell FROM (SELECT DISTINCT model FROM v_bench) CROSS JOIN (SELECT DISTINCT size FROM v_bench) CROSS JOIN (SELECT DISTINCT tier FROM v_bench) LEFT JOIN b USING (model, size, tier)""")
query("realtime_viability", "v_bench", realtime_viability, """WITH b AS (SELECT model, size, max(fps) AS fps FROM v_bench GROUP BY model, size)
SELECT size, CAST(rate AS INTEGER) AS rate, arg_max(model, {'f': fps, 'm': model}) AS model FROM b CROSS JOIN (SELECT unnest([24, 30, 60]) AS rate) WHERE fps >= rate * CAST(1.3 AS DOUBLE) GROUP BY size, rate""")
query("sink_bench_report", "v_bench", lambda spark, b: write_report(b, shared_folder(spark, "report")), """WITH b AS (SELECT model, size, CAST(round(max(fps), 1) AS VARCHAR) AS c FROM v_bench GROUP BY model, size),
c AS (SELECT model, coalesce(max(CASE WHEN size = '720p' THEN c END), 'n/a') AS p720, coalesce(max(CASE WHEN size = '1080p' THEN c END), 'n/a') AS p1080, coalesce(max(CASE WHEN size = '1440p' THEN c END), 'n/a') AS p1440 FROM b GROUP BY model)
SELECT model, p720, p1080, p1440, '| ' || model || ' | ' || p720 || ' | ' || p1080 || ' | ' || p1440 || ' |' AS line FROM c""", with_spark=True)
query("quality_options", "v_quality_requests", quality_options, """WITH o AS (SELECT * FROM (VALUES ('lossless-hevc', 'hevc', true, true, NULL), ('hevc-qp2', 'hevc', false, true, 350), ('hevc-qp4', 'hevc', false, true, 250), ('hevc-qp6', 'hevc', false, true, 200), ('hevc-qp10', 'hevc', false, true, 100),
 ('hevc-qp14', 'hevc', false, true, 50), ('hevc-qp18', 'hevc', false, true, 50), ('lossless-ffv1', 'ffv1', true, false, NULL)) t(id, codec, lossless, android_supported, p95_mbps)),
n AS (SELECT CASE tier WHEN 'visually-lossless' THEN 'hevc-qp18' ELSE tier END AS id, count(*) AS asked FROM v_quality_requests GROUP BY 1)
SELECT id, codec, lossless, android_supported, p95_mbps, coalesce(asked, 0) AS asked FROM o LEFT JOIN n USING (id)""", with_spark=True)
_CAT = """CASE WHEN regexp_matches(lower(error_text), 'no free|resource|session|out of memory|too many') THEN 'session/resource exhaustion' WHEN regexp_matches(lower(error_text), 'option|invalid argument|not supported') THEN 'unsupported options'
 WHEN regexp_matches(lower(error_text), 'not found|unknown encoder|driver|library') THEN 'missing encoder/driver' WHEN regexp_matches(lower(error_text), 'device|cuda|nvenc|hardware') THEN 'device/driver failure' ELSE 'encoder open failure' END"""
query("failure_categories", "v_hosts", failure_categories, f"SELECT {_CAT} AS category, count(*) AS n FROM v_hosts GROUP BY 1")
query("encoder_choice", "v_hosts v_candidates v_probes", encoder_choice, f"""WITH h AS (SELECT host, tier AS asked, CASE tier WHEN 'visually-lossless' THEN 'hevc-qp18' ELSE tier END AS tier, CASE WHEN tier = 'lossless-hevc' THEN profile ELSE 'auto' END AS profile FROM v_hosts),
p AS (SELECT h.host, h.asked, c.place, c.codec, c.options, error_text, {_CAT} AS category FROM h LEFT JOIN v_candidates c USING (tier, profile) LEFT JOIN v_probes b ON b.host = h.host AND b.codec = c.codec AND b.options = c.options),
g AS (SELECT host, asked, arg_min(codec || ' ' || options, place) FILTER (WHERE error_text IS NULL AND codec IS NOT NULL) AS encoder, string_agg(codec || ' [' || category || ']', '; ' ORDER BY place) FILTER (WHERE codec IS NOT NULL) AS detail FROM p GROUP BY host, asked)
SELECT host, encoder, CASE WHEN encoder IS NULL THEN CASE WHEN detail IS NULL THEN 'unknown quality tier ' || asked ELSE 'no encoder available for tier ' || asked || '; ' || detail END END AS error FROM g""")
query("provider_choice", "v_hosts", provider_choice, """SELECT host, CASE WHEN ep <> 'auto' THEN '' ELSE CASE WHEN has_tensorrt THEN 'TensorrtExecutionProvider,' ELSE '' END || CASE WHEN has_cuda THEN 'CUDAExecutionProvider,' ELSE '' END
 || CASE WHEN has_dml THEN 'DmlExecutionProvider,' ELSE '' END END || 'CPUExecutionProvider' AS providers FROM v_hosts""")
query("provider_gap", "v_hosts", provider_gap, "SELECT host, 'CUDAExecutionProvider' AS missing FROM v_hosts WHERE NOT has_cuda UNION ALL SELECT host, 'TensorrtExecutionProvider' FROM v_hosts WHERE NOT has_tensorrt")
query("gpu_fallback_audit", "v_hosts", gpu_fallback_audit, "SELECT host, active_provider FROM v_hosts WHERE ep <> 'cpu' AND (active_provider IS NULL OR active_provider = 'CPUExecutionProvider')", with_spark=True)
