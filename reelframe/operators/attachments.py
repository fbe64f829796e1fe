"""Content-addressed attachments: manifests, caches, budgets, eviction and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelframe.functions.exprs import safe_name
from reelframe.functions.scan import running
from reelframe.plans.registry import query

# Largest attachment, and largest manifest or set of attachments, in bytes.
MAX_OBJECT, MAX_TOTAL = 64 * 1024 * 1024, 256 * 1024 * 1024
# Font types that a client may cache.
FONT_TYPES = ("font/ttf", "font/otf", "application/x-font-ttf")


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def running_budget(df: DataFrame, by: str, size: str, limit: int, order: str) -> DataFrame:
    """Running total of sizes and whether it is over the limit at this row."""
    total = F.sum(size).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("running", total).withColumn("over", F.col("running") > limit)


def validate_manifest(manifest: DataFrame, *, max_object: int = MAX_OBJECT, max_total: int = MAX_TOTAL) -> DataFrame:
    """Status of every row (invalid_hash, invalid_size, duplicate, over_limit or ok) and whether its session's manifest is accepted.

    Rows are checked before repeats are skipped; only first occurrences count towards the total.
    """
    digest = F.lower(F.coalesce("sha256", F.lit("")))
    rows = manifest.withColumn("digest", digest).withColumn(
        "bad", F.when(~F.col("digest").rlike("^[0-9a-f]{64}$"), "invalid_hash").when(F.col("size").isNull() | (F.col("size") < 0) | (F.col("size") > max_object), "invalid_size")
    )
    rn = F.row_number().over(W.partitionBy("session_id", "digest").orderBy(F.col("bad").isNotNull(), "pos"))
    rows = rows.withColumn("first", F.col("bad").isNull() & (rn == 1))
    running = F.sum(F.when(F.col("first"), F.col("size")).otherwise(0)).over(W.partitionBy("session_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    status = F.coalesce("bad", F.when(~F.col("first"), "duplicate"), F.when(running > max_total, "over_limit"), F.lit("ok"))
    rows = rows.withColumn("status", status)
    accepted = F.min(F.col("status").isin("ok", "duplicate").cast("int")).over(W.partitionBy("session_id")) == 1
    return rows.select("session_id", "pos", "status", accepted.alias("accepted"))


def cache_misses(manifest: DataFrame, store: DataFrame) -> DataFrame:
    """Declared objects that the store does not hold in the declared size."""
    wanted = manifest.where("size >= 0").select("session_id", "sha256", "size").distinct()
    return wanted.join(store.select("sha256", "size"), ["sha256", "size"], "left_anti").select("session_id", "sha256", "size")


def authorized_objects(requests: DataFrame, sessions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Status of requests (pos, auth, digest) for objects of sessions (session_id, token, state) and their manifests.

    401 without a bearer token, 404 for a digest that is none (any case counts), 401 where no live session has the token, 404 where its manifest lacks the object, else 200.
    """
    live = sessions.where("state <> 'closed'").groupBy("token").agg(F.min("session_id").alias("session_id"))
    named = manifest.select("session_id", F.lower("sha256").alias("digest"), F.lit(True).alias("named")).distinct()
    bearer = F.coalesce(F.col("auth").startswith("Bearer "), F.lit(False))
    rows = requests.select("pos", bearer.alias("bearer"), F.when(bearer, F.trim(F.substring("auth", 8, 1 << 20))).alias("token"), F.lower("digest").alias("digest"))
    rows = rows.join(live, "token", "left").join(named, ["session_id", "digest"], "left")
    fine = F.coalesce(F.col("digest").rlike("^[0-9a-f]{64}$"), F.lit(False))
    return rows.select("pos", F.when(~F.col("bearer"), 401).when(~fine, 404).when(F.col("session_id").isNull(), 401).when(F.col("named").isNull(), 404).otherwise(200).alias("status"))


def lru_evict(store: DataFrame, *, limit_bytes: int, max_entries: int | None = None) -> DataFrame:
    """Objects to delete, oldest first, so that each store fits; protected ones stay but count.  A store of any size is scanned by many tasks."""
    unprotected = F.when(F.col("protected"), 0).otherwise(1).cast("long")
    rows = running(store, ["store"], ["mtime", "size", "sha256"], {"freed": ("sum", unprotected * F.col("size")), "gone": ("sum", unprotected)})
    totals = store.groupBy("store").agg(F.sum("size").alias("bytes"), F.count("*").alias("entries"))
    over = F.col("bytes") - (F.col("freed") - F.col("size")) > limit_bytes  # of rows that are not protected, so `freed` holds their own size
    if max_entries is not None:
        over = over | (F.col("entries") - (F.col("gone") - 1) > max_entries)
    return rows.where("NOT protected").join(totals, "store").where(over).select("store", "sha256", "size")


def unique_view_names(manifest: DataFrame) -> DataFrame:
    """File names of a session's view; a name that was used before gets eight digits of the hash before its suffix."""
    rows = dedupe_first(manifest.where("size >= 0"), ["session_id", "sha256"], ["pos"])
    again = F.row_number().over(W.partitionBy("session_id", "name").orderBy("pos")) > 1
    stem, ext = F.regexp_extract("name", r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"^.+?(\.[^.]*)$", 1)
    return rows.select("session_id", "pos", F.when(again, F.concat(stem, F.lit("-"), F.left("sha256", F.lit(8)), ext)).otherwise(F.col("name")).alias("view_name"))


def attachment_totals(attachments: DataFrame, *, max_object: int = MAX_OBJECT, max_total: int = MAX_TOTAL) -> DataFrame:
    """Bytes of each file's attachments and whether a client may cache them all."""
    rows = attachments.where("size >= 0").groupBy("session_id").agg(F.sum("size").alias("bytes"), F.bool_and(F.lower("mimetype").isin(*FONT_TYPES) & (F.col("size") <= max_object)).alias("fonts"))
    return rows.select("session_id", "bytes", (F.col("fonts") & (F.col("bytes") <= max_total)).alias("cacheable"))


def attachment_names(attachments: DataFrame) -> DataFrame:
    """Both variants of the safe name."""
    ugly = F.concat(F.lit("dir/"), F.when(F.col("pos") % 5 == 0, " ._ ").otherwise(F.concat(F.col("name"), F.lit("\t!?"))))
    return attachments.select(
        "session_id", "pos", safe_name(ugly, F.concat(F.lit("font-"), F.left("sha256", F.lit(12)))).alias("cache_name"), safe_name(ugly, F.lit("attachment"), cut_after_fallback=True).alias("wire_name")
    )


query("content_hash", "documents", lambda d: d.select("doc_id", F.sha2("text", 256).alias("sha256")), "SELECT doc_id, sha256(text) AS sha256 FROM documents")
query("safe_name", "v_attachments", attachment_names, """WITH u AS (SELECT *, 'dir/' || CASE WHEN pos % 5 = 0 THEN ' ._ ' ELSE name || chr(9) || '!?' END AS raw FROM v_attachments),
s AS (SELECT *, trim(regexp_replace(regexp_replace(string_split(raw, '/')[-1], '[\\x00-\\x1f\\x7f]', '', 'g'), '[^A-Za-z0-9._-]+', '_', 'g'), ' ._') AS base FROM u)
SELECT session_id, pos, CASE WHEN base = '' THEN 'font-' || left(sha256, 12) ELSE left(base, 128) END AS cache_name, left(CASE WHEN base = '' THEN 'attachment' ELSE base END, 128) AS wire_name FROM s""")
query("dedupe_first", "v_attachments", lambda a: dedupe_first(a, ["session_id", "sha256"], ["pos"]).select("session_id", "sha256", "pos"), "SELECT session_id, sha256, min(pos) AS pos FROM v_attachments GROUP BY session_id, sha256")
query("running_budget", "v_attachments", lambda a: running_budget(a, "session_id", "size", 100_000, "pos").select("session_id", "pos", "running", "over"),
      """SELECT session_id, pos, running, running > 100000 AS over FROM (SELECT *, CAST(sum(size) OVER (PARTITION BY session_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM v_attachments)""")
query("validate_manifest", "v_attachments", lambda a: validate_manifest(a, max_object=20_000, max_total=100_000), """WITH b AS (SELECT *, CASE WHEN NOT regexp_full_match(lower(sha256), '[0-9a-f]{64}') THEN 'invalid_hash' WHEN size < 0 OR size > 20000 THEN 'invalid_size' END AS bad FROM v_attachments),
f AS (SELECT *, bad IS NULL AND pos = (SELECT min(c.pos) FROM b c WHERE c.session_id = b.session_id AND lower(c.sha256) = lower(b.sha256) AND c.bad IS NULL) AS first FROM b),
r AS (SELECT *, sum(CASE WHEN first THEN size ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS running FROM f),
s AS (SELECT *, CASE WHEN bad IS NOT NULL THEN bad WHEN NOT first THEN 'duplicate' WHEN running > 100000 THEN 'over_limit' ELSE 'ok' END AS status FROM r)
SELECT session_id, pos, status, bool_and(status IN ('ok', 'duplicate')) OVER (PARTITION BY session_id) AS accepted FROM s""")
query("cache_misses", "v_attachments v_store", cache_misses, "SELECT DISTINCT session_id, sha256, size FROM v_attachments a WHERE size >= 0 AND NOT EXISTS (SELECT 1 FROM v_store s WHERE s.sha256 = a.sha256 AND s.size = a.size)")
query("authorized_objects", "v_object_requests v_tokens v_attachments", authorized_objects, """SELECT pos, CAST(CASE WHEN auth IS NULL OR auth NOT LIKE 'Bearer %' THEN 401 WHEN NOT regexp_full_match(lower(digest), '[0-9a-f]{64}') THEN 404
 WHEN NOT EXISTS (SELECT 1 FROM v_tokens t WHERE t.token = trim(substr(auth, 8)) AND t.state <> 'closed') THEN 401
 WHEN NOT EXISTS (SELECT 1 FROM v_tokens t JOIN v_attachments a USING (session_id) WHERE t.token = trim(substr(auth, 8)) AND t.state <> 'closed' AND a.sha256 = lower(digest)) THEN 404 ELSE 200 END AS INTEGER) AS status FROM v_object_requests""")
_EVICT = """WITH c AS (SELECT *, sum(size) OVER (PARTITION BY store) AS total, count(*) OVER (PARTITION BY store) AS entries,
 coalesce(sum(CASE WHEN protected THEN 0 ELSE size END) OVER (PARTITION BY store ORDER BY mtime, size, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
 coalesce(sum(CASE WHEN protected THEN 0 ELSE 1 END) OVER (PARTITION BY store ORDER BY mtime, size, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM v_store)
SELECT store, sha256, size FROM c WHERE NOT protected AND """
query("lru_evict", "v_store", lambda s: lru_evict(s, limit_bytes=50_000), _EVICT + "total - before > 50000")
query("lru_evict_entries", "v_store", lambda s: lru_evict(s, limit_bytes=500_000, max_entries=20), _EVICT + "(total - before > 500000 OR entries - gone > 20)")
query("unique_view_names", "v_attachments", unique_view_names, """WITH f AS (SELECT * FROM v_attachments a WHERE size >= 0 AND pos = (SELECT min(b.pos) FROM v_attachments b WHERE b.size >= 0 AND b.session_id = a.session_id AND b.sha256 = a.sha256)),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, name ORDER BY pos) AS rn FROM f)
SELECT session_id, pos, CASE WHEN rn > 1 THEN replace(name, '.ttf', '') || '-' || left(sha256, 8) || '.ttf' ELSE name END AS view_name FROM n""")
query("attachment_totals", "v_attachments", lambda a: attachment_totals(a, max_object=20_000, max_total=150_000), """SELECT session_id, CAST(sum(size) AS BIGINT) AS bytes, bool_and(lower(mimetype) IN ('font/ttf', 'font/otf', 'application/x-font-ttf') AND size <= 20000) AND sum(size) <= 150000 AS cacheable
FROM v_attachments WHERE size >= 0 GROUP BY session_id""")
