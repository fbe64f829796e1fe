"""Media catalogues: what is playable, what a path means, and how a directory is sorted and paged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelframe.functions.exprs import fold, infer_scale, playable
from reelframe.functions.scan import running
from reelframe.plans.registry import query

COLUMNS = ("path", "parent", "name", "is_dir", "mtime", "length")


def filter_playable(catalog: DataFrame) -> DataFrame:
    """Directories and files with a playable suffix; links are skipped."""
    return catalog.where(~F.col("is_symlink") & (F.col("is_dir") | playable(F.col("name")))).select(*COLUMNS)


def classify_paths(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Verdict on each requested file: invalid, not_found, not_playable or ok."""
    parts = F.filter(F.split("request", "/"), lambda x: (x != "") & (x != "."))
    asked = requests.withColumn("path", F.array_join(parts, "/")).withColumn(
        "bad", (F.col("request") == "") | F.col("request").contains("\\") | F.col("request").startswith("/") | F.array_contains(parts, "..") | (F.size(parts) == 0)
    )
    known = catalog.where(~F.col("is_symlink")).select("path", "name", "is_dir")
    status = (
        F.when(F.col("bad"), "invalid").when(F.col("name").isNull() | F.col("is_dir"), "not_found").when(~playable(F.col("name")), "not_playable").otherwise("ok")
    )
    return asked.join(known, "path", "left").select("request", status.alias("status"))


def _order(sort: str) -> list:
    keys = {"name": [fold(F.col("name")), F.col("path")], "mtime": [F.desc("mtime"), fold(F.col("name")), F.col("path")]}
    if sort not in keys:
        raise ValueError(f"unknown sort key {sort!r}")
    return [~F.col("is_dir"), *keys[sort]]


def _ranked(catalog: DataFrame, sort: str) -> DataFrame:
    order = W.partitionBy("parent").orderBy(*_order(sort))
    return filter_playable(catalog).withColumn("position", F.row_number().over(order).cast("long"))


def _sorted(catalog: DataFrame, sort: str) -> DataFrame:
    """Positions by a running count, so that a directory of any size is numbered by many tasks."""
    return running(filter_playable(catalog), ["parent"], _order(sort), {"position": ("sum", F.lit(1).cast("long"))}).select("parent", "path", "position")


def library_sort_name(catalog: DataFrame) -> DataFrame:
    """Each directory's entries in order: directories first, then by folded name."""
    return _sorted(catalog, "name")


def library_sort_mtime(catalog: DataFrame) -> DataFrame:
    """Each directory's entries in order: directories first, then newest first."""
    return _sorted(catalog, "mtime")


def library_page(catalog: DataFrame, path: str | None = None, *, offset: int = 0, limit: int = 100, sort: str = "name") -> DataFrame:
    """One page of a directory (or of every directory) and the cursor of the next page, null on the last."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    limit = min(limit, 500)
    # one entry beyond the page tells whether there is a next one, so no task ranks or counts more than that many rows of a directory at once
    rows = _ranked(catalog if path is None else catalog.where(F.col("parent") == path), sort).where(F.col("position") <= offset + limit + 1)
    rows = rows.withColumn("last", F.max("position").over(W.partitionBy("parent")))
    cursor = F.when(F.col("last") > offset + limit, F.lit(str(offset + limit)))
    return rows.where((F.col("position") > offset) & (F.col("position") <= offset + limit)).select("parent", "path", "position", cursor.alias("next_cursor"))


def newest_per_directory(catalog: DataFrame, *, k: int = 3) -> DataFrame:
    return _ranked(catalog.where(~F.col("is_dir")), "mtime").where(F.col("position") <= k).select("parent", "path", "mtime", "position")


def models_with_manifest(models: DataFrame) -> DataFrame:
    """Sidecar where there is one (its null scale stays), else the scale that the name states."""
    scale = F.when(F.col("has_sidecar"), F.col("sidecar_scale")).otherwise(infer_scale(F.col("model")))
    return models.select("model_id", "model", scale.alias("scale"))


def models_plus_passthrough(models: DataFrame) -> DataFrame:
    """All models and the built-in one of scale 1."""
    built_in = models.groupBy().agg(F.lit(0).cast("long").alias("model_id"), F.lit("passthrough").alias("model"), F.lit(1).cast("long").alias("scale"))
    return models_with_manifest(models).unionByName(built_in)


def model_list(models: DataFrame) -> DataFrame:
    """Names once each in order, the built-in model last."""
    names = models_plus_passthrough(models).groupBy("model").agg(F.min("scale").alias("scale"))
    return names.withColumn("is_last", F.col("model") == "passthrough").orderBy("is_last", "model")


_PLAYABLE = "lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) IN ('.mkv', '.mp4', '.m4v', '.avi', '.mov', '.ts', '.webm')"
_OK = f"SELECT * FROM v_catalog WHERE NOT is_symlink AND (is_dir OR {_PLAYABLE})"
_FOLD = "replace(lower(name), 'ß', 'ss')"
_SCALE = """coalesce(CAST(nullif(regexp_extract(' ' || model || ' ', '[^0-9]([1-9][0-9]*)[xX][^0-9]', 1), '') AS BIGINT), CAST(nullif(regexp_extract(' ' || model || ' ', '[^0-9][xX]([1-9][0-9]*)[^0-9]', 1), '') AS BIGINT), 2)"""

query("filter_playable", "v_catalog", filter_playable, f"SELECT path, parent, name, is_dir, mtime, length FROM ({_OK})")
query(
    "classify_paths",
    "v_requests v_catalog",
    classify_paths,
    f"""WITH n AS (SELECT request, list_filter(string_split(request, '/'), lambda x: x <> '' AND x <> '.') AS p FROM v_requests)
SELECT request, CASE WHEN request = '' OR contains(request, chr(92)) OR request LIKE '/%' OR list_contains(p, '..') OR len(p) = 0 THEN 'invalid'
 WHEN c.name IS NULL OR c.is_dir THEN 'not_found' WHEN NOT ({_PLAYABLE}) THEN 'not_playable' ELSE 'ok' END AS status
FROM n LEFT JOIN (SELECT * FROM v_catalog WHERE NOT is_symlink) c ON array_to_string(p, '/') = c.path""",
)
query("library_sort_name", "v_catalog", library_sort_name, f"SELECT parent, path, row_number() OVER (PARTITION BY parent ORDER BY NOT is_dir, {_FOLD}, path) AS position FROM ({_OK})")
query("library_sort_mtime", "v_catalog", library_sort_mtime, f"SELECT parent, path, row_number() OVER (PARTITION BY parent ORDER BY NOT is_dir, mtime DESC, {_FOLD}, path) AS position FROM ({_OK})")
query(
    "library_page",
    "v_catalog",
    lambda c: library_page(c, offset=10, limit=20, sort="mtime"),
    f"""SELECT parent, path, position, CASE WHEN total > 30 THEN '30' END AS next_cursor FROM (SELECT parent, path, row_number() OVER (PARTITION BY parent ORDER BY NOT is_dir, mtime DESC, {_FOLD}, path) AS position,
 count(*) OVER (PARTITION BY parent) AS total FROM ({_OK})) WHERE position > 10 AND position <= 30""",
)
query("newest_per_directory", "v_catalog", newest_per_directory, f"SELECT parent, path, mtime, position FROM (SELECT parent, path, mtime, row_number() OVER (PARTITION BY parent ORDER BY mtime DESC, {_FOLD}, path) AS position FROM ({_OK}) WHERE NOT is_dir) WHERE position <= 3")
query("infer_scale", "v_models", lambda m: m.select("model_id", "model", infer_scale(F.col("model")).alias("scale")), f"SELECT model_id, model, {_SCALE} AS scale FROM v_models")
_WITH_MANIFEST = f"SELECT model_id, model, CASE WHEN has_sidecar THEN sidecar_scale ELSE {_SCALE} END AS scale FROM v_models"
query("models_with_manifest", "v_models", models_with_manifest, _WITH_MANIFEST)
query("models_plus_passthrough", "v_models", models_plus_passthrough, f"{_WITH_MANIFEST} UNION ALL SELECT 0, 'passthrough', 1")
query("model_list", "v_models", model_list, f"SELECT model, min(scale) AS scale, model = 'passthrough' AS is_last FROM ({_WITH_MANIFEST} UNION ALL SELECT 0, 'passthrough', 1) GROUP BY model")
