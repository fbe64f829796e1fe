"""Frame sizes: fitting, covering, cropping, display plans and tile grids, all as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.functions.exprs import aligned, cover_size, crop_box, fit_size
from reelframe.plans.registry import query

#: Tile sizes in order of preference, and the activation bytes of a pixel beyond its 3 channels of 4 bytes.
LADDER, FUDGE = (1024, 512, 256, 128), 24


def _args() -> list[Column]:
    return [F.col(c) for c in ("w", "h", "tw", "th", "align")]


def fit_dims(sizes: DataFrame) -> DataFrame:
    w, h = fit_size(*_args())
    return sizes.select("size_id", w.alias("out_w"), h.alias("out_h"))


def cover_dims(sizes: DataFrame) -> DataFrame:
    w, h = cover_size(*_args())
    return sizes.select("size_id", w.alias("out_w"), h.alias("out_h"))


def cover_crop(sizes: DataFrame) -> DataFrame:
    return sizes.select("size_id", *(c.alias(n) for c, n in zip(crop_box(*_args()), ("x", "y", "crop_w", "crop_h"), strict=True)))


def aligned_target(sizes: DataFrame) -> DataFrame:
    """Displays rounded down to the alignment; sizes that are not positive are an error row."""
    bad = (F.col("tw") <= 0) | (F.col("th") <= 0) | (F.col("align") <= 0)
    return sizes.select("size_id", F.when(~bad, aligned(F.col("tw"), F.col("align"))).alias("out_w"), F.when(~bad, aligned(F.col("th"), F.col("align"))).alias("out_h"), F.when(bad, "not positive").alias("error"))


def display_plan(sizes: DataFrame) -> DataFrame:
    """Output size of each source with its model's scale on its display, by fit mode."""
    rows = sizes.withColumn("w", F.col("w") * F.col("scale")).withColumn("h", F.col("h") * F.col("scale"))
    fw, fh = fit_size(*_args())
    cover = F.col("fit_mode") == "cover"
    w, h = F.when(cover, aligned(F.col("tw"), F.col("align"))).otherwise(fw), F.when(cover, aligned(F.col("th"), F.col("align"))).otherwise(fh)
    return rows.select("size_id", "fit_mode", w.alias("out_w"), h.alias("out_h"))


def _starts(dim: Column, tile: int, step: int) -> Column:
    inner = F.when(dim - tile - 1 >= 0, F.sequence(F.lit(0).cast("long"), dim - tile - 1, F.lit(step).cast("long")))
    return F.when(dim <= tile, F.array(F.lit(0).cast("long"))).otherwise(F.array_append(inner, dim - tile))


def tile_grid(sizes: DataFrame, *, tile: int = 512, overlap: int = 16) -> DataFrame:
    """Tiles of each frame with the part of each that is kept; the last tile of an axis lies flush with the edge."""
    if overlap % 2:
        raise ValueError("overlap must be even")
    rows = sizes.select("size_id", "w", "h", F.explode(_starts(F.col("h"), tile, tile - overlap)).alias("y0")).select("*", F.explode(_starts(F.col("w"), tile, tile - overlap)).alias("x0"))
    tw, th = F.least(F.lit(tile), F.col("w") - F.col("x0")), F.least(F.lit(tile), F.col("h") - F.col("y0"))
    m = overlap // 2
    rows = rows.withColumn("tw", tw.cast("long")).withColumn("th", th.cast("long"))
    margin = lambda c: F.when(c, m).otherwise(0)
    return rows.select(
        "size_id", "x0", "y0", "tw", "th", margin(F.col("x0") > 0).alias("left"), margin(F.col("y0") > 0).alias("top"), margin(F.col("x0") + F.col("tw") < F.col("w")).alias("right"), margin(F.col("y0") + F.col("th") < F.col("h")).alias("bottom")
    )


def auto_tile(sizes: DataFrame) -> DataFrame:
    """Largest tile whose activations fit in 80 % of the free memory; null is the whole frame.  A model whose scale isn't known yet counts as one of 4."""
    scale = F.coalesce("scale", F.lit(4))
    px = (scale * scale + 1) * (12 * FUDGE)
    budget = F.col("free_mb") * 1048576 * 0.8
    pick = F.when(F.col("free_mb").isNull() | (F.col("h") * F.col("w") * px <= budget), F.lit(None).cast("int"))
    for t in LADDER:
        pick = pick.when(F.lit(t * t) * px <= budget, F.lit(t))
    return sizes.select("size_id", pick.otherwise(LADDER[-1]).alias("tile"))


def _half_even(x: str) -> str:
    return f"CASE WHEN {x} - floor({x}) = 0.5 THEN 2 * round({x} / 2) ELSE round({x}) END"


def _scaled(kind: str) -> str:
    fw, fh = _half_even(f"w * CAST({kind}(tw / w, th / h) AS DOUBLE) / align"), _half_even(f"h * CAST({kind}(tw / w, th / h) AS DOUBLE) / align")
    return f"SELECT *, greatest(align, CAST({fw} AS BIGINT) * align) AS fw, greatest(align, CAST({fh} AS BIGINT) * align) AS fh FROM"


_DOWN = "greatest(align, tw // align * align) AS atw, greatest(align, th // align * align) AS ath"
query("fit_dims", "v_sizes", fit_dims, f"SELECT size_id, CASE WHEN fw > tw THEN fw - align ELSE fw END AS out_w, CASE WHEN fh > th THEN fh - align ELSE fh END AS out_h FROM ({_scaled('least')} v_sizes)")
query("cover_dims", "v_sizes", cover_dims, f"SELECT size_id, CASE WHEN fw < tw THEN fw + align ELSE fw END AS out_w, CASE WHEN fh < th THEN fh + align ELSE fh END AS out_h FROM ({_scaled('greatest')} v_sizes)")
query("cover_crop", "v_sizes", cover_crop, f"""WITH a AS (SELECT *, {_DOWN}, greatest(align, w // align * align) AS aw, greatest(align, h // align * align) AS ah FROM v_sizes),
c AS (SELECT *, least(aw, CASE WHEN aw * ath > ah * atw THEN greatest(align, ah * atw // ath // align * align) ELSE aw END) AS crop_w, least(ah, CASE WHEN aw * ath > ah * atw THEN ah ELSE greatest(align, aw * ath // atw // align * align) END) AS crop_h FROM a)
SELECT size_id, greatest(0, (w - crop_w) // (2 * align) * align) AS x, greatest(0, (h - crop_h) // (2 * align) * align) AS y, crop_w, crop_h FROM c""")
query("aligned_target", "v_sizes", aligned_target, f"SELECT size_id, atw AS out_w, ath AS out_h, CAST(NULL AS VARCHAR) AS error FROM (SELECT *, {_DOWN} FROM v_sizes)")
query("display_plan", "v_sizes", display_plan, f"""SELECT size_id, fit_mode, CASE WHEN fit_mode = 'cover' THEN atw WHEN fw > tw THEN fw - align ELSE fw END AS out_w, CASE WHEN fit_mode = 'cover' THEN ath WHEN fh > th THEN fh - align ELSE fh END AS out_h
FROM (SELECT *, {_DOWN} FROM ({_scaled('least')} (SELECT * REPLACE (w * scale AS w, h * scale AS h) FROM v_sizes)))""")
query("tile_grid", "v_sizes", tile_grid, """WITH s AS (SELECT *, CASE WHEN h <= 512 THEN [0] ELSE list_append(range(0, h - 512, 496), h - 512) END AS ys, CASE WHEN w <= 512 THEN [0] ELSE list_append(range(0, w - 512, 496), w - 512) END AS xs FROM v_sizes),
g AS (SELECT size_id, w, h, x0, unnest(ys) AS y0 FROM (SELECT *, unnest(xs) AS x0 FROM s))
SELECT size_id, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, least(512, w - x0) AS tw, least(512, h - y0) AS th, CASE WHEN x0 > 0 THEN 8 ELSE 0 END AS left, CASE WHEN y0 > 0 THEN 8 ELSE 0 END AS top,
 CASE WHEN x0 + least(512, w - x0) < w THEN 8 ELSE 0 END AS right, CASE WHEN y0 + least(512, h - y0) < h THEN 8 ELSE 0 END AS bottom FROM g""".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))
query("auto_tile", "v_sizes", lambda s: auto_tile(s.withColumn("scale", F.when(F.col("size_id") % 17 != 0, F.col("scale")))), """WITH n AS (SELECT * REPLACE (CASE WHEN size_id % 17 <> 0 THEN scale ELSE 4 END AS scale) FROM v_sizes),
b AS (SELECT *, (1 + scale * scale) * 288 AS px, free_mb * 1048576 * CAST(0.8 AS DOUBLE) AS budget FROM n)
SELECT size_id, CASE WHEN free_mb IS NULL OR h * w * px <= budget THEN NULL WHEN 1048576 * px <= budget THEN 1024 WHEN 262144 * px <= budget THEN 512 WHEN 65536 * px <= budget THEN 256 ELSE 128 END AS tile FROM b""")
