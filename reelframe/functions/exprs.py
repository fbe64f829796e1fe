"""Column helpers that several jobs share; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of playable files.
PLAYABLE = (".mkv", ".mp4", ".m4v", ".avi", ".mov", ".ts", ".webm")


def fold(name: Column) -> Column:
    """Case-folded for sorting: lower case with the sharp s spelt out."""
    return F.replace(F.lower(name), F.lit("ß"), F.lit("ss"))


def suffix(name: Column) -> Column:
    """Last suffix in lower case; names that only begin with a dot have none."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def playable(name: Column) -> Column:
    return suffix(name).isin(*PLAYABLE)


def whole(x: Column) -> Column:
    """Rounded down, as a long."""
    return F.floor(x).cast("long")


def infer_scale(model: Column) -> Column:
    """Scale factor that a model's name states (2x, x4, ...), else 2; digits on either side of the token forbid it."""
    # Fixed value: the pattern of a scale in a name.
    pattern = r"(?i)(?<!\d)(?:([1-9]\d*)x|x([1-9]\d*))(?!\d)"
    found = F.coalesce(F.nullif(F.regexp_extract(model, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(model, pattern, 2), F.lit("")))
    return F.coalesce(found.cast("long"), F.lit(2).cast("long"))


def safe_name(name: Column, fallback: Column, *, cut_after_fallback: bool = False) -> Column:
    """A bounded, plain base name: after the last slash, no control characters, runs of others as one underscore."""
    base = F.substring_index(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/")), "/", -1)
    # The characters that a safe name drops, folds and trims, and its length.
    base = F.regexp_replace(base, r"[\x00-\x1f\x7f]", "")
    base = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_"), r"^[ ._]+|[ ._]+$", "")
    if cut_after_fallback:
        return F.left(F.coalesce(F.nullif(base, F.lit("")), fallback), F.lit(128))
    return F.coalesce(F.nullif(F.left(base, F.lit(128)), F.lit("")), fallback)


def aligned(x: Column, align: Column) -> Column:
    return F.greatest(align, whole(x / align) * align)


def fit_size(w: Column, h: Column, tw: Column, th: Column, align: Column) -> tuple[Column, Column]:
    """Largest aligned size of the same aspect inside a display; halves round to even, one step back where that pokes out."""
    scale = F.least(tw / w, th / h)
    fw = F.greatest(align, F.rint(w * scale / align).cast("long") * align)
    fh = F.greatest(align, F.rint(h * scale / align).cast("long") * align)
    return F.when(fw > tw, fw - align).otherwise(fw), F.when(fh > th, fh - align).otherwise(fh)


def cover_size(w: Column, h: Column, tw: Column, th: Column, align: Column) -> tuple[Column, Column]:
    """Smallest aligned size of the same aspect that covers a display."""
    scale = F.greatest(tw / w, th / h)
    fw = F.greatest(align, F.rint(w * scale / align).cast("long") * align)
    fh = F.greatest(align, F.rint(h * scale / align).cast("long") * align)
    return F.when(fw < tw, fw + align).otherwise(fw), F.when(fh < th, fh + align).otherwise(fh)


def crop_box(w: Column, h: Column, tw: Column, th: Column, align: Column) -> tuple[Column, Column, Column, Column]:
    """Centred aligned source rectangle with a display's aspect: x, y, width, height."""
    tw, th, aw, ah = aligned(tw, align), aligned(th, align), aligned(w, align), aligned(h, align)
    wide = aw * th > ah * tw
    cw = F.least(aw, F.when(wide, F.greatest(align, whole(whole(ah * tw / th) / align) * align)).otherwise(aw))
    ch = F.least(ah, F.when(wide, ah).otherwise(F.greatest(align, whole(whole(aw * th / tw) / align) * align)))
    x = F.greatest(F.lit(0).cast("long"), whole((w - cw) / (align * 2)) * align)
    y = F.greatest(F.lit(0).cast("long"), whole((h - ch) / (align * 2)) * align)
    return x, y, cw, ch
