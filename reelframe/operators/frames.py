"""Frame tables: synthetic clips, stages with state, super-resolution whole or by tiles, fitting, and checks.

A frame is a row (clip_id, pts, h, w, rgb) with row-major bytes.  Numpy runs inside tasks on whole Arrow batches; frames are independent, so
clips spread over the cluster, and only stages with state group a clip.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelframe.operators.sessions import ALGORITHMS
from reelframe.operators.sizes import tile_grid
from reelframe.plans.registry import QUERIES
from reelframe.plans.views import view

SCHEMA = "clip_id long, pts long, h long, w long, rgb binary"
NAMES = ["clip_id", "pts", "h", "w", "rgb"]
Model = Callable[[np.ndarray], np.ndarray]


def frames_from_embeddings(embeddings: DataFrame) -> DataFrame:
    """The test clips: each vector is an 8 x 8 grey frame, each label a clip."""
    grey = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.rint((x + 0.6) * 212).cast("int"))))
    pixels = F.transform(F.slice(grey, F.lit(1), F.lit(64)), lambda v: F.repeat(F.lpad(F.hex(v), 2, F.lit("0")), F.lit(3)))
    order = W.partitionBy("label").orderBy("vec_id")
    return embeddings.select(F.col("label").cast("long").alias("clip_id"), (F.row_number().over(order) * 40).cast("long").alias("pts"), F.lit(8).cast("long").alias("h"), F.lit(8).cast("long").alias("w"), F.unhex(F.array_join(pixels, "")).alias("rgb"))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    columns = [batch.column(batch.schema.get_field_index(n)) for n in NAMES]
    for clip, pts, h, w, rgb in zip(*(c.to_pylist() for c in columns), strict=True):
        yield clip, pts, np.frombuffer(rgb, np.uint8).reshape(h, w, 3)


def _batch(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].shape[0] for r in rows], pa.int64()), pa.array([r[2].shape[1] for r in rows], pa.int64()), pa.array([np.ascontiguousarray(r[2]).tobytes() for r in rows], pa.binary())], NAMES
    )


def per_frame(frames: DataFrame, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Each frame changed on its own; stamps stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                yield _batch([(c, p, change(x)) for c, p, x in _rows(batch.slice(k, 64))])

    return frames.select(*NAMES).mapInArrow(run, SCHEMA)


def synth_frames(clips: DataFrame, *, n: int, h: int, w: int) -> DataFrame:
    """`n` frames for each clip_id: moving gradients and a white box that bounces."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = np.mgrid[0:h, 0:w]
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part, rows = batch.slice(k, 64), []
                for clip, i in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    rgb = np.stack([(x / w * 255 + 2 * i) % 256, (y / h * 255 + i) % 256, (x + y) / (w + h) * 255 % 256], -1).astype(np.uint8)
                    side = max(1, min(h, w) // 4)
                    at = [abs((i * v) % (2 * max(1, d - side)) - max(1, d - side)) for v, d in ((2, h), (3, w))]
                    rgb[at[0] : at[0] + side, at[1] : at[1] + side] = 255
                    rows.append((clip, i * 40, rgb))
                yield _batch(rows)

    return clips.select("clip_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).mapInArrow(draw, SCHEMA)


def bilinear(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Linear resampling at half-pixel centres with clamped edges, as floats."""

    def axis(size: int, out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(out) + 0.5) * size / out - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, size - 1), np.clip(low + 1, 0, size - 1), at - low

    a, b, f = axis(x.shape[0], h)
    rows = x[a] * (1 - f)[:, None, None] + x[b] * f[:, None, None]
    a, b, f = axis(x.shape[1], w)
    return rows[:, a] * (1 - f)[None, :, None] + rows[:, b] * f[None, :, None]


def area(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mean over the source area of each output pixel, as floats."""

    def weights(size: int, out: int) -> np.ndarray:
        edge = np.arange(out + 1) * size / out
        cell = np.arange(size)
        overlap = np.minimum(edge[1:, None], cell + 1) - np.maximum(edge[:-1, None], cell)
        return np.maximum(overlap, 0) * out / size

    return _separable(x, weights(x.shape[0], h), weights(x.shape[1], w))


def _separable(x: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    return np.einsum("ij,jkc,lk->ilc", rows, x.astype(float), columns)


def _cubic(a: float) -> Callable[[np.ndarray], np.ndarray]:
    def kernel(d: np.ndarray) -> np.ndarray:
        d = np.abs(d)
        return np.where(d < 1, (a + 2) * d**3 - (a + 3) * d**2 + 1, np.where(d < 2, a * (d**3 - 5 * d**2 + 8 * d - 4), 0.0))

    return kernel


#: Kernel and its reach in source pixels of each algorithm, in their textbook forms; fast-bilinear and area have functions of their own.
KERNELS: dict[str, tuple[Callable[[np.ndarray], np.ndarray], int]] = {
    "bilinear": (lambda d: np.maximum(0.0, 1 - np.abs(d)), 1),
    "bicubic": (_cubic(-0.6), 2),
    "bicublin": (_cubic(-0.6), 2),
    "gaussian": (lambda d: np.exp2(-3.0 * d * d), 2),
    "sinc": (np.sinc, 10),
    "lanczos": (lambda d: np.where(np.abs(d) < 3, np.sinc(d) * np.sinc(d / 3), 0.0), 3),
    "spline": (_cubic(-0.5), 2),
}


def resample(x: np.ndarray, h: int, w: int, algorithm: str) -> np.ndarray:
    """Resize by a named algorithm, as floats: half-pixel centres, edge pixels repeated, kernels widened where the frame shrinks."""
    if algorithm == "area":
        return area(x, h, w)
    if algorithm == "fast-bilinear":
        return bilinear(x, h, w)
    kernel, reach = KERNELS[algorithm]

    def weights(size: int, out: int) -> np.ndarray:
        wide = max(1.0, size / out)
        centre = (np.arange(out) + 0.5) * size / out - 0.5
        at = np.floor(centre)[:, None].astype(int) + np.arange(-int(np.ceil(reach * wide)), int(np.ceil(reach * wide)) + 2)
        value = kernel((at - centre[:, None]) / wide)
        matrix = np.zeros((out, size))
        np.add.at(matrix, (np.arange(out)[:, None], np.clip(at, 0, size - 1)), value / value.sum(1, keepdims=True))
        return matrix

    return _separable(x, weights(x.shape[0], h), weights(x.shape[1], w))


def bilinear2x(x: np.ndarray) -> np.ndarray:
    """The reference model: doubles a float frame in [0, 1]."""
    return bilinear(x, 2 * x.shape[0], 2 * x.shape[1])


def infer(x: np.ndarray, model: Model, *, low: float = 0.0, high: float = 1.0, bgr: bool = False) -> np.ndarray:
    """One frame through a model: bytes to [low, high] and back, halves to even; `bgr` turns the channels both ways."""
    y = (x[..., ::-1] if bgr else x).astype(np.float32) * np.float32((high - low) / 255) + np.float32(low)
    out = np.clip(np.rint((model(y) - low) * (255 / (high - low))), 0, 255).astype(np.uint8)
    return out[..., ::-1] if bgr else out


def upscale_frames(frames: DataFrame, model: Model = bilinear2x, *, low: float = 0.0, high: float = 1.0, bgr: bool = False) -> DataFrame:
    return per_frame(frames, lambda x: infer(x, model, low=low, high=high, bgr=bgr))


def upscale_tiled(frames: DataFrame, model: Model = bilinear2x, *, tile: int, overlap: int = 16, scale: int = 2, broadcast_rows: int = 100_000) -> DataFrame:
    """Large frames by tiles: each tile is a row of its own through the model, its kept part returns to its frame.

    Equal to the whole frame within a level where the model looks less than overlap / 2 around a pixel.  The grid is broadcast only
    where it has at most `broadcast_rows` rows.
    """
    sizes = frames.select("h", "w").distinct().withColumn("size_id", F.concat_ws("x", "h", "w"))
    grid = tile_grid(sizes, tile=tile, overlap=overlap).withColumn("h", F.split("size_id", "x")[0].cast("long")).withColumn("w", F.split("size_id", "x")[1].cast("long")).drop("size_id")
    grid = grid.persist()  # one row for each tile of each distinct size
    rows = frames.join(F.broadcast(grid) if grid.count() <= broadcast_rows else grid, ["h", "w"])
    names = ["x0", "y0", "tw", "th", "left", "top", "right", "bottom"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                own = list(zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True))
                out = []
                for (clip, pts, x), (x0, y0, tw, th, left, top, right, bottom) in zip(_rows(part), own, strict=True):
                    y = infer(x[y0 : y0 + th, x0 : x0 + tw], model)[top * scale : (th - bottom) * scale, left * scale : (tw - right) * scale]
                    out.append((clip, pts, (y0 + top) * scale, (x0 + left) * scale, x.shape[0] * scale, x.shape[1] * scale, y.shape[0], y.shape[1], np.ascontiguousarray(y).tobytes()))
                kinds = [pa.int64()] * 8 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["clip_id", "pts", "y", "x", "fh", "fw", "h", "w", "rgb"])

    tiles = rows.mapInArrow(run, "clip_id long, pts long, y long, x long, fh long, fw long, h long, w long, rgb binary")

    def stitch(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = np.empty((rows[0]["fh"], rows[0]["fw"], 3), np.uint8)
        for r in rows:
            out[r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]] = np.frombuffer(r["rgb"], np.uint8).reshape(r["h"], r["w"], 3)
        return pa.Table.from_batches([_batch([(rows[0]["clip_id"], rows[0]["pts"], out)])])

    return tiles.groupBy("clip_id", "pts").applyInArrow(stitch, SCHEMA)  # a group is one frame


def fit_frames(frames: DataFrame, *, w: int, h: int, mode: str = "fit", algorithm: str = "lanczos", align: int = 2) -> DataFrame:
    """Resize to fit inside a display, or crop and resize to cover it; a frame of that size passes unchanged."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown resize algorithm {algorithm!r}")
    def change(x: np.ndarray) -> np.ndarray:
        sh, sw = x.shape[:2]
        if mode == "cover":
            ow, oh = max(align, w // align * align), max(align, h // align * align)
            aw, ah = max(align, sw // align * align), max(align, sh // align * align)
            cw, ch = (max(align, int(ah * ow / oh) // align * align), ah) if aw * oh > ah * ow else (aw, max(align, int(aw * oh / ow) // align * align))
            cw, ch = min(cw, aw), min(ch, ah)
            x0, y0 = max(0, (sw - cw) // (2 * align) * align), max(0, (sh - ch) // (2 * align) * align)
            x = x[y0 : y0 + ch, x0 : x0 + cw]
        else:
            s = min(w / sw, h / sh)
            ow, oh = max(align, round(sw * s / align) * align), max(align, round(sh * s / align) * align)
            ow, oh = ow - align if ow > w else ow, oh - align if oh > h else oh
        return x if x.shape[:2] == (oh, ow) else np.clip(np.rint(resample(x.astype(float), oh, ow, algorithm)), 0, 255).astype(np.uint8)

    return per_frame(frames, change)


class Stage:
    """A user's stage: `process` gives frames for a frame, `flush` gives what is held at the end of a clip."""

    def process(self, pts: int, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
        return [(pts, x)]

    def flush(self) -> list[tuple[int, np.ndarray]]:
        return []


class PairMean(Stage):
    """Holds one frame: each second frame gives the mean of the pair; an odd one out is flushed."""

    def __init__(self) -> None:
        self.held: tuple[int, np.ndarray] | None = None

    def process(self, pts: int, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
        if self.held is None:
            self.held = (pts, x)
            return []
        (first, y), self.held = self.held, None
        return [(first, ((x.astype(int) + y) // 2).astype(np.uint8))]

    def flush(self) -> list[tuple[int, np.ndarray]]:
        return [self.held] if self.held else []


def frame_stage(frames: DataFrame, stage: type[Stage]) -> DataFrame:
    """A stage with state over each clip in order of pts; clips stream through a task in sorted batches, so no clip is held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, clip = None, None
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                out = []
                for c, pts, x in _rows(batch.slice(k, 64)):
                    if own is None or c != clip:
                        out += [(clip, *r) for r in (own.flush() if own else [])]
                        own, clip = stage(), c
                    out += [(c, *r) for r in own.process(pts, x)]
                yield _batch(out)
        if own:
            yield _batch([(clip, *r) for r in own.flush()])

    return frames.select(*NAMES).repartition("clip_id").sortWithinPartitions("clip_id", "pts").mapInArrow(run, SCHEMA)


def run_stages(frames: DataFrame, stages: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Stages one after the other; what a stage flushes passes through the later ones."""
    for stage in stages:
        frames = frames.transform(stage)
    return frames


def frame_verify(before: DataFrame, after: DataFrame, *, tol: float = 0.002) -> DataFrame:
    """Counts and stamps of each clip before and after a chain of stages, matched by place."""
    place = lambda df, name: df.select("clip_id", F.col("pts").alias(name), F.row_number().over(W.partitionBy("clip_id").orderBy("pts")).alias("place"))
    both = place(before, "a").join(place(after, "b"), ["clip_id", "place"], "full")
    by = both.groupBy("clip_id").agg(F.count("a").alias("n_before"), F.count("b").alias("n_after"), (F.coalesce(F.max(F.abs(F.col("a") - F.col("b"))), F.lit(0)) / 1000).alias("worst_s"))
    return by.withColumn("ok", (F.col("n_before") == F.col("n_after")) & (F.col("worst_s") <= tol))


def digest(frames: DataFrame) -> DataFrame:
    """Frames with a hash of their bytes in their place."""
    return frames.select("clip_id", "pts", "h", "w", F.sha2("rgb", 256).alias("rgb_sha256"))


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_from_embeddings(view(spark, sf_dir, "embeddings"))


def _half(frames: DataFrame) -> DataFrame:
    return fit_frames(frames, w=12, h=12, algorithm="bilinear")


QUERIES.update(
    {
        "frame_stage": lambda s, d: digest(frame_stage(_clips(s, d), PairMean)),
        "run_stages": lambda s, d: digest(run_stages(_clips(s, d), [upscale_frames, _half])),
        "upscale_frames": lambda s, d: digest(upscale_frames(_clips(s, d), low=-1.0, high=1.0, bgr=True)),
        "bilinear2x": lambda s, d: digest(upscale_frames(_clips(s, d))),
        "upscale_tiled": lambda s, d: digest(upscale_tiled(upscale_frames(_clips(s, d)), tile=12, overlap=4)),
        "fit_frames": lambda s, d: digest(fit_frames(_clips(s, d), w=6, h=4, mode="cover", algorithm="area")),
        "frame_verify": lambda s, d: frame_verify(_clips(s, d), run_stages(_clips(s, d), [upscale_frames, _half])),
    }
)
