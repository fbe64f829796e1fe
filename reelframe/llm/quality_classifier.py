"""Compression classifier: which of two zstandard dictionaries, of good and of bad labelled text, compresses a text better."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelframe.llm.common import crc_mod, table
from reelframe.llm.labelled import fit_logistic, labelled_sample, logistic

#: Texts are compressed in pieces of so many bytes, so that the dictionary counts throughout a long text.
PIECE = 1024


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    trained: bool  #: whether the dictionaries are zstandard's trained form, else raw content
    level: int
    weights: np.ndarray

    def measure(self) -> _Measure:
        return _Measure(self)


class _Measure:
    """Compressors live in the task; the model only carries the dictionaries."""

    def __init__(self, model: CompressionModel):
        kind = zstandard.DICT_TYPE_FULLDICT if model.trained else zstandard.DICT_TYPE_RAWCONTENT
        make = lambda d: zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind), write_content_size=False, write_checksum=False)
        self.good, self.bad = make(model.good), make(model.bad)
        self.plain = zstandard.ZstdCompressor(level=model.level, write_content_size=False, write_checksum=False)
        self.weights = model.weights

    def features(self, text: str) -> tuple[float, float, float]:
        """The normalised difference of the compressed sizes, and how far the text and its pieces compress at all."""
        data = text.encode()
        if not data:
            return 0.0, 1.0, 0.0
        good = bad = 0
        for k in range(0, len(data), PIECE):
            piece = data[k : k + PIECE]
            good += len(self.good.compress(piece))
            bad += len(self.bad.compress(piece))
        plain = len(self.plain.compress(data))
        return (good - bad) / max(good, bad), min(1.5, plain / len(data)), np.log1p(len(data)) * min(1.5, plain / len(data))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return logistic(np.array([self.features(x or "") for x in texts]).reshape(-1, 3), self.weights)


def dictionaries(good: list[str], bad: list[str], size: int) -> tuple[bytes, bytes, bool]:
    """Dictionaries of `size` bytes trained on the pieces of the texts; raw content, an even share of each text, where there is too little to train on."""
    pieces = [[p[k : k + 2 * PIECE] for p in (x.encode() for x in texts) for k in range(0, len(p), 2 * PIECE)] for texts in (good, bad)]
    try:
        trained = [zstandard.train_dictionary(size, p).as_bytes() for p in pieces]
        return trained[0], trained[1], True
    except zstandard.ZstdError:
        share = [max(64, size // max(len(p), 1)) for p in pieces]
        raw = [b"\n".join(x[:n] for x in p)[:size] or b"\x00" * 8 for p, n in zip(pieces, share, strict=True)]
        return raw[0], raw[1], False


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, *, per_class: int = 1500, max_chars: int = 20_000, dict_bytes: int = 114_688, level: int = 3) -> CompressionModel:
    """Fit on at most `per_class` training documents of either class of at most `max_chars` characters.

    Half of them fill the dictionaries, the other half calibrates the score.  An id on several rows is learnt from once.  Without both
    classes, or with an empty table, the score is a neutral 0.5.
    """
    rows = labelled_sample(docs, labels, "quality", train, per_class=per_class, max_chars=max_chars).collect()  # bounded: 2 * per_class * max_chars characters
    rows = sorted(((r["doc_id"], r["text"] or "", r["y"]) for r in rows), key=lambda r: r[0])
    half = {k: [r for r in rows if r[2] == k] for k in (0, 1)}
    fit = {k: [r[1] for r in v[::2]] for k, v in half.items()}
    check = [r for v in half.values() for r in v[1::2]]
    model = CompressionModel(*dictionaries(fit[1], fit[0], dict_bytes), level, np.zeros(4))
    measure = model.measure()
    x = np.array([measure.features(r[1]) for r in check]).reshape(-1, 3)
    return CompressionModel(model.good, model.bad, model.trained, level, fit_logistic(x, np.array([r[2] for r in check])))


def score_quality(docs: DataFrame, model: CompressionModel, *, keep: float = 0.7) -> DataFrame:
    """`docs` with score and predicted (1 from `keep` on, so a tie with `keep` is kept); columns of those names are replaced.

    Null texts score as empty ones; a very long text is compressed whole, piece by piece; repeated rows give repeated results; an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size
    names = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = shared.value.measure()
        for batch in batches:
            texts = batch.column(names.index("text"))
            score = np.concatenate([np.zeros(0), *(measure.scores(texts.slice(k, 128).to_pylist()) for k in range(0, batch.num_rows, 128))])
            columns = [*batch.columns, pa.array(score), pa.array((score >= keep).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "score", "predicted"])

    schema = docs.select(*names).schema.add("score", T.DoubleType()).add("predicted", T.IntegerType())
    return docs.select(*names).mapInArrow(run, schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels, crc_mod(F.col("doc_id"), 4) != 2)
    return score_quality(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
