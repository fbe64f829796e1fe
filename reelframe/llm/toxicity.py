"""Toxic passages as maximum-scoring segments of token log-odds.

Token scores are log-odds of toxic over other training documents with a Dirichlet prior that is the token's frequency in
the whole corpus.  All maximal scoring segments of a text are found in one linear scan; a segment counts by how far it
exceeds what chance gives in a text of that length (extreme-value statistics with Karlin's lambda and a fitted K), and
the sum over segments is calibrated to a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import crc_mod, table
from reelframe.llm.labelled import class_sizes, fit_logistic, labelled_sample, logistic
from reelframe.llm.textcodes import NOT_ALNUM, chunks, mix, shingles, words


def maximal_segments(at: np.ndarray, score: np.ndarray, cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score) of a sequence in which the tokens at `at` score `score` > 0 and every other one -cost.

    The linear scan of Ruzzo and Tompa; runs of negative tokens are stepped over at once.
    """
    kept: list[list[float]] = []  # left sum, right sum, first, last + 1
    total, before = 0.0, 0
    for p, s in zip(at.tolist(), score.tolist(), strict=True):
        total -= cost * (p - before)
        new = [total, total + s, p, p + 1]
        total, before = total + s, p + 1
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= new[0]:
                j -= 1
            if j < 0 or kept[j][1] >= new[1]:
                kept.append(new)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:]
    return [(int(a), int(b), r - left) for left, r, a, b in kept]


@dataclass(frozen=True)
class ToxicModel:
    tokens: np.ndarray  #: sorted hashes of the tokens that score above 0
    scores: np.ndarray
    cost: float  #: every other token scores -cost
    lam: float
    log_k: float
    weights: np.ndarray

    def segments(self, hashes: np.ndarray) -> list[tuple[int, int, float]]:
        if not len(self.tokens) or not len(hashes):
            return []
        k = np.minimum(np.searchsorted(self.tokens, hashes), len(self.tokens) - 1)
        at = np.flatnonzero(self.tokens[k] == hashes)
        return maximal_segments(at, self.scores[k[at]], self.cost)

    def evidence(self, hashes: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
        """Sum over the significant segments of lambda * score - ln(K * tokens), and those segments."""
        found = [(a, b, self.lam * s - self.log_k - np.log(max(len(hashes), 2))) for a, b, s in self.segments(hashes)]
        found = [x for x in found if x[2] > 0]
        return float(sum(x[2] for x in found)), found

    def features(self, values: np.ndarray) -> np.ndarray:
        return np.log1p(values)[:, None]


def _words(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for row, stop, data, offsets in chunks(batch):
        h, start, end, begins = words(data, offsets, lower=True, separators=NOT_ALNUM)
        yield row, stop, h.view(np.int64), start - offsets[np.searchsorted(begins, np.arange(len(h)), "right") - 1], end, begins


#: Stands for a whole text among its tokens, so that the number of texts is counted with them.
EVERY = 0


def fit_toxicity(docs: DataFrame, labels: DataFrame, train, *, per_class: int = 4000, vocabulary: int = 20_000, prior: float = 2000.0, cost: float = 0.05, lift: float = 2.0, surprise: float = 15.0) -> ToxicModel:
    """Fit on at most `per_class` training documents of either class, with at most `vocabulary` candidate tokens.

    Tokens are chosen by their rates within each class, so the share of either class in the sample changes nothing, and against
    their rate among all documents, so few labelled clean texts are enough.  The prior's counts come from every document too; the
    calibration weighs the classes as all labels do.
    Near copies (texts with the same least five-word shingle) count a token once.  Of candidates with equal evidence the smaller
    hash comes first.  An id on several rows is learnt from once.  Without toxic training rows, or with an empty table, no token
    scores and every text gets the same neutral score.
    """
    sample = labelled_sample(docs, labels, "toxic", train, per_class=per_class).persist()

    def token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(2).to_numpy()
            for row, stop, h, _, _, begins in _words(batch):
                doc = np.repeat(np.arange(stop - row), np.diff(begins))
                runs, firsts = shingles(h.view(np.uint64), begins)
                least = np.zeros(stop - row, np.uint64)
                some = np.flatnonzero(np.diff(firsts))
                least[some] = np.minimum.reduceat(mix(runs), firsts[some]) if len(some) else 0
                h, doc = np.concatenate([h, np.full(len(some), EVERY)]), np.concatenate([doc, some])
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                once = np.ones(len(h), bool)
                once[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])  # a document counts a token once
                h, doc = h[once], doc[once]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(least.view(np.int64)[doc]), pa.array(y[row:stop][doc].astype(np.int64))], ["h", "family", "y"])

    seen = sample.mapInArrow(token_counts, "h long, family long, y long").distinct()
    counts = seen.groupBy("h").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("other")).persist()
    texts = counts.where(F.col("h") == EVERY).first()
    n_bad, n_other = (texts["bad"], texts["other"]) if texts else (0, 0)
    total = counts.where(F.col("h") != EVERY).agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("other"), F.lit(0))).first()
    # candidates: at least `lift` times as frequent among toxic texts as among other labelled ones, most evidence first
    bad, other = F.col("bad"), F.col("other")
    rates = F.log((bad * (n_other + 1)) / ((other + 1) * F.lit(max(n_bad, 1))))
    known = counts.where((F.col("h") != EVERY) & (bad >= 3) & (bad * n_other >= lift * other * n_bad))
    picked = known.orderBy(F.desc(bad * rates), "h").limit(vocabulary).collect() if n_bad and n_other else []
    counts.unpersist()
    token = np.array(sorted(r["h"] for r in picked), np.int64)
    by = {r["h"]: (r["bad"], r["other"]) for r in picked}

    def corpus_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, texts, everything, all_texts = np.zeros(len(token), np.int64), np.zeros(len(token), np.int64), 0, 0
        for batch in batches:
            for row, stop, h, _, _, begins in _words(batch):
                everything, all_texts = everything + len(h), all_texts + stop - row
                if len(token):
                    k = np.minimum(np.searchsorted(token, h), len(token) - 1)
                    at = np.flatnonzero(token[k] == h)
                    n += np.bincount(k[at], minlength=len(token))
                    doc = np.searchsorted(begins, at, "right") - 1
                    texts += np.bincount(np.unique(np.stack([doc, k[at]]), axis=1)[1], minlength=len(token))
        seen = np.flatnonzero(n)
        columns = [np.append(token[seen], EVERY), np.append(n[seen], everything), np.append(texts[seen], all_texts)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h", "n", "texts"])

    background = docs.select("text").mapInArrow(corpus_counts, "h long, n long, texts long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")).collect()  # at most `vocabulary` rows
    of_corpus = {r["h"]: (r["n"], r["texts"]) for r in background}
    corpus, n_texts = of_corpus.pop(EVERY, (1, 1))
    # of them those stay that are `lift` times as frequent in toxic texts as in the whole corpus, beyond chance by a likelihood ratio of `surprise`
    at_rate = {h: max(texts, 1) / max(n_texts, 1) for h, (_, texts) in of_corpus.items()}
    ratio = lambda x, m, q: 2 * (x * np.log(x / (m * q)) + ((m - x) * np.log((m - x) / (m * (1 - q))) if x < m else 0.0))
    token = np.array([h for h in token.tolist() if h in at_rate and by[h][0] > lift * n_bad * at_rate[h] and ratio(by[h][0], n_bad, at_rate[h]) >= surprise], np.int64)
    share = {h: n / max(corpus, 1) for h, (n, _) in of_corpus.items()}
    scored, clean_rate = {}, {}
    for h in token.tolist():
        bad, other = by[h]
        a = prior * max(share.get(h, 0.0), 1 / corpus)
        up, down = (bad + a) / max(total[0] + prior - bad - a, 1e-9), (other + a) / max(total[1] + prior - other - a, 1e-9)
        if up > down:
            scored[h], clean_rate[h] = float(np.log(up) - np.log(down)), (other + a) / max(total[1] + prior, 1e-9)
    keep = np.array(sorted(scored), np.int64)
    scores = np.array([scored[h] for h in keep.tolist()])
    # Karlin's lambda: sum of p * exp(lambda * score) = 1 with the frequencies of other text
    p = np.array([clean_rate[h] for h in keep.tolist()])
    lam = 1.0
    if len(keep):
        low, high = 1e-3, 20.0
        for _ in range(80):
            lam = (low + high) / 2
            low, high = (low, lam) if (p * np.exp(np.minimum(lam * scores, 500))).sum() + (1 - p.sum()) * np.exp(-lam * cost) > 1 else (lam, high)

    def values(model: ToxicModel, value) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label, number of tokens and `value` of the segments of each text of the sample: at most 2 * per_class rows of three numbers."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, stop, h, _, _, begins in _words(batch):
                    found = [value(model, h[begins[i] : begins[i + 1]]) for i in range(stop - row)]
                    yield pa.RecordBatch.from_arrays([batch.column(2).slice(row, stop - row).cast(pa.int32()), pa.array(np.diff(begins)), pa.array(found, pa.float64())], ["y", "n", "value"])

        rows = sample.mapInArrow(run, "y int, n long, value double").collect()
        return np.array([r["y"] for r in rows]), np.array([r["n"] for r in rows]), np.array([r["value"] for r in rows], float)

    raw = ToxicModel(keep, scores, cost, lam, 0.0, np.zeros(2))
    y, n, best = values(raw, lambda m, h: max((s for _, _, s in m.segments(h)), default=0.0))
    # Gumbel: the mean of lambda * S - ln(n) over clean texts is ln K + Euler's constant
    clean = (y == 0) & (best > 0) if len(y) else np.zeros(0, bool)
    log_k = float((lam * best[clean] - np.log(np.maximum(n[clean], 2))).mean() - 0.5772) if clean.sum() >= 30 else 0.0
    model = ToxicModel(keep, scores, cost, lam, log_k, np.zeros(2))
    y, _, evidence = values(model, lambda m, h: m.evidence(h)[0])
    sample.unpersist()
    if not len(y) or not 0 < y.sum() < len(y):
        return model
    sizes = class_sizes(labels, "toxic", train)
    weight = np.where(y == 1, sizes[1] / max((y == 1).sum(), 1), sizes[0] / max((y == 0).sum(), 1))
    return ToxicModel(keep, scores, cost, lam, log_k, fit_logistic(model.features(evidence), y, weight))


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, score, predicted, segments (start, stop in tokens and excess) of every document.

    Null and empty texts have no evidence and get the score of a text without a toxic passage; a very long text is one linear scan,
    and each of its passages counts; repeated rows give repeated results; other columns of the input are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most `vocabulary` tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for row, stop, h, _, _, begins in _words(batch):
                found = [m.evidence(h[begins[i] : begins[i + 1]]) for i in range(stop - row)]
                score = logistic(m.features(np.array([x[0] for x in found])), m.weights)
                spans = [[{"start": a, "stop": b, "excess": float(e)} for a, b, e in x[1]] for x in found]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("excess", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, stop - row), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, kind)], ["doc_id", "score", "predicted", "segments"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, segments array<struct<start: long, stop: long, excess: double>>")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, crc_mod(F.col("doc_id"), 5) != 0)
    return score_toxicity(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
