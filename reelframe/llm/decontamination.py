"""Benchmark decontamination by spaced seeds.

A seed mask selects some of the word positions of a short span; the others may differ.  The seeds of all
benchmark items meet the seeds of every training text by hash, and around each hit the item is laid over the text and compared
word by word, so passages with some words exchanged are found while chance hits are not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import table
from reelframe.llm.textcodes import chunks, mix, words

#: Selected positions of each mask.  Together they hit every placing of three exchanged words in a window of 13.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 6, 8, 9), (0, 1, 3, 4, 5))
#: A window of so many words with so many equal ones is a leak (an item of fewer words is compared whole, in that share).
WINDOW, EQUAL = 13, 10
#: Characters of benchmark text that one pass may hold in memory and broadcast; more is taken in blocks of items.
BLOCK_CHARS = 20_000_000


def _seeds(h: np.ndarray, mask: tuple[int, ...], at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for k, x in enumerate(mask):
        out = mix(out + h[at + x] * np.uint64(2 * k + 3))
    return out


@dataclass(frozen=True)
class SeedTable:
    """Word hashes of the items, and the seeds of each mask in order of hash with the words they start at."""

    items: list  #: item ids, null for an item without one
    hashes: np.ndarray
    begins: np.ndarray
    tables: list[tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray]]  #: mask, seed hashes, starts, presence bits


def seed_table(rows: list[tuple[int | None, str]], masks: tuple[tuple[int, ...], ...] = MASKS, *, least_words: int = 5) -> SeedTable:
    """Items of WINDOW words and more are seeded by the masks; shorter ones by one more block of neighbouring words than may be exchanged, one of which is always whole."""
    batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.string())], ["text"])
    parts, counts = [np.zeros(0, np.uint64)], []
    for _, _, data, offsets in chunks(batch):
        h, _, _, begins = words(data, offsets, lower=True)
        parts.append(h)
        counts += np.diff(begins).tolist()
    h, begins = np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    size = np.diff(begins)
    own = np.repeat(np.arange(len(size)), size)
    left = begins[1:][own] - np.arange(len(h))  # words from here to the item's end
    jobs: dict[tuple[int, ...], list[np.ndarray]] = {m: [np.flatnonzero((left > m[-1]) & (size[own] >= WINDOW))] for m in masks}
    for n in range(least_words, WINDOW):
        exchanged = n - -(-EQUAL * n // WINDOW)
        cuts = [n * i // (exchanged + 1) for i in range(exchanged + 2)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            jobs.setdefault(tuple(range(b - a)), []).append(begins[:-1][size == n] + a)
    tables = []
    for mask, found in jobs.items():
        at = np.concatenate(found)
        if len(at):
            s = _seeds(h, mask, at)
            order = np.argsort(s, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[s & np.uint64((1 << 20) - 1)] = True
            tables.append((mask, s[order], at[order], bits))
    return SeedTable([r[0] for r in rows], h, begins, tables)


def leaks(table_: SeedTable, h: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(item index, first word in the text, words compared, words equal) of the best leak of each item in one text."""
    found: set[tuple[int, int]] = set()
    for mask, seeds, starts, bits in table_.tables:
        at = np.arange(max(0, len(h) - mask[-1]))
        s = _seeds(h, mask, at)
        maybe = np.flatnonzero(bits[s & np.uint64((1 << 20) - 1)])
        if not len(maybe):
            continue
        a, b = np.searchsorted(seeds, s[maybe]), np.searchsorted(seeds, s[maybe], "right")
        n = b - a
        where = np.repeat(maybe, n)
        word = starts[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)]
        item = np.searchsorted(table_.begins, word, "right") - 1
        found.update(zip(item.tolist(), (where - (word - table_.begins[item])).tolist(), strict=True))
    best: dict[int, tuple[int, int, int, int]] = {}
    for item, shift in sorted(found):
        own = table_.hashes[table_.begins[item] : table_.begins[item + 1]]
        lo, hi = max(0, -shift), min(len(own), len(h) - shift)
        equal = own[lo:hi] == h[shift + lo : shift + hi]
        width = min(WINDOW, len(own))
        if len(equal) < width:
            continue
        sums = np.concatenate([[0], np.cumsum(equal)])
        windows = sums[width:] - sums[:-width]
        if windows.max() * WINDOW >= EQUAL * width:
            row = (item, shift + lo, hi - lo, int(equal.sum()))
            if item not in best or row[3] > best[item][3]:
                best[item] = row
    return list(best.values())


def _blocks(benchmark: DataFrame, least_words: int) -> Iterator[SeedTable]:
    """Seed tables of the benchmark, each of a bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    k = int(chars // BLOCK_CHARS) + 1
    for i in range(k):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(k)) == i).orderBy("item_id", "text").collect()  # about BLOCK_CHARS characters
        yield seed_table([(r["item_id"], r["text"]) for r in rows], least_words=least_words)


def _by_text(shared, batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[int, list[tuple[int, int, int, int]]]]:
    for row, stop, data, offsets in chunks(batch, text):
        h, _, _, begins = words(data, offsets, lower=True)
        # one look at the whole chunk tells which texts have a seed at all
        hit = np.zeros(len(h) + 1, np.int64)
        for mask, seeds, _, bits in shared.value.tables:
            s = _seeds(h, mask, np.arange(max(0, len(h) - mask[-1])))
            maybe = np.flatnonzero(bits[s & np.uint64((1 << 20) - 1)])
            k = np.minimum(np.searchsorted(seeds, s[maybe]), len(seeds) - 1)
            hit[maybe[seeds[k] == s[maybe]]] = 1
        some = np.concatenate([[0], np.cumsum(hit)])
        for d in np.flatnonzero(some[begins[1:]] > some[begins[:-1]]).tolist():
            if found := leaks(shared.value, h[begins[d] : begins[d + 1]]):
                yield row + d, found


def contaminated(docs: DataFrame, benchmark: DataFrame, *, least_words: int = 5) -> DataFrame:
    """(doc_id, item_id, start, n_words, n_equal): for each text and benchmark item of which it holds a leak, the best one.

    Words are lower-cased (A-Z).  Items of fewer than `least_words` words are too common to tell a leak and are not looked for.  Null and empty
    texts and items hold nothing; a very long text is looked through whole; of leaks of an item with equally many equal words the earliest one counts; items
    without item_id count, with a null in their place; repeated rows give repeated results; an empty table on either side gives no rows.  Extra columns
    are ignored, whatever their names.
    """
    out = None
    for block in _blocks(benchmark, least_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                for d, found in _by_text(shared, batch):
                    rows += [(ids[d], shared.value.items[i], a, n, e) for i, a, n, e in found]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], ["doc_id", "item_id", "start", "n_words", "n_equal"])

        one = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, start long, n_words long, n_equal long")
        out = one if out is None else out.unionByName(one)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, least_words: int = 5) -> DataFrame:
    """The rows of `docs`, with all their columns, whose texts hold no leak; cases as in `contaminated`."""
    at = docs.columns.index("text")
    for block in _blocks(benchmark, least_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                only = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
                keep[[d for d, _ in _by_text(shared, only)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
