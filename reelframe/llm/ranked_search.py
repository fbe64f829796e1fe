"""Ranked lexical search over geometrically blocked posting lists.

Two passes over the documents.  The first counts documents, words and the document frequencies of the items' terms.  In the second each task cuts its
documents into segments and keeps the best documents of every item as it goes.  In a segment a term's posting list is clustered by the similarity of
its documents (nearest of a few of them, in a random projection) into blocks of about `BLOCK` documents, and a block is summed up by the coordinatewise maximum of its documents'
term impacts.  A summary's score is therefore never below that of any of its documents: a block is skipped only where that exact integer bound
stays below the item's k-th best score so far, and then all its documents are settled, for the item's other lists as well.  Terms are taken by falling
impact, and an item is done with a segment once all its remaining lists together can't reach its k-th best score.  The similarity
only decides how much is skipped, never a result.

No posting leaves its task: only each task's k best documents an item are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.llm.common import table
from reelframe.llm.terms import word_strings
from reelframe.llm.textcodes import chunks

#: Characters of items that are looked for in one pass over the documents; further items take further passes.
ITEM_CHARS = 4_000_000
#: Distinct terms of the items that share an index of a segment, and cells (documents times terms) of such an index; one item may have more terms.
TERMS = 4096
CELLS = 1 << 24
#: Documents of a segment, and postings that close it early.
SEGMENT, POSTINGS = 4096, 1 << 21
BLOCK = 8
#: Dimensions of the random projection that documents are clustered in.
SKETCH = 32


@dataclass
class Group:
    """Items with few enough distinct terms to share an index: numbers of the items, of their terms, and how often each item has each of its terms."""

    items: list[int]
    terms: np.ndarray
    columns: list[np.ndarray]
    repeats: list[np.ndarray]


@dataclass
class Items:
    ids: list[int | None]
    words: pa.Array
    groups: list[Group]


def prepared(rows: list[tuple[int | None, str]]) -> Items:
    """The items' terms as numbers into one vocabulary, in groups of at most TERMS terms."""
    texts = [t.encode() for _, t in rows]
    words, begins = word_strings(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy()
    own = [np.unique(code[begins[i] : begins[i + 1]], return_counts=True) for i in range(len(rows))]
    groups, members, seen = [], [], np.zeros(0, np.int64)

    def close() -> None:
        if members:
            groups.append(Group(list(members), seen, [np.searchsorted(seen, own[i][0]) for i in members], [own[i][1].astype(np.int64) for i in members]))

    for i, (terms, _) in enumerate(own):
        if not len(terms):
            continue
        more = np.union1d(seen, terms)
        if members and len(more) > TERMS:
            close()
            members, more = [], terms.astype(np.int64)
        members.append(i)
        seen = more
    close()
    return Items([r[0] for r in rows], coded.dictionary, groups)


def item_blocks(items: DataFrame) -> Iterator[Items]:
    """The items in blocks of a bounded size."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    k = int(rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // ITEM_CHARS) + 1
    for i in range(k):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(k)) == i).orderBy("item_id", "text").collect()  # about ITEM_CHARS characters
        yield prepared([(r["item_id"], r["text"]) for r in part])


def _postings(batch: pa.RecordBatch, vocabulary: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, words of each text, and the text, term and times of each posting) by chunk; only terms of the vocabulary count as postings."""
    n = max(1, len(vocabulary))
    for row, _, data, offsets in chunks(batch):
        words, begins = word_strings(data, offsets)
        ids = pc.index_in(words, value_set=vocabulary).fill_null(-1).to_numpy().astype(np.int64)
        size = np.diff(begins)
        own = ids >= 0
        key, times = np.unique(np.repeat(np.arange(len(size)), size)[own] * n + ids[own], return_counts=True)
        yield row, size, key // n, key % n, times.astype(np.int64)


def _statistics(docs: DataFrame, shared) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and document frequency of each term of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value.words
        held, terms, df = 0, 0, np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, size, _, term, _ in _postings(batch, vocabulary):
                held, terms = held + int((size > 0).sum()), terms + int(size.sum())
                df += np.bincount(term, minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-2, -1])), pa.array(np.append(df[some], [held, terms]))], ["term", "n"])

    found = docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # at most a row for each term of a block of items
    df = np.zeros(len(shared.value.words), np.int64)
    total = {-2: 0, -1: 0}
    for r in found:
        if r["term"] < 0:
            total[r["term"]] = r["n"]
        else:
            df[r["term"]] = r["n"]
    return total[-2], total[-1], df


def weight_of(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Best:
    """The k best documents of each item so far: higher scores first, then smaller ids (null before all)."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.scores = [np.zeros(0, np.int64) for _ in range(n_items)]
        self.docs = [np.zeros((0, 2), np.int64) for _ in range(n_items)]

    def floor(self, item: int) -> int:
        """A document below this score can't be among the best."""
        own = self.scores[item]
        return int(own[-1]) if len(own) == self.k else 1

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray) -> None:
        some = scores > 0
        scores, docs = np.concatenate([self.scores[item], scores[some]]), np.concatenate([self.docs[item], docs[some]])
        order = np.lexsort((docs[:, 1], docs[:, 0], -scores))[: self.k]
        self.scores[item], self.docs[item] = scores[order], docs[order]


def blocks_of(rows: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents of a posting list in the order of their blocks, and where each block begins: clusters around evenly spaced documents, cut at BLOCK."""
    if len(rows) <= BLOCK:
        return rows, np.zeros(1, np.int64)
    own = sketch[rows]
    near = own @ own[:: max(2, BLOCK // 2)].T
    cluster = near.argmax(1)
    order = np.lexsort((-near[np.arange(len(rows)), cluster], cluster))
    sizes = np.bincount(cluster)
    first = np.cumsum(sizes) - sizes
    inside = np.arange(len(rows)) - np.repeat(first, sizes)
    return rows[order], np.flatnonzero(inside % BLOCK == 0)


def search_segment(impacts: np.ndarray, docs: np.ndarray, group: Group, weights: np.ndarray, best: Best) -> dict[str, int]:
    """Puts a segment's documents among the best of the group's items; `impacts` is documents by terms of the group, before weights.

    Returns how many blocks were met and skipped, and documents scored.
    """
    told = {"blocks": 0, "skipped": 0, "scored": 0}
    factors = [r * weights[group.terms[c]] for c, r in zip(group.columns, group.repeats, strict=True)]
    top = impacts.max(0).astype(np.int64)
    reach = [top[c] * f for c, f in zip(group.columns, factors, strict=True)]
    left = np.array([r.sum() for r in reach])
    open_ = [np.ones(len(docs), bool) for _ in group.items]
    users: list[list[tuple[int, int]]] = [[] for _ in group.terms]
    for i, columns in enumerate(group.columns):
        for j, t in enumerate(columns.tolist()):
            users[t].append((i, j))
    plane = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (len(group.terms), SKETCH))
    weighted = impacts * weights[group.terms].astype(np.float32)
    sketch = weighted @ plane / np.maximum(np.sqrt(np.einsum("ij,ij->i", weighted, weighted)), 1)[:, None]
    for t in np.argsort(-top * weights[group.terms], kind="stable").tolist():
        wanted = [(i, j) for i, j in users[t] if left[i] >= best.floor(group.items[i])]
        rows = np.flatnonzero(impacts[:, t])
        if wanted and len(rows):
            rows, begins = blocks_of(rows, sketch)
            asked = np.unique(np.concatenate([group.columns[i] for i, _ in wanted]))  # no other coordinate can count
            summary = np.maximum.reduceat(impacts[np.ix_(rows, asked)], begins)
            of = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(rows))))
            for i, _ in wanted:
                item, columns = group.items[i], group.columns[i]
                bounds = summary[:, np.searchsorted(asked, columns)].astype(np.int64) @ factors[i]
                told["blocks"] += len(bounds)
                for part in np.array_split(np.argsort(-bounds, kind="stable"), [1]):  # the most promising block first: it raises the bar
                    good = np.zeros(len(bounds), bool)
                    good[part] = bounds[part] >= best.floor(item)
                    told["skipped"] += len(part) - int(good.sum())
                    some = rows[good[of]]
                    some = some[open_[i][some]]
                    if len(some):
                        told["scored"] += len(some)
                        best.add(item, impacts[np.ix_(some, columns)].astype(np.int64) @ factors[i], docs[some])
                open_[i][rows] = False  # scored, or below the bar
        for i, j in users[t]:
            left[i] -= reach[i][j]
    return told


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0 for each item, equal scores by ascending doc_id.

    A document's score is the sum over the item's terms, repeats included, of w * ((10^9 tf) div (1000 tf + 8 m)), where m is 25 + (75 n N) div L.  Null and
    empty texts have no terms: such a document is never found, such an item finds nothing.  Documents without id rank before others of their
    score; a row of either table stands for itself, so repeated documents are each ranked, and repeated items each have ranks from 1.  A very long
    text is scored whole.  An empty table on either side gives no rows; extra columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out, first = None, 0
    for block in item_blocks(items):
        shared = spark.sparkContext.broadcast(block)  # ITEM_CHARS characters at most, or one item
        n_docs, n_terms, df = _statistics(texts.select("text"), shared)
        weights = spark.sparkContext.broadcast(np.array([weight_of(d, n_docs) for d in df.tolist()], np.int64))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, weights=weights, n_docs=n_docs, n_terms=n_terms, first=first) -> Iterator[pa.RecordBatch]:
            own = shared.value
            best = Best(len(own.ids), k)
            held: list[tuple[np.ndarray, ...]] = []

            def search() -> None:
                ids, size, doc, term, times = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                m = np.array([25 + 75 * x * n_docs // n_terms for x in size.tolist()], np.int64)
                unit = (1_000_000_000 * times) // (1000 * times + 8 * m[doc])
                for group in own.groups:
                    column = np.searchsorted(group.terms, term)
                    column[column == len(group.terms)] = 0
                    mine = group.terms[column] == term
                    d, c, u = doc[mine], column[mine], unit[mine]
                    step = max(1, CELLS // len(group.terms))
                    for low in range(0, len(ids), step):
                        high = min(low + step, len(ids))
                        a, b = np.searchsorted(d, (low, high))
                        if a < b:
                            impacts = np.zeros((high - low, len(group.terms)), np.int32)
                            impacts[d[a:b] - low, c[a:b]] = u[a:b]
                            search_segment(impacts, ids[low:high], group, weights.value, best)

            rows = postings = 0
            for batch in batches:
                ids = np.column_stack([batch.column(0).is_valid().to_numpy(zero_copy_only=False).astype(np.int64), batch.column(0).fill_null(0).to_numpy()])
                for row, size, doc, term, times in _postings(batch.select([1]), own.words):
                    held.append((ids[row : row + len(size)], size, doc + rows, term, times))
                    rows, postings = rows + len(size), postings + len(term)
                    if rows >= SEGMENT or postings >= POSTINGS:
                        search()
                        rows = postings = 0
            if held:
                search()
            n = [len(x) for x in best.scores]
            item = np.repeat(np.arange(len(n)), n)
            found = np.concatenate([np.zeros((0, 2), np.int64), *best.docs])
            score = np.concatenate([np.zeros(0, np.int64), *best.scores])
            yield pa.RecordBatch.from_arrays(
                [pa.array(item + first), pa.array([own.ids[i] for i in item.tolist()], pa.int64()), pa.array(found[:, 1], mask=found[:, 0] == 0), pa.array(score)], ["item", "item_id", "doc_id", "score"]
            )

        one = texts.mapInArrow(run, "item long, item_id long, doc_id long, score long")
        out = one if out is None else out.unionByName(one)
        first += len(block.ids)
    # the best of each task, then of 32 parts of an item, then of the item: no task reads more than a share of an item's rows at first
    for keys in (["item", "part"], ["item"]):
        best_first = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        out = out.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(32))) if "part" in keys else out
        out = out.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return out.select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH a AS (SELECT 'd' AS side, row_number() OVER () AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'i', row_number() OVER (), item_id, text FROM benchmark),
w AS (SELECT side, k, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM a),
tf AS (SELECT side, k, id, term, count(*) AS tf FROM w GROUP BY ALL),
n AS (SELECT k, sum(tf)::BIGINT AS n FROM tf WHERE side = 'd' GROUP BY k),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
v AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s WHERE side = 'd' GROUP BY term, docs),
p AS (SELECT d.k, d.id, d.term, v.w * ((1000000000 * d.tf) // (1000 * d.tf + 8 * (25 + (75 * n.n * docs) // terms))) AS x FROM tf d JOIN n ON d.k = n.k JOIN v ON d.term = v.term, s WHERE d.side = 'd'),
r AS (SELECT i.k AS ik, i.id AS item_id, p.k, p.id AS doc_id, sum(i.tf * p.x)::BIGINT AS score FROM tf i JOIN p ON i.term = p.term WHERE i.side = 'i' GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY ik ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM r WHERE score > 0) WHERE rank <= 10
"""
