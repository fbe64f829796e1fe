"""Source divergence audit: how far the term distributions of a language's sources lie apart.

Counting is a Spark job: tasks count the terms of their batches, two shuffles add them up by (lang, source, term) and by (lang, term).  The kept terms of
a language are dealt by hash into blocks of about `width` terms.  A block holds, for each source, a segment tree over its term ids.  Trees
are hash-consed: within a level, nodes with equal children are one node, so equal count subtrees of any sources and at any place are shared.  Two sources are
compared by walking their trees at the same time, level by level, and equal pairs of nodes are merged with their multiplicity before they are followed,
so each is priced once.  Blocks only add up, so no task ever holds more than one block of a bounded number of sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.llm.common import checkpointed, table
from reelframe.llm.terms import NOT_ALPHA, word_strings
from reelframe.llm.textcodes import chunks

SCALE = 1_000_000_000
SMOOTH = 5
#: Term ids in a block, and sources in a tile of a block.
WIDTH = 4096
TILE = 256
#: Leaves that are walked at a time, counted over pairs of sources.
LEAVES = 1 << 19


def _counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and document counts of each (lang, source, term) of a chunk, and a row without term for each (lang, source)."""
    for batch in batches:
        lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
        width = len(source.dictionary) or 1
        found, group = np.unique(lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy(), return_inverse=True)
        langs, sources = lang.dictionary.take(pa.array(found // width)), source.dictionary.take(pa.array(found % width))
        zero = pa.array(np.zeros(len(found), np.int64))
        yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(found), pa.string()), zero, zero], ["lang", "source", "term", "n", "df"])
        for row, stop, data, offsets in chunks(batch):
            words, begins = word_strings(data, offsets, NOT_ALPHA)
            if not len(words):
                continue
            coded = words.dictionary_encode()
            terms, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(stop - row), np.diff(begins))
            key, times = np.unique(doc * len(terms) + code, return_counts=True)
            key = group[row + key // len(terms)] * len(terms) + key % len(terms)
            order = np.argsort(key, kind="stable")
            key, times = key[order], times[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            of = pa.array(key[at] // len(terms))
            yield pa.RecordBatch.from_arrays(
                [langs.take(of), sources.take(of), terms.take(pa.array(key[at] % len(terms))).cast(pa.string()), pa.array(np.add.reduceat(times, at)), pa.array(np.diff(np.append(at, len(key))))],
                ["lang", "source", "term", "n", "df"],
            )


def price(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / total), exact at every size; 0 for the filling leaves (count -1)."""
    if total >= 1 << 48:
        p = np.array([1 + SCALE * (int(c) + SMOOTH) // total for c in count], np.int64)
    else:
        whole, rest = np.divmod(count + SMOOTH, total)
        high, rest = np.divmod(rest * 32_000, total)  # SCALE in two factors, so that no product passes 64 bits
        p = 1 + whole * SCALE + high * 31_250 + rest * 31_250 // total
    return np.where(count < 0, 0, p)


def shared_trees(counts: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(leaf values, children of the nodes of each level from the leaves up, root of each row) of the rows' segment trees.

    The width is a power of two.  Nodes are numbered within their level, and equal subtrees have one number.
    """
    values, node = np.unique(counts, return_inverse=True)
    node = node.reshape(counts.shape)
    levels, size = [], len(values)
    while node.shape[1] > 1:
        pairs, inverse = np.unique(node[:, 0::2] * size + node[:, 1::2], return_inverse=True)
        levels.append((pairs // size, pairs % size))
        node, size = inverse.reshape(len(counts), -1), len(pairs)
    return values, levels, node[:, 0]


def _merged(pair: np.ndarray, a: np.ndarray, b: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal (pair, a, b) as one, their multiplicities added up."""
    order = np.lexsort((b, a, pair))
    pair, a, b, times = pair[order], a[order], b[order], times[order]
    at = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return pair[at], a[at], b[at], np.add.reduceat(times, at)


def distances(counts: np.ndarray, totals: list[int], pairs: np.ndarray) -> tuple[np.ndarray, int]:
    """(sum over the terms of |p - q| for each pair of rows, node pairs followed); `counts` has one row a source, -1 where it is only filled up."""
    values, levels, roots = shared_trees(counts)
    out, followed = np.zeros(len(pairs), np.int64), 0
    prices = np.stack([price(values, t) for t in totals])
    same = np.array([[s == t for t in totals] for s in totals])
    step = max(1, LEAVES // counts.shape[1])
    for first in range(0, len(pairs), step):
        rows = pairs[first : first + step]
        pair = np.arange(len(rows))
        a, b, times = roots[rows[:, 0]], roots[rows[:, 1]], np.ones(len(rows), np.int64)
        for level in [*reversed(levels), None]:
            alike = (a == b) & same[rows[pair, 0], rows[pair, 1]]  # one node under one total: no difference below it
            pair, a, b, times = (x[~alike] for x in (pair, a, b, times))
            followed += len(pair)
            if not len(pair):
                break
            if level is None:
                continue
            left, right = level
            pair, a, b, times = _merged(np.tile(pair, 2), np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]]), np.tile(times, 2))
        if len(pair):
            np.add.at(out, first + pair, np.abs(prices[rows[pair, 0], a] - prices[rows[pair, 1], b]) * times)
    return out, followed


def _block_pairs(key: tuple, table_: pa.Table) -> pa.Table:
    """Partial distances of a block's pairs of sources in two tiles."""
    lang, _, low, high = (x.as_py() for x in key)
    rows = table_.sort_by("source")
    source, tile = rows["source"].to_pylist(), rows["tile"].to_pylist()
    totals, n_terms = rows["total"].to_pylist(), int(rows["n_terms"][0].as_py())
    lists = rows["counts"].combine_chunks()
    flat = lists.flatten()
    of = np.repeat(np.arange(len(source)), lists.value_lengths().fill_null(0).to_numpy())
    coded = flat.field(0).dictionary_encode()
    code, n = coded.indices.to_numpy().astype(np.int64), flat.field(1).to_numpy()
    seen = len(coded.dictionary)
    weight = np.zeros(seen, np.int64)
    np.add.at(weight, code, n)
    place = np.empty(seen, np.int64)
    place[np.argsort(-weight, kind="stable")] = np.arange(seen)  # frequent terms first: rare ones make equal subtrees side by side
    width = 1 << max(0, max(n_terms, seen) - 1).bit_length()
    counts = np.zeros((len(source), width), np.int64)
    counts[:, n_terms:] = -1
    counts[of, place[code]] = n
    index = np.arange(len(source))
    if low == high:
        a, b = np.triu_indices(len(source), 1)
    else:
        one, two = index[np.array(tile) == low], index[np.array(tile) == high]
        a, b = np.repeat(one, len(two)), np.tile(two, len(one))
    value, _ = distances(counts, totals, np.column_stack([a, b]))
    pick = lambda x: pa.array([source[i] for i in x.tolist()], pa.string())
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pick(a), "b": pick(b), "value": pa.array(value)})


def _share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / total) in decimals that hold any count."""
    return F.expr("bigint(1)") + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(20,0)"), total.cast("decimal(20,0)"))


def _beside(rows: DataFrame, table_: DataFrame, on: list[str], *, most: int = 200_000, salts: int = 32) -> DataFrame:
    """`rows` joined with a table of one row a language or group: broadcast up to `most` rows, else a join that deals each key's rows over `salts` tasks."""
    if table_.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(table_), on)
    spread = table_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")).join(spread, [*on, "salt"]).drop("salt")


def divergence(docs: DataFrame, *, min_docs: int = 30, top: int = 50, width: int = WIDTH, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): distances between the sources of a language (`pair`) and each source's most over-used terms (`term`).

    A language keeps the terms of at least `min_docs` of its documents.  p of a term in a group is 1 + floor(10^9 (count + 5) / (N + 5 V)), all integers.
    Null text, lang and source count as empty strings; every row is a document of its own, so repeated rows count again; a group
    without terms still has its pairs, with counts of 0; a language without kept terms has pairs of value 0 and no terms; a language with one source has no
    pairs; equal values rank by the bytes of the item; a very long text is counted whole; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    filled = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = filled.mapInArrow(_counts_of, "lang string, source string, term string, n long, df long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    of_term = Window.partitionBy("lang", "term")
    kept = counted.select(
        "lang", "source", "term", "n", F.sum("n").over(of_term).alias("all"), F.sum("df").over(of_term).alias("docs"), (F.row_number().over(of_term.orderBy("source")) == 1).alias("head")
    ).where(F.col("term").isNull() | (F.col("docs") >= min_docs))
    kept = checkpointed(kept)
    terms = kept.where("term IS NOT NULL")
    langs = kept.groupBy("lang").agg(F.count_if(F.col("head") & F.col("term").isNotNull()).alias("v"), F.sum("n").alias("n_lang"), F.count_if(F.col("term").isNull()).alias("n_sources"))
    langs = checkpointed(langs)  # one row a language
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group")).join(langs, "lang")
    groups = groups.select(
        "lang",
        "source",
        (F.col("n_group") + SMOOTH * F.col("v")).alias("total"),
        (F.col("n_lang") + SMOOTH * F.col("v")).alias("total_lang"),
        F.greatest(F.lit(1), F.ceil(F.col("v") / width)).cast("int").alias("blocks"),
        F.ceil(F.col("n_sources") / tile).cast("int").alias("tiles"),
    )
    groups = checkpointed(groups)
    shares = _beside(terms.where("n > 0"), groups, ["lang", "source"])
    over = shares.select("lang", "source", F.col("term").alias("item"), (_share(F.col("n"), F.col("total")) - _share(F.col("all"), F.col("total_lang"))).alias("value")).where("value > 0")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = over.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))

    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    blocks = langs.select("lang", F.greatest(F.lit(1), F.ceil(F.col("v") / width)).cast("int").alias("blocks"))
    sizes = _beside(terms.where("head"), blocks, ["lang"]).groupBy("lang", block).agg(F.count("*").alias("n_terms"))
    vectors = shares.select("lang", "source", block, F.struct("term", "n").alias("x")).groupBy("lang", "source", "block").agg(F.collect_list("x").alias("counts"))
    every = groups.select("lang", "source", "total", "tiles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(sizes, ["lang", "block"])
    own = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    tiled = (
        every.join(vectors, ["lang", "source", "block"], "left")
        .select("lang", "block", "source", "total", "n_terms", "counts", own.alias("tile"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
        .select("lang", "block", "source", "total", "n_terms", "counts", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    )
    parts = tiled.groupBy("lang", "block", "low", "high").applyInArrow(_block_pairs, "lang string, a string, b string, value long")
    sources = groups.select("lang", "source")
    # the pairs of a language without kept terms have no block
    bare = groups.where(F.col("total_lang") == 0).select("lang", F.col("source").alias("a"))
    bare = bare.join(sources.withColumnRenamed("source", "b"), "lang").where("a < b").select("lang", "a", "b", F.lit(0).cast("long").alias("value"))
    pairs = parts.unionByName(bare).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("p"), "value")
    both = both.select("lang", "p.source", "p.item", "value").withColumn("rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair"))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return both.select(*columns).unionByName(over.select(*columns))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, kept.n AS n_lang FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n,
 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p,
 1 + (1000000000::HUGEINT * (n_lang + 5)) // (sum(n_lang) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS q FROM dense),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
 ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS k FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, k::INTEGER AS rank FROM o WHERE part = 'pair' OR k <= 50
"""
