"""Exact n-gram Jaccard join by set relations, at document level: shingle counts, classes, links and components.

A document's set holds the hashes of its distinct five-word shingles.  Equal sets form a class, which its smallest doc_id stands for and which is compared once.

1. `set_pass` names every set by 128 bits, sketches it by the parities of its shingles in about as many buckets, and counts shingles in a bounded number of
   hash buckets.  Rare buckets come first in the global order of shingles (the counts only steer the order, so collisions cannot lose a link).
2. Two sets with a Jaccard similarity of t or more share a shingle among the first n - ceil(t * n) + 1 of each.  `index_lists`
   deals these prefixes by shingle.  The position of a shingle in its set bounds the overlap that is left, and so the size of a partner;
   each list is ordered by size and cut into blocks wherever no earlier position reaches the next size, and blocks are skipped by one another.
   The pairs of a short block are candidates where their positions allow a link and where their sketches do: the buckets whose parities differ are no more than the
   shingles in which the two sets differ, so no link is lost, and sets that share a few shingles by chance part here.  Sets in a long block are one candidate family.
3. Families are the components of those pairs and blocks; a large one is cut into parts by size and hash.  Neighbouring parts are compared first, and
   other pairs of parts only where they still hold different components.
4. `linked_sets` walks the links of a group: a set is compared only with sets outside the components found so far.  Its overlaps
   are counted over index lists from the first block that size allows to the last, or derived from the answers of the highly similar set that it was found from, through
   the lists of the few shingles in which the two differ.
5. Links give components; a component's smallest class name is the smallest id of its documents.

Only a spanning forest of links leaves a task, never all pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import checkpointed, connected_components, table
from reelframe.llm.textcodes import mix, text_sets

#: Rows of a packed list that one task sends on at once.
FLUSH = 2_000_000
#: Sets of a block up to which its pairs are judged one by one; a longer block is one family.
PAIRED = 16
#: Buckets of ids by which texts are sorted out before a shuffle: so many numbers are broadcast at most.
MET_BUCKETS = 1 << 20
#: Marks the reach of an entry that stands for a long block.
LONG = 1 << 31


def _set_ids(s: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names of each set, from its distinct shingles in any order; 0 for an empty one."""
    n = np.diff(begins).astype(np.uint64)
    out = []
    for seed in (0x1234567, 0x9E3779B97F4A7C15):
        totals = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s ^ np.uint64(seed)))])
        out.append(np.where(n > 0, mix(totals[begins[1:]] - totals[begins[:-1]] + n * np.uint64(seed)) | np.uint64(1), np.uint64(0)).view(np.int64))
    return out[0], out[1]


def _sketches(s: np.ndarray, begins: np.ndarray) -> pa.Array:
    """The parity of each set's shingles in each of w buckets, w the least power of two from 64 and three quarters of its size on.

    Of two sets the wider sketch is folded to the narrower one's width; the bits in which they then differ are no more than the shingles in which the sets do.
    """
    n = np.diff(begins)
    width = 64 << np.ceil(np.log2(np.maximum(n * 0.75 / 64, 1))).astype(np.int64)
    start = np.concatenate([np.zeros(1, np.int64), np.cumsum(width)])
    at = np.repeat(start[:-1], n) + (s & np.repeat(width - 1, n).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=int(start[-1])) & 1).astype(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(start // 8), pa.py_buffer(np.packbits(odd, bitorder="little"))]).cast(pa.binary())


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where each value begins in them (one more at the end)."""
    column = column.cast(pa.large_binary())
    _, where, data = column.buffers()
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]


def set_pass(docs: DataFrame, *, bits: int, slices: int) -> DataFrame:
    """One pass over the texts: (doc_id, n, sid, sid2, sketch) of each document's set, and for each task (slice, counts) of its shingles in 2**bits hash buckets, of 255 at most."""
    size = 1 << bits
    part = size // slices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        names = ["doc_id", "n", "sid", "sid2", "sketch", "slice", "counts"]
        counts = np.zeros(size, np.uint32)
        for batch in batches:
            for row, stop, s, begins in text_sets(batch):
                np.add.at(counts, (s >> np.uint64(64 - bits)).astype(np.int64), 1)
                rows, (sid, sid2) = stop - row, _set_ids(s, begins)
                columns = [batch.column(0).slice(row, rows), pa.array(np.diff(begins)), pa.array(sid), pa.array(sid2), _sketches(s, begins), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)
        if counts.any():
            parts = [zlib.compress(np.minimum(counts[k * part : (k + 1) * part], 255).astype(np.uint8).tobytes(), 1) for k in range(slices)]
            none = pa.nulls(slices, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(slices, pa.binary()), pa.array(range(slices), pa.int32()), pa.array(parts, pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sid long, sid2 long, sketch binary, slice int, counts binary")


def shingle_ranks(counted: DataFrame, *, bits: int, slices: int) -> np.ndarray:
    """For each hash bucket the quarter-octave of its number of shingles over all documents: a fixed 2**bits bytes, from (slice, counts)."""
    size = 1 << bits
    part = size // slices

    def add(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        n = np.zeros(part, np.int64)
        for batch in tables:
            for x in batch.column(batch.schema.get_field_index("counts")):
                n += np.frombuffer(zlib.decompress(x.as_py()), np.uint8)
        rank = np.minimum(255, np.round(4 * np.log2(1 + n))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([rank.tobytes()], pa.binary())], ["slice", "ranks"])

    rows = counted.groupBy("slice").applyInArrow(add, "slice int, ranks binary").collect()  # 2**bits bytes in all
    out = np.zeros(size, np.uint8)
    for r in rows:
        out[r["slice"] * part : (r["slice"] + 1) * part] = np.frombuffer(r["ranks"], np.uint8)
    return out


def _chains(token: np.ndarray, low: np.ndarray, reach: np.ndarray, sid: np.ndarray):
    """Order entries by (token, low) and chain those of a token that an earlier one reaches.

    `low` is the size of the set (of the smallest one, for a chain that is an entry), `reach` the largest size that its position in it allows a partner.
    Gives the order, the index of each entry's chain, each chain's first entry, and each chain's reach.
    """
    order = np.lexsort((sid, low, token))
    t, lo, hi = token[order], low[order], reach[order]
    new = np.ones(len(t), bool)
    new[1:] = t[1:] != t[:-1]
    rank = np.cumsum(new)
    far = np.maximum.accumulate((rank << 32) + hi) & 0xFFFFFFFF
    brk = new.copy()
    brk[1:] |= far[:-1] < lo[1:]  # no earlier set of the list reaches this one
    first = np.flatnonzero(brk)
    return order, np.cumsum(brk) - 1, first, np.maximum.reduceat(hi, first) if len(first) else hi


def index_lists(docs: DataFrame, ranks: np.ndarray, *, bits: int, num: int, den: int, buckets: int) -> DataFrame:
    """The blocks of each shingle's index list: the set names of a block of up to PAIRED sets as `members`, of a longer one a star of links (a, b).

    A set that no other set of its short block can be linked with, by both positions, is left out.  Within a task, the entries of a longer block are linked at once and sent on
    as one entry with their least size and furthest reach, so a shingle of a third of all documents costs each task one entry.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def pack(token, low, reach, sid) -> list[tuple[int, bytes]]:
        where = ((token >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        kinds, cuts = np.unique(where[order], return_index=True)
        out = []
        for k, a, b in zip(kinds.tolist(), cuts, np.append(cuts[1:], len(order)), strict=True):
            i = order[a:b]
            out.append((k, token[i].tobytes() + low[i].astype(np.uint32).tobytes() + reach[i].astype(np.uint32).tobytes() + sid[i].tobytes()))
        return out

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of, held, total = shared.value, [], 0

        def flush():
            token, n, reach, sid = (np.concatenate([h[k] for h in held]) for k in range(4))
            order, chain, first, far = _chains(token.view(np.int64), n, reach, sid)
            token, n, reach, sid = token[order], n[order], reach[order], sid[order]
            again = np.zeros(len(token), bool)
            again[1:] = (token[1:] == token[:-1]) & (sid[1:] == sid[:-1])
            long = np.bincount(chain, ~again) > PAIRED
            one = ~again & ~long[chain]
            star = np.flatnonzero(long[chain])
            links = np.unique(np.stack([sid[first[chain[star]]], sid[star]], 1), axis=0) if len(star) else np.zeros((0, 2), np.int64)
            links = links[links[:, 0] != links[:, 1]]
            head = first[long]
            rows = pack(*(np.concatenate(x) for x in ((token[one], token[head]), (n[one], n[head]), (reach[one], far[long] | LONG), (sid[one], sid[head]))))
            empty = [b""] * len(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1] * len(links) + [k for k, _ in rows], pa.int32()), pa.array(links[:, 0].tolist() + [0] * len(rows), pa.int64()), pa.array(links[:, 1].tolist() + [0] * len(rows), pa.int64()), pa.array(empty + [x for _, x in rows], pa.binary())],
                ["bucket", "a", "b", "entries"],
            )

        for batch in batches:
            for row, stop, s, begins in text_sets(batch):
                n = np.diff(begins)
                sid, _ = _set_ids(s, begins)
                doc = np.repeat(np.arange(stop - row), n)
                order = np.lexsort((s, rank_of[(s >> np.uint64(64 - bits)).astype(np.int64)], doc))
                place = np.arange(len(s)) - begins[:-1][doc]
                size = n[doc]
                keep = place < size - -(-size * num // den) + 1
                size, place = size[keep], place[keep]
                held.append((s[order][keep], size, (size - place) * (num + den) // num - size, sid[doc][keep]))
                total += len(size)
                if total >= FLUSH:
                    yield from flush()
                    held, total = [], 0
        if total:
            yield from flush()

    def merge(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, names = [], ["a", "b", "members"]
        for batch in tables:
            if key[0].as_py() < 0:
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.nulls(len(batch), pa.binary())], names)
                continue
            for x in batch.column(3):
                raw = x.as_py()
                k = len(raw) // 24
                parts.append((np.frombuffer(raw, np.uint64, k), np.frombuffer(raw, np.uint32, k, 8 * k), np.frombuffer(raw, np.uint32, k, 12 * k), np.frombuffer(raw, np.int64, k, 16 * k)))
        if parts:
            token, low, reach, sid = (np.concatenate([p[k] for p in parts]) for k in range(4))
            low, reach = low.astype(np.int64), reach.astype(np.int64)
            longer, reach = reach >= LONG, reach & (LONG - 1)
            order, chain, first, _ = _chains(token.view(np.int64), low, reach, sid)
            token, low, reach, sid, longer = token[order], low[order], reach[order], sid[order], longer[order]
            again = np.zeros(len(token), bool)
            again[1:] = (token[1:] == token[:-1]) & (sid[1:] == sid[:-1]) & ~longer[1:]
            long = (np.bincount(chain, ~again) > PAIRED) | (np.bincount(chain, longer) > 0)
            star = np.flatnonzero(long[chain])
            if len(star):
                direct = np.unique(np.stack([sid[first[chain[star]]], sid[star]], 1), axis=0)
                direct = direct[direct[:, 0] != direct[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(direct[:, 0]), pa.array(direct[:, 1]), pa.nulls(len(direct), pa.binary())], names)
            one = ~again & ~long[chain]
            chain, low, reach, sid = chain[one], low[one], reach[one], sid[one]
            met = np.zeros(len(sid), bool)
            for d in range(1, min(PAIRED, len(sid))):
                both = chain[d:] == chain[:-d]
                if not both.any():
                    break
                both &= (low[d:] <= reach[:-d]) & (low[:-d] <= reach[d:])
                met[d:] |= both
                met[:-d] |= both
            chain, sid = chain[met], sid[met]
            sid = sid[np.lexsort((sid, chain))]
            begin = np.flatnonzero(np.diff(chain, prepend=-1))
            members = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(8 * np.append(begin, len(sid)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(sid))])
            yield pa.RecordBatch.from_arrays([pa.array(sid[begin], pa.int64()), pa.nulls(len(begin), pa.int64()), members], names)

    packed = docs.select("doc_id", "text").mapInArrow(spread, "bucket int, a long, b long, entries binary")
    dealt = packed.withColumn("salt", F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("a", "b"), F.lit(buckets)).cast("int")).otherwise(F.col("bucket")))
    return dealt.groupBy("salt").applyInArrow(merge, "a long, b long, members binary")


def block_pairs(blocks: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) within blocks(a, members): blocks of one least member meet in a task, so near copies, which share many blocks, give most of their pairs once."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush():
            a, b = (np.concatenate([h[k] for h in held]) for k in range(2))
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            a, b = a[new], b[new]
            for x in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[x : x + 100_000]), pa.array(b[x : x + 100_000])], ["a", "b"])

        for batch in batches:
            data, where = _bytes(batch.column(1))
            sid = np.frombuffer(data[where[0] : where[-1]].tobytes(), np.int64)
            block = np.repeat(np.arange(len(batch)), np.diff(where) // 8)
            for d in range(1, min(PAIRED, len(sid))):
                both = block[d:] == block[:-d]
                if not both.any():
                    break
                held.append((sid[:-d][both], sid[d:][both]))
                total += len(held[-1][0])
            if total >= FLUSH:
                yield from flush()
                held, total = [], 0
        if total:
            yield from flush()

    return blocks.select("a", "members").repartition("a").mapInArrow(pairs, "a long, b long").repartition("a").distinct()


def sketched_pairs(pairs: DataFrame, classes: DataFrame, *, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    one = classes.select(F.col("sid").alias("a"), "n", "sketch")
    two = classes.select(F.col("sid").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("sketch2"))
    met = pairs.join(one, "a").join(two, "b").where(F.least("n", "n2") * den >= F.greatest("n", "n2") * num)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            (x, at), (y, at2) = _bytes(batch.column(4)), _bytes(batch.column(5))
            width, width2 = np.diff(at), np.diff(at2)
            differ = np.zeros(len(batch), np.int64)
            kinds, kind = np.unique(np.stack([width, width2], 1), axis=0, return_inverse=True)
            for k, (w, w2) in enumerate(kinds.tolist()):
                rows, least = np.flatnonzero(kind.ravel() == k), min(w, w2)
                step = max(1, (1 << 22) // max(w, w2))
                for i in range(0, len(rows), step):
                    r = rows[i : i + step]
                    first, second = (np.bitwise_xor.reduce(d[f[r][:, None] + np.arange(v)].reshape(len(r), v // least, least), axis=1) for d, f, v in ((x, at, w), (y, at2, w2)))
                    differ[r] = np.bitwise_count(first ^ second).sum(1, dtype=np.int64)
            near = pa.array(differ * (den + num) <= total * (den - num))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])

    return met.select("a", "b", "n", "n2", "sketch", "sketch2").mapInArrow(judge, "a long, b long")


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range in turn."""
    return np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)


class _Lists:
    """Index lists of the sets of a group that are still outside: sorted (shingle, set) keys, sets by size, so that a range of sizes is one range of each list."""

    def __init__(self, code: np.ndarray, owner: np.ndarray, m: int):
        self.m, self.keys = m, np.sort(code * m + owner)

    def keep(self, alive: np.ndarray) -> None:
        self.keys = self.keys[alive[self.keys % self.m]]

    def within(self, codes: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the sets low to high - 1 stand in the lists of the shingles: first places and numbers."""
        a = np.searchsorted(self.keys, codes * self.m + low)
        return a, np.searchsorted(self.keys, codes * self.m + high) - a

    def sets(self, a: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.keys[_ranges(a, n)] % self.m


def linked_sets(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, component: np.ndarray, num: int, den: int, *, kept_answers: int = 64) -> list[tuple[int, int]]:
    """Links between sets (sorted hash arrays) of different components that join all linked ones: left x right, or all pairs where both mark every set.

    A walk from set to set; each is compared with the sets outside all components walked so far.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    by_size = np.argsort(sizes, kind="stable")
    sets, sizes, left, right = [sets[i] for i in by_size], sizes[by_size], left[by_size], right[by_size]
    _, group = np.unique(component[by_size], return_inverse=True)
    if group.max() == 0:
        return []
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)
    # rare shingles first: each set's codes in the order of its prefix
    count = np.bincount(code)
    place = np.empty(len(count), np.int64)
    place[np.argsort(count, kind="stable")] = np.arange(len(count))
    code = place[code]
    order = np.lexsort((code, owner))
    code = code[order]
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    lists = _Lists(code, owner, m)
    members = np.argsort(group, kind="stable")
    begins = np.searchsorted(group[members], np.arange(group.max() + 2))
    alive = np.ones(m, bool)
    outside = indexed = m
    marked = np.zeros(len(count), bool)
    answers: dict[int, tuple[np.ndarray, int, int]] = {}
    forest: list[tuple[int, int]] = []

    def overlaps(i: int, parent: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets that may be linked with set i, and their overlaps with it."""
        own, n = code[cuts[i] : cuts[i + 1]], int(sizes[i])
        low, high = int(np.searchsorted(sizes, -(-n * num // den))), int(np.searchsorted(sizes, n * den // num, "right"))
        prefix = own[: n - -(-n * num // den) + 1]
        near = lists.sets(*lists.within(prefix, low, high))
        near = np.unique(near[alive[near]])
        if not len(near):
            return near, near
        look = int(sizes[near].sum())
        held, ready = answers.get(parent), None
        if held is not None and held[1] <= low and high <= held[2]:
            other = code[cuts[parent] : cuts[parent + 1]]
            come, gone = np.setdiff1d(own, other, True), np.setdiff1d(other, own, True)
            plus, minus = lists.within(come, held[1], held[2]), lists.within(gone, held[1], held[2])
            if plus[1].sum() + minus[1].sum() + m <= look:
                ready = held[0] + np.bincount(lists.sets(*plus), minlength=m) - np.bincount(lists.sets(*minus), minlength=m), held[1], held[2]
        if ready is None:
            wide = int(np.searchsorted(sizes, -(-sizes[low] * num // den))), int(np.searchsorted(sizes, sizes[high - 1] * den // num, "right"))
            every = lists.within(own, *wide)
            if every[1].sum() <= look:
                ready = np.bincount(lists.sets(*every), minlength=m), *wide
        if ready is None:
            marked[own] = True
            hits = marked[code[_ranges(cuts[near], sizes[near])]].astype(np.int64)
            marked[own] = False
            return near, np.add.reduceat(hits, np.cumsum(sizes[near]) - sizes[near])
        answers[i] = ready
        if len(answers) > kept_answers:
            answers.pop(next(iter(answers)))
        return near, ready[0][near]

    def enter(g: int) -> list[int]:
        nonlocal outside
        new = members[begins[g] : begins[g + 1]]
        alive[new] = False
        outside -= len(new)
        return new.tolist()

    for g in np.argsort(begins[:-1] - begins[1:], kind="stable").tolist():
        if not outside:
            break
        if not alive[members[begins[g]]]:
            continue
        walk = [(i, -1) for i in enter(g)]
        while walk and outside:
            i, parent = walk.pop()
            if 2 * outside <= indexed:
                lists.keep(alive)
                indexed = outside
            near, shared = overlaps(i, parent)
            if len(near):
                linked = (shared * den >= num * (sizes[near] + sizes[i] - shared)) & ((left[near] & right[i]) | (right[near] & left[i]))
                found, at = np.unique(group[near[linked]], return_index=True)
                for h, j in zip(found.tolist(), near[linked][at].tolist(), strict=True):
                    forest.append((int(by_size[i]), int(by_size[j])))
                    walk += [(x, i) for x in enter(h)]
    return forest


def group_links(rows: DataFrame, docs: DataFrame, *, num: int, den: int) -> DataFrame:
    """Verified links (a, b) between classes within the groups of rows(rep, n, sid, sid2, component, g, side): side 0 with side 1, and side 2 with itself.

    The texts of representatives meet their rows by doc_id; a text of that id that is not of the class is left out.  Before they are shuffled, texts of which
    no representative shares the bucket are left out too: the buckets in use, MET_BUCKETS at most, are broadcast.
    """
    wanted = rows.groupBy("rep", "sid", "sid2").agg(F.collect_list(F.struct("g", "side", "component")).alias("in"))  # as many as a class has groups: its part's neighbours
    bucket = F.pmod(F.xxhash64("rep"), F.lit(MET_BUCKETS))
    met = docs.select(F.col("doc_id").alias("rep"), "text").withColumn("met", bucket).join(F.broadcast(rows.select(bucket.alias("met")).distinct()), "met", "left_semi")
    texts = met.select("rep", "text").join(wanted, "rep")
    texts = texts.select("rep", "sid", "sid2", "text", F.explode("in").alias("x")).select("x.g", "rep", "sid", "sid2", "x.side", "x.component", "text")

    def link(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple[int, int, int], tuple[np.ndarray, int, int]] = {}
        for batch in batches:
            names = [batch.column(k).to_pylist() for k in range(1, 6)]
            for row, _, s, begins in text_sets(batch):
                sid, sid2 = _set_ids(s, begins)
                for d, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
                    rep, first, second, side, component = (x[row + d] for x in names)
                    if first == sid[d] and second == sid2[d]:
                        sets[rep, first, second] = s[a:b], side, component
        found = []
        if len(sets) > 1:
            side = np.array([x[1] for x in sets.values()])
            found = linked_sets([x[0] for x in sets.values()], side != 1, side != 0, np.array([x[2] for x in sets.values()]), num, den)
        rep = [k[0] for k in sets]
        yield pa.RecordBatch.from_arrays([pa.array([rep[a] for a, _ in found], pa.int64()), pa.array([rep[b] for _, b in found], pa.int64())], ["a", "b"])

    return texts.groupBy("g").applyInArrow(link, "a long, b long")


def family_links(families: DataFrame, docs: DataFrame, *, num: int, den: int, block: int) -> DataFrame:
    """Links (a, b) between the classes of families(rep, n, sid, sid2, family) that give the components of all links.

    A family of more than `block` shingles in all is cut by size, where sets further apart than one step can't link, and by hash into parts of about
    `block`; no group holds more than two parts.  Neighbouring parts are compared first, in a number of groups that grows with the
    family, not with its square.  Other pairs of parts follow where they still hold more than one component.
    """
    families = checkpointed(families)
    large = families.groupBy("family").agg(F.sum("n").alias("total")).where(F.col("total") > block).select("family", F.lit(True).alias("large"))
    marked = families.join(large, "family", "left")
    group = lambda *x: F.xxhash64(F.col("family"), *x)
    small = marked.where("large IS NULL").select("rep", "n", "sid", "sid2", F.col("rep").alias("component"), group(F.lit(-1)).alias("g"), F.lit(2).alias("side"))
    step = F.floor(F.log(F.col("n").cast("double")) / (math.log(den / num) * 1.001)).cast("int")
    big = marked.where("large").withColumn("step", step)
    parts = checkpointed(big.groupBy("family", "step").agg(F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("parts")))
    if parts.isEmpty():
        return group_links(small, docs, num=num, den=den)
    of = big.join(parts, ["family", "step"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    of = checkpointed(of.select("rep", "n", "sid", "sid2", "family", "step", "part", "parts"))
    # first: (p, p + 1) of one step as a whole, and part 0 with part 0 of the next step
    p, last = F.col("part"), F.col("parts") - 1
    whole = F.sequence(F.greatest(p - 1, F.lit(0)), F.least(p, F.greatest(last - 1, F.lit(0))))
    first = of.select("*", F.explode(whole).alias("x")).select("rep", "n", "sid", "sid2", F.col("rep").alias("component"), group(F.col("step"), F.col("x"), F.lit(0)).alias("g"), F.lit(2).alias("side"))
    cross = of.where("part = 0").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("up")).select("rep", "n", "sid", "sid2", F.col("rep").alias("component"), group(F.col("step") - F.col("up"), F.lit(0), F.lit(1)).alias("g"), F.col("up").alias("side"))
    links = checkpointed(group_links(small.unionByName(first).unionByName(cross), docs, num=num, den=den))
    # then: pairs of parts that hold more than one component so far
    component = connected_components(links).withColumnRenamed("node", "rep")
    of = checkpointed(of.join(component, "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    ends = of.groupBy("family", "step", "part", "parts").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    next_ = ends.select("family", (F.col("step") - 1).alias("step"), F.col("part").alias("part2"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.lit(1).alias("up"))
    same = ends.select("family", "step", F.col("part").alias("part2"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.lit(0).alias("up"))
    other = same.unionByName(next_)
    open_ = F.least("low", "low2") < F.greatest("high", "high2")
    left_over = ends.join(other, ["family", "step"]).where(open_ & F.when(F.col("up") == 0, F.col("part2") > F.col("part") + 1).otherwise((F.col("part") > 0) | (F.col("part2") > 0)))
    left_over = checkpointed(left_over.select("family", "step", "part", "part2", "up"))
    if left_over.isEmpty():
        return links
    g = group(F.col("step"), F.col("part"), F.col("part2"), F.col("up") + 2)
    sides = left_over.select("family", "step", "part", g.alias("g"), F.lit(0).alias("side")).unionByName(left_over.select("family", (F.col("step") + F.col("up")).alias("step"), F.col("part2").alias("part"), g.alias("g"), F.lit(1).alias("side")))
    rest = of.join(sides, ["family", "step", "part"]).select("rep", "n", "sid", "sid2", "component", "g", "side")
    return links.unionByName(group_links(rest, docs, num=num, den=den))


def jaccard_components(docs: DataFrame, *, num: int = 80, den: int = 100, bits: int = 22, block: int = 500_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; documents link from a Jaccard similarity of num / den on.

    Null texts and texts without words have an empty set and link with nothing; a text of one to four words is one
    shingle; a very long text is one set, held by the tasks that compare it.  Shingles are counted in 2**bits buckets, up to four times as many where there is more than a bucket's 128 bytes of text.  Repeated rows are equal sets, so they share a component and each gives
    a row; rows of one doc_id with different texts are judged by their own texts.  Rows without doc_id keep their n_shingles and have no component.  Extra columns are
    ignored.  Words and shingles are compared by 64-bit hashes, equal sets by 128 bits and their size.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = 1 << min(10, max(4, (partitions - 1).bit_length()))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    bits = min(bits + 2, max(bits, (size >> 7).bit_length()))
    everything = checkpointed(set_pass(docs, bits=bits, slices=slices))
    sets = everything.where("slice IS NULL").select("doc_id", "n", "sid", "sid2")
    ranks = shingle_ranks(everything.where("slice IS NOT NULL").select("slice", "counts"), bits=bits, slices=slices)
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    named = everything.where("slice IS NULL AND n > 0 AND doc_id IS NOT NULL")
    classes = checkpointed(named.groupBy("sid", "sid2", "n").agg(F.min("doc_id").alias("rep"), F.min("sketch").alias("sketch")))
    buckets = max(partitions, total // 4_000_000 + 1)
    blocks = checkpointed(index_lists(docs.where("doc_id IS NOT NULL"), ranks, bits=bits, num=num, den=den, buckets=buckets))
    pairs = sketched_pairs(block_pairs(blocks.where("members IS NOT NULL")), classes, num=num, den=den)
    family = connected_components(pairs.unionByName(blocks.where("members IS NULL").select("a", "b"))).withColumnRenamed("node", "sid").withColumnRenamed("component", "family")
    links = family_links(classes.select("rep", "n", "sid", "sid2").join(family, "sid"), docs, num=num, den=den, block=block)
    linked = connected_components(links).select(F.col("node").alias("rep"), F.col("component").alias("low"))
    found = classes.join(linked, "rep", "left").select("sid", "sid2", "n", F.coalesce("low", "rep").alias("low"))
    return sets.join(found, ["sid", "sid2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("low")).otherwise(F.col("doc_id")).alias("component_id"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
