"""Removal of byte strings that an earlier document holds, by bucket-pointer refinement of suffixes.

Only one question of the suffix order is needed: which suffixes agree on their first `length` bytes, and what is the
smallest document among them.

1. A suffix is dealt by a q-gram among its first `length` bytes, its anchor: the one of the least hash, q-grams that `common_grams` found
   in far more places than most coming last.  Suffixes that agree on `length` bytes have the same anchor at the same offset, so
   one entry per anchor, not one per byte, is dealt to the initial buckets.  Buckets of one document end here.
2. A run of neighbouring suffixes with one anchor is named by its whole extent.  A run that a smaller document has too is
   settled at once for all its suffixes: the smaller document's result is reused.
3. Runs that are the first of their kind, in a bucket where first runs of several documents meet, send their bytes.  `repeated_windows`
   sorts their suffixes into buckets of 8-grams and refines each open bucket by the bucket identifiers at offsets 8, 16 and 18: an identifier
   to 16 bytes is the pair of those to 8, and so on to `length`, each step reusing the identifiers of the step before.  Buckets of one
   document are closed and never sorted again.  No hash decides here.

Each task sends on one entry for each run it met, with its smallest document, so a passage of a third of all rows costs each
task one entry.  Results return packed by groups of documents, so rows number as the blocks of a shuffle do, not as documents times buckets.
Runs are named by 64 bits of a hash within the buckets of an independent one of 32 bits and more.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelframe.llm.common import table
from reelframe.llm.textcodes import chunks, mix, prefix_sums, span_hash

#: Length of a q-gram, entries that a task gathers before it sends them on, and bytes of a text looked at together.
Q, FLUSH, SEGMENT = 20, 1_500_000, 1 << 22
_PLACE = np.uint64((1 << 28) - 1)
#: Hash buckets in which q-grams are counted, and how many times the mean makes one common.
GRAM_BITS, COMMON = 22, 8


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the bytes and the hash of the q-gram at each place."""
    sums = prefix_sums(data)
    return sums, span_hash(sums, np.arange(len(data) - Q + 1), np.arange(Q, len(data) + 1))


def common_grams(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Which of 2**GRAM_BITS hash buckets hold common q-grams (bits, packed), and the number of bytes of all texts.

    A task reports buckets of four times its own mean: what is common overall is common in some task.  At most 1 / COMMON of the buckets can be
    common.  They only steer which q-gram is an anchor, never a result.
    """
    size = 1 << GRAM_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(size, np.int64), 0
        for batch in batches:
            for _, _, data, _ in chunks(batch):
                total += len(data)
                for k in range(0, len(data), SEGMENT):
                    part = data[k : k + SEGMENT + Q - 1]
                    if len(part) >= Q:
                        counts += np.bincount((_grams(part)[1] >> np.uint64(64 - GRAM_BITS)).astype(np.int64), minlength=size)
        many = np.flatnonzero(counts > 16 + 4 * counts.mean())
        yield pa.RecordBatch.from_arrays([pa.array(np.append(many, -1)), pa.array(np.append(counts[many], total))], ["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).persist()
    total = found.where("bucket < 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    bits = np.zeros(size, bool)
    common = found.where((F.col("bucket") >= 0) & (F.col("n") > 64 + COMMON * (total // size))).select("bucket").toArrow()  # at most 2**GRAM_BITS / COMMON numbers
    bits[common.column(0).to_numpy()] = True
    found.unpersist()
    return np.packbits(bits), total


class Runs:
    """The runs of suffixes of a chunk of documents: start, number, anchor hash, identifier and document of each.

    A text longer than SEGMENT is looked at in pieces that overlap by `length` - 1 bytes, so a run ends with its piece.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, common: np.ndarray):
        self.length = length
        if len(data) <= 2 * SEGMENT or len(offsets) > 2:
            found = [self._look(data, offsets, common)]
        else:
            found = []
            for k in range(0, max(1, len(data) - length + 1), SEGMENT):
                part = data[k : k + SEGMENT + length - 1]
                start, *rest = self._look(part, np.array([0, len(part)]), common)
                found.append((start + k, *rest))
        self.start, self.count, self.anchor, self.name = (np.concatenate([f[i] for f in found]) for i in range(4))
        self.doc = np.searchsorted(offsets, self.start, "right") - 1

    def _look(self, data: np.ndarray, offsets: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, ...]:
        length, sizes = self.length, np.diff(offsets)
        if len(data) < length or sizes.max(initial=0) < length:
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64), none.astype(np.uint64)
        sums, grams = _grams(data)
        last_place = common[(grams >> np.uint64(64 - GRAM_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(63)
        low = (((grams >> np.uint64(1)) | last_place) & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        width, have = length - Q + 1, 1
        while have * 2 <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < width:
            low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
        edge = np.zeros(len(data) + 1, np.int64)
        long = sizes >= length
        np.add.at(edge, offsets[:-1][long], 1)
        np.add.at(edge, offsets[1:][long] - length + 1, -1)
        valid = np.cumsum(edge)[: len(low)] > 0
        at = (low & _PLACE).astype(np.int64)
        first = valid.copy()
        first[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
        last = valid.copy()
        last[:-1] &= (at[1:] != at[:-1]) | ~valid[1:]
        start = np.flatnonzero(first)
        stop = np.flatnonzero(last) + 1
        return start, stop - start, grams[at[start]], span_hash(sums, start, stop + length - 1)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range in turn."""
    return np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)


def repeated_windows(data: np.ndarray, sizes: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each entry (a stretch of `sizes` bytes of `data` from document `doc`) the bits of its windows of `length` bytes that an entry of a smaller document has.

    Bucket-pointer refinement: identifier[p] is the bucket of the suffix at p to `known` bytes, -1 where it is closed, that is, where one document
    alone has it.  Each step sorts open suffixes by their own bucket and the bucket at a later offset.
    """
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(begins + sizes, sizes) - np.arange(len(data))  # bytes from here to the entry's end
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    identifier = np.ndarray((len(data),), "<u8", padded.tobytes(), strides=(1,)).copy()
    known, smallest = 8, np.zeros(0, np.int64)
    open_ = np.flatnonzero(left >= known)
    keys = identifier[open_]
    buckets = np.full(len(data), -1, np.int64)
    while True:
        order = np.argsort(keys, kind="stable")
        at, key = open_[order], keys[order]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(new)
        buckets[:] = -1
        if not len(heads):
            smallest = np.zeros(0, np.int64)
            break
        of = doc[owner[at]]
        smallest, largest = np.minimum.reduceat(of, heads), np.maximum.reduceat(of, heads)
        several = (smallest < largest)[np.cumsum(new) - 1]
        number = np.cumsum(smallest < largest) - 1
        buckets[at[several]] = number[(np.cumsum(new) - 1)[several]]
        smallest = smallest[smallest < largest]
        if known == length:
            break
        step = min(known, length - known)
        known += step
        open_ = np.flatnonzero(buckets >= 0)
        open_ = open_[left[open_] >= known]
        open_ = open_[buckets[open_ + step] >= 0]
        keys = buckets[open_] * (len(smallest) + 1) + buckets[open_ + step]
    out = np.zeros(len(sizes), np.uint64)
    at = np.flatnonzero(buckets >= 0)
    at = at[doc[owner[at]] > smallest[buckets[at]]]
    np.bitwise_or.at(out, owner[at], np.uint64(1) << (at - begins[owner[at]]).astype(np.uint64))
    return out


def _packed(where: np.ndarray, columns: list[np.ndarray], doc: np.ndarray) -> tuple[list[int], list[bytes]]:
    """For each bucket one binary of its columns, and of the documents as compressed differences."""
    if not len(where):
        return [], []
    order = np.lexsort((doc, where))
    where, doc, columns = where[order], doc[order], [c[order] for c in columns]
    buckets, cuts = np.unique(where, return_index=True)
    out = []
    for a, b in zip(cuts, np.append(cuts[1:], len(where)), strict=True):
        docs = zlib.compress(np.diff(doc[a:b], prepend=0).tobytes(), 1)
        out.append(np.array([b - a], np.int64).tobytes() + b"".join(c[a:b].tobytes() for c in columns) + docs)
    return buckets.tolist(), out


def _unpacked(raw: bytes, kinds: list[type]) -> tuple[list[np.ndarray], np.ndarray]:
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out, np.cumsum(np.frombuffer(zlib.decompress(raw[at:]), np.int64))


def _firsts(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (keys, doc) without repeats, and whether each entry is its key's smallest document."""
    order = np.lexsort((doc, *reversed(keys)))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    fresh = new.copy()
    fresh[1:] |= doc[order][1:] != doc[order][:-1]
    order, new = order[fresh], new[fresh]
    return order, new


def _halves(name: np.ndarray) -> list[np.ndarray]:
    """Names as two columns of four bytes."""
    return [(name >> np.uint64(32)).astype(np.uint32), (name & np.uint64(0xFFFFFFFF)).astype(np.uint32)]


def _whole(halves: list[np.ndarray]) -> np.ndarray:
    return halves[0].astype(np.uint64) << np.uint64(32) | halves[1]


def _grouped(doc: np.ndarray, groups: int) -> np.ndarray:
    """The group of each document."""
    return (mix(doc.view(np.uint64)) % np.uint64(groups)).astype(np.int64)


_PACKED = "bucket int, settled binary, open binary, entries binary"


def _rows(bucket: list[int], settled: list, open_: list, entries: list) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((bucket, settled, open_, entries), kinds, strict=True)], ["bucket", "settled", "open", "entries"])


def _known(doc: np.ndarray, columns: list[np.ndarray], groups: int) -> pa.RecordBatch:
    """Results known in the task already: they pass the exchange in buckets below 0, one for each group of documents."""
    where, blobs = _packed(_grouped(doc, groups), columns, doc)
    none = [None] * len(blobs)
    return _rows([-1 - g for g in where], blobs, none, none)


def _results(where: list[int], settled: list, open_: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(settled, pa.binary()), pa.array(open_, pa.binary())], ["docs", "settled", "open"])


def _passed(group: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    return _results([group] * batch.num_rows, batch.column(1).to_pylist(), [None] * batch.num_rows)


def _by_document(refined: DataFrame, kinds: list[type]) -> DataFrame:
    """One row for each document with a result: doc_id and the bytes of its settled and open names."""

    def collect(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list] = [[], []]
        for batch in tables:
            for k in (0, 1):
                got[k] += [_unpacked(x.as_py(), kinds) for x in batch.column(1 + k) if x.is_valid]
        lists: list[dict[int, bytes]] = [{}, {}]
        for k, parts in enumerate(got):
            if parts:
                doc = np.concatenate([p[1] for p in parts])
                order = np.argsort(doc, kind="stable")
                ids, cuts = np.unique(doc[order], return_index=True)
                columns = [np.split(np.concatenate([p[0][i] for p in parts])[order], cuts[1:]) for i in range(len(kinds))]
                lists[k] = {d: b"".join(c[i].tobytes() for c in columns) for i, d in enumerate(ids.tolist())}
        ids = sorted({*lists[0], *lists[1]})
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([x.get(d) for d in ids], pa.binary()) for x in lists)], ["doc_id", "settled", "open"])

    return refined.groupBy("docs").applyInArrow(collect, "doc_id long, settled binary, open binary")


def run_buckets(docs: DataFrame, shared, *, length: int, buckets: int) -> DataFrame:
    """(doc_id, settled, open), the last two as bytes of names: of runs that a smaller document has, and of first runs in buckets that hold first runs of other documents."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, common = [], 0, np.unpackbits(shared.value).view(bool)

        def flush():
            anchor, name, doc = (np.concatenate([h[k] for h in held]) for k in range(3))
            order, first = _firsts([anchor, name], doc)
            anchor, name, doc = anchor[order], name[order], doc[order]
            if not first.all():
                yield _known(doc[~first], _halves(name[~first]), buckets)
            anchor, name, doc = anchor[first], name[first], doc[first]
            low = (anchor & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            where, entries = _packed(((anchor >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), [low, *_halves(name)], doc)
            none = [None] * len(where)
            yield _rows(where, none, none, entries)

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, _, data, offsets in chunks(batch):
                runs = Runs(data, offsets, length, common)
                held.append((runs.anchor, runs.name, ids[row + runs.doc]))
                total += len(runs.start)
                if total >= FLUSH:
                    yield from flush()
                    held, total = [], 0
        if total:
            yield from flush()

    def refine(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in tables:
            if key[0].as_py() < 0:
                yield _passed(-1 - key[0].as_py(), batch)
                continue
            parts += [_unpacked(x.as_py(), [np.uint32, np.uint32, np.uint32]) for x in batch.column(3)]
        if not parts:
            return
        anchor, name = np.concatenate([p[0][0] for p in parts]), np.concatenate([_whole(p[0][1:]) for p in parts])
        doc = np.concatenate([p[1] for p in parts])
        del parts
        order, first = _firsts([anchor, name], doc)
        # first runs need refining only where those of one bucket begin in different documents
        group, heads = np.unique(anchor[order][first], return_inverse=True)
        smallest = np.full(len(group), np.iinfo(np.int64).max)
        largest = np.full(len(group), np.iinfo(np.int64).min)
        np.minimum.at(smallest, heads, doc[order][first])
        np.maximum.at(largest, heads, doc[order][first])
        mixed = np.zeros(len(order), bool)
        mixed[first] = (smallest < largest)[heads]
        for settled, which in ((True, ~first), (False, mixed)):
            doc_, name_ = doc[order][which], name[order][which]
            where, blobs = _packed(_grouped(doc_, buckets), _halves(name_), doc_)
            none = [None] * len(blobs)
            yield _results(where, blobs if settled else none, none if settled else blobs)

    packed = docs.mapInArrow(spread, _PACKED)
    return _by_document(packed.groupBy("bucket").applyInArrow(refine, "docs int, settled binary, open binary"), [np.uint32, np.uint32])


def _stretches(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    return data[_ranges(start, size)].tobytes()


def suffix_buckets(joined: DataFrame, shared, *, length: int, buckets: int, slice_bytes: int = 2_000_000) -> DataFrame:
    """(doc_id, repeated): names of open runs and bits of their windows whose first `length` bytes a smaller document has, from (doc_id, text, open)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, common = [], 0, np.unpackbits(shared.value).view(bool)

        def flush():
            anchor, name, size, doc = (np.concatenate([h[k] for h in held]) for k in range(4))
            data = np.concatenate([h[4] for h in held])
            begins = np.cumsum(size) - size
            bucket = ((anchor >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((doc, anchor, bucket))
            where, cuts = np.unique(bucket[order], return_index=True)
            entries = []
            for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
                i = order[a:b]
                rest = zlib.compress(doc[i].tobytes() + _stretches(data, begins[i], size[i]), 1)
                entries.append(np.array([b - a], np.int64).tobytes() + (anchor[i] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + b"".join(x.tobytes() for x in _halves(name[i])) + size[i].astype(np.uint8).tobytes() + rest)
            none = [None] * len(entries)
            yield _rows(where.tolist(), none, none, entries)

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(2)
            for row, stop, data, offsets in chunks(batch):
                runs = Runs(data, offsets, length, common)
                cuts = np.searchsorted(runs.doc, np.arange(stop - row + 1))
                keep = np.zeros(len(runs.start), bool)
                for d in range(stop - row):
                    a, b = cuts[d], cuts[d + 1]
                    keep[a:b] = np.isin(runs.name[a:b], _runs_of(lists[row + d].as_py()))
                which = np.flatnonzero(keep)
                _, once = np.unique(np.stack([runs.doc[which].astype(np.uint64), runs.name[which]]), axis=1, return_index=True)
                which = which[np.sort(once)]
                size = runs.count[which] + length - 1
                held.append((runs.anchor[which], runs.name[which], size, ids[row + runs.doc[which]], data[_ranges(runs.start[which], size)]))
                total += len(which)
                if total >= FLUSH // 16:
                    yield from flush()
                    held, total = [], 0
        if total:
            yield from flush()

    def refine(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in tables:
            for x in batch.column(3):
                raw = x.as_py()
                n = int(np.frombuffer(raw, np.int64, 1)[0])
                rest = np.frombuffer(zlib.decompress(raw[8 + 13 * n :]), np.uint8)
                got.append((np.frombuffer(raw, np.uint32, n, 8), _whole([np.frombuffer(raw, np.uint32, n, 8 + 4 * n), np.frombuffer(raw, np.uint32, n, 8 + 8 * n)]), np.frombuffer(raw, np.uint8, n, 8 + 12 * n).astype(np.int64), rest[: 8 * n].view(np.int64), rest[8 * n :]))
        anchor, name, size, doc, data = (np.concatenate([g[k] for g in got]) for k in range(5))
        del got
        order = np.lexsort((doc, anchor))
        anchor, name, doc = anchor[order], name[order], doc[order]
        begins, size = (np.cumsum(size) - size)[order], size[order]
        mask = np.zeros(len(order), np.uint64)
        # whole anchors together, some millions of bytes at a time
        heads = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(anchor))
        ends = np.append(0, np.cumsum(size))[heads]
        a = 0
        while a < len(heads) - 1:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + slice_bytes, "right")) - 1)
            i = slice(heads[a], heads[b])
            mask[i] = repeated_windows(data[_ranges(begins[i], size[i])], size[i], doc[i], length)
            a = b
        found = mask > 0
        where, blobs = _packed(_grouped(doc[found], buckets), [*_halves(name[found]), mask[found]], doc[found])
        yield _results(where, blobs, [None] * len(blobs))

    refined = joined.mapInArrow(spread, _PACKED).groupBy("bucket").applyInArrow(refine, "docs int, settled binary, open binary")
    return _by_document(refined, [np.uint32, np.uint32, np.uint64]).select("doc_id", F.col("settled").alias("repeated"))


def _runs_of(data: bytes | None) -> np.ndarray:
    """Names of runs from eight bytes each: all upper parts, then all lower ones."""
    n = len(data or b"") // 8
    return _whole([np.frombuffer(data, np.uint32, n), np.frombuffer(data, np.uint32, n, 4 * n)]) if n else np.zeros(0, np.uint64)


def _windows_of(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Names of runs, in order, and bits of their repeated windows, from sixteen bytes each."""
    n = len(data or b"") // 16
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    name, bits = _whole([np.frombuffer(data, np.uint32, n), np.frombuffer(data, np.uint32, n, 4 * n)]), np.frombuffer(data[8 * n :], np.uint64)
    order = np.argsort(name, kind="stable")
    return name[order], bits[order]


def remove_repeats(docs: DataFrame, *, length: int = 50, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row; with `keep_text` also `kept` (binary) and the row itself as `row`.

    A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller doc_id, judged on the input.
    Null texts are empty; texts shorter than `length` lose nothing; rows of one doc_id never remove from
    one another; rows without doc_id neither lose bytes nor make others lose them; a very long text is looked at in pieces that overlap.  Extra
    columns are ignored.  `length` is 28 to 83 bytes: a run has at most 64 windows and its extent less than 256 bytes.
    """
    if not Q + 8 <= length <= Q + 63:
        raise ValueError(f"length must be from {Q + 8} to {Q + 63}")
    spark = docs.sparkSession
    rest = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")] if keep_text else []
    rows = docs.select("doc_id", "text", *rest)
    named = rows.where("doc_id IS NOT NULL")
    packed, size = common_grams(named)
    common_of = spark.sparkContext.broadcast(packed)  # 2**GRAM_BITS bits
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // ((length - Q) // 2 * 1_000_000) + 1)
    runs = run_buckets(named.select("doc_id", "text"), common_of, length=length, buckets=buckets)
    shared = named.join(runs, "doc_id", "left")
    # both uses of the texts by document read one exchange, so this one takes all columns too
    opened = shared.where("open IS NOT NULL").select("doc_id", "text", "open", *(["row"] if keep_text else []))
    suffixes = suffix_buckets(opened, common_of, length=length, buckets=buckets)
    found = shared.join(suffixes, "doc_id", "left").select("doc_id", "text", "settled", "repeated", *(["row"] if keep_text else []))
    bare = rows.where("doc_id IS NULL").select("doc_id", "text", F.lit(None).cast("binary").alias("settled"), F.lit(None).cast("binary").alias("repeated"), *(["row"] if keep_text else []))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.unpackbits(common_of.value).view(bool)
        for batch in batches:
            settled, repeated = batch.column(2), batch.column(3)
            for row, stop, data, offsets in chunks(batch):
                gone = np.zeros(len(data) + 1, np.int64)
                if any(settled[k].is_valid or repeated[k].is_valid for k in range(row, stop)):
                    runs = Runs(data, offsets, length, common)
                    cuts = np.searchsorted(runs.doc, np.arange(stop - row + 1))
                    for d in range(stop - row):
                        whole, (parts, bits) = _runs_of(settled[row + d].as_py()), _windows_of(repeated[row + d].as_py())
                        if not len(whole) and not len(parts):
                            continue
                        mine = np.arange(cuts[d], cuts[d + 1])
                        dup = np.isin(runs.name[mine], whole)
                        np.add.at(gone, runs.start[mine[dup]], 1)
                        np.add.at(gone, runs.start[mine[dup]] + runs.count[mine[dup]] + length - 1, -1)
                        if len(parts):
                            rest = mine[~dup]
                            k = np.minimum(np.searchsorted(parts, runs.name[rest]), len(parts) - 1)
                            rest, k = rest[parts[k] == runs.name[rest]], k[parts[k] == runs.name[rest]]
                            for w in range(length - Q + 1):
                                at = runs.start[rest[(bits[k] >> np.uint64(w)) & np.uint64(1) > 0]] + w
                                np.add.at(gone, at, 1)
                                np.add.at(gone, at + length, -1)
                mask = np.cumsum(gone)[:-1] > 0
                out: list[list] = [[], [], [], [], []]
                for d in range(stop - row):
                    a, b = offsets[d], offsets[d + 1]
                    lost = mask[a:b]
                    kept = data[a:b][~lost].tobytes() if lost.any() else data[a:b].tobytes()
                    for column, x in zip(out, (b - a, b - a - len(kept), int(lost[:1].sum() + (lost[1:] & ~lost[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                        column.append(x)
                columns = [batch.column(0).slice(row, stop - row), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())]
                if keep_text:
                    columns += [pa.array(out[4], pa.binary()), batch.column(4).slice(row, stop - row)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept", "row"] * keep_text])

    schema = T.StructType().add("doc_id", T.LongType()).add("n_bytes", T.LongType()).add("n_removed", T.LongType()).add("n_spans", T.LongType()).add("kept_sha256", T.StringType())
    if keep_text:
        schema = schema.add("kept", T.BinaryType()).add(rows.schema["row"])
    return found.unionByName(bare).mapInArrow(cut, schema)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
