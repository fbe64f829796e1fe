"""Vectorised word and shingle hashing over Arrow string batches.

Every function here works on the bytes of a whole batch with numpy, so a task pays a few passes over
its text instead of a Python call per word.  Words are maximal runs of bytes other than
0x20 and 0x09-0x0D; nulls count as empty texts.  Hashes are 64-bit and seeded by fixed constants, so that
every task of every job names the same word alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A chunk holds about so many bytes of text (a longer single text makes a chunk of its own).
CHUNK_BYTES = 1 << 21

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of plain words: every ASCII byte but letters and digits.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not chr(x).isalnum() for x in range(128)]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = [np.uint64(x | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, x in enumerate((_BASE, _BASE_INV)):
            out = _POWERS[k]
            while len(out) < n:
                out = np.concatenate([out, out * np.uint64(pow(x, len(out), 1 << 64))])
            _POWERS[k] = out
    return _POWERS[0], _POWERS[1]


def chunks(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into (first row, last row, bytes, offsets); nulls are empty."""
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        stop = min(stop, n)
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] = sum of byte codes times powers over [i, j)."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, stop): depends on the bytes and their number alone."""
    inverse = powers(len(sums))[1]
    return mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64) * _STEP[1])


def _places(n: int) -> np.ndarray:
    """Random odd factors of the first n places of a word, n up to 2**16; each place has its own, whatever n is."""
    global _PLACES
    if len(_PLACES) < n:
        _PLACES = mix(np.arange(1, 2 * n, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    return _PLACES


_PLACES = np.zeros(0, np.uint64)


def _word_hashes(data: np.ndarray, solid: np.ndarray, start: np.ndarray, stop: np.ndarray, lower: bool) -> np.ndarray:
    """Multilinear hashes: the sum of byte codes times the random factor of the byte's place in its word.

    No structure of the words (such as a Thue-Morse pattern) makes two of them meet, as it can in a polynomial modulo 2**64.
    """
    size = stop - start
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    code = (_LOWER if lower else _BYTE)[data[solid]]
    longest = int(size.max())
    if longest > 1 << 16:
        block = (place >> 16).astype(np.uint64)
        code = code * np.where(block > 0, mix(block) | np.uint64(1), np.uint64(1))  # a word hashes alike, whatever long words stand beside it
        place = place & 0xFFFF
    total = np.add.reduceat(code * _places(min(longest, 1 << 16))[place], first)
    return mix(total + size.astype(np.uint64) * _STEP[1])


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, separators: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and stop of each word of a chunk, and for each text the index of its first word (one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    solid = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = _word_hashes(data, solid, start, stop, lower) if len(start) else np.zeros(0, np.uint64)
    return hashes, start, stop, np.searchsorted(start, offsets)


def shingles(hashes: np.ndarray, begins: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `width` words within a text, and for each text the index of its first shingle.

    A text of fewer words gives its whole sequence as one shingle; a text without words gives none.
    """
    counts = np.diff(begins)
    per = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    firsts = np.concatenate([[0], np.cumsum(per)])
    total = int(firsts[-1])
    if not total:
        return np.zeros(0, np.uint64), firsts
    at = np.arange(total) - np.repeat(firsts[:-1], per) + np.repeat(begins[:-1], per)
    size = np.repeat(np.minimum(counts, width), per)
    out = size.astype(np.uint64) * _STEP[4]
    for k in range(width):
        inside = size > k
        out = mix(out) + np.where(inside, hashes[np.minimum(at + k, len(hashes) - 1)] * _STEP[k % 5] + np.uint64(k), np.uint64(0))
    return mix(out), firsts


def text_sets(batch: pa.RecordBatch, text: str = "text", width: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, shingles, begins) by chunk: each text's distinct shingles, sorted."""
    for row, stop, data, offsets in chunks(batch, text):
        h, _, _, begins = words(data, offsets, lower=True)
        s, firsts = shingles(h, begins, width)
        doc = np.repeat(np.arange(stop - row), np.diff(firsts))
        order = np.argsort(s, kind="stable")
        order = order[np.argsort(doc[order], kind="stable")]
        s, doc = s[order], doc[order]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
        yield row, stop, s[keep], np.searchsorted(doc[keep], np.arange(stop - row + 1))
