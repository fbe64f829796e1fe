"""Words of Arrow text batches as exact strings: what the counting, ranking and matching operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from reelframe.llm.textcodes import NOT_ALNUM

#: Separators of pure letter terms: every ASCII byte but letters.
NOT_ALPHA = NOT_ALNUM.copy()
NOT_ALPHA[ord("0") : ord("9") + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def word_strings(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = NOT_ALNUM) -> tuple[pa.Array, np.ndarray]:
    """The words of a chunk with A-Z lower-cased, and for each text the index of its first word (one more at the end).

    A word is a maximal run of bytes that are no separators; it never crosses the end of a text.
    """
    if not len(data):
        return pa.array([], pa.large_string()), np.zeros(len(offsets), np.int64)
    solid = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    start = np.flatnonzero(first)
    kept = np.concatenate([[0], np.cumsum(solid)])  # bytes of words before each byte
    ends = np.append(kept[start], kept[-1])  # words lie one after the other once the separators are gone
    letters = _LOWER[data[solid]]
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters))
    return words, np.searchsorted(start, offsets)
