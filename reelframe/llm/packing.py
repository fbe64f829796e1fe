"""Packing tokens into fixed windows by minimum bin slack.

Each task tokenises its documents, cuts them into pieces and packs the pieces of a block.  Pieces of a whole window stand
alone.  For the rest, the multiset of remaining lengths is all that the search sees: a bitset (one Python integer) marks
the sums that some sub-multiset reaches, lengths are added by falling size with binary-split counts, and the reachable sum closest to the
capacity is traced back to counts.  A pattern found is used as often as the counts allow.  Nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from reelframe.llm.common import table


def encoder(ranks_file: str, pattern: str, special: dict[str, int]):
    """The byte-level vocabulary as a tiktoken encoding: the ids of the tokenizers file of the same vocabulary at a third of the time."""
    import base64

    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def encode_with(ranks_file: str, pattern: str, tokenizer_file: str) -> Callable[[str], np.ndarray]:
    """Text -> the ids of a plain call of tokenizers on `tokenizer_file` with add_special_tokens=False.

    The file's added tokens are found in a text as tokenizers finds them.  A text on which tiktoken's pattern gives up (about a
    million white-space characters in a row) goes to tokenizers itself.
    """
    import json

    with open(tokenizer_file, encoding="utf-8") as file:
        special = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
    fast, whole = encoder(ranks_file, pattern, special), None

    def encode(text: str) -> np.ndarray:
        nonlocal whole
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            if whole is None:
                from tokenizers import Tokenizer

                whole = Tokenizer.from_file(tokenizer_file)
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The sub-multiset of `counts` (length -> number) whose sum is closest to `capacity` from below.

    Lengths enter by falling size and the search ends as soon as the capacity itself is reached.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, size = min(counts[length], capacity // length), 1
        while left > 0 and not reach >> capacity & 1:
            take = min(size, left)
            steps.append((length, take, reach))
            reach |= (reach << length * take) & mask
            left, size = left - take, size * 2
        if reach >> capacity & 1:
            break
    target, used = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> target & 1:
            used[length] += take
            target -= length * take
    return dict(used)


def plan_windows(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int, int]]:
    """(lengths in a window, slack, how many such windows) until nothing is left; the largest length is always placed (minimum bin slack)."""
    counts = {k: v for k, v in counts.items() if v > 0}
    while counts:
        top = max(counts)
        counts[top] -= 1
        rest = fill({k: v for k, v in counts.items() if v}, capacity - top)
        counts[top] += 1
        used = Counter(rest)
        used[top] += 1
        times = min(counts[k] // v for k, v in used.items())
        for k, v in used.items():
            counts[k] -= v * times
            if not counts[k]:
                del counts[k]
        yield dict(used), capacity - sum(k * v for k, v in used.items()), times


def _powers_of_two(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def pack_lengths(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token of documents of these lengths once.

    Whole windows are cut from the front of each document; what remains is packed by minimum bin slack.  Where a
    window keeps slack, the next smaller remaining piece is cut to fill it; the last, part-filled window of all is cut
    into sequences of powers of two, which need no padding.
    """
    out: list[list[tuple[int, int, int]]] = []
    have: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for doc, n in enumerate(lengths):
        whole = n // capacity
        out.extend([(doc, k * capacity, capacity)] for k in range(whole))
        if n % capacity:
            have[n % capacity].append((doc, whole * capacity))
    short = []
    for used, slack, times in plan_windows({k: len(v) for k, v in have.items()}, capacity):
        for _ in range(times):
            window = [(*have[k].pop(), k) for k, v in used.items() for _ in range(v)]
            (short if slack else out).append(window)
    tail = [p for window in short for p in window]
    pending: list[tuple[int, int, int]] = []
    room = capacity
    for doc, start, n in tail:
        while n >= room:
            out.append([*pending, (doc, start, room)])
            start, n, pending, room = start + room, n - room, [], capacity
        if n:
            pending.append((doc, start, n))
            room -= n
    for size in _powers_of_two(capacity - room):
        window, left = [], size
        while left:
            doc, start, n = pending.pop(0)
            take = min(n, left)
            window.append((doc, start, take))
            left -= take
            if n > take:
                pending.insert(0, (doc, start + take, n - take))
        out.append(window)
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, *, ranks_file: str | None = None, tokenizer_file: str | None = None, window: int = 2048, end_id: int = 1, block_tokens: int = 4_000_000, include_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if asked for).

    A null text is an empty one and gives its end token alone; repeated rows, and rows without doc_id, are packed each; an empty
    table gives no rows; other columns are ignored, whatever their names.  A text longer than a window is cut into whole windows and a
    rest.  Remaining pieces of equal length are taken in the order of their rows.  Blocks of about `block_tokens` (or one longer
    text) bound a task's memory; sequence ids are unique over tasks and blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = encode_with(ranks_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tokenizer_file or public_tokenizers.path("byte_bpe_50k.json"))
        task, sequence = TaskContext.get().partitionId(), 0

        def flush(names: list, ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            pieces = []
            for pack_of in pack_lengths([len(x) for x in ids], window):
                offset = 0
                for doc, start, n in pack_of:
                    piece = ids[doc][start : start + n]
                    for k, v in zip(rows, (names[doc], start, n, zlib.crc32(piece.tobytes()), len(ids[doc]), task << 36 | sequence, offset), strict=True):
                        rows[k].append(v)
                    if include_ids:
                        pieces.append(piece.astype(np.int32))
                    offset += n
                sequence += 1
            columns = [pa.array(v, pa.int64()) for v in rows.values()]
            if include_ids:
                columns.append(pa.array(pieces, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [*rows, *["ids"] * include_ids])

        names, ids, total = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                names += part.column(0).to_pylist()
                ids += [np.append(x, np.uint32(end_id)).astype("<u4") for x in (encode(t or "") for t in part.column(1).to_pylist())]
                total += sum(map(len, ids[-part.num_rows :]))
                if total >= block_tokens:
                    yield from flush(names, ids)
                    names, ids, total = [], [], 0
        if names:
            yield from flush(names, ids)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + ", ids array<int>" * include_ids)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
