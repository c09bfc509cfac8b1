"""Packing documents into token windows by non-negative least squares.

Each task packs blocks of its documents on its own. A document's ids (byte-level
BPE, then id 0) give whole windows of ``WINDOW`` ids and one remainder. For the
remainders of a block the shallow combinations of two or three lengths that fill
a window exactly are enumerated; how often each is used is the non-negative
least-squares fit of their lengths to the block's histogram. The rounded counts
are laid out, and what they leave over is packed greedily, cutting the next
remainder where a window has room left. The last window of a block is laid out
as sequences whose lengths are powers of two, which need no padding, so nothing
is padded at all.

No shuffle takes place and a block is at most ``BLOCK_IDS`` ids and one document,
whatever the input's size or skew. ``sequence_id`` holds the number of the task
in its upper bits. Null texts are empty and have the one id 0; null ids,
repeated rows and extra columns make no difference. An empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import text_or_empty

WINDOW = 1024
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"   # the same vocabulary
LONG = 1000            # characters of a word, or of blanks beyond one a word, that go to the tokenizer
BLOCK_IDS = 1 << 21
SWEEPS = 25            # of the least-squares solver
TRIPLES = 4            # combinations of three enumerated for each largest length

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    Two libraries hold the vocabulary, one of them as ranks, and give the same ids for every
    character of Unicode (tests compare them). The faster one takes a text, unless it has very long
    words or blanks, which that one is slow on; such a text goes to the tokenizer.
    """

    def __init__(self, path: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.by_rank = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={}).encode_to_numpy

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: str) -> bytes:
        sizes = list(map(len, text.split()))
        if max(sizes, default=0) > LONG or len(text) - sum(sizes) - len(sizes) > LONG:
            return self.encode(text)
        return self.by_rank(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=1)
def shared_ids(name: str = VOCABULARY) -> Ids:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers as files
    return Ids(files.path(name), files.path(RANKS), files.PATTERN)


def combinations(histogram: np.ndarray) -> list[tuple[int, ...]]:
    """Two or three lengths that are there and fill a window exactly, longest first."""
    there = np.flatnonzero(histogram)
    has = histogram > 0
    out = []
    for a in there[::-1].tolist():
        rest = WINDOW - a
        if rest <= a and has[rest] and (rest < a or histogram[a] > 1):
            out.append((a, rest))
        middle = there[(there < rest) & (there <= a) & (2 * there >= rest)]
        n = 0
        for b in middle[::-1].tolist():
            c = rest - b
            if c > 0 and has[c]:
                out.append((a, b, c))
                n += 1
                if n == TRIPLES:
                    break
    return out


def repeat_counts(histogram: np.ndarray, columns: list[tuple[int, ...]]) -> np.ndarray:
    """Non-negative least squares by cyclic coordinate descent: minimise |histogram - A x|, x >= 0.

    A column of A counts the lengths of one combination.
    """
    left = histogram.astype(float).tolist()
    x = [0.0] * len(columns)
    squares = []
    for c in columns:
        squares.append(float(sum(c.count(v) * c.count(v) for v in set(c))))
    for _ in range(SWEEPS):
        moved = 0.0
        for j, c in enumerate(columns):
            step = sum(left[v] for v in c) / squares[j]
            new = x[j] + step
            if new < 0.0:
                new = 0.0
            d = new - x[j]
            if d:
                x[j] = new
                for v in c:
                    left[v] -= d
                moved += abs(d)
        if moved < 0.5:
            break
    return np.array(x)


def windows(lengths: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Sequences of (remainder's index, from, length) for the given remainders (1 to WINDOW - 1 each)."""
    by_length: list[list[int]] = [[] for _ in range(WINDOW)]
    for i in reversed(range(len(lengths))):
        by_length[lengths[i]].append(i)
    histogram = np.array([len(b) for b in by_length])
    out = []
    columns = combinations(histogram)
    counts = repeat_counts(histogram, columns)
    for j in np.argsort(-counts, kind="stable").tolist():
        c = columns[j]
        for _ in range(int(counts[j] + 0.5)):
            if any(len(by_length[v]) < c.count(v) for v in c):
                break
            out.append([(by_length[v].pop(), 0, v) for v in c])
    # greedy: the longest that fits, else cut the longest that is left
    free = [v for v in range(WINDOW) if by_length[v]]
    open_window: list[tuple[int, int, int]] = []
    room = WINDOW
    cut: tuple[int, int, int] | None = None
    while free or cut:
        if cut:
            i, at, n = cut
            cut = None
        else:
            k = bisect_right(free, room) - 1
            k = len(free) - 1 if k < 0 else k
            v = free[k]
            i, at, n = by_length[v].pop(), 0, v
            if not by_length[v]:
                free.pop(k)
        take = min(n, room)
        open_window.append((i, at, take))
        room -= take
        if take < n:
            cut = (i, at + take, n - take)
        if not room:
            out.append(open_window)
            open_window, room = [], WINDOW
    # the last one: sequences of a power of two each
    queue = open_window[::-1]
    total = sum(p[2] for p in queue)
    for bit in range(WINDOW.bit_length() - 2, -1, -1):
        if total >> bit & 1:
            need, seq = 1 << bit, []
            while need:
                i, at, n = queue.pop()
                take = min(n, need)
                seq.append((i, at, take))
                need -= take
                if take < n:
                    queue.append((i, at + take, n - take))
            out.append(seq)
    return out


def block(doc_ids: list[int | None], ids: list[bytes], first_sequence: int) -> tuple[dict[str, list], int]:
    """Pieces of a block of documents, and how many sequences they make."""
    cols: dict[str, list] = {k.split()[0]: [] for k in SCHEMA.split(", ")}
    add = [cols[k].append for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    sequence = first_sequence
    views = [memoryview(b) for b in ids]
    sizes = [len(b) // 4 for b in ids]

    def put(k: int, start: int, length: int, offset: int) -> None:
        crc = zlib.crc32(views[k][4 * start:4 * (start + length)])
        for f, v in zip(add, (doc_ids[k], start, length, crc, sizes[k], sequence, offset)):
            f(v)

    rest = []
    for k, n in enumerate(sizes):
        whole = n - n % WINDOW
        for start in range(0, whole, WINDOW):
            put(k, start, WINDOW, 0)
            sequence += 1
        if whole < n:
            rest.append((k, whole))
    lengths = np.array([sizes[k] - at for k, at in rest], dtype=np.int64)
    for seq in windows(lengths):
        offset = 0
        for i, at, n in seq:
            k, begin = rest[i]
            put(k, begin + at, n, offset)
            offset += n
        sequence += 1
    return cols, sequence - first_sequence


def pack(docs: DataFrame) -> DataFrame:
    """One row per piece, see SCHEMA."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequence = shared_ids().of, TaskContext.get().partitionId() << 40
        held, ids, n = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, ids, n, sequence
            cols, made = block(held, ids, sequence)
            sequence += made
            held, ids, n = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols.values()], names=list(cols))

        for batch in batches:
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for doc_id, text in zip(names, texts):
                held.append(doc_id)
                ids.append(encode(text.as_py()) + b"\0\0\0\0")
                n += len(ids[-1]) // 4
                if n >= BLOCK_IDS:
                    yield flush()
        if held:
            yield flush()

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
            .mapInArrow(run, SCHEMA))
