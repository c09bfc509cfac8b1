"""Removal of repeated substrings by a distributed difference-cover suffix sort.

Texts are UTF-8 bytes. Every byte that lies in a string of ``LENGTH`` bytes which
also starts earlier (smaller ``doc_id``; in the same document, further left) is
removed; strings never cross documents and are judged on the input.

A suffix sort of all bytes would move each byte several times, though most
strings occur once. So suffixes are dealt out by content and only those that can
be equal are sorted together:

1. Documents are written once as packs of about ``PACK_BYTES`` (``PACK_DOCS`` documents at most), the unit of all
   later steps.
2. Each window (string of ``LENGTH`` bytes) is assigned to an anchor, the
   ``GRAM``-byte piece in it with the smallest hash. Equal windows have equal
   anchors in the same place, so an anchor that occurs once rules out its windows.
   Anchors are counted by hash range, once per pack.
3. Neighbouring windows of one anchor form a segment. Segments of anchors that
   occur again go, each distinct one once per pack with its first place, to the
   task of the anchor's hash range.
4. There equal segments become one. An anchor with several distinct segments has
   their text sorted by the difference-cover method: name the sampled triples
   (places 1 and 2 modulo 3) by sorting them, recurse on the names until they
   differ or reach ``LENGTH`` bytes, merge the remaining suffixes, and compare
   the prefixes of neighbours in the order. Equal windows are adjacent; the one
   with the earliest place is kept.
5. The verdicts go back to the packs, which find their segments again and cut.

An anchor whose segments, distinct ones once per pack, may have more than ``RANGE_BYTES``
bytes, or which more than ``HOT_PACKS`` packs hold, is dealt out by the
content of its single windows, so no task gets all its segments; the text that this adds
gets ranges of its own.

Null texts count as empty. A null ``doc_id`` comes before all others; rows that
share an id come in the order of the packs. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import stored, text_or_empty

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM + 1       # pieces in a window
PACK_BYTES = 4 << 20
PACK_DOCS = 1 << 18
RANGE_BYTES = 3 << 20           # text for which one range of anchor hashes is made
COUNTED_RANGES = 16             # of these whose anchors are counted together, so a pack sends fewer, larger rows
HOT_PACKS = 50_000
CHUNK = 1 << 19                 # windows whose anchors are found at a time
_POSITION = np.uint64((1 << 20) - 1)
_TABLE = np.random.default_rng(1001).integers(0, 1 << 64, 256, dtype=np.uint64)
_ODD = np.random.default_rng(1002).integers(0, 1 << 64, 8, dtype=np.uint64) | np.uint64(1)


# ---- difference-cover suffix sort of one array -------------------------------------------------------------------

def _names(*columns: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Ranks from 1 of rows of small non-negative numbers (equal rows share one), how many there are, and the rows in order."""
    key = columns[0]
    for c in columns[1:]:
        top = int(c.max(initial=0)) + 1
        if int(key.max(initial=0)) >= (1 << 62) // top:
            key = _names(key)[0]
        key = key * top + c
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), np.int64)
    new[1:] = key[1:] != key[:-1]
    ranks = np.cumsum(new)
    names = np.empty(len(key), np.int64)
    names[order] = ranks
    return names, int(ranks[-1]) if len(ranks) else 0, order


def suffix_order(text: np.ndarray, length: int, reach: int = 1) -> np.ndarray:
    """Suffix array of ``text`` (positive numbers), exact up to ``length`` bytes; a number stands for ``reach`` bytes."""
    n = len(text)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.concatenate([text, np.zeros(3, np.int64)])
    first = np.arange(1, n + (n % 3 == 1), 3)   # the end counts as a sample if it keeps the two classes apart
    second = np.arange(2, n, 3)
    sample = np.concatenate([first, second])
    names, distinct, order = _names(t[sample], t[sample + 1], t[np.minimum(sample + 2, n + 2)])
    if distinct < len(sample) and 3 * reach < length:
        order = suffix_order(names, length, 3 * reach)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    if distinct < len(sample) and 3 * reach >= length:
        rank[sample] = names                     # equal up to the length: equal ranks
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    rest = np.arange(0, n, 3)
    top = n + 4
    rest = rest[np.argsort(t[rest] * top + rank[rest + 1])]
    # merge: how many sampled suffixes of either kind come before each remaining one, by what decides between the two
    one, two = (sorted_sample[sorted_sample % 3 == k] for k in (1, 2))
    low = np.searchsorted(t[one] * top + rank[one + 1], t[rest] * top + rank[rest + 1])
    pairs = _names(np.concatenate([t[rest], t[two]]), np.concatenate([t[rest + 1], t[two + 1]]))[0] * top
    low += np.searchsorted(pairs[len(rest):] + rank[two + 2], pairs[:len(rest)] + rank[rest + 2])
    low = np.maximum.accumulate(low)   # suffixes that are equal up to the length may have met in any order
    out = np.empty(len(rest) + len(sorted_sample), np.int64)
    places = low + np.arange(len(rest))
    taken = np.zeros(len(out), bool)
    taken[places] = True
    out[places] = rest
    out[~taken] = sorted_sample
    return out


def window_classes(segments: list[bytes], windows: list[int]) -> np.ndarray:
    """Class number of every window of the segments, one after the other; equal windows share a number."""
    raw = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments])
    begins = np.cumsum(sizes) - sizes
    counts = np.array(windows)
    total = int(counts.sum())
    nth = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(begins, counts) + nth
    order = suffix_order(raw.astype(np.int64) + 1, LENGTH)
    number = np.full(len(raw), -1, np.int64)
    number[starts] = np.arange(total)
    own = number[order]
    own = own[own >= 0]
    places = starts[own]
    views = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)
    differs = np.ones(len(own), bool)
    for at in range(1, len(own), 1 << 16):   # neighbours in the order
        upto = min(len(own), at + (1 << 16))
        differs[at:upto] = (views[places[at:upto]] != views[places[at - 1:upto - 1]]).any(1)
    out = np.empty(total, np.int64)
    out[own] = np.cumsum(differs)
    return out


# ---- packs and anchors -------------------------------------------------------------------------------------------

def packed(docs: DataFrame) -> DataFrame:
    """pack, size, blob: documents in packs. The pack number is fixed once the table is written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, bytes]] = []
        size = 0
        small = zstandard.ZstdCompressor(level=1)

        def flush() -> pa.RecordBatch:
            nonlocal number, held, size
            one = pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()),
                                              pa.array([h[1] for h in held], pa.large_binary())], names=["doc_id", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, one.schema) as writer:
                writer.write_batch(one)
            out = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64()),
                                              pa.array([small.compress(sink.getvalue().to_pybytes())], pa.binary())],
                                             names=["pack", "size", "blob"])
            number, held, size = number + 1, [], 0
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                held.append((doc_id, text.as_py().encode("utf-8", "replace")))
                size += len(held[-1][1])
                if size >= PACK_BYTES or len(held) >= PACK_DOCS:
                    yield flush()
        if held:
            yield flush()

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
                  .mapInArrow(run, "pack long, size long, blob binary"))


class Pack:
    """The documents of a pack side by side, with the runs of windows that share an anchor."""

    def __init__(self, blob: bytes):
        with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31)) as reader:
            batch = reader.read_next_batch()
        self.ids = batch.column("doc_id").to_pylist()
        self.texts = batch.column("text").to_pylist()
        self.bytes = b"".join(self.texts)
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        self.raw = np.frombuffer(self.bytes, np.uint8)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, number of windows, anchor hash) of every run."""
        n = len(self.raw) - LENGTH + 1
        parts: tuple[list, list, list] = ([], [], [])
        if n > 0:
            edge = np.zeros(len(self.raw) + 1, np.int64)   # windows may not start in the last bytes of a document
            np.add.at(edge, np.maximum(self.begins, self.ends - LENGTH + 1), 1)
            np.add.at(edge, self.ends, -1)
            inside = (np.cumsum(edge)[:n] == 0)
            for at in range(0, n, CHUNK):
                for kept, part in zip(parts, self._runs(at, min(CHUNK, n - at), inside)):
                    kept.append(part)
        return tuple(np.concatenate(p) if p else np.zeros(0, d)  # type: ignore[return-value]
                     for p, d in zip(parts, (np.int64, np.int64, np.uint64)))

    def _runs(self, at: int, n: int, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = _TABLE[self.raw[at:at + n + LENGTH - 1]]
        for k in range(5):                                   # pieces of 2, 4, 8, 16, 32 bytes
            w = 1 << k
            h = h[:-w] * _ODD[k] + h[w:]
            h ^= h >> np.uint64(29)
        h = h * _ODD[5]
        h ^= h >> np.uint64(32)
        best = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= REACH:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        best = np.minimum(best[:n], best[REACH - width:][:n]) & _POSITION
        valid = inside[at:at + n]
        new = np.ones(n, bool)
        new[1:] = (best[1:] != best[:-1]) | ~valid[:-1]
        starts = np.flatnonzero(new & valid)
        stops = np.flatnonzero(np.append((new | ~valid)[1:], True) & valid) + 1
        return starts + at, stops - starts, h[best[starts].astype(np.int64)]

    def distinct_segments(self, starts: np.ndarray, counts: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """How many different segments each of the ``n`` owners has, by hash."""
        step = np.cumprod(np.full(len(self.raw) + 1, _ODD[0]))   # modulo 2 ** 64
        upto = np.append(np.uint64(0), np.cumsum(_TABLE[self.raw] * step[:-1]))
        ends = starts + counts + LENGTH - 1
        h = (upto[ends] - upto[starts]) * step[len(self.raw) - starts] + counts.astype(np.uint64)   # as if all began in one place
        order = np.lexsort((h, owner))
        new = np.append(True, (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1]))[:len(h)]
        return np.bincount(owner[order][new], minlength=n)

    def places(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document number and place in it."""
        doc = np.searchsorted(self.ends, starts, side="right")
        return doc, starts - self.begins[doc]


def ranges_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Range numbers of anchor hashes; scrambled first, as the smallest hash of a window is a small number."""
    hashes = hashes * _ODD[6]
    hashes = (hashes ^ (hashes >> np.uint64(32))) * _ODD[7]
    return ((hashes >> np.uint64(33)) * np.uint64(n) >> np.uint64(31)).astype(np.int64)


class Segments:
    """Distinct segments of a pack's repeated anchors, in a fixed order by range, and where each occurs."""

    def __init__(self, pack: Pack, repeated: np.ndarray, hot: np.ndarray, n_ranges: int):
        starts, counts, hashes = pack.runs()
        again = np.isin(hashes, repeated)
        starts, counts, hashes = starts[again], counts[again], hashes[again]
        single = np.isin(hashes, hot)
        if single.any():   # a hot anchor's windows one by one, dealt by their content
            each = np.repeat(np.arange(len(starts)), np.where(single, counts, 1))
            nth = np.arange(len(each)) - np.repeat(np.cumsum(np.where(single, counts, 1)) - np.where(single, counts, 1),
                                                   np.where(single, counts, 1))
            cut = single[each]
            starts = starts[each] + np.where(cut, nth, 0)
            counts, hashes = np.where(cut, 1, counts[each]), hashes[each].copy()
            hashes[cut] = [int.from_bytes(hashlib.blake2b(pack.bytes[s:s + LENGTH], digest_size=8).digest(), "little")
                           for s in starts[cut].tolist()]
        self.starts, self.counts = starts, counts
        doc, place = pack.places(starts)
        low = -(1 << 63)
        ids = np.array([low if i is None else i for i in pack.ids] or [0], np.int64)
        self.ids, self.rows, self.place = ids[doc], doc, place
        seen: dict[bytes, int] = {}
        self.which = np.empty(len(starts), np.int64)
        texts: list[bytes] = []
        first: list[int] = []
        key = list(zip(self.ids.tolist(), self.rows.tolist(), place.tolist()))
        data = pack.bytes
        for i, (s, c) in enumerate(zip(starts.tolist(), counts.tolist())):
            text = data[s:s + c + LENGTH - 1]
            k = seen.setdefault(text, len(texts))
            if k == len(texts):
                texts.append(text)
                first.append(i)
            elif key[i] < key[first[k]]:
                first[k] = i
            self.which[i] = k
        self.texts, self.first = texts, np.array(first, np.int64)
        self.hashes = hashes[self.first] if len(first) else np.zeros(0, np.uint64)
        self.windows = counts[self.first] if len(first) else np.zeros(0, np.int64)
        self.range = ranges_of(self.hashes, n_ranges)
        self.order = np.argsort(self.range, kind="stable")   # range by range, each in order of appearance


def by_range(ranges: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Slices of a sorted array of range numbers; an array that isn't sorted is an error."""
    if (ranges[1:] < ranges[:-1]).any():
        raise ValueError("range numbers have to be sorted")
    values, begins = np.unique(ranges, return_index=True)
    for v, b, e in zip(values.tolist(), begins.tolist(), [*begins.tolist()[1:], len(ranges)]):
        yield v, slice(b, e)


# ---- the three exchanges -----------------------------------------------------------------------------------------

def anchors(packs: DataFrame, n_ranges: int) -> DataFrame:
    """range, pack, hashes (sorted, distinct), twice (1 where the pack itself repeats it), segments (how many
    different ones, of those that it repeats)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column("pack").to_pylist(), batch.column("blob")):
                pack = Pack(blob.as_py())
                starts, windows, each = pack.runs()
                hashes, owner, counts = np.unique(each, return_inverse=True, return_counts=True)
                many = counts[owner] > 1
                segments = pack.distinct_segments(starts[many], windows[many], owner[many], len(hashes)).astype(np.int32)
                ranges = ranges_of(hashes, n_ranges)
                order = np.argsort(ranges, kind="stable")
                ranges, hashes, counts, segments = ranges[order], hashes[order], counts[order], segments[order]
                rows = [(r, number, hashes[s].tobytes(), (counts[s] > 1).astype(np.uint8).tobytes(), segments[s][counts[s] > 1].tobytes())
                        for r, s in by_range(ranges)]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    schema = pa.schema([("range", pa.int64()), ("pack", pa.int64()), ("hashes", pa.binary()), ("twice", pa.binary()),
                        ("segments", pa.binary())])
    return packs.mapInArrow(run, "range long, pack long, hashes binary, twice binary, segments binary")


def repeated_anchors(part: pa.Table, hot_packs: int, range_bytes: int) -> pa.Table:
    """pack, repeated, hot, more of one range: which of each pack's anchors occur again, which are hot, and the bytes
    that the single windows of these may have."""
    blobs = [np.frombuffer(b, np.uint64) for b in part.column("hashes").to_pylist()]
    twice = [np.frombuffer(b, np.uint8) > 0 for b in part.column("twice").to_pylist()]
    every, count = np.unique(np.concatenate(blobs), return_counts=True)
    again = count > 1
    at = [np.searchsorted(every, b) for b in blobs]
    segments = count.copy()
    for i, t, n in zip(at, twice, part.column("segments").to_pylist()):
        again[i[t]] = True
        segments[i[t]] += np.frombuffer(n, np.int32) - 1
    hot = again & ((count > hot_packs) | (segments * (REACH + LENGTH - 1) > range_bytes))
    more = [0] * len(blobs)
    more[0] = int(segments[hot].sum()) * REACH * LENGTH
    return pa.table({"pack": part.column("pack"),
                     "repeated": pa.array([b[again[i]].tobytes() for b, i in zip(blobs, at)], pa.binary()),
                     "hot": pa.array([b[hot[i]].tobytes() for b, i in zip(blobs, at)], pa.binary()),
                     "more": pa.array(more, pa.int64())})


def _joined(blobs: list[bytes] | None, kind) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(blobs or []), kind))


def segments_of(row: dict, n_ranges: int) -> tuple[Pack, Segments]:
    pack = Pack(row["blob"])
    return pack, Segments(pack, _joined(row["repeated"], np.uint64), _joined(row["hot"], np.uint64), n_ranges)


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):   # one row's blobs at a time
        yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def sent_segments(known: DataFrame, n_ranges: int) -> DataFrame:
    """range, pack and the range's segments of the pack: texts, sizes, windows, hashes, first places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for row in rows_of(batch):
                _, s = segments_of(row, n_ranges)
                out = []
                for r, part in by_range(s.range[s.order]):
                    k = s.order[part]
                    f = s.first[k]
                    numbers = np.stack([np.array([len(s.texts[i]) for i in k.tolist()]), s.windows[k], s.hashes[k].view(np.int64),
                                        s.ids[f], s.rows[f], s.place[f]]).astype(np.int64)
                    out.append({"range": r, "pack": row["pack"], "numbers": small.compress(numbers.tobytes()),
                                "texts": small.compress(b"".join(s.texts[i] for i in k.tolist()))})
                yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("range", pa.int64()), ("pack", pa.int64()), ("numbers", pa.binary()), ("texts", pa.binary())])
    return known.mapInArrow(run, "range long, pack long, numbers binary, texts binary")


def verdicts(part: pa.Table) -> pa.Table:
    """pack, range, kept: for each sent segment's windows 1 where its first place is the earliest of all equal windows."""
    big = zstandard.ZstdDecompressor()
    numbers, texts = [], []
    for n, t in zip(part.column("numbers"), part.column("texts")):
        numbers.append(np.frombuffer(big.decompress(n.as_py()), np.int64).reshape(6, -1))
        whole, at = big.decompress(t.as_py(), max_output_size=1 << 31) if len(t.as_py()) else b"", 0
        for size in numbers[-1][0].tolist():
            texts.append(whole[at:at + size])
            at += size
    size, windows, hashes, ids, rows, place = np.concatenate(numbers, axis=1)
    pack = np.repeat(part.column("pack").to_numpy(), [n.shape[1] for n in numbers])   # rows are numbers within a pack
    # equal segments: one, with the earliest place
    unique: dict[bytes, int] = {}
    which = np.array([unique.setdefault(t, len(unique)) for t in texts], np.int64)
    by_place = np.lexsort((place, rows, pack, ids, which))
    lead = by_place[np.append(True, which[by_place][1:] != which[by_place][:-1])]   # by number of the unique segment
    first_here = np.zeros(len(texts), bool)
    first_here[lead] = True
    # anchors with several distinct segments
    anchor = hashes[lead]
    _, inverse, count = np.unique(anchor, return_inverse=True, return_counts=True)
    sort_these = np.flatnonzero(count[inverse] > 1)
    n_windows = windows[lead]
    offsets = np.cumsum(n_windows) - n_windows
    keeps = np.ones(int(n_windows.sum()), np.uint8)
    if len(sort_these):
        names = list(unique)
        classes = window_classes([names[i] for i in sort_these.tolist()], n_windows[sort_these].tolist())
        of = np.repeat(sort_these, n_windows[sort_these])
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n_windows[sort_these]) - n_windows[sort_these], n_windows[sort_these])
        owner = lead[of]
        order = np.lexsort((place[owner] + nth, rows[owner], pack[owner], ids[owner], classes))
        earliest = np.append(True, classes[order][1:] != classes[order][:-1])
        keeps[(offsets[of] + nth)[order[~earliest]]] = 0
    packs, kept, at = part.column("pack").to_pylist(), [], 0
    for n in numbers:
        out = [keeps[offsets[u]:offsets[u] + n_windows[u]] if f else np.zeros(n_windows[u], np.uint8)
               for u, f in zip(which[at:at + n.shape[1]].tolist(), first_here[at:at + n.shape[1]].tolist())]
        kept.append(np.packbits(np.concatenate(out)).tobytes())
        at += n.shape[1]
    return pa.table({"pack": pa.array(packs, pa.int64()), "range": part.column("range"), "kept": pa.array(kept, pa.binary())})


def removal(pack: Pack, s: Segments, kept: dict[int, bytes]) -> np.ndarray:
    """True for each byte of the pack that goes."""
    starts_of = np.zeros(len(s.texts) + 1, np.int64)
    flags = np.zeros(int(s.windows.sum()), np.uint8)
    starts_of[1:] = np.cumsum(s.windows)
    for r, part in by_range(s.range[s.order]):
        k = s.order[part]
        bits = np.unpackbits(np.frombuffer(kept[r], np.uint8), count=int(s.windows[k].sum()))
        to = np.repeat(starts_of[k] - (np.cumsum(s.windows[k]) - s.windows[k]), s.windows[k]) + np.arange(len(bits))
        flags[to] = bits
    is_first = np.zeros(len(s.starts), bool)
    is_first[s.first] = True
    each = np.repeat(np.arange(len(s.starts)), s.counts)
    nth = np.arange(len(each)) - np.repeat(np.cumsum(s.counts) - s.counts, s.counts)
    stays = is_first[each] & (flags[starts_of[s.which[each]] + nth] > 0)
    gone = (s.starts[each] + nth)[~stays]
    cover = np.zeros(len(pack.raw) + 1, np.int32)
    np.add.at(cover, gone, 1)
    np.add.at(cover, gone + LENGTH, -1)
    return np.cumsum(cover[:-1]) > 0


def cut_rows(judged: DataFrame, n_ranges: int) -> DataFrame:
    """doc_id, text (remaining bytes), n_bytes, n_removed, n_spans of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                pack, s = segments_of(row, n_ranges)
                gone = removal(pack, s, {v["range"]: v["kept"] for v in row["verdicts"] or []})
                texts, removed, spans = [], [], []
                for b, e, text in zip(pack.begins.tolist(), pack.ends.tolist(), pack.texts):
                    g = gone[b:e]
                    n = int(np.count_nonzero(g))
                    removed.append(n)
                    spans.append(int(np.count_nonzero(g[1:] & ~g[:-1])) + int(g[0]) if n else 0)
                    texts.append(pack.raw[b:e][~g].tobytes() if n else text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pack.ids, pa.int64()), pa.array(texts, pa.binary()), pa.array(pack.sizes), pa.array(removed, pa.int64()),
                     pa.array(spans, pa.int64())], names=["doc_id", "text", "n_bytes", "n_removed", "n_spans"])

    return judged.mapInArrow(run, "doc_id long, text binary, n_bytes long, n_removed long, n_spans long")


def dealt(packs: DataFrame, hot_packs: int = HOT_PACKS) -> tuple[DataFrame, int]:
    """pack, blob, repeated, hot; and how many ranges their segments are dealt out to."""
    total = packs.agg(F.sum("size")).first()[0] or 0
    n_ranges, range_bytes = max(1, -(-total // RANGE_BYTES)), RANGE_BYTES
    again = stored(anchors(packs, -(-n_ranges // COUNTED_RANGES)).groupBy("range")
                   .applyInArrow(lambda t: repeated_anchors(t, hot_packs, range_bytes), "pack long, repeated binary, hot binary, more long")
                   .groupBy("pack").agg(F.collect_list("repeated").alias("repeated"), F.collect_list("hot").alias("hot"),
                                        F.sum("more").alias("more")))
    more = again.agg(F.sum("more")).first()[0] or 0
    return packs.select("pack", "blob").join(again.drop("more"), "pack", "left"), n_ranges + -(-more // range_bytes)


def cut_packs(packs: DataFrame, hot_packs: int = HOT_PACKS) -> DataFrame:
    # known is used twice in one plan, with one exchange of the packs
    known, n_ranges = dealt(packs, hot_packs)
    judged = (sent_segments(known, n_ranges).groupBy("range")
              .applyInArrow(verdicts, "pack long, range long, kept binary")
              .groupBy("pack").agg(F.collect_list(F.struct("range", "kept")).alias("verdicts")))
    return cut_rows(known.join(judged, "pack", "left"), n_ranges)


def cut_repeats(docs: DataFrame, hot_packs: int = HOT_PACKS) -> DataFrame:
    """One row per document: doc_id, text (bytes that remain), n_bytes, n_removed, n_spans."""
    return cut_packs(packed(docs), hot_packs)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return cut_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))
