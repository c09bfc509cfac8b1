"""SimHash near duplicates by covering locality-sensitive hashing.

A text's features are its shingles of three words (A-Z in lower case, joined by a
blank), repeats included; a text of fewer words is one shingle. Bit ``i`` of the
fingerprint is set if it is set in more than half of the shingles' XXH64 hashes
(seed 42). Fingerprints that differ in at most ``RADIUS`` bits are linked, and a
component is named by its smallest ``doc_id``.

Bit ``i`` gets a nonzero vector ``m(i)`` of ``RADIUS + 1`` bits. Each of the 15 nonzero
vectors ``v`` of that length gives a table, whose mask keeps the bits with an odd
inner product of ``m(i)`` and ``v``. Three bits have vectors that span at most
three dimensions of four, so some ``v`` is orthogonal to all of them: whatever the
(up to three) bits in which two fingerprints differ, one table masks them all out and
the two fall into one bucket. No pair is lost by chance.

1. Documents with equal fingerprints are one class.
2. Every class goes into one bucket a table (34 bits of the fingerprint on average). A bucket
   of two is its least and greatest member, which the count already gives.
3. A larger bucket of at most ``BUCKET`` members is searched in one task, which
   returns links that join its members, fewer than there are members.
4. A bucket with more members is dealt out again by the same masks over the bits
   that its table left free (about 30, then 14, then 6), so after three levels it
   holds fewer than ``BUCKET`` different fingerprints, however many rows there are. Nothing is cut off.
5. Components over the links; every document gets that of its fingerprint, and a
   fingerprint that very many documents share is joined without an exchange.

A text without words (or null) has fingerprint zero, linked like any other. Rows with a null ``doc_id``
take no part in links (component null). Rows that share an id are one document: it is
linked with whatever one of its texts is linked with. A long text is read in slices.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import joined_on_hot, map_arrow, stored, text_or_empty
from tally.llm.components import components

WORDS, SEED, BITS, RADIUS = 3, 42, 64, 3
BUCKET = 4096           # members that one task searches at once
SLICE = 1 << 20         # bytes of a text whose words are held at once
LEVELS = 3
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


# ---- fingerprints ------------------------------------------------------------------------------------------------

def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists, one for each slice; slices end at blanks."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            blank = _BLANK.search(text, end)
            end = blank.start() if blank else len(text)
        yield text[at:end].lower().split()  # bytes: A-Z only, and exactly the six blanks
        at = end


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    import xxhash
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    ones, total = np.zeros(BITS, np.int64), 0
    held: list[bytes] = []

    def add(shingles: Iterator[bytes]) -> None:
        nonlocal ones, total
        hashes = np.fromiter(map(digest, shingles), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(hashes)

    for words in words_of(text):
        held += words
        if len(held) >= WORDS:
            add(map(b" ".join, zip(*(held[k:] for k in range(WORDS)))))
            held = held[1 - WORDS:]
    if held and not total:
        add(iter([b" ".join(held)]))
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed number) of every row."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        found = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    return map_arrow(rows, one, "doc_id long, fp long")


# ---- covering masks ----------------------------------------------------------------------------------------------

def covering_masks(bits: int, radius: int = RADIUS) -> list[int]:
    """Masks over the given bits (a number), such that for any ``radius`` of these some mask holds none of them."""
    places = [i for i in range(BITS) if bits >> i & 1]
    vectors = (1 << radius + 1) - 1
    odd = lambda x: x.bit_count() & 1
    return [sum(1 << p for k, p in enumerate(places) if odd((1 + k % vectors) & v)) for v in range(1, vectors + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tables(level: int) -> list[tuple[int, int, int]]:
    """(number, number of the table it refines, mask) of each table of a level; a mask holds those that it refines."""
    whole = (1 << BITS) - 1
    if level == 0:
        return [(k + 1, 0, m) for k, m in enumerate(covering_masks(whole))]
    return [(up * 16 + k + 1, up, mask | m) for up, _, mask in tables(level - 1) for k, m in enumerate(covering_masks(whole & ~mask))]


# ---- links -------------------------------------------------------------------------------------------------------

def joining_links(members: np.ndarray) -> tuple[list[int], list[int]]:
    """Links within the radius that join all members which such links connect, fewer than there are members."""
    left, right = [], []
    rest = np.unique(members)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            u = queue.pop()
            near = np.bitwise_count((rest ^ u).view(np.uint64)) <= RADIUS
            found = rest[near]
            left += [int(u)] * len(found)
            right += found.tolist()
            queue += list(found)
            rest = rest[~near]
    return left, right


def searched(buckets: DataFrame) -> DataFrame:
    """u, v: links inside buckets (``members``: lists of at most ``BUCKET`` fingerprints)."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        u, v = [], []
        for members in batch.column("members"):
            a, b = joining_links(members.values.to_numpy())
            u += a
            v += b
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return map_arrow(buckets.select("members"), one, "u long, v long")


def bucketed(rows: DataFrame, level: int) -> DataFrame:
    """fp, b (table and masked fingerprint): the buckets of fingerprints in the tables of a level that refine table ``up``."""
    masks = rows.sparkSession.createDataFrame([(t, up, signed(m)) for t, up, m in tables(level)], "t int, up int, mask long")
    bucket = F.struct("t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    return rows.join(F.broadcast(masks), "up").select("fp", bucket.alias("b"))   # 15, 225 or 3,375 masks


def near_links(classes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """u, v: links between fingerprints (``fp``, distinct) that differ in at most ``RADIUS`` bits, enough for every component."""
    rows, found = classes.select("fp", F.lit(0).alias("up")), []
    for level in range(LEVELS):
        buckets = bucketed(rows, level)
        met = stored(buckets.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
                     .where("n > 1"))
        found.append(met.where((F.col("n") == 2) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)).select("u", "v"))
        fits = F.lit(level == LEVELS - 1) | (F.col("n") <= bucket)   # buckets of the last level are small by their masks
        small = buckets.join(met.where((F.col("n") > 2) & fits).select("b"), "b")
        found.append(searched(small.groupBy("b").agg(F.collect_list("fp").alias("members"))))
        large = met.where(~fits).select("b", "n")
        if level == LEVELS - 1 or large.isEmpty():
            break
        rows = stored(joined_on_hot(buckets, large, "b", "n").select("fp", F.col("b.t").alias("up")).distinct())
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return stored(links.distinct())


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    rows = stored(fingerprints(docs))
    known = rows.where("doc_id is not null")
    classes = stored(known.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    several = (known.groupBy("doc_id").agg(F.min("fp").alias("u"), F.max("fp").alias("high")).where("u <> high").select("doc_id", "u"))
    own = known.join(several, "doc_id").select("u", F.col("fp").alias("v"))
    label = components(near_links(classes, bucket).union(own), "u", "v").withColumnRenamed("node", "fp")
    labelled = stored(classes.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    names = stored(labelled.groupBy("label").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members")))
    of_class = stored(joined_on_hot(labelled, names, "label", "members").select("fp", "component_id", "n"))
    named = joined_on_hot(known, of_class, "fp", "n").select("doc_id", "fp", "component_id")
    unnamed = rows.where("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id"))
    return named.unionByName(unnamed).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
