"""MinHash near-duplicate removal: fast similarity sketches, banding, exact verification.

A document's set is its distinct shingles of five words (A-Z in lower case),
with fewer words the whole sequence as one; without words it is empty and linked
with nothing. Two documents are linked if 100 * shared >= ``percent`` * united,
and a component keeps its smallest ``doc_id``.

1. Each set gets a fast similarity sketch of ``COORDINATES`` coordinates: in
   round after round every shingle is thrown into a random bin, which keeps the
   smallest value of the first round that reached it; bins still empty after as
   many rounds as there are bins look at every shingle, so none stays empty.
2. Equal sets become one class. ``BANDS`` bands of the sketch put classes into
   buckets (two sets with a similarity of 0.8 share none with a chance under
   1e-7). Buckets with the same members count once.
3. Each member of a bucket is compared with the bucket's smallest member, on the
   full sets of 64-bit shingle hashes.
4. A bucket whose members these links leave in several components is searched
   for links between those components: its members go in blocks to tasks that
   compare sketches and confirm on the full sets (blocks are bounded by members and
   by the bytes of their sets). A task returns links that
   join components, fewer than its members, never all pairs.
5. Components over all links; a set that very many documents share, and a component of very many sets,
   are joined without an exchange.

Rows with a null ``doc_id`` take no part in links (component null, kept), a
document without words is a component of its own (if its id has no other text). Rows
that share an id are one document: it is linked with whatever one of its texts
is linked with. Null texts count as empty. Extra columns are ignored by
``near_duplicates`` and kept by ``drop_duplicates``. Empty tables give empty
results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import joined_on_hot, map_arrow, stored, text_or_empty
from tally.llm.components import components

SHINGLE = 5
COORDINATES, ROWS = 128, 4   # of sketches, and of a band
BLOCK = 400                # members of a bucket that one task compares with as many others
SPREAD = 5                 # standard deviations that a sketch's estimate may lie under the similarity
BLOCK_BYTES = 8 << 20      # of their sets
DIRECT_BYTES = 1 << 16     # members times bytes of their sets, of a bucket that is compared pair by pair
MAX_COORDINATES = 128
_MASK56 = np.uint64((1 << 56) - 1)
_SEEDS = np.random.default_rng(64_128).integers(0, 1 << 64, 2 * MAX_COORDINATES, dtype=np.uint64)
_PLACES = np.random.default_rng(5).integers(0, 1 << 64, SHINGLE, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash
    return mixed(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and exactly the six blanks
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        import xxhash
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = word_hashes(words)
    n = len(words) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total = mixed(total + h[k:k + n] * _PLACES[k])
    return np.unique(total)


def shingles_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The sets of many texts at once: sorted distinct hashes, one text after the other, and how many each has."""
    words: list[bytes] = []
    lengths = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        w = text.encode("utf-8", "replace").lower().split()
        lengths[i] = len(w)
        words += w
    owner = np.repeat(np.arange(len(texts)), lengths)
    values, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= SHINGLE:
        h = word_hashes(words)
        n = len(words) - SHINGLE + 1
        total = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            total = mixed(total + h[k:k + n] * _PLACES[k])
        inside = owner[:n] == owner[SHINGLE - 1:]
        values, of = total[inside], owner[:n][inside]
    short = np.flatnonzero((lengths > 0) & (lengths < SHINGLE))
    if len(short):
        values = np.append(values, np.array([shingles(texts[i])[0] for i in short], np.uint64))
        of = np.append(of, short)
    order = np.lexsort((values, of))
    values, of = values[order], of[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    return values[new], np.bincount(of[new], minlength=len(texts))


def sketches_of(values: np.ndarray, counts: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketches of many sets at once, ``t`` numbers each; two sets agree in one with the
    chance of their similarity. An empty set's numbers are all the largest there is."""
    none = np.iinfo(np.uint64).max
    out = np.full(len(counts) * t, none, np.uint64)
    owner = np.repeat(np.arange(len(counts)), counts)
    v, o = values, owner
    for i in range(t):                                   # every shingle into a random bin
        if not len(v):
            return out.reshape(-1, t)
        x = mixed(v ^ _SEEDS[i])
        place = ((x >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(out, o * t + place, (np.uint64(i) << np.uint64(56)) | (x & _MASK56))
        if i % 2:
            open_sets = (out.reshape(-1, t) == none).any(1)
            stay = open_sets[o]
            v, o = v[stay], o[stay]
    for b in range(t):                                   # every shingle into the bins still empty
        stay = (out.reshape(-1, t)[:, b] == none)[o]
        x = mixed(v[stay] ^ _SEEDS[t + b])
        np.minimum.at(out, o[stay] * t + b, (np.uint64(t + b) << np.uint64(56)) | (x & _MASK56))
    return out.reshape(-1, t)


def sketch(items: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    return sketches_of(items, np.array([len(items)]), t)[0]


def band_keys(sketches: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(sets, bands): one number for each ``rows`` coordinates."""
    parts = sketches.reshape(len(sketches), -1, rows)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2])
    for k in range(rows):
        key = mixed(key * _PLACES[k] + parts[:, :, k])
    return key.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The exact test on two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    shared = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def set_key(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def digests(values: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """``set_key`` of sets that lie one after the other."""
    data, at, out = memoryview(values.tobytes()), 0, []
    for n in counts.tolist():
        out.append(hashlib.blake2b(data[at:at + 8 * n], digest_size=16).digest())
        at += 8 * n
    return out


def list_array(rows: np.ndarray, wanted: np.ndarray) -> pa.Array:
    """An array<long> column of the rows of a matrix; empty where not wanted."""
    ends = np.append(0, np.cumsum(np.where(wanted, rows.shape[1], 0))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows[wanted].ravel()))


TEXTS = 256   # texts whose sets are made at a time


def set_columns(texts: list[str], t: int, used: int, rows: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """n, set_key, bands of the texts' sets."""
    sizes, keys, bands = [], [], []
    for at in range(0, len(texts), TEXTS):
        values, counts = shingles_of(texts[at:at + TEXTS])
        sizes.append(counts)
        keys += digests(values, counts)
        bands.append(band_keys(sketches_of(values, counts, t)[:, :used], rows))
    n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    matrix = np.concatenate(bands) if bands else np.zeros((0, used // rows), np.int64)
    return pa.array(n, pa.int64()), pa.array(keys, pa.binary()), list_array(matrix, n > 0)


def sketched_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), set_key (digest of the set), bands."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = set_columns(batch.column("text").to_pylist(), COORDINATES, COORDINATES, ROWS)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n", "set_key", "bands"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), one,
                     "doc_id long, n long, set_key binary, bands array<long>")


def set_table(docs: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_key, items (the sorted set as bytes) of the wanted keys, each from the document with the smallest id."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, items = [], []
        for key, text in zip(batch.column("set_key").to_pylist(), batch.column("text").to_pylist()):
            s = shingles(text)
            if set_key(s) == key:  # not another text under the same id
                keys.append(key)
                items.append(s.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(items, pa.binary())], names=["set_key", "items"])

    first = rows.groupBy("set_key").agg(F.min("doc_id").alias("doc_id")).join(wanted, "set_key")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_arrow(texts.join(first, "doc_id").select("set_key", "text"), one, "set_key binary, items binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v: set keys) that are linked."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = zip(batch.column("left"), batch.column("right"))      # the sets are read where they lie
        ok = pa.array([linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                       for x, y in pairs], pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column("u").filter(ok), batch.column("v").filter(ok)], names=["u", "v"])

    left = sets.select(F.col("set_key").alias("u"), F.col("items").alias("left"))
    right = sets.select(F.col("set_key").alias("v"), F.col("items").alias("right"))
    return map_arrow(pairs.join(left, "u").join(right, "v").select("u", "v", "left", "right"), one, "u binary, v binary")


def block_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links that join different labels among the members of one pair of blocks."""
    rows = rows.drop_duplicates("set_key").reset_index(drop=True)
    items = [np.frombuffer(x, np.uint64) for x in rows["items"]]
    counts = np.array([len(x) for x in items], np.int64)
    sketches = sketches_of(np.concatenate(items) if items else np.zeros(0, np.uint64), counts)
    share = percent / 100
    least = COORDINATES * share - SPREAD * np.sqrt(COORDINATES * share * (1 - share))
    names = {v: k for k, v in enumerate(dict.fromkeys(rows["label"]))}
    label = rows["label"].map(names).to_numpy()
    side = rows["side"].to_numpy()
    sizes = counts
    found = []
    for i in range(len(items)):
        other = np.flatnonzero((label != label[i]) & (side != side[i]) if side.any() else (label != label[i]))
        other = other[other > i]
        if not len(other):
            continue
        fits = np.minimum(sizes[other], sizes[i]) * 100 >= percent * np.maximum(sizes[other], sizes[i])
        other = other[fits]
        alike = (sketches[other] == sketches[i]).sum(1)
        for j in other[np.argsort(-alike, kind="stable")][:int((alike >= least).sum())]:
            if label[i] != label[j] and linked(items[i], items[j], percent):
                found.append((rows["set_key"][i], rows["set_key"][j]))
                label[label == label[j]] = label[i]
    return pd.DataFrame(found, columns=["u", "v"], dtype=object)


def bucket_members(rows: DataFrame) -> DataFrame:
    """band, members, hub, set_key: the buckets that hold several sets, those with the same members once."""
    classes = rows.groupBy("set_key").agg(F.any_value("bands").alias("bands"))
    buckets = classes.select("set_key", F.explode("bands").alias("band"))
    # most bands hold one set: count them by their number alone, then look at the sets of the others
    met = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    crowded = stored(buckets.join(met, "band"))
    mark = F.xxhash64("set_key")
    groups = (crowded.groupBy("band", "members").agg(F.min("set_key").alias("hub"), F.bit_xor(mark).alias("x"),
                                                     F.sum(mark % 1_000_003).alias("s"))
              .groupBy("members", "hub", "x", "s").agg(F.min("band").alias("band")).select("band", "hub"))
    return crowded.join(groups, "band")


def near_links(rows: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, direct: int = 2,
               members_of: Callable[[DataFrame], DataFrame] = bucket_members) -> DataFrame:
    """u, v: links between set keys, enough for every component.

    ``rows`` has set_key and bands; ``sets_of`` gives (set_key, items) for a table of wanted keys, ``members_of`` the buckets of ``rows``.
    Buckets of up to ``direct`` members with small sets are compared pair by pair instead of in blocks.
    """
    members = stored(members_of(rows))
    sets = stored(sets_of(members.select("set_key").distinct()))
    star = members.where("set_key <> hub").select(F.col("hub").alias("u"), F.col("set_key").alias("v")).distinct()
    links = stored(confirmed(star, sets, percent))
    labels = components(links, "u", "v").withColumnRenamed("node", "set_key")
    # buckets of two are settled
    labelled = members.where("members > 2").join(labels, "set_key", "left").withColumn("label", F.coalesce("label", "set_key"))
    open_groups = (labelled.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"))
                   .where("low <> high").select("band"))
    opened = stored(labelled.join(open_groups, "band").select("band", "members", "hub", "label", "set_key"))
    weights = (opened.join(sets.select("set_key", F.octet_length("items").alias("bytes")), "set_key")
               .groupBy("band").agg(F.sum("bytes").alias("bytes")))
    links_of_few = []
    if direct > 2:
        few = weights.join(opened.select("band", "members").distinct(), "band").where((F.col("members") <= direct) & (F.col("members") * F.col("bytes") <= DIRECT_BYTES))
        of_few = opened.where(F.col("members") <= direct).join(few.select("band"), "band").where("set_key <> hub")
        one, other = (of_few.select("band", F.col("set_key").alias(k), F.col("label").alias(f"{k}_label")) for k in "uv")
        pairs = one.join(other, "band").where("u < v and u_label <> v_label").select("u", "v").distinct()
        links_of_few.append(stored(confirmed(pairs, sets, percent)))
        opened = opened.join(few.select("band"), "band", "left_anti")
    # member blocks: every two blocks of a bucket meet in one task
    n_blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("set_key", F.lit("block")), n_blocks).cast("int")
    meet = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda k: F.struct(
        F.least(own, k).alias("low"), F.greatest(own, k).alias("high"), (own > k).cast("int").alias("side")))
    sent = (opened.join(weights, "band").withColumn("m", F.explode(meet))
            .select("band", "m.low", "m.high", "m.side", "label", "set_key").join(sets, "set_key"))
    more = (sent.groupBy("band", "low", "high")
            .applyInPandas(lambda pdf: block_links(pdf, percent), "u binary, v binary"))
    return reduce(DataFrame.union, links_of_few, links.union(stored(more.distinct())))


def with_components(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows = stored(sketched_rows(docs))
    full = rows.where("doc_id is not null and n > 0").select("doc_id", "set_key", "bands")
    links = near_links(full, lambda wanted: set_table(docs, full, wanted), percent)
    # an id with several texts joins their sets
    several = (full.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high"))
               .where("low <> high").select("doc_id", "low"))
    own = full.join(several, "doc_id").select(F.col("set_key").alias("u"), F.col("low").alias("v"))
    labels = components(links.union(own), "u", "v").withColumnRenamed("node", "set_key")
    classes = full.groupBy("set_key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    labelled = stored(classes.join(labels, "set_key", "left").withColumn("label", F.coalesce("label", "set_key")))
    names = stored(labelled.groupBy("label").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members")))
    of_set = stored(joined_on_hot(labelled, names, "label", "members").select("set_key", "component_id", "copies"))
    linkable = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    named = joined_on_hot(rows.where(linkable).select("doc_id", "n", "set_key"), of_set, "set_key", "copies")
    alone = rows.where(~linkable).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = named.select("doc_id", "n", "component_id").unionByName(alone.select("doc_id", "n", "component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    return with_components(docs, percent)


def drop_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the rows of its smallest id. All columns stay."""
    dropped = with_components(docs, percent).where("not kept").select(F.col("doc_id").alias("_near_id")).distinct()
    return docs.join(dropped, F.col("doc_id").cast("long") == F.col("_near_id"), "left_anti")


#: The components at 85 percent, by comparing all sets that share a shingle.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT doc_id, unnest(range(1, greatest(len(w) - 3, 2))) AS i, w FROM words WHERE len(w) > 0),
items AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM shingles),
sets AS (SELECT d.doc_id, count(x) AS n FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN items USING (doc_id) GROUP BY 1),
shared AS (
  SELECT i.doc_id, n, x FROM items i JOIN sets ON i.doc_id = sets.doc_id
  WHERE x IN (SELECT x FROM items GROUP BY x HAVING count(*) > 1)),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM shared a JOIN shared b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached AS (
  SELECT doc_id, doc_id AS r FROM sets UNION SELECT reached.doc_id, pairs.v FROM reached JOIN pairs ON reached.r = pairs.u)
SELECT sets.doc_id, n::BIGINT AS n_shingles, min(r) AS component_id, sets.doc_id = min(r) AS kept
FROM sets JOIN reached ON sets.doc_id = reached.doc_id GROUP BY sets.doc_id, n
"""
