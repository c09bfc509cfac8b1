"""The trie of conversation prefixes, by union-find over neighbours in sorted order.

A conversation's turns are ordered by ``turn`` (null first; ties by role, then text; null role
or text is empty). Conversation c is rebuilt: the first h turns of conversation ``c - c % 20`` (all if
it has fewer, none if there is none), then c's own turns after its first h, with h = crc32 of c in decimal,
modulo 4. Every distinct sequence of the first d rebuilt turns is a node of depth d.

1. A turn becomes a 16-byte digest, a conversation the digests in a row (``seq``). Equal
   sequences are one row with their number and smallest id; texts are not moved again.
2. Sequences are sorted over the cluster. A task takes a run of neighbours: the common prefix
   of two neighbours is an edge as deep as it is long. In descending depth a union-find joins
   what an edge connects, and every joining makes a branching node (or adds
   a child to the one of the same depth). Between a node and its parent lie the
   nodes of a chain, which have the same members.
3. Only nodes on the paths of a task's first and last sequence can have members elsewhere. All
   other nodes are complete and are returned. The forest hanging from those two paths is
   contracted to one row per open node, with the sums of what hangs there.
4. The contracted rows of all tasks, added up by prefix, are again distinct sequences with
   sums, far fewer than before, and are sorted and merged in the same way, until one task has all.
5. A node returned before its parent gets the parent's id by a join that keeps a parent
   with very many children off any single task.
6. The ids that end at a node are hashed as one text: tasks write runs of sorted ids as pieces
   of text, and one task streams a node's pieces through the hash.

The digests of one conversation (16 bytes a turn) are held together by one task, and of
their sequences about ``TURNS`` turns. Rows with a null ``conv_id`` belong to no conversation and are left out.
Repeated rows of a turn are turns. Extra columns are ignored. Without conversations the result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import WORD, joined_on_hot, partitions, stored

UNIT = 16                 # bytes of a turn's digest
GROUP, HEAD = 20, 4       # ids that share the head of their first, and the number of possible head lengths
TURNS = 1 << 18           # turns of the sequences that one task merges
LEAST_ROWS = 2_000        # below this many sequences a task is not worth splitting
PIECE = 1 << 20           # bytes of ids in a piece of text
NO_ENDS = hashlib.sha256(b"").hexdigest()
ITEM = ["seq", "words", "members", "least", "kids", "leaves", "saved", "ends"]
NODE = ["conv_id", "depth", "parent_conv_id", "parent_key", "own_key", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]


# ---- conversations -----------------------------------------------------------------------------------------------

def own_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: (digest in hex, words) of each conversation's turns in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                role.alias("role"), text.alias("text")).where("conv_id is not null")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    digest = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    words = F.regexp_count("text", F.lit(WORD)).cast("int")
    turns = rows.select("conv_id", F.struct(place.alias("at"), digest.alias("digest"), words.alias("words")).alias("t"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, seq (the digests of the rebuilt turns in a row), words (of every rebuilt turn)."""
    own = stored(own_turns(conversations))
    first = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, HEAD).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    rows = own.withColumn("first", first).join(heads, "first", "left")
    turns = F.concat(F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h),
                     F.slice("turns", h + 1, F.size("turns")))
    rows = rows.select("conv_id", turns.alias("turns"))
    return rows.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("seq"), F.col("turns.words").alias("words"))


def ends(rows: DataFrame) -> DataFrame:
    """key (md5 of the sequence), ends (SHA-256 of its ids, in order and comma-joined)."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, 0, [], 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([first], pa.int64()), pa.array([",".join(held)])],
                                              names=["key", "first", "piece"])

        for batch in batches:
            for k, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if held and (k != key or size >= PIECE):
                    yield piece()
                    held, size = [], 0
                if not held:
                    key, first = k, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield piece()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, hashlib.sha256(), []
        for batch in batches:
            for k, text in zip(batch.column("key").to_pylist(), batch.column("piece")):
                if k == key:
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(text.as_py().encode())
            yield pa.RecordBatch.from_pydict({"key": pa.array([d[0] for d in done], pa.string()), "ends": pa.array([d[1] for d in done], pa.string())})
            done = []
        if key is not None:
            yield pa.RecordBatch.from_pydict({"key": [key], "ends": [state.hexdigest()]})

    n = partitions(rows.sparkSession)
    ids = rows.select(F.md5("seq").alias("key"), "conv_id").repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    return (ids.mapInArrow(pieces, "key string, first long, piece string").repartition(n, "key").sortWithinPartitions("key", "first")
            .mapInArrow(hashed, "key string, ends string"))


# ---- one run of sorted sequences ---------------------------------------------------------------------------------

def common(a: bytes, b: bytes) -> int:
    """Turns that two sequences share at their beginning."""
    low, high = 0, min(len(a), len(b)) // UNIT
    if a[:UNIT] != b[:UNIT]:
        return 0
    while low < high:   # the longest equal prefix, by halves
        middle = (low + high + 1) // 2
        if a[low * UNIT:middle * UNIT] == b[low * UNIT:middle * UNIT]:
            low = middle
        else:
            high = middle - 1
    return low


class Forest:
    """The compressed trie of sorted distinct sequences: a terminal node for every sequence, and the branching nodes.

    ``depth``, ``low`` and ``high`` (first and last sequence below) of each node, ``parent`` (-1: none), children before parents.
    """

    def __init__(self, seqs: list[bytes]):
        n = len(seqs)
        self.depth = [len(s) // UNIT for s in seqs]
        self.low, self.high, self.parent = list(range(n)), list(range(n)), [-1] * n
        edges = [common(seqs[i], seqs[i + 1]) for i in range(n - 1)]
        group = list(range(n))      # union-find over sequences
        top = list(range(n))        # by a group's root: its topmost node

        def find(i: int) -> int:
            while group[i] != i:
                group[i] = group[group[i]]
                i = group[i]
            return i

        for i in sorted(range(n - 1), key=lambda i: -edges[i]):   # stable: edges as deep go from left to right
            a, b = find(i), find(i + 1)
            left, right, d = top[a], top[b], edges[i]
            if self.depth[left] == d:   # that sequence is a prefix of the others, or the node is there already
                node = left
            else:
                node = len(self.depth)
                self.depth.append(d)
                self.low.append(self.low[left])
                self.high.append(self.high[left])
                self.parent.append(-1)
                self.parent[left] = node
            self.parent[right] = node
            self.high[node] = self.high[right]
            group[b] = a
            top[a] = node

    def bottom_up(self) -> list[int]:
        return sorted(range(len(self.depth)), key=lambda x: -self.depth[x])


def merged(items: dict[str, list], whole: bool) -> tuple[dict[str, list], dict[str, list]]:
    """The complete nodes of a run of sorted items, and the contracted rows of those that may go on in other runs
    (none, if this is the ``whole``)."""
    seqs, words = items["seq"], items["words"]
    f = Forest(seqs)
    n, size = len(seqs), len(f.depth)
    extra = [0] * (size - n)
    members, kids, leaves, saved = (items[c] + extra for c in ("members", "kids", "leaves", "saved"))
    least: list[int | None] = items["least"] + [None] * (size - n)
    tails: list[str | None] = items["ends"] + [None] * (size - n)
    nodes: dict[str, list] = {c: [] for c in NODE}
    rest: dict[str, list] = {c: [] for c in ITEM}
    waiting: list[tuple[int, int]] = []   # (row of a complete node, its complete parent)
    is_open = [not whole and (f.low[x] == 0 or f.high[x] == n - 1) for x in range(size)]
    for x in f.bottom_up():
        up, rep = f.parent[x], f.low[x]
        if is_open[x]:
            if members[x] or kids[x]:
                d = f.depth[x]
                for c, value in zip(ITEM, (seqs[rep][:d * UNIT], words[rep][:d], members[x], least[x], kids[x], leaves[x], saved[x], tails[x])):
                    rest[c].append(value)
            continue
        count, low, w = members[x], least[x], words[rep]
        k, below, total, tail = kids[x], leaves[x], saved[x], tails[x]
        upto = f.depth[up] + 1 if up >= 0 else 0
        for d in range(f.depth[x], upto - 1, -1):
            below = below if k else 1
            total += (count - 1) * w[d - 1] if d else 0
            own = hashlib.md5(seqs[rep][:d * UNIT]).hexdigest() if items["again"] else None
            for c, value in zip(NODE, (low, d, low if d > upto else None, None, own, count, k, below, total, tail)):
                nodes[c].append(value)
            k, tail = 1, None
        if up >= 0:
            members[up] += count
            least[up] = low if least[up] is None else min(least[up], low)
            kids[up] += 1
            leaves[up] += below
            saved[up] += total
            row = len(nodes["depth"]) - 1
            if is_open[up]:
                nodes["parent_key"][row] = hashlib.md5(seqs[rep][:f.depth[up] * UNIT]).hexdigest()
            else:
                waiting.append((row, up))
    for row, up in waiting:
        nodes["parent_conv_id"][row] = least[up]
    return nodes, rest


# ---- runs of all tasks, merged -----------------------------------------------------------------------------------

_ITEM_TYPES = {"seq": pa.binary(), "words": pa.list_(pa.int32()), "ends": pa.string()}
_NODE_TYPES = {"parent_key": pa.string(), "own_key": pa.string(), "ends": pa.string()}
_SCHEMA = pa.schema([pa.field("node", pa.struct([(c, _NODE_TYPES.get(c, pa.int64())) for c in NODE])),
                     pa.field("item", pa.struct([(c, _ITEM_TYPES.get(c, pa.int64())) for c in ITEM]))])
_SPARK = ("node struct<conv_id: long, depth: long, parent_conv_id: long, parent_key: string, own_key: string, n_convs: long, "
          "n_children: long, n_leaves: long, saved_tokens: long, ends: string>, "
          "item struct<seq: binary, words: array<int>, members: long, least: long, kids: long, leaves: long, saved: long, ends: string>")
ROWS_OUT = 10_000


def merged_runs(items: DataFrame, runs: int, again: bool) -> DataFrame:
    """node, item (one of them null): what ``merged`` returns of each of ``runs`` runs; ``again``: of contracted rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in ITEM}
        for batch in batches:
            for c in ITEM:
                held[c] += batch.column(c).to_pylist()
        if not held["seq"]:
            return
        nodes, rest = merged(held | {"again": again}, runs == 1)
        for name, found in (("node", nodes), ("item", rest)):
            kind = _SCHEMA.field(name).type
            size = len(next(iter(found.values())))
            for at in range(0, size, ROWS_OUT):
                part = pa.StructArray.from_arrays([pa.array(found[f.name][at:at + ROWS_OUT], f.type) for f in kind], fields=list(kind))
                none = pa.nulls(len(part), _SCHEMA.field("item" if name == "node" else "node").type)
                yield pa.RecordBatch.from_arrays([part, none] if name == "node" else [none, part], schema=_SCHEMA)

    # a single run is one partition; more are cut at prefixes that Spark samples
    dealt = items.repartition(1) if runs == 1 else items.repartitionByRange(runs, "seq")
    return dealt.sortWithinPartitions("seq").mapInArrow(run, _SPARK)


def trie(conversations: DataFrame, turns: int = TURNS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    spark = conversations.sparkSession
    rows = stored(rebuilt(conversations))
    zero = F.lit(0).cast("long")
    items = stored(rows.groupBy("seq", "words").agg(F.count(F.lit(1)).alias("members"), F.min("conv_id").alias("least"))
                   .withColumn("key", F.md5("seq")).join(ends(rows), "key")
                   .select("seq", "words", "members", "least", zero.alias("kids"), zero.alias("leaves"), zero.alias("saved"), "ends"))
    levels, runs = [], 0
    while True:
        size = items.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("words") + 1).alias("turns")).first()
        need = max(1, -(-(size["turns"] or 0) // turns))
        if not levels:   # all cores have work on a small input too
            runs = max(need, min(partitions(spark), -(-size["rows"] // least_rows)))
        else:            # fewer every time, so that the merging ends
            runs = min(need, max(1, runs // 2))
        done = stored(merged_runs(items, runs, bool(levels)))
        levels.append(done.where("node is not null").select("node.*"))
        if runs == 1:
            break
        again = done.where("item is not null").select("item.*")
        items = stored(again.groupBy("seq", "words").agg(
            F.sum("members").alias("members"), F.min("least").alias("least"), F.sum("kids").alias("kids"),
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends")).select(*ITEM))
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    if len(levels) > 1:
        above = levels[1]
        for more in levels[2:]:
            above = above.unionByName(more)
        parents = stored(above.select(F.col("own_key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"), "n_children"))
        pending = nodes.where("parent_key is not null").drop("parent_conv_id")
        nodes = nodes.where("parent_key is null").unionByName(joined_on_hot(pending, parents, "parent_key", "n_children"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


#: The same nodes from the prefixes themselves; crc32 by its bits.
ORACLE_SQL = f"""
WITH own AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}}
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (
  SELECT conv_id, s, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
                             lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % {HEAD} AS h
  FROM own),
seqs AS (
  SELECT o.conv_id, list_concat(coalesce(b.s, [])[1:h], o.s[h + 1:]) AS s
  FROM heads o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % {GROUP}),
members AS (SELECT conv_id, len(s) AS n, unnest(range(0, len(s) + 1)) AS d, s FROM seqs),
nodes AS MATERIALIZED (
  SELECT s[1:d] AS p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CASE WHEN n = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(s[1:d][-1].t, '{WORD}')) END AS saved
  FROM members GROUP BY s[1:d], d),
kids AS (SELECT p[1:depth - 1] AS p, count(*) AS k FROM nodes WHERE depth > 0 GROUP BY 1),
leafy AS MATERIALIZED (
  SELECT n.*, coalesce(k, 0) AS k FROM nodes n LEFT JOIN kids ON n.p = kids.p),
up AS (SELECT unnest(range(0, depth + 1)) AS a, p, k, saved FROM leafy),
below AS (SELECT p[1:a] AS p, count(*) FILTER (k = 0) AS leaves, sum(saved) AS saved FROM up GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.k::BIGINT AS n_children,
  b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM leafy n JOIN below b ON n.p = b.p LEFT JOIN nodes o ON n.depth > 0 AND o.p = n.p[1:n.depth - 1]
"""
