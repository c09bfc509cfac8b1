"""SimHash classes, bit-plane clustering and the prefix trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tally.llm import bitplanes, prefixes, simhash
from tally.llm.common import joined_on_hot

# ---- SimHash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_labels(prints):
    """The smallest id reachable by links of at most three bits, from (id, fingerprint) pairs."""
    label = {i: i for i, _ in prints}
    links = [(a, b) for k, (a, x) in enumerate(prints) for b, y in prints[:k] if a == b or (x ^ y).bit_count() <= 3]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if (label[a], label[b]) != (low, low):
                label[a] = label[b] = low
                changed = True
    return label


def simhash_rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    for _ in range(5):
        base = [rng.choice(words) for _ in range(300)]
        for k in range(20):
            text = list(base)
            for _ in range(k // 3):
                text[rng.randrange(300)] = rng.choice(words)
            rows.append((n, " ".join(text)))
            n += 1
    rows += [(n + k, rows[0][1]) for k in range(40)]
    rows += [(500 + k, " ".join(rng.choice(words) for _ in range(k))) for k in range(12)]
    rows += [(600, None), (601, ""), (602, " \t\n"), (603, rows[3][1].upper()), (None, rows[1][1]), (None, None), (604, "a b c a b c a b c"),
             (605, "Ünï cödé \x1f wörds"), (606, rows[0][1]), (606, rows[25][1]), (606, rows[0][1]), (607, "one two"), (608, "ONE\x0btwo")]
    return rows


@pytest.mark.parametrize("bucket", [2, 4096])
def test_simhash(docs_of, bucket):
    """Buckets of two force every level of masks."""
    rows = simhash_rows()
    got = simhash.near_duplicates(docs_of(rows), bucket).collect()
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    label = plain_labels([p for p in prints if p[0] is not None])
    expected = sorted((str(i), f"{x:016x}", str(label.get(i))) for i, x in prints)
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == expected


def test_simhash_whole_table(small_docs, small_rows):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(small_docs).collect()}
    prints = [(i, plain_fingerprint(t)) for i, t in small_rows]
    label = plain_labels(prints)
    assert len(got) == len(prints) and all(got[i]["fingerprint"] == f"{x:016x}" and got[i]["component_id"] == label[i] for i, x in prints)


def test_simhash_empty_and_long(docs_of):
    assert simhash.near_duplicates(docs_of([])).collect() == []
    long = " ".join(f"x{i % 7919}" for i in range(700_000))           # several slices
    assert len(long) > 3 * simhash.SLICE
    assert simhash.fingerprint(long.encode()) == plain_fingerprint(long)
    blank = " " * (2 * simhash.SLICE)
    assert simhash.fingerprint((blank + "a" + blank + "b").encode()) == plain_fingerprint("a b")


def test_covering_masks_cover():
    """Whatever three bits differ, one table of each level masks them all out."""
    rng = random.Random(5)
    for level in range(2):
        masks = [m for _, _, m in simhash.tables(level)]
        for _ in range(300):
            bits = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(m & bits == 0 for m in masks)
    refined = defaultdict(list)
    for _, up, m in simhash.tables(1):
        refined[up].append(m)
    for number, _, mask in simhash.tables(0):      # what a table does not see, its own refinements still cover
        free = [b for b in range(64) if not mask >> b & 1]
        for _ in range(50):
            bits = sum(1 << b for b in rng.sample(free, 3))
            assert any(m & bits == 0 for m in refined[number])
    assert all(64 - m.bit_count() <= 12 for _, _, m in simhash.tables(2))    # at most BUCKET members


def test_simhash_crowded_bucket(spark):
    """A bucket with more different fingerprints than one task searches loses no link."""
    rng = random.Random(8)
    low = [rng.getrandbits(30) for _ in range(600)]
    prints = sorted({(0xABCDE << 40) | x for x in low} | {((0xABCDE << 40) | x) ^ (1 << rng.randrange(30)) for x in low[:200]})
    classes = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = [(r["u"], r["v"]) for r in simhash.near_links(classes, 50).collect()]
    assert all((u ^ v).bit_count() <= 3 for u, v in got)
    label = {p: p for p in prints}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p
    for u, v in got:
        label[max(root(u), root(v))] = min(root(u), root(v))
    expected = plain_labels([(p, p) for p in prints])
    assert {p: root(p) for p in prints} == expected


def test_joined_on_hot(spark):
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 3000), (2, 5), (None, 4)) for i in range(n)], "k long, x long")
    keyed = spark.createDataFrame([(1, "a", 3000), (2, "b", 5), (3, "c", 0)], "k long, v string, n long")
    got = joined_on_hot(rows, keyed, "k", "n")
    assert got.columns == ["k", "x", "v"]
    assert {(r["k"], r["v"]): r["n"] for r in got.groupBy("k", "v").agg(F.count("x").alias("n")).collect()} == {(1, "a"): 3000, (2, "b"): 5}


# ---- clustering

def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    mark = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        cents = [[sum(x) // len(own[n]) for x in zip(*own[n])] if n in own else c for n, c in enumerate(cents)]
    found = [(i, *nearest(v)) for i, v in kept]
    sums = defaultdict(int)
    for _, d, n in found:
        sums[n] += d
    return sorted((str(i), n, d, sums[n], sum(sums.values()), hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest())
                  for i, d, n in found)


def cluster_frame(spark, rows):
    return (spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
            .withColumns({c: F.lit("x") for c in ("cluster", "planes", "v", "mark", "distance")}))


def told(df):
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def test_clusters(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=64) * (0.1 if i % 3 else 300.0)).tolist()) for i in range(120)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (5, rows[9][1]), (5, rows[9][1]), (None, rows[7][1]), (202, [0.0] * 64),
             (203, [-0.0] * 64), (204, [-1 / 64] * 64), (205, None), (206, []), (207, [1.0] * 63), (208, [1.0] * 65),
             (209, [1.0] * 63 + [None]), (210, [1.0] * 63 + [float("nan")]), (211, [float("-inf")] + [1.0] * 63)]
    assert told(bitplanes.cluster(cluster_frame(spark, rows))) == plain_clusters(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(n)] + [(99, [1.0])]
    assert told(bitplanes.cluster(cluster_frame(spark, rows))) == plain_clusters(rows)


def test_equal_vectors_leave_clusters_empty(spark):
    rows = [(i, [0.5] * 64) for i in range(40)]
    assert told(bitplanes.cluster(cluster_frame(spark, rows))) == plain_clusters(rows)


def test_planes_are_exact():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(1 << 27) + 1, 1 << 27, (50, 64)), rng.integers(-70, 70, (9, 64))
    pa_, pb = bitplanes.planes_of(a), bitplanes.planes_of(b)
    assert (bitplanes.dots(pa_, pb) == a @ b.T).all() and (bitplanes.squares(pb) == (b * b).sum(1)).all()
    assert (bitplanes.dots(bitplanes.widened(pb, 20), pa_) == b @ a.T).all()
    assert (bitplanes.sums(pa_, np.arange(50) % 3, 4) == [a[np.arange(50) % 3 == c].sum(0) for c in range(4)]).all()
    with pytest.raises(ValueError):
        bitplanes.planes_of(np.full((1, 64), 1 << 27))


# ---- prefix trie

def plain_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        own_saved = (len(m) - 1) * len(p[-1][1].encode().split()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += own_saved
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p)).encode()).hexdigest())
                  for p, m in members.items())


def told_nodes(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"],
                   r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


def conversation_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi there", "a b c", "", "long  text\x0bhere now"])))
    same = [(t, "user", f"same {t}") for t in range(6)]
    rows += [(5000 + c, *s) for c in range(60) for s in same]                     # one conversation many times
    rows += [(7000 + c, *s) for c in range(6) for s in same[:c]]                   # nested prefixes
    rows += [(8000, t, "u", f"t{t % 3}") for t in range(700)] + [(8001, t, "u", f"t{t % 3}") for t in range(650)]
    rows += [(9000, None, None, "null first"), (9000, 0, "user", None), (9000, 0, "user", "tie"), (9000, 0, "user", "tie"),
             (9000, 0, None, "tie"), (None, 0, "user", "nobody"), (-3, 0, "user", "below"), (-20, 0, "u", "x"), (-23, 4, "u", "y"), (-23, 5, "u", "y")]
    return rows


def conversation_frame(spark, rows):
    return (spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
            .withColumns({c: F.lit("x") for c in ("turns", "seq", "words", "key", "node", "item", "depth", "ends", "at")}))


@pytest.mark.parametrize("turns,least", [(1 << 18, 1 << 20), (1 << 18, 20), (300, 1), (40, 1)])
def test_trie(spark, turns, least):
    """One run, several runs, and runs so small that the merging takes several rounds."""
    rows = conversation_rows(7, 300)
    assert told_nodes(prefixes.trie(conversation_frame(spark, rows), turns, least)) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert prefixes.trie(conversation_frame(spark, [])).collect() == []
    assert prefixes.trie(conversation_frame(spark, [(None, 1, "a", "b")])).collect() == []


def test_trie_without_turns(spark):
    """A conversation shorter than its head, whose first conversation is absent, is a member of the root alone."""
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1)
    rows = [(c, 0, "user", "gone")]
    assert plain_trie(rows) == told_nodes(prefixes.trie(conversation_frame(spark, rows))) and len(plain_trie(rows)) == 1


def test_forest_of_neighbours():
    """Branching nodes of the union-find: equal edges give one node, a prefix of others is its own branching node."""
    turn = {k: k.encode() * prefixes.UNIT for k in "abcdx"}
    seqs = sorted(b"".join(turn[k] for k in s) for s in ("", "a", "abx", "abc", "abd", "b", "cd", "ca"))
    f = prefixes.Forest(seqs)
    name = lambda x: "".join(chr(seqs[f.low[x]][i * prefixes.UNIT]) for i in range(f.depth[x]))
    below = {(name(x), name(f.parent[x]) if f.parent[x] >= 0 else None) for x in range(len(f.depth))}
    assert below == {("", None), ("a", ""), ("ab", "a"), ("abc", "ab"), ("abd", "ab"), ("abx", "ab"), ("b", ""), ("c", ""), ("ca", "c"), ("cd", "c")}
