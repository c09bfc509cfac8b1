"""Near duplicates, paragraphs, substrings, fingerprints and neighbours against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tally.llm import fingerprints, neardup, neighbours, paragraphs, suffixes
from tally.llm.common import FREE_SHUFFLES, stored
from tally.llm.components import components

WORDS = [f"w{i}" for i in range(3000)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split())


# ---- components

def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (200, 100), (7, 7), (300, 300)] + [(500, k) for k in range(501, 560)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 200)}, **{i: 500 for i in range(500, 560)}}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# ---- near duplicates

def word_sets(rows):
    out = defaultdict(list)
    for i, t in rows:
        words = (t or "").encode().lower().split()
        n = len(words)
        out[i].append({b" ".join(words[k:k + 5]) for k in range(n - 4)} if n >= 5 else {b" ".join(words)} if n else set())
    return out


def plain_components(rows, percent):
    sets = [(i, s) for i, many in word_sets(rows).items() if i is not None for s in many]
    label = {i: i for i, _ in sets}
    changed = True
    pairs = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k]
             if x and y and 100 * len(x & y) >= percent * len(x | y)]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def near_rows():
    rng = random.Random(4)
    rows, base = [], [prose(rng, 120) for _ in range(6)]
    n = 0
    for b, text in enumerate(base):
        for k in range(25):
            rows.append((n, edited(rng, text, 0.004 * k)))
            n += 1
    rows += [(n + k, base[0]) for k in range(30)]                         # exact copies
    rows += [(1000 + k, prose(rng, k)) for k in range(8)]                 # short ones
    rows += [(2000, None), (2001, ""), (2002, "  \n"), (None, base[1]), (None, ""), (2003, base[2].upper()), (2004, base[2])]
    rows += [(2005, base[3]), (2005, base[4]), (2006, "a b c"), (2007, "A  b\tC"), (2004, base[2])]
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs_of, percent):
    rows = near_rows()
    got = neardup.near_duplicates(docs_of(rows), percent).collect()
    assert len(got) == len(rows)
    label = plain_components(rows, percent)
    sizes = {i: {len(s) for s in many} for i, many in word_sets(rows).items()}
    for r in got:
        assert r["n_shingles"] in sizes[r["doc_id"]]
        assert r["component_id"] == (None if r["doc_id"] is None else label[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] is None or label[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_in_a_crowded_bucket(docs_of, monkeypatch):
    """Members of a bucket whose first member resembles few of them still find each other, block by block."""
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng = random.Random(9)
    base = prose(rng, 200)
    rows = [(k, edited(rng, base, 0.018)) for k in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs_of(rows), 80).collect()}
    assert got == plain_components(rows, 80) and 1 < len(set(got.values())) < 60


def test_drop_duplicates(docs_of):
    rows = near_rows()
    docs = docs_of(rows)
    out = neardup.drop_duplicates(docs)
    assert out.columns == docs.columns
    label = plain_components(rows, 80)
    kept = [r["doc_id"] for r in out.collect()]
    assert sorted(kept, key=repr) == sorted([i for i, _ in rows if i is None or label[i] == i], key=repr)
    assert neardup.near_duplicates(docs.where("false"), 80).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(8)
    for n in (1, 3, 50, 2000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        assert len(set(neardup.sketch(a).tolist())) <= 2 * neardup.COORDINATES and (neardup.sketch(a) == neardup.sketch(a)).all()
    agree = []
    for _ in range(30):
        shared, x, y = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (800, 100, 100))
        agree.append((neardup.sketch(np.union1d(shared, x)) == neardup.sketch(np.union1d(shared, y))).mean())
    assert abs(np.mean(agree) - 0.8) < 0.03


# ---- paragraphs

def test_paragraph_clusters(docs_of):
    rng = random.Random(2)
    passage, other = prose(rng, 60), prose(rng, 80)
    rows = [(k, "\n".join([prose(rng, 30), passage if k % 3 == 0 else edited(rng, passage, 0.005), prose(rng, 25)])) for k in range(12)]
    rows += [(50, other + "\n" + other), (51, None), (52, ""), (53, prose(rng, 19)), (None, passage), (54, prose(rng, 40)), (3, rows[3][1])]
    docs = docs_of(rows)
    got = paragraphs.clusters(docs).collect()
    texts = {i: t for i, t in rows if i is not None}
    places = [(i, s, e, neardup.shingles(t[s:e])) for i, t in texts.items() for s, e in paragraphs.paragraphs(t or "")]
    label = {p[:3]: p[:3] for p in places}
    links = [(a[:3], b[:3]) for a in places for b in places if neardup.linked(a[3], b[3], 80)]
    for _ in range(8):
        for a, b in links:
            low = min(label[a], label[b])
            label[a] = label[b] = low
    several = {v for k, v in label.items() if k[0] != v[0] or k[1] >= v[2]}       # not only in one place
    assert {(r["doc_id"], r["start"], r["end"]): (r["cluster_doc_id"], r["cluster_start"]) for r in got} == {
        k: v[:2] for k, v in label.items() if v in several}
    first_end = {v[:2]: v[2] for v in several}
    assert all(r["kept"] == (r["doc_id"] == r["cluster_doc_id"] and r["start"] < first_end[r["cluster_doc_id"], r["cluster_start"]]) for r in got)
    cut = paragraphs.cut(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    after = defaultdict(list)
    for r in cut.collect():
        after[r["doc_id"]].append(r["text"])
    assert after[50] == [other] and after[51] == [None] and after[54] == [texts[54]] and after[None] == [passage]
    passages = {k: (len(texts[k].split("\n")[0]), len(texts[k]) - len(texts[k].split("\n")[2]) - 1) for k in range(12)}
    assert all(len(after[k][0].split("\n")) == 2 for k in range(1, 12) if label.get((k, *passages[k])) in several)
    assert sum(label.get((k, *passages[k])) in several for k in range(1, 12)) > 6
    assert paragraphs.clusters(docs.where("false")).count() == 0


def test_pasted_passages_are_found(docs_of):
    """Passages of 50 words and more in short sentences, short lines, without punctuation and in the middle of a line."""
    rng = random.Random(12)
    sentences = " ".join(prose(rng, 9) + "." for _ in range(7))
    lines = "\n".join(prose(rng, 6) for _ in range(10))
    dots = " ".join(prose(rng, 3) + " e.g. 3.14 a.b.c/d" for _ in range(10))
    plain = [prose(rng, 60) for _ in range(30)]
    rows = [(k, f"{prose(rng, 30)}\n{p}\n{prose(rng, 30)}") for k, p in enumerate((sentences, lines, dots))]
    rows += [(10 + k, f"{prose(rng, 7)}\n{p}\n{prose(rng, 30)}") for k, p in enumerate((sentences, lines, dots))]
    rows += [(100 + k, f"{prose(rng, 25)} {p} {prose(rng, 25)}") for k, p in enumerate(plain)]
    rows += [(200 + k, f"{prose(rng, 40)} {p} {prose(rng, 15)}") for k, p in enumerate(plain)]
    texts = dict(rows)
    covered = {i: np.zeros(len(t), bool) for i, t in rows}
    for r in paragraphs.clusters(docs_of(rows)).collect():
        covered[r["doc_id"]][r["start"]:r["end"]] |= not r["kept"]
    part = lambda i, p: covered[i][texts[i].index(p):][:len(p)].mean()
    for k, p in enumerate((sentences, lines, dots)):
        assert part(10 + k, p) == 1
    found = [part(200 + k, p) for k, p in enumerate(plain)]
    assert min(found) > 0.3 and np.mean(found) > 0.65
    assert not any(covered[i].any() for i in (*range(3), *range(100, 130)))


def test_links_of_paragraphs_are_found_without_chance():
    """Every two sets at the threshold share a key."""
    rng = np.random.default_rng(3)
    for n in [*range(1, 40)] * 5:
        fresh = lambda k: rng.integers(0, 1 << 63, k, dtype=np.uint64)
        m = n + int(rng.integers(0, n // 4 + 1))
        shared = fresh(-(-80 * (n + m) // 180))
        a, b = (np.unique(np.append(shared, fresh(k - len(shared)))) for k in (n, m)) if len(shared) <= n else (shared[:n], shared[:n])
        if not neardup.linked(np.sort(a), np.sort(b), 80):
            continue
        x, y = paragraphs.meeting_keys(np.concatenate([np.sort(a), np.sort(b)]), np.array([len(a), len(b)]), 80)
        assert set(x.tolist()) & set(y.tolist())


def test_overlapping_paragraphs_do_not_remove_each_other(docs_of):
    rows = [(1, "ha " * 40), (2, "one two three four five six " * 20)]
    kept = {r["doc_id"]: r["text"] for r in paragraphs.cut(docs_of(rows)).collect()}
    assert all(len(kept[i].split()) >= 10 for i in kept)


def test_whole_sentences_are_found_wherever_they_stand(docs_of):
    """A sentence of 10 to 30 words copied whole, between short sentences that are others each time."""
    rng = random.Random(41)
    short = lambda: " ".join(prose(rng, rng.randrange(1, 5)) + "." for _ in range(rng.randrange(1, 4)))
    rows, places = [], []
    for k in range(500):
        sentence = prose(rng, rng.randrange(10, 31)) + "."
        for side in range(2):
            before = short()
            rows.append((2 * k + side, f"{before} {sentence} {short()}"))
            places.append((2 * k + side, len(before) + 1, len(before) + 1 + len(sentence)))
    got = defaultdict(list)
    for r in paragraphs.clusters(docs_of(rows)).collect():
        got[r["doc_id"]].append((r["start"], r["end"], r["cluster_doc_id"]))
    for i, start, end in places:
        assert any(s <= start and e >= end - 1 and c == i - i % 2 for s, e, c in got[i]), i


def test_paragraphs_without_repeats_are_left_out_before_keys(docs_of):
    """Only units with marks that occur elsewhere, and those linked with them in place, are written and get keys."""
    rng = random.Random(51)
    rows = [(k, "\n".join(prose(rng, rng.randrange(8, 40)) + "." for _ in range(4))) for k in range(200)]
    assert paragraphs.sketched_paragraphs(docs_of(rows)).count() == 0
    passage = prose(rng, 30) + "."
    rows += [(500 + k, f"{prose(rng, 60)}\n{passage}\n{prose(rng, 60)}") for k in range(2)]
    got = paragraphs.sketched_paragraphs(docs_of(rows)).collect()
    assert {r["doc_id"] for r in got} == {500, 501} and len(got) < 20


def test_clusters_of_overlapping_and_repeated_units(docs_of):
    """Against all pairs: links in place, crowded buckets, texts with repeats of their own."""
    rng = random.Random(52)
    base = [" ".join(prose(rng, rng.randrange(9, 14)) + "." for _ in range(5)) for _ in range(3)]
    rows = [(k, "\n".join([prose(rng, 12), edited(rng, base[k % 3], 0.006 * (k % 7)), prose(rng, 11)])) for k in range(42)]
    rows += [(100 + k, f"{base[0]} {prose(rng, 3)} {base[0]}") for k in range(3)]
    rows += [(200, "ha " * 40), (201, "ha " * 25), (202, "one two three four five six " * 9), (203, f"{'ha ' * 12}{base[1]}")]
    places = [(i, s, e, neardup.shingles(t[s:e])) for i, t in rows for s, e in paragraphs.paragraphs(t)]
    label = {p[:3]: p[:3] for p in places}
    links = [(a[:3], b[:3]) for k, a in enumerate(places) for b in places[:k] if neardup.linked(a[3], b[3], 80)]
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    several = {v for k, v in label.items() if k[0] != v[0] or k[1] >= v[2]}
    got = {(r["doc_id"], r["start"], r["end"]): (r["cluster_doc_id"], r["cluster_start"]) for r in paragraphs.clusters(docs_of(rows)).collect()}
    assert got == {k: v[:2] for k, v in label.items() if v in several} and len(got) > 200


def test_buckets_of_paragraph_keys_against_a_plain_version(docs_of):
    rng = random.Random(41)
    words = [f"w{i}" for i in range(400)]
    sentence = lambda n: " ".join(rng.choices(words, k=n)) + "."
    shared = [sentence(rng.randint(10, 30)) for _ in range(12)]
    docs = [(i, " ".join(rng.choice([sentence(14), rng.choice(shared), rng.choice(shared).replace("w1", "v", 1)]) for _ in range(6))) for i in range(60)]
    rows = paragraphs.sketched_paragraphs(docs_of(docs)).cache()
    all_rows = rows.collect()
    # a key takes 14 bytes of the exchange, whatever it belongs to
    sent = paragraphs.dealt_keys(rows).agg(F.sum(F.octet_length("entries"))).first()[0]
    assert sent == 14 * sum(len(r.bands) for r in all_rows) > 0
    sets, of_text, again = defaultdict(set), defaultdict(lambda: defaultdict(set)), defaultdict(bool)
    for r in all_rows:
        for band in r.bands:
            sets[band].add(bytes(r.set_key))
            of_text[band][r.text_key].add(bytes(r.set_key))
            again[band] |= r.again
    met = {frozenset(s) for band, s in sets.items() if len(s) > 1}
    # buckets of which one text holds all sets need not be there
    needed = {frozenset(s) for band, s in sets.items() if len(s) > 1 and (again[band] or s not in of_text[band].values())}
    got = defaultdict(set)
    for r in paragraphs.bucket_members(rows).collect():
        got[bytes(r.band)].add((bytes(r.set_key), bytes(r.hub), r.members))
    found = {frozenset(k for k, _, _ in b) for b in got.values()}
    assert len(found) == len(got) > 10                                   # the same members once
    assert all(len({(h, n) for _, h, n in b}) == 1 and len(b) == min(b)[2] and min(b)[1] in {k for k, _, _ in b} for b in got.values())
    assert needed <= found <= met and needed
    rows.unpersist()


def test_sets_of_a_crowded_bucket_are_listed_in_rows_of_bounded_size(monkeypatch):
    monkeypatch.setattr(paragraphs, "LISTED", 3)
    entries = np.zeros(9, paragraphs.KEY_ENTRY)
    entries["key"] = [5 << 16 | i % 2 for i in range(8)] + [6 << 16]
    entries["low"], entries["high"] = np.arange(9), 7
    rows = paragraphs.buckets_of([entries[:4].tobytes(), entries[4:].tobytes()]).to_pylist()
    assert [(r["part"], r["members"], len(r["sets"])) for r in rows] == [(0, 8, 3), (1, 8, 3), (2, 8, 2)]
    assert len({r["name"] for r in rows}) == 1 and [int.from_bytes(m[:4], "little") for r in rows for m in r["sets"]] == list(range(8))
    one_text = np.zeros(2, paragraphs.KEY_ENTRY)
    one_text["key"], one_text["low"] = 5 << 16, [1, 2]
    assert paragraphs.buckets_of([one_text.tobytes()]).num_rows == 0
    one_text["key"] |= paragraphs.SOME_TEXT
    assert paragraphs.buckets_of([one_text.tobytes()]).num_rows == 1


def test_shuffle_files_are_deleted_when_a_table_is_stored(spark):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    before, setting = files(), spark.conf.get(FREE_SHUFFLES, None)
    out = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert files() <= before and spark.conf.get(FREE_SHUFFLES, None) == setting
    assert out.agg(F.sum("count")).first()[0] == 1000


def test_every_word_lies_in_a_paragraph():
    rng = random.Random(13)
    for n in range(10, 120):
        text = "".join(w + rng.choice([" ", " ", " ", ". ", "\n", "! "]) for w in prose(rng, n).split())
        inside = np.zeros(len(text), bool)
        for s, e in paragraphs.paragraphs(text):
            inside[s:e] = True
            assert len(text[s:e].split()) >= 10
        assert all(inside[i] or c in " \n.!" for i, c in enumerate(text))


# ---- substrings

def plain_cut(rows, length=100):
    """By definition, over rows in order."""
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if b[s:s + length] in seen:
                gone[s:s + length] = True
            else:
                seen.add(b[s:s + length])
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def substring_rows():
    rng = random.Random(6)
    passage, line = prose(rng, 90), prose(rng, 22)
    rows = [(k, prose(rng, 40) + " " + (passage[k:] if k % 2 else passage[:-k or None]) + "\n" + line + "\n" + prose(rng, 40)) for k in range(30)]
    rows += [(40, "a" * 350), (41, "ab" * 200), (42, "a" * 99), (43, "a" * 100), (44, None), (45, ""), (46, "é" * 120), (47, "xé" * 90 + passage),
             (48, passage + passage), (60, rows[0][1]), (61, rows[0][1]), (62, "tail " + rows[0][1])]
    return rows


@pytest.mark.parametrize("hot, pack, piece", [(50_000, 2 << 20, 1 << 19), (1, 3000, 1 << 8)])
def test_repeated_substrings(docs_of, monkeypatch, hot, pack, piece):
    """Whole, and with tiny packs, ranges and pieces and every repeated anchor hot."""
    monkeypatch.setattr(suffixes, "PACK_BYTES", pack)
    monkeypatch.setattr(suffixes, "RANGE_BYTES", pack * 4)
    monkeypatch.setattr(suffixes, "CHUNK", piece)
    rows = substring_rows()
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["text"]).hexdigest())
                 for r in suffixes.cut_repeats(docs_of(rows), hot).collect())
    assert got == plain_cut(rows)


def test_repeated_substrings_odd_rows(docs_of):
    text = "x1 " * 60
    got = suffixes.digest(docs_of([(5, text), (5, text), (None, text)])).collect()
    whole = [r for r in got if r["n_removed"] == len(text)]
    assert len(got) == 3 and len(whole) == 2 and [r["doc_id"] for r in got if r["n_removed"] < len(text)] == [None]
    assert suffixes.digest(docs_of([(1, text)]).where("false")).count() == 0


def test_many_hash_ranges(docs_of, small_rows, monkeypatch):
    """Hundreds of ranges and more than ten packs: nothing stays in, and no range gets much more than others."""
    monkeypatch.setattr(suffixes, "PACK_BYTES", 1 << 15)
    monkeypatch.setattr(suffixes, "RANGE_BYTES", 1 << 10)
    packs = suffixes.packed(docs_of(small_rows))
    n_ranges = -(-packs.agg(F.sum("size")).first()[0] // suffixes.RANGE_BYTES)
    assert packs.count() > 10 and n_ranges > 300
    sent = defaultdict(int)
    for r in suffixes.anchors(packs, n_ranges).select("range", F.octet_length("hashes").alias("n")).collect():
        sent[r["range"]] += r["n"] // 8
    median = sorted(sent.values())[len(sent) // 2]
    assert len(sent) > 0.9 * n_ranges and max(sent.values()) < 6 * median
    texts = {i: (t or "").encode() for i, t in small_rows}
    first, expected = {}, {}
    for i in sorted(texts):
        gone = bytearray(len(texts[i]))
        for k in range(len(texts[i]) - 99):
            if first.setdefault(texts[i][k:k + 100], (i, k)) != (i, k):
                gone[k:k + 100] = b"\1" * 100
        expected[i] = hashlib.sha256(bytes(b for b, g in zip(texts[i], gone) if not g)).hexdigest()
    assert {r["doc_id"]: r["kept_sha256"] for r in suffixes.digest(docs_of(small_rows)).collect()} == expected


def test_ranges_have_to_be_sorted():
    with pytest.raises(ValueError):
        list(suffixes.by_range(np.array([2, 1])))


def test_a_line_in_a_third_of_the_documents(docs_of):
    """One anchor with a different segment in each of many documents is dealt out over many ranges, at production values."""
    rng = random.Random(8)
    line = prose(rng, 40)[:90]
    around = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=75))
    rows = [(k, around() + line + around() if k % 3 == 0 else around()[:12]) for k in range(66_000)]
    rows += [(70_000 + k, "again " + rows[3 * k][1]) for k in range(5)]
    packs = suffixes.packed(docs_of(rows))
    known, n_ranges = suffixes.dealt(packs)
    load = defaultdict(int)
    for r in suffixes.sent_segments(known, n_ranges).select("range", "numbers").collect():
        numbers = np.frombuffer(suffixes.zstandard.decompress(r["numbers"]), np.int64)
        load[r["range"]] += int(numbers.reshape(6, -1)[0].sum())
    assert len(load) > 10 and max(load.values()) < 1.5 * suffixes.RANGE_BYTES
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffixes.cut_repeats(docs_of(rows)).drop("text").collect()}
    assert len(got) == len(rows) and {i for i, g in got.items() if g[1]} == set(range(70_000, 70_005))
    assert all(got[70_000 + k][1:] == (240, 1) for k in range(5))


def test_repeated_substrings_of_late_partitions_and_empty_documents(docs_of, monkeypatch):
    """Pack numbers as in an input of very many splits; packs also end at a number of documents."""
    monkeypatch.setattr(suffixes, "PACK_BYTES", 3000)
    monkeypatch.setattr(suffixes, "PACK_DOCS", 4)
    rows = substring_rows() + [(100 + k, "") for k in range(30)]
    packs = suffixes.packed(docs_of(rows, 1))
    assert packs.count() >= len(rows) / 4
    late = packs.withColumn("pack", F.col("pack") + F.lit(1_000_000 << 32))
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["text"]).hexdigest())
                 for r in suffixes.cut_packs(late).collect())
    assert got == plain_cut(rows)


@pytest.mark.parametrize("letters", [1, 2, 3, 26])
def test_suffix_order(letters):
    rng = np.random.default_rng(letters)
    for n in [0, 1, 2, 3, 4, 5, 6, 7, *rng.integers(8, 500, 25).tolist()]:
        raw = rng.integers(97, 97 + letters, n, dtype=np.uint8)
        text = raw.tobytes()
        for length in (100, 10 ** 9):
            order = suffixes.suffix_order(raw.astype(np.int64) + 1, length).tolist()
            cut = [text[i:i + length] for i in order]
            assert sorted(order) == list(range(n)) and cut == sorted(cut)


# ---- fingerprints

def test_fingerprints(docs_of, small_rows):
    rows = [(i * 3, t) for i, t in small_rows] + [(10_000, None), (10_001, ""), (10_002, "ä b"), (10_003, "one two three four five six"),
                                                  (10_003, "one two three four five six"), (10_004, "ONE two three four five six"), (None, "first row")]
    got = fingerprints.fingerprints(docs_of(rows)).collect()
    assert len(got) == len(rows)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected = defaultdict(list)
    for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1]):
        t, n = t or "", n or ""
        half = len(t) // 2
        expected[i].append(hashlib.sha256((t[:len(t) - half] + n[:half]).encode()).hexdigest())
    have = defaultdict(list)
    for r in got:
        have[r["doc_id"]].append(r["edited_sha256"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in expected.items()}
    by_text = defaultdict(set)
    texts = {i: t for i, t in rows}
    for r in got:
        by_text[(texts[r["doc_id"]] or "").lower()].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert {r["fingerprint"] for r in got if r["doc_id"] in (10_000, 10_001)} == {""}
    long = [r for r in got if r["n_chars"] > 1500]
    assert np.mean([r["near_edited"] for r in long]) > 0.35 > 0.1 > np.mean([r["near_next"] for r in long])
    assert fingerprints.fingerprints(docs_of([(1, "x")]).where("false")).count() == 0


def plain_sketch(text):
    """The sketch by itself: chained XXH64 of five words, those in the lowest quarter, as signed numbers."""
    import xxhash
    words = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    found = set()
    for k in range(len(words) - 4):
        h = 42
        for w in words[k:k + 5]:
            h = xxhash.xxh64_intdigest(w, seed=h)
        found.add(h)
    if 0 < len(words) < 5:
        found = {xxhash.xxh64_intdigest(b" ".join(words), seed=42)}
    return {h for h in (x - (1 << 64) if x >> 63 else x for x in found) if h < -(1 << 63) + (1 << 62)}


def test_sketches_and_likeness_against_a_plain_version(docs_of, small_rows):
    rows = [*small_rows, (100_001, None), (100_002, ""), (100_003, "a b c"), (100_004, "A  b\tc"), (100_005, "word " * 60_000), (100_006, "x" * 300_000)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs_of(rows)).collect()}
    order = sorted(rows)
    shown = lambda s: ",".join(f"{h & (1 << 64) - 1:016x}" for h in sorted(s)).upper()

    def near(a, b, same):
        least = min(len(a), len(b))
        return len(a & b) / least if least else float(not a and not b and same)

    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        own, new, other = plain_sketch(text), plain_sketch(edited), plain_sketch(after)
        r = got[i]
        assert r["fingerprint"].upper() == shown(own) and r["edited_fingerprint"].upper() == shown(new), i
        assert abs(r["near_edited"] - near(own, new, text == edited)) < 1e-12 and abs(r["near_next"] - near(own, other, text == after)) < 1e-12, i


def test_containment_of_unequal_documents(spark):
    rng = random.Random(1)
    whole = prose(rng, 4000)
    df = spark.createDataFrame([(whole, " ".join(whole.split()[:400]))], "a string, b string")
    df = fingerprints.with_sketch(fingerprints.with_sketch(df, "a", "x"), "b", "y")
    r = df.select(fingerprints.near("x", "y", F.lit(False)).alias("c"), fingerprints.resemblance("x", "y", F.lit(False)).alias("j")).first()
    assert r["c"] == 1.0 and r["j"] == pytest.approx(0.1, abs=0.04)


# ---- neighbours

def plain_nearest(rows, k=5):
    out = {}
    for i, v in rows:
        if i % 50 == 0:
            a = np.array(v, float)
            scores = [(-float(a @ np.array(w)) / (np.linalg.norm(a) * np.linalg.norm(w)), j) for j, w in rows if j != i and len(w) == len(v)]
            out[i] = [j for _, j in sorted(scores)[:k]]
    return out


def test_nearest_recall(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = defaultdict(list)
    for r in neighbours.nearest(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"), F.col("id") % 50 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    expected = plain_nearest(rows)
    assert set(got) == set(expected) and all([n for n, _ in sorted(g)] == [1, 2, 3, 4, 5] for g in got.values())
    hits = sum(len({v for _, v in got[i]} & set(e)) for i, e in expected.items())
    assert hits >= 0.9 * 5 * len(expected)


def test_nearest_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 40)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 3)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 300)]                       # one crowded vector
    rows += [(400, [0.0, 0.0, 0.0]), (450, None), (500, [1.0, nan, 0.0]), (550, [inf, 1.0, 0.0]), (600, [1.0, None, 0.0]), (650, []),
             (None, [1.0, 2.0, 3.0]), (700, [1.0, 1.0]), (750, [1.0, 1.0, 1.0]), (0, [1.0, 2.0, 3.0]), (801, [-1.0, -2.0, -3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "v", "score", "block")})
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {0, 50, 100, 150, 200, 250, 750}                        # 700 has no other of its length
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[50]] == [0, 1, 2, 3, 4]
    assert all(s == pytest.approx(1.0) for _, s in got[100])
    assert neighbours.nearest(df.where("false"), F.col("id") % 50 == 0).count() == 0


def test_nearest_of_few_and_far_vectors(spark):
    """Every query gets all candidates where there are fewer than asked for, also those that no bucket leads to."""
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for count in range(2, 7):
        for copy in range(3):
            dim = 60 + 3 * count + copy                        # compared within their length only
            basis = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
            vectors = [basis[0], -basis[0], *basis[1:]][:count] if copy else basis[:count]
            rows += [(n + k, v.tolist()) for k, v in enumerate(vectors)]
            n += 10
    got = defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") >= 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    by_table = defaultdict(dict)
    for i, v in rows:
        by_table[len(v)][i] = np.array(v)
    for table in by_table.values():
        for i, v in table.items():
            found = sorted(got[i])
            assert [rank for rank, _, _ in found] == list(range(1, len(table))) and {j for _, j, _ in found} == set(table) - {i}
            assert all(score == pytest.approx(float(v @ table[j]), abs=1e-9) for _, j, score in found)


def test_buckets_are_visited_by_estimated_success():
    rng = np.random.default_rng(2)
    unit = rng.normal(size=(500, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    tables = neighbours.Tables(unit)
    assert all(i in tables.candidates(unit[i]) for i in range(0, 500, 25))
    found = neighbours.search_block(pd.DataFrame({"v": list(unit), "ids": [[i] for i in range(500)]}),
                                    pd.DataFrame({"query": [7], "v": [unit[7]]}), 3)
    assert found["id"][0] == 7 and found["score"][0] == pytest.approx(1.0)
