"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` tables hashes a vector of length 1 by ``HASHES`` random
Gaussian projections, cut into slots of ``WIDTH``. A query visits its own bucket
and the buckets one slot away in any of the projections, in the order of their
estimated success (the squared distances to the slots that are crossed, summed),
``PROBES`` buckets a table. The candidates of all tables are merged and ranked by
the exact cosine of the original vectors in double precision. A query for which
this finds fewer ids than asked for, though there are more vectors of its length, is compared
with all of them, so every query gets ``k`` neighbours or all there are.

The index is cut by vector into blocks of about ``BLOCK_ROWS`` rows, each with
all its tables, so a crowded bucket is spread over all blocks. Queries are sent to
every block in groups of ``QUERY_ROWS``; a block returns its best few per query
and the best of all blocks stay. Equal vectors are one entry with their smallest
ids, as many as a result can name, so a vector that a third of all rows share is one entry.

Recall is measured in the tests. Vectors of many independent dimensions have no
near neighbours to tell from the rest, so more than half of all buckets have to be
visited for a recall of 0.9; on clustered vectors the same probes visit far fewer rows.

Rows take no part if the id is null or the vector is null, empty, zero or holds
null or non-finite numbers. Rows that repeat id and vector count once; a query's
own id is never its candidate; vectors are compared with those of their own
length only. Extra columns are ignored. Without rows the result is empty.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import stored

TABLES, HASHES, WIDTH, PROBES = 6, 8, 1.5, 2000
BLOCK_ROWS, QUERY_ROWS = 8192, 512
SEED = 20_011
_HALF = np.array(list(product((-1, 0, 1), repeat=HASHES // 2)))
_OFFSETS = np.array(list(product((-1, 0, 1), repeat=HASHES)))
_STEPS = (_OFFSETS << (7 * np.arange(HASHES))).sum(-1)      # what an offset adds to a bucket's code


def usable(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """id, v (array<double>), dim of the rows that take part, each once."""
    v = F.col("v")
    return (vectors.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & (F.size("v") > 0)
                   & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
                   & F.exists(v, lambda x: x != 0)).distinct())


def entries(rows: DataFrame, keep: int) -> DataFrame:
    """v, ids: each distinct vector with its ``keep`` smallest ids."""
    smallest = Window.partitionBy("v").orderBy("id")
    return (rows.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= keep)
            .groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))


class Tables:
    """The tables of one block of unit vectors."""

    def __init__(self, unit: np.ndarray):
        rng = np.random.default_rng(SEED)
        dim = unit.shape[1]
        self.parts = []
        for _ in range(TABLES):
            a, b = rng.normal(size=(dim, HASHES)), rng.uniform(0, WIDTH, HASHES)
            buckets, bucket_of = np.unique(self.code(np.floor((unit @ a + b) / WIDTH).astype(np.int64)), return_inverse=True)
            self.parts.append((a, b, buckets, bucket_of))

    @staticmethod
    def code(slots: np.ndarray) -> np.ndarray:
        return ((slots + 64) << (7 * np.arange(HASHES))).sum(-1)  # slots lie well within -64 to 63

    def candidates(self, query: np.ndarray) -> np.ndarray:
        """Rows of the block in the visited buckets of all tables, each once."""
        found = np.zeros(len(self.parts[0][3]), bool)
        for a, b, buckets, bucket_of in self.parts:
            at = (query @ a + b) / WIDTH
            slot = np.floor(at).astype(np.int64)
            low = at - slot
            cost = np.stack([low * low, np.zeros(HASHES), (1 - low) ** 2], 1)
            halves = [sum(cost[h + k][_HALF[:, k] + 1] for k in range(HASHES // 2)) for h in (0, HASHES // 2)]
            score = np.add.outer(*halves).ravel()            # in the order of _OFFSETS
            visit = np.argpartition(score, PROBES)[:PROBES]
            visit = visit[np.argsort(score[visit], kind="stable")]
            wanted = self.code(slot) + _STEPS[visit]
            k = np.searchsorted(buckets, wanted)
            visited = np.zeros(len(buckets), bool)
            visited[k[(k < len(buckets)) & (buckets[np.minimum(k, len(buckets) - 1)] == wanted)]] = True
            found |= visited[bucket_of]
        return np.flatnonzero(found)


def search_block(index: pd.DataFrame, queries: pd.DataFrame, keep: int, whole: bool = False) -> pd.DataFrame:
    """query, id, score: for each query the block's best candidates, or with ``whole`` the best of all rows, ``keep`` ids at most."""
    out: tuple[list, list, list] = ([], [], [])
    if len(index) and len(queries):
        x, q = np.stack(index["v"].to_numpy()), np.stack(queries["v"].to_numpy())
        # times a power of two, which rounds nothing: no square over- or underflows
        x, q = (a * np.exp2(-np.floor(np.log2(np.abs(a).max(1, keepdims=True)))) for a in (x, q))
        x_norm, q_norm = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
        tables = None if whole else Tables(x / x_norm[:, None])
        ids = index["ids"].to_numpy()
        for i, name in enumerate(queries["query"].tolist()):
            c = tables.candidates(q[i] / q_norm[i]) if tables else np.arange(len(x))
            cosine = (x[c] @ q[i]) / (x_norm[c] * q_norm[i])
            if len(c) > keep:  # all that reach the score of the keep-th
                least = np.partition(cosine, len(c) - keep)[len(c) - keep]
                c, cosine = c[cosine >= least], cosine[cosine >= least]
            best = sorted((-s, int(n)) for s, k in zip(cosine.tolist(), c.tolist()) for n in ids[k])[:keep]
            out[0].extend([name] * len(best))
            out[1].extend(n for _, n in best)
            out[2].extend(-s for s, _ in best)
    return pd.DataFrame({"query": np.array(out[0], np.int64), "id": np.array(out[1], np.int64), "score": np.array(out[2], float)})


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row for which ``is_query`` (over ``id``) holds."""
    keep = k + 1  # one of them may be the query itself
    rows = stored(usable(vectors, ident, vector))
    index = stored(entries(rows, keep))
    asked = rows.where(is_query)
    distinct = stored(asked.groupBy("v").agg(F.min("id").alias("query")))
    blocks = max(1, -(-index.count() // BLOCK_ROWS))
    spread = lambda of, n: F.pmod(F.xxhash64(of), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dim = F.size("v").alias("dim")
    key = ["dim", "block", "part"]

    def best_of(queries: DataFrame, whole: bool) -> DataFrame:
        """query, top: the best ``keep`` found, in order."""
        groups = max(1, -(-queries.count() // QUERY_ROWS))
        left = index.select("v", "ids", dim, spread("v", blocks).cast("int").alias("block"), every(groups).alias("part"))
        right = queries.select("v", "query", dim, spread("query", groups).cast("int").alias("part"), every(blocks).alias("block"))
        found = (left.groupBy(*key).cogroup(right.groupBy(*key))
                 .applyInPandas(lambda x, q: search_block(x, q, keep, whole), "query long, id long, score double"))
        best = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
        return (found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= keep)
                .groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("top")))

    top = stored(best_of(distinct, False))
    there = index.groupBy(dim).agg(F.sum(F.size("ids")).alias("there"))
    short = stored(distinct.withColumn("dim", dim).join(there, "dim").join(top, "query", "left")
                   .where(F.coalesce(F.size("top"), F.lit(0)) < F.least(F.col("there"), F.lit(keep))).select("v", "query"))
    if not short.isEmpty():
        top = top.join(short, "query", "left_anti").union(best_of(short, True))
    own = asked.select("v", F.col("id").alias("query_id")).join(distinct, "v").select("query_id", "query")
    mine = F.slice(F.filter("top", lambda t: t["id"] != F.col("query_id")), 1, k)
    return (own.join(top, "query").select("query_id", F.posexplode(mine).alias("at", "t"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.id").alias("vec_id"),
                    F.col("t.score").alias("score")))
