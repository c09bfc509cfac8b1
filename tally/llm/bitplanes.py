"""Centroid clustering of vectors by bit-plane popcounts.

A vector takes part if it has exactly ``PARTS`` components, none null or non-finite; its
components become the integers ``floor(SCALE * x)``. In two's complement bit ``b`` of
all 64 components is one bit plane, packed into one unsigned 64-bit number, with the weight
``2 ** b`` (the sign plane's is negative). The dot product of two vectors is then the sum over
all pairs of planes of their weights times the popcount of the AND of the two planes, exact in
64-bit integers, and the squared distance is ``x.x - 2 x.c + c.c``.

The centroids start as the vectors with the smallest SHA-256 of ``1:<vec_id>``. In each of ``ROUNDS`` rounds
every task assigns its vectors and sums up each centroid's components (from the planes);
the sums of all tasks, 64 numbers a centroid, are added up and the centroid becomes
their exact mean, rounded down. An empty centroid stays. Nothing else reaches the driver.

Planes are written once and read in every round; a task holds ``ROWS`` vectors at a time.

Ties go to the smaller centroid number. Rows that share an id are vectors of their own (where their hashes
tie, the smaller components come first); a null id is hashed as empty text. With fewer than
``k`` vectors there are as many centroids as vectors; without vectors the result is empty.
Components of 2 ** 27 or more in size, whose squared distances would not fit in 64 bits, are
an error. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import stored

PARTS, SCALE = 64, 64
K, ROUNDS = 16, 3
ROWS = 4096
LARGEST = 1 << 27
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


# ---- planes ------------------------------------------------------------------------------------------------------

def planes_of(vectors: np.ndarray) -> np.ndarray:
    """(n, planes) bit planes of (n, 64) integers, the sign plane last; as few as the largest needs."""
    if vectors.size and int(np.abs(vectors).max()) >= LARGEST:
        raise ValueError(f"a component times {SCALE} is {LARGEST} or more in size")
    top = int(np.where(vectors < 0, ~vectors, vectors).max(initial=0)).bit_length() + 1
    bits = (vectors[:, None, :] >> np.arange(top)[None, :, None] & 1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")[:, :, 0]


def widened(planes: np.ndarray, to: int) -> np.ndarray:
    """The same numbers in ``to`` planes: the sign plane is repeated."""
    return np.concatenate([planes, np.repeat(planes[:, -1:], to - planes.shape[1], axis=1)], axis=1)


def weights(n: int) -> np.ndarray:
    w = np.int64(1) << np.arange(n, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(n, k) dot products of vectors given by their planes."""
    out = np.zeros((len(a), len(b)), np.int64)
    for i, wa in enumerate(weights(a.shape[1]).tolist()):
        for j, wb in enumerate(weights(b.shape[1]).tolist()):
            out += np.bitwise_count(a[:, None, i] & b[None, :, j]).astype(np.int64) * (wa * wb)
    return out


def squares(a: np.ndarray) -> np.ndarray:
    """Every vector's dot product with itself."""
    w = weights(a.shape[1])
    return (np.bitwise_count(a[:, :, None] & a[:, None, :]).astype(np.int64) * np.outer(w, w)).sum((1, 2))


def assigned(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every vector (ties: the smaller number) and the squared distance."""
    distance = squares(planes)[:, None] - 2 * dots(planes, centroids) + squares(centroids)[None, :]
    cluster = distance.argmin(1)
    return cluster, distance[np.arange(len(planes)), cluster]


def sums(planes: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """(k, 64) sums of the components of each cluster's vectors."""
    member = (cluster[None, :] == np.arange(k)[:, None]).astype(np.float32)   # counts below 2 ** 24 are exact
    out = np.zeros((k, PARTS), np.int64)
    for i, w in enumerate(weights(planes.shape[1]).tolist()):
        bits = np.unpackbits(planes[:, i:i + 1].copy().view(np.uint8), axis=1, bitorder="little")
        out += (member @ bits.astype(np.float32)).astype(np.int64) * w
    return out


# ---- over tables -------------------------------------------------------------------------------------------------

def integer_vectors(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """vec_id, v (array<long>) of the rows that take part."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.select(F.col(ident).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
            .where((F.size("v") == PARTS) & ~bad)
            .select("vec_id", F.transform("v", lambda x: F.floor(x * SCALE).cast("long")).alias("v")))


def packed(vectors: DataFrame) -> DataFrame:
    """vec_id, planes (8 bytes each)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                planes = planes_of(part.column("v").flatten().to_numpy().reshape(-1, PARTS))
                ends = np.arange(len(planes) + 1, dtype=np.int32) * planes.shape[1] * 8
                blob = pa.Array.from_buffers(pa.binary(), len(planes), [None, pa.py_buffer(ends), pa.py_buffer(planes.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), blob], names=["vec_id", "planes"])

    return vectors.mapInArrow(run, "vec_id long, planes binary")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and planes of up to ``ROWS`` vectors at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            blobs = part.column("planes").to_pylist()
            sizes = set(map(len, blobs))
            if len(sizes) == 1:
                yield part.column("vec_id"), np.frombuffer(b"".join(blobs), "<u8").reshape(len(blobs), -1)
            else:
                most = max(sizes) // 8
                yield part.column("vec_id"), np.concatenate([widened(np.frombuffer(x, "<u8")[None, :], most) for x in blobs])


def next_centroids(planes: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The mean of each centroid's vectors, rounded down; a centroid without vectors as it was."""
    coded, k = planes_of(centroids), len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, PARTS), np.int64), np.zeros(k, np.int64)
        for _, x in slices(batches):
            cluster, _ = assigned(x, coded)
            total += sums(x, cluster, k)
            n += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(some, PARTS), pa.int32()), pa.array(np.tile(np.arange(PARTS), len(some)), pa.int32()),
             pa.array(total[some].ravel()), pa.array(np.repeat(n[some], PARTS))], names=["cluster", "part", "total", "n"])

    rows = (planes.mapInArrow(run, "cluster int, part int, total long, n long").groupBy("cluster", "part")
            .agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect())   # 64 rows a centroid
    out = centroids.copy()
    for r in rows:
        out[r["cluster"], r["part"]] = r["total"] // r["n"]
    return out


def assignments(planes: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance."""
    coded = planes_of(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in slices(batches):
            cluster, distance = assigned(x, coded)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return planes.mapInArrow(run, "vec_id long, cluster int, distance long")


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest hashes."""
    mark = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(mark.alias("mark"), "v").orderBy("mark", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, PARTS)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector that takes part: its cluster, squared distance, the cluster's and the whole inertia, and
    the SHA-256 of its final centroid."""
    spark, whole = vectors.sparkSession, integer_vectors(vectors, ident, vector)
    centroids = first_centroids(whole, k)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    planes = stored(packed(whole))
    for _ in range(rounds):
        centroids = next_centroids(planes, centroids)
    found = stored(assignments(planes, centroids))
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}   # a row a centroid
    text = lambda c: ",".join(map(str, centroids[c].tolist()))
    about = spark.createDataFrame([(c, s, sum(inertia.values()), hashlib.sha256(text(c).encode()).hexdigest()) for c, s in inertia.items()],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(n: int) -> str:
    """CTEs a{n} (the assignment to c{n}) and c{n + 1} (its means)."""
    return f"""
a{n} AS MATERIALIZED (
  SELECT r, c, d FROM (
    SELECT k.r, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
    FROM kept k CROSS JOIN c{n} c)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1),
s{n} AS (
  SELECT c, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n
  FROM (SELECT a.c, generate_subscripts(k.v, 1) AS i, unnest(k.v) AS x FROM a{n} a JOIN kept k ON a.r = k.r) GROUP BY c, i),
c{n + 1} AS MATERIALIZED (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{n} GROUP BY c
  UNION ALL SELECT c, v FROM c{n} WHERE c NOT IN (SELECT c FROM a{n}))"""


#: The same clustering by plain distances.
ORACLE_SQL = f"""
WITH rows_in AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = {PARTS}),
kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, e) AS r, vec_id, list_transform(e, lambda x: floor({SCALE} * x)::BIGINT) AS v
  FROM rows_in WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM kept QUALIFY c < {K}),
{",".join(_round(n) for n in range(ROUNDS + 1))}
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
  sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN kept k ON a.r = k.r JOIN c{ROUNDS} c ON a.c = c.c
"""
