"""Connected components of links between ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import joined_on_hot, stored


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first()
    return tuple(r)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): every id in a link with the smallest id it is connected to.

    Large star: each node links its larger neighbours to the smallest id it
    knows; small star: each node links its smaller neighbours to the smallest.
    Both keep what is connected and the number of links does not grow; the
    rounds, logarithmic in practice, end when nothing changes. Smallest
    neighbours are found before the shuffle and joined back without an exchange for nodes with
    very many links (``joined_on_hot``). Each round is written.
    Nulls and links of an id to itself are left out.
    """
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a) != F.col(b)).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("v", "u"))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = stored(joined_on_hot(both, least, "u", "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        smallest = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        small = joined_on_hot(large, smallest, "u", "n").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                                                  F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.u", "e.v").where("u != v").distinct())
        now = _state(edges)
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
