"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.llm import (bitplanes, fingerprints, mixing, neardup, neighbours, packing, paragraphs, prefixes, quality, secrets,
                       simhash, suffixes, toxicity)
from tally.llm.common import checksum_split, table

Builder = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.clusters(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), checksum_split() % 5 == 0
    model = quality.train_model(docs, table(spark, sf_dir, "labels"), ~held_out)
    return (quality.score(docs, model)
            .select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), checksum_split() % 4 == 2
    grammar = toxicity.train_grammar(docs, table(spark, sf_dir, "labels"), ~held_out)
    return (toxicity.score(docs, grammar)
            .select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted")))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.cluster(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Builder]:
    return {f.__name__: f for f in (
        op1_secret_scan, op2_neighbours, op3_near_duplicates, op4_paragraphs, op5_suffix_dedup, op6_packing, op7_mixing,
        op8_fingerprints, op9_quality, op10_toxicity, op11_simhash, op12_centroids, op13_prefix_trie, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op3_near_duplicates": neardup.ORACLE_SQL, "op7_mixing": mixing.ORACLE_SQL, "op12_centroids": bitplanes.ORACLE_SQL,
            "op13_prefix_trie": prefixes.ORACLE_SQL}
