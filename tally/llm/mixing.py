"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash. Sizes are summed by source and leading hash
bits; the bucket in which a source's budget ends is the only one that is looked
at again, with the next bits, until all 60 are used. The result is one hash
threshold per source: documents below it are taken once more than those above,
without any sort of the documents. Ordering by hash makes budgets nested: a
smaller budget takes a subset.

Budget of a source: all sizes together, shared by weights 1, 2, 3, 1, 2, 3, ...
over the sources by code point (null last), at most ``MAX_REPEATS`` times the
source's own size, the excess shared again by weight among the others.

The document at the threshold is taken in part, so each source takes its target
rounded to a whole word. Rows with equal hash (repeated rows) share that
part by size. Null texts have size 0; a null ``doc_id`` is hashed like an empty
one (the text is hashed too, so such rows still differ); a null source is a
source of its own. Other columns are ignored by ``mix``; ``apply_mix`` keeps
them. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import WORD, partitions, stored, text_or_empty
from tally.operators.positions import POS, global_positions

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BITS, LEVELS = 12, 5  # 60 bits in all
SOURCE_BOUND = 10_000  # sources that one task ranks and adds up


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def hash60(doc_id: Column, text: Column) -> Column:
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), text).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source (src, source): source_size, target. ``sizes``: src, source, size.

    Sources are ranked by code point and the shares filled up to their caps. Up to
    ``SOURCE_BOUND`` sources one task does that; above it they are sorted by ranges, with
    offsets from the sums of each partition.
    """
    per = stored(sizes.groupBy("src", "source").agg(F.sum("size").alias("source_size")))
    few = per.count() <= SOURCE_BOUND
    if few:
        ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    else:
        ranked = (global_positions(per, [F.col("source").asc_nulls_last()], partitions(sizes.sparkSession))
                  .select("src", "source", "source_size", F.col(POS).alias("rank")))
    weighted = (ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)),
                                                         (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("long"))
                .withColumn("cap", F.lit(MAX_REPEATS).cast("long") * F.col("source_size")))
    # sources in the order in which they reach their cap when the level (words per weight) rises
    order = [(F.col("cap") / F.col("weight")).asc(), F.col("rank").asc()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if not few:
        return many_targets(weighted, order)
    whole = Window.partitionBy(F.lit(1))
    level = ((F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
             / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    levels = weighted.withColumn("level", level)
    free = F.col("cap") / F.col("weight") >= F.col("level")
    # the first source that stays under its cap fixes the level of all that follow
    fixed = levels.withColumn("fixed", F.min(F.when(free, F.struct((F.col("cap") / F.col("weight")).alias("o"),
                                                                   F.col("rank"), F.col("level")))).over(whole))
    free_now = F.coalesce(F.struct((F.col("cap") / F.col("weight")).alias("o"), F.col("rank"))
                          >= F.struct(F.col("fixed.o").alias("o"), F.col("fixed.rank").alias("rank")), F.lit(False))
    return fixed.select("src", "source", "source_size",
                        F.when(free_now, F.col("fixed.level") * F.col("weight"))
                        .otherwise(F.col("cap").cast("double")).alias("target"))


def many_targets(weighted: DataFrame, order: list[Column]) -> DataFrame:
    """The same without a window over all sources."""
    rows = stored(weighted.repartitionByRange(partitions(weighted.sparkSession), *order).withColumn("part", F.spark_partition_id()))
    sums = rows.groupBy("part").agg(F.sum("cap").alias("part_cap"), F.sum("weight").alias("part_weight"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)   # a row for each partition
    offsets = sums.select("part", *(F.coalesce(F.sum(f"part_{c}").over(earlier), F.lit(0)).alias(f"{c}_offset") for c in ("cap", "weight")))
    total = rows.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"))
    here = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = {c: F.col(f"{c}_offset") + F.coalesce(F.sum(c).over(here), F.lit(0)) for c in ("cap", "weight")}
    levels = stored(rows.join(offsets, "part").crossJoin(F.broadcast(total))
                    .withColumns({"cap_before": before["cap"], "weight_before": before["weight"]})
                    .withColumn("o", F.col("cap") / F.col("weight"))
                    .withColumn("level", (F.col("words") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")))
                    .select("src", "source", "source_size", "cap", "weight", "o", "rank", "level"))
    fixed = levels.where(F.col("o") >= F.col("level")).agg(F.min(F.struct("o", "rank", "level")).alias("fixed"))
    free = F.coalesce(F.struct("o", "rank") >= F.struct(F.col("fixed.o").alias("o"), F.col("fixed.rank").alias("rank")), F.lit(False))
    return (levels.crossJoin(F.broadcast(fixed))
            .select("src", "source", "source_size", F.when(free, F.col("fixed.level") * F.col("weight"))
                    .otherwise(F.col("cap").cast("double")).alias("target")))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """One row per source: src, copies, cut (60-bit hash), left, unit.

    Every document is taken ``copies`` times, those with a hash under ``cut``
    once more, and ``left`` words of the ``unit`` words whose hash is ``cut``.
    """
    budget = F.round("target").cast("long")
    safe = F.greatest(F.col("source_size"), F.lit(1))
    edge = goals.select("src", F.floor(budget / safe).cast("long").alias("copies"),
                        (budget - F.floor(budget / safe).cast("long") * safe).alias("left"), F.lit(0).cast("long").alias("cut"),
                        F.lit(0).cast("long").alias("unit"))
    inside = rows.select("src", "size", "hash")
    for level in range(1, LEVELS + 1):
        bucket = F.shiftright("hash", (LEVELS - level) * BITS)
        sums = (inside.withColumn("bucket", bucket).groupBy("src", "bucket").agg(F.sum("size").alias("words"))
                .join(edge, "src"))
        upto = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        edge = (sums.withColumn("upto", F.sum("words").over(upto))
                .where(F.col("upto") > F.col("left"))
                .groupBy("src").agg(F.min(F.struct("bucket", "upto", "words", "left", "copies")).alias("b"))
                .select("src", F.col("b.copies").alias("copies"),
                        (F.col("b.left") - F.col("b.upto") + F.col("b.words")).alias("left"),
                        F.col("b.bucket").alias("cut"), F.col("b.words").alias("unit")))
        edge = stored(edge)
        if level < LEVELS:
            inside = (rows.join(edge.select("src", "cut"), "src")
                      .where(F.shiftright("hash", (LEVELS - level) * BITS) == F.col("cut")).select("src", "size", "hash"))
    return edge


def mixed(docs: DataFrame) -> DataFrame:
    """(doc_id, text hash, size, source_size, target, copies, extra) of every row."""
    text = text_or_empty()
    rows = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("src"),
        size_of(text).alias("size"), hash60(F.col("doc_id"), text).alias("hash")))
    goals = stored(targets(rows))
    cuts = thresholds(rows, goals)
    # a source without words has no threshold: nothing of it is taken
    return (rows.join(goals.select("src", "source_size", "target").join(cuts, "src", "left"), "src")
            .withColumn("copies", F.coalesce("copies", F.lit(0).cast("long")))
            .withColumn("extra", F.when(F.col("hash") < F.col("cut"), F.col("size"))
                        .when(F.col("hash") == F.col("cut"), F.floor(F.col("left") * F.col("size") / F.col("unit")))
                        .otherwise(F.lit(0)).cast("long")))


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    return mixed(docs).select("doc_id", "size", "source_size", "target",
                              (F.col("copies") * F.col("size") + F.col("extra")).alias("taken"))


def apply_mix(docs: DataFrame) -> DataFrame:
    """``docs`` with each document as often as the mix takes it, whole documents only.

    The document at the threshold is taken when at least half of it is due.
    A document without words goes with its hash like any other; those of a source
    without any words are kept once, as there is nothing to weigh.
    """
    text = text_or_empty()
    src = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    rows = stored(docs.select(src.alias("src"), F.col("source").cast("string").alias("source"),
                              size_of(text).alias("size"), hash60(F.col("doc_id"), text).alias("hash")))
    cuts = thresholds(rows, stored(targets(rows))).select(
        F.col("src").alias("_mix_src"), F.col("copies").alias("_mix_copies"), F.col("cut").alias("_mix_cut"),
        (2 * F.col("left") >= F.col("unit")).alias("_mix_edge"))
    keyed = docs.withColumn("_mix_src", src).withColumn("_mix_hash", hash60(F.col("doc_id"), text))
    times = F.when(F.col("_mix_copies").isNull(), 1).otherwise(F.col("_mix_copies") + F.when((F.col("_mix_hash") < F.col("_mix_cut"))
                                           | ((F.col("_mix_hash") == F.col("_mix_cut")) & F.col("_mix_edge")), 1)
             .otherwise(0)).cast("int")
    return (keyed.join(cuts, "_mix_src", "left").withColumn("_mix_times", times).where("_mix_times > 0")
            .withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(0), F.col("_mix_times"))))
            .select(*[f"`{c}`" for c in docs.columns]))


ORACLE_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS hash
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rk, 3 * source_size AS cap FROM per),
weighted AS (SELECT *, 1 + rk % 3 AS weight, (cap::DOUBLE / (1 + rk % 3)) AS o FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM weighted WINDOW w AS (ORDER BY o, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first_free AS (SELECT o, rk, level FROM levels WHERE o >= level ORDER BY o, rk LIMIT 1),
goals AS (
  SELECT l.source, l.source_size,
         CASE WHEN (l.o, l.rk) >= (f.o, f.rk) THEN f.level * l.weight ELSE l.cap::DOUBLE END AS target
  FROM levels l LEFT JOIN first_free f ON true),
budget AS (SELECT *, round(target)::BIGINT AS b, greatest(source_size, 1) AS safe FROM goals),
taken AS (
  SELECT r.doc_id, r.size, g.source_size, g.target, r.hash, g.b // g.safe AS copies, g.b % g.safe AS left_over,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.hash) AS upto, sum(r.size) OVER (PARTITION BY r.source, r.hash) AS unit
  FROM rows r JOIN budget g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (copies * size + CASE WHEN upto <= left_over THEN size WHEN upto - unit >= left_over THEN 0
     ELSE floor((left_over - (upto - unit)) * size / unit) END)::BIGINT AS taken
FROM taken
"""
