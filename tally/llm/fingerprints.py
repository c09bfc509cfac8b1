"""Document fingerprints: a threshold-scaled sketch, in DataFrame functions only.

A text's words (A-Z in lower case) give its distinct shingles of five words,
with fewer words the whole sequence. A sketch keeps every shingle hash in the
lowest ``FRACTION`` of the hash range: the sketch of a union is the union of the
sketches, and the share of a sketch that another one holds estimates how much of
the document the other contains, however unequal the two are. A fingerprint is
the sketch as sorted hex numbers.

``near`` is the containment of the smaller sketch in the larger; with one sketch
empty it is 0, with both empty 1 for equal texts and else 0. Null texts count
as empty, whose fingerprint is empty.

``with_next`` gives each row the row that follows in order of ``doc_id`` (null
first; equal ids by text), the last one the first. Ids are cut into ranges at
approximate quantiles; the first rows of a range are also sent to the range
before, so a range is complete in one task and the texts are shuffled once. Rows that share an
id, or have none, lie in one range (ids are taken to be nearly unique), and there are
at most ``MAX_RANGES`` of them. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import partitions, text_or_empty

SHINGLE = 5
FRACTION = 1 / 4
RANGES_PER_PARTITION, MAX_RANGES = 4, 4096
_CUT = int(-(1 << 63) + FRACTION * (1 << 64))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def sketch(word_column: str) -> Column:
    """Sorted distinct shingle hashes under the threshold. The words must be a column of their own."""
    w = F.col(word_column)
    n = F.size(w)

    def shingle(first: Column, i: Column) -> Column:
        return F.xxhash64(first, *(w[i + F.lit(k)] for k in range(1, SHINGLE)))

    hashes = (F.when(n >= SHINGLE, F.transform(F.slice(w, 1, n - (SHINGLE - 1)), shingle))
              .when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<bigint>")))
    return F.sort_array(F.array_distinct(F.filter(hashes, lambda h: h < F.lit(_CUT))))


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    return df.withColumn("_words", words(F.col(text))).withColumn(name, sketch("_words")).drop("_words")


def written(name: str) -> Column:
    """A sketch as text."""
    return F.array_join(F.transform(F.col(name), lambda h: F.lpad(F.hex(h), 16, "0")), ",")


def _shared(a: str, b: str) -> Column:
    return F.size(F.array_intersect(F.col(a), F.col(b)))


def near(a: str, b: str, same_text: Column) -> Column:
    """Containment of the smaller sketch in the larger."""
    least = F.least(F.size(a), F.size(b))
    return (F.when(least > 0, _shared(a, b) / least)
            .when((F.size(a) == 0) & (F.size(b) == 0) & same_text, F.lit(1.0)).otherwise(F.lit(0.0)))


def resemblance(a: str, b: str, same_text: Column) -> Column:
    """Shared part of both sketches together."""
    both = F.size(a) + F.size(b) - _shared(a, b)
    return F.when(both > 0, _shared(a, b) / both).when(same_text, F.lit(1.0)).otherwise(F.lit(0.0))


def with_next(docs: DataFrame, more=None) -> DataFrame:
    """doc_id, text, next_text; ``more`` may add columns from rows that still lie in their range, see ``fingerprints``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    n = min(MAX_RANGES, RANGES_PER_PARTITION * partitions(spark))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    # at most n numbers: the ranges' bounds, then the first id of each range
    cuts = sorted(set(cuts or []))
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    range_of = F.coalesce(F.size(F.filter(bounds, lambda c: c <= F.col("doc_id"))), F.lit(-1))
    ranged = rows.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(range_of))
    firsts = sorted((r["range"], r["first"]) for r in ranged.groupBy("range").agg(F.min("doc_id").alias("first")).collect())
    before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}  # the first range follows the last
    here = F.struct(F.col("range").alias("range"), F.lit(0).alias("guest"))
    null_guest = F.lit(before.pop(None, None)).cast("int")
    known = F.create_map(*[F.lit(x).cast("int" if i % 2 else "bigint") for pair in before.items() for i, x in enumerate(pair)])
    guest = F.when(F.col("doc_id").isNull(), null_guest)
    if before:
        guest = guest.otherwise(F.try_element_at(known, F.coalesce("doc_id", F.lit(0).cast("bigint"))))
    sent = F.filter(F.array(here, F.struct(guest.alias("range"), F.lit(1).alias("guest"))), lambda s: s["range"].isNotNull())
    placed = (rows.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(range_of))
              .withColumn("place", F.explode(sent)).select("doc_id", "text", "place.range", "place.guest"))
    in_order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    out = placed.withColumn("next_text", F.lead("text").over(in_order))
    if more is not None:
        out = more(out, in_order)
    return out.where("guest = 0").drop("range", "guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of the text edited with the next document, and both likenesses."""
    def next_sketch(df: DataFrame, in_order) -> DataFrame:
        return with_sketch(df, "text", "own").withColumn("next", F.lead("own").over(in_order))

    rows = with_next(docs, next_sketch).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited_text", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half),
                                                   F.substring(F.col("next_text"), F.lit(1), half)))
    rows = with_sketch(rows, "edited_text", "edited")
    as_edited, as_next = F.col("text") == F.col("edited_text"), F.col("text") == F.col("next_text")
    return rows.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
                       written("own").alias("fingerprint"), written("edited").alias("edited_fingerprint"),
                       near("own", "edited", as_edited).alias("near_edited"), near("own", "next", as_next).alias("near_next"),
                       resemblance("own", "edited", as_edited).alias("resemblance_edited"),
                       resemblance("own", "next", as_next).alias("resemblance_next"))
