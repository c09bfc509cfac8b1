import pytest
from pyspark.sql import functions as F

SF_SMALL = "/root/testdata/sf0.001"

#: Extra columns whose names the operators use inside.
CLASHING = ("text_", "size", "hash", "label", "score", "set_key", "band", "range", "pack", "_words", "node", "component_id")


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents with the given (doc_id, text[, source]) rows and clashing extra columns."""
    def make(rows, partitions=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s1", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        return df.repartition(partitions).withColumns({c: F.lit("x") for c in CLASHING})
    return make


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def small_rows(small_docs):
    return sorted((r["doc_id"], r["text"]) for r in small_docs.select("doc_id", "text").collect())
