"""The pipeline's stages, each against a plain version on its own input."""

import corpus_pipeline
from tally.llm import neardup, packing, secrets
from tally.llm.common import stored

SF_SMALL = "/root/testdata/sf0.001"


def test_stages(spark, small_docs):
    docs = small_docs
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF_SMALL))
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name != "packing":
            assert out.columns == small_docs.columns
            after = {r["doc_id"]: r["text"] for r in out.collect()}
            assert set(after) <= set(before)
        if name == "toxicity":
            toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").where("toxic = 1").collect()}
            assert len(toxic - set(after)) >= 0.5 * len(toxic) and len(after) > 0.75 * len(before)
        elif name == "near_duplicates":
            sets = {i: neardup.shingles(t) for i, t in before.items()}
            gone = set(before) - set(after)
            assert all(any(neardup.linked(sets[i], sets[j], 80) for j in sets if j != i) for i in gone)
            kept = sorted(after)
            assert not any(len(sets[i]) and len(sets[j]) and neardup.linked(sets[i], sets[j], 80) for i in kept for j in kept if j < i)
        elif name == "secrets":
            assert after == {i: secrets.masked(t, secrets.all_spans(t)) for i, t in before.items()}
        elif name == "packing":
            tokens = {r["doc_id"]: r["doc_tokens"] for r in out.collect()}
            assert set(tokens) == set(before)
            assert out.groupBy().sum("length").first()[0] == sum(
                len(packing.shared_ids().of(r["text"])) // 4 + 1 for r in docs.collect())
        docs = out


def test_run_and_empty(spark, small_docs, tmp_path):
    assert corpus_pipeline.run(spark, SF_SMALL).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    (small_docs.where("false")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF_SMALL}/labels.parquet").where("false").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
