"""Each pipeline stage takes out exactly what its operator decides, and nothing else."""

import corpus_pipeline
from pyspark.sql import functions as F

from pagewright.llm import common, decontaminate, near_dedup, quality_classifier

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "decontaminate", "tokens"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    after = common.materialize(stages["quality"](spark, docs, SF), "test")
    assert after.columns == columns
    assert ids(after) == ids(quality_classifier.op4_quality_classifier(spark, SF).where("predicted = 1"))

    before, after = after, common.materialize(stages["line_dedup"](spark, after, SF), "test")
    assert after.columns == columns
    old = {r.doc_id: r.text for r in before.collect()}
    new = {r.doc_id: r for r in after.collect()}
    assert all(r.n_chars == len(r.text) for r in new.values())
    for i, r in new.items():
        lines = iter(old[i].split("\n"))
        assert all(line in lines for line in r.text.split("\n"))  # a subsequence
    once = {line for t in old.values() for line in t.split("\n") if len(line) >= 20}
    assert once == {line for r in new.values() for line in r.text.split("\n") if len(line) >= 20}  # every line stays somewhere

    before, after = after, common.materialize(stages["near_dedup"](spark, after, SF), "test")
    assert after.columns == columns
    assert ids(after) == ids(near_dedup.near_dedup(before, near_dedup.STAGE_PERCENT).where("kept"))

    before, after = after, common.materialize(stages["decontaminate"](spark, after, SF), "test")
    assert after.columns == columns
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ids(after) == ids(decontaminate.decontaminate(before, items).where(F.col("n_hit") == 0))

    assert ids(stages["tokens"](spark, after, SF)) == ids(after)
