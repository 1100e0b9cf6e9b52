"""The pipeline against its stages done plainly, each on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from tempora.llm import quality
from tests.llm.test_llm import slow_hits
from tests.llm.test_shingles import slow_kept, slow_set

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "mixing to target weights", "hilbert sharding"]

    first = stages["quality classifier"](spark, docs, SF)
    scores = {r.doc_id for r in quality.quality_scores(docs, labels).collect() if r.predicted}
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == scores

    second = stages["simhash near-dedup"](spark, first, SF)
    kept = slow_kept({r.doc_id: slow_set(r.text) for r in first.collect()})  # five words, a similarity of 0.8 or more
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == kept

    third = stages["benchmark decontamination"](spark, second, SF)
    items = [(r.item_id, r.text) for r in bench.collect()]
    assert {r.doc_id for r in third.collect()} == {r.doc_id for r in second.collect() if not slow_hits(r.text, items)[2]}

    whole = corpus_pipeline.run(spark, SF)
    counts = [r.n for r in whole.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert whole.columns == [*docs.columns, "shard", "slot"] and max(counts) - min(counts) <= 1
    assert {r.doc_id for r in whole.select("doc_id").collect()} <= {r.doc_id for r in third.collect()}
    words = third.withColumn("n", F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))).agg(F.sum("n")).first()[0]
    mixed = whole.withColumn("n", F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))).agg(F.sum("n")).first()[0]
    assert 1.2 * words < mixed < 1.8 * words


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs, SF)
        assert out.columns[: len(odd_docs.columns)] == odd_docs.columns, name
        assert out.count() <= 2 * 8 and {r.doc_id for r in out.select("doc_id").collect()} <= {1, 2, 3, 5, 6, 7, None}
        assert stage(spark, no_docs, SF).count() == 0, name
