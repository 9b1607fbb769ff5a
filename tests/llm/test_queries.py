"""The registered queries of this subpackage against SQL, and the pipeline against its parts."""

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import queries as q
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_against_sql(name, spark, duck, sf_dir):
    same_rows(q.queries()[name](spark, sf_dir), duck.execute(q.oracle_sql()[name]).df())


def test_held_out_accuracy(spark, sf_dir):
    docs, labels = q.table(spark, sf_dir, "documents"), q.table(spark, sf_dir, "labels")
    lang = q.op2_langid(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    assert lang.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.95
    qual = q.op8_quality(spark, sf_dir).join(labels, "doc_id").where("held_out")
    assert qual.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.9


def test_shards(spark, sf_dir):
    s = q.op7_shard(spark, sf_dir)
    assert s.count() == q.table(spark, sf_dir, "documents").count()
    n = [r["count"] for r in s.groupBy("shard").count().collect()]
    assert len(n) == 24 and max(n) - min(n) <= 1


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = q.table(spark, sf_dir, "documents")
    assert [n for n, _ in p.STAGES] == ["quality_classifier", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "sentencepiece"]
    now = docs
    for name, step in p.STAGES[:-1]:
        after = step(spark, now, sf_dir).cache()
        assert after.dtypes == docs.dtypes and 0 < after.count() <= now.count(), name
        if name == "ngram_jaccard_join":
            from rasterloom.llm.jaccard import components

            assert components(after).where("doc_id <> component_id").count() == 0
        if name == "suffix_array_dedup":
            assert after.where("n_chars <> length(text)").count() == 0 and after.count() == now.count()
        now = after
    last = p.to_tokens(spark, now, sf_dir)
    assert last.where("NOT round_trip").count() == 0 and last.count() == now.count()
    assert all(step(spark, docs.limit(0), sf_dir).count() == 0 for _, step in p.STAGES)
