import pytest
from helpers import DATA, connect, same

import corpus_pipeline
from lexigauge.llm import queries

SF = DATA / "sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    same(spark, connect(SF), queries.QUERIES, queries.ORACLE_SQL, name, SF)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline_stages_follow_their_operators(spark):
    """Each stage against its operator's own verdicts on the stage's input."""
    from lexigauge.llm import exact_dedup, jaccard_join, language_id, quality_rules
    from lexigauge.llm.common import staged

    docs = spark.read.parquet(str(SF / "documents.parquet"))
    labels = spark.read.parquet(str(SF / "labels.parquet"))
    verdicts = [
        lambda d: quality_rules.quality_rules(d, labels).where("kept"),
        lambda d: language_id.language_id(d).where("lang_pred <> 'und' and score >= 0.3"),
        lambda d: exact_dedup.exact_dedup(d).where("kept"),
        lambda d: jaccard_join.jaccard_join(d).where("doc_id = component_id"),
    ]
    for (_, stage), verdict in zip(corpus_pipeline.STAGES[:-1], verdicts, strict=True):
        out = staged(stage(spark, docs, str(SF)), "test-stage")
        assert out.columns == docs.columns
        assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in verdict(docs).collect()}
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(SF))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(str(SF / "documents.parquet")).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(SF))
        assert docs.count() == 0
