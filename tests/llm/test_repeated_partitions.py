"""A partition that occurs twice is two blocks, so no set gets its tokens twice."""

from lexigauge.llm import jaccard_join


def test_repeated_partitions_are_blocks_of_their_own(spark):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(30)), k) for k in range(8)]
    twice = spark.createDataFrame(spark.sparkContext.parallelize(rows + rows, 2), "doc_id bigint, text string, key bigint")
    cut = twice.mapInArrow(jaccard_join._cut(4, 5), jaccard_join.CUT_DDL)
    assert cut.where("doc_ids is not null").select("block").distinct().count() == 2
