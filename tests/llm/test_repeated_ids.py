"""A stage's verdict is on a row, not on an id that other rows have too."""

from lexigauge.llm import jaccard_join, language_id, quality_rules

SCHEMA = "doc_id bigint, text string, lang string"


def texts(rows):
    return sorted((r["text"] or "")[:12] for r in rows.collect())


def test_rules_judge_rows(spark):
    good = lambda k: " ".join(f"word{k}x{j}" for j in range(60))
    rows = [(None, good(1), "en"), (None, None, "en"), (7, good(2), "en"), (7, "too short", "en")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert texts(quality_rules.keep_good(docs, labels)) == sorted(t[:12] for t in (good(1), good(2)))


def test_language_judges_rows(spark):
    words = ["river stone light paper window", "garden winter summer letter number"]
    train = [(k, f"{words[k % 2]} the and of to {k}", "en") for k in range(40)]
    rows = [(None, "river stone and paper light", None), (None, "123 456", None), (3, "999", "en")]
    kept = language_id.confident(spark.createDataFrame(train + rows, SCHEMA))
    assert kept.count() == 41 and "river stone " in texts(kept)


def test_near_copies_judge_rows(spark):
    a = " ".join(f"a{j}" for j in range(60))
    b = " ".join(f"b{j}" for j in range(60))
    c = " ".join(f"c{j}" for j in range(60))
    rows = [(1, a, "x"), (5, a + " end", "x"), (5, b, "x"), (6, c, "x"), (6, c + " end", "x")]
    kept = jaccard_join.one_per_component(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["text"][0]) for r in kept) == [(1, "a"), (5, "b"), (6, "c")]
