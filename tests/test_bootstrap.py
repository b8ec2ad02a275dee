"""The bootstrap has the reference's replicates and all four of its metrics."""

from lexigauge.operators import statistics
from lexigauge.plans import queries


def test_registered_bootstrap_is_whole(spark, monkeypatch):
    schema = "sample_id string, source_page_id string, reference string, prediction string"
    rows = [(str(k), str(k % 5), "one two three", "one two three" if k % 3 else "one too three") for k in range(20)]
    docs = spark.createDataFrame(rows, schema)
    monkeypatch.setattr(queries.R, "records", lambda spark, sf_dir: docs)
    asked, whole = [], statistics.bootstrap

    def bootstrap(partials, replicates=1000, seed=42):
        asked.append(replicates)
        return whole(partials, replicates, seed)

    monkeypatch.setattr(statistics, "bootstrap", bootstrap)
    got = {r["metric"]: r for r in queries.QUERIES["bootstrap_ci_1000"](spark, "").collect()}
    assert asked == [1000] and set(got) == {"cer", "wer", "chrf", "exact_match"}
    assert all(r["lo"] < r["mean"] < r["hi"] for r in got.values())
    parts = queries.QUERIES["page_partials_all"](spark, "").collect()
    assert sum(r["wer_num"] for r in parts) == 7 and sum(r["wer_den"] for r in parts) == 60
    assert all(0 < r["chrf_sum"] <= r["crops"] for r in parts)
