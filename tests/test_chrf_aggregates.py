"""chrF is in the gate's judgement and in the aggregates that report it."""

from lexigauge.plans import queries


def test_gate_query_warns_of_a_low_chrf(spark, monkeypatch):
    """Few characters are wrong, but they are everywhere: CER passes outright and chrF does not."""
    ref = "abcdefghij" * 60
    hyp = "".join(c if k % 25 else "#" for k, c in enumerate(ref))
    schema = "sample_id string, language string, reference string, prediction string"
    rows = spark.createDataFrame([("1", "x", ref, hyp), ("2", "y", ref, ref)], schema)
    monkeypatch.setattr(queries.R, "records", lambda spark, sf_dir: rows)
    got = {r["language"]: (r["status"], r["reasons"]) for r in queries.QUERIES["gate"](spark, "").collect()}
    assert got == {"x": ("WARN", "val_rec_chrf below strong_result_chrf"), "y": ("PASS", "")}
