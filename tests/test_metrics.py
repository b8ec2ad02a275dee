import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexigauge.functions import metrics, text
from lexigauge.operators import edit_operations, errors, evaluate


def one(spark, expression, *values):
    names = "abcdef"[: len(values)]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return df.select(expression(*[F.col(n) for n in names]).alias("v")).first()["v"]


def test_golden_values(spark):
    assert one(spark, metrics.cer, "abc", "adc") == pytest.approx(1 / 3)
    assert one(spark, metrics.wer, "бір екі үш", "бір төрт үш") == pytest.approx(1 / 3)
    assert one(spark, metrics.rare_char_cer, "қазақ", "казак") == 1.0
    assert one(spark, metrics.rare_char_cer, "москва", "москва") is None
    assert one(spark, metrics.rare_char_cer, "ә ғ қ ң ө ұ ү і һ", "а г к н о у у и х") == 1.0
    assert one(spark, text.normalize, "  a   b ") == "a b"
    assert one(spark, text.normalize, None) == ""


@pytest.mark.parametrize("n,bucket", [(31, "short"), (32, "medium"), (80, "medium"), (128, "long"), (200, "long"), (512, "very_long")])
def test_length_buckets(spark, n, bucket):
    assert one(spark, text.length_bucket, "x" * n) == bucket


def test_language_rules(spark):
    assert one(spark, text.infer_language, "қазақ тілі") == "kazakh"
    assert one(spark, text.infer_language, "Өмүр") == "kyrgyz_or_kazakh"
    assert one(spark, text.infer_language, "москва") == "russian_or_other"
    assert one(spark, lambda t, g: text.infer_language(t, g), "қазақ", "tatar") == "tatar"
    assert one(spark, text.rare_present, "үш қазақ әні") == ["ә", "қ", "ү", "і"]


def grams(s, n):
    return Counter([s] if 0 < len(s) < n else [s[i : i + n] for i in range(len(s) - n + 1)])


def brute_chrf(r, h, beta):
    total = 0
    for n in range(1, 7):
        a, b = grams(r, n), grams(h, n)
        if not a and not b:
            total += 1
            continue
        o = sum((a & b).values())
        p, q = o / max(1, sum(b.values())), o / max(1, sum(a.values()))
        total += (1 + beta**2) * p * q / (beta**2 * p + q) if p + q else 0
    return total / 6


def test_chrf_against_brute_force():
    rnd = random.Random(3)
    pairs = [("".join(rnd.choices("abç ", k=rnd.randint(0, 12))), "".join(rnd.choices("abç ", k=rnd.randint(0, 12)))) for _ in range(300)]
    for beta in (1.0, 2.0):
        got = metrics.chrf_batch([a for a, _ in pairs], [b for _, b in pairs], beta)
        assert got == pytest.approx([brute_chrf(a, b, beta) for a, b in pairs])


def test_bag_of_words(spark):
    assert tuple(one(spark, metrics.bag_of_words, "a b b, c", "B c d")) == pytest.approx((2 / 3, 0.5, 4 / 7))
    assert tuple(one(spark, metrics.bag_of_words, "", "..")) == (1.0, 1.0, 1.0)
    assert tuple(one(spark, metrics.bag_of_words, "a", "")) == (0.0, 0.0, 0.0)


def test_alignment_counts():
    rnd = random.Random(5)
    for _ in range(200):
        r, h = ("".join(rnd.choices("abc", k=rnd.randint(0, 9))) for _ in range(2))
        ops = Counter(op for op, _, _ in edit_operations.align(r, h))
        cost = [[i + j if not i * j else 0 for j in range(len(h) + 1)] for i in range(len(r) + 1)]
        for i in range(1, len(r) + 1):
            for j in range(1, len(h) + 1):
                cost[i][j] = min(cost[i - 1][j] + 1, cost[i][j - 1] + 1, cost[i - 1][j - 1] + (r[i - 1] != h[j - 1]))
        assert sum(ops.values()) == cost[-1][-1]
        assert ops["del"] - ops["ins"] == len(r) - len(h)


def test_positional_diff(spark):
    rows = one(spark, metrics.positional_diff, "abc", "axcd")
    assert [(d["index"], d["status"]) for d in rows] == [(0, "match"), (1, "substitution"), (2, "match"), (3, "inserted")]
    assert one(spark, metrics.positional_diff, "", "") == []


GATE_CASES = [(0.03, "PASS"), (0.07, "WARN"), (0.11, "FAIL"), (0.30, "SMOKE_FAIL"), (None, "FAIL")]


@pytest.mark.parametrize("cer,status", GATE_CASES)
def test_gate(spark, cer, status):
    schema = "val_rec_cer double, val_rec_rare_char_cer double, val_rec_chrf double, val_rec_exact_match_short double, val_rec_length_ratio double, val_rec_empty_prediction_rate double, val_rec_too_short_rate double"
    row = evaluate.gate(spark.createDataFrame([(cer, 0.04, 0.95, 0.95, 1.0, 0.0, 0.0)], schema)).first()
    assert row["status"] == status
    assert row["promote"] == (status in ("PASS", "WARN"))


def test_short_exact_match_and_empty_input(spark):
    schema = "reference string, prediction string, text_length_bucket string"
    rows = spark.createDataFrame([("a b", "a b", "short"), ("c", "x", "short"), ("d", "y", None)], schema)
    out = evaluate.overall(metrics.with_metrics(rows)).first()
    assert out["val_rec_exact_match"] == pytest.approx(1 / 3)
    assert out["val_rec_exact_match_short"] == pytest.approx(1 / 3)
    empty = evaluate.overall(metrics.with_metrics(rows.limit(0))).first()
    assert empty["val_rec_count"] == 0 and empty["val_rec_cer"] is None
    assert evaluate.gate(evaluate.overall(metrics.with_metrics(rows.limit(0)))).first()["reasons"] == ["missing val_rec_cer"]


def test_failure_modes(spark):
    schema = "reference string, prediction string, degradation_profile string, layout_type string, cer double"
    cases = [
        (("abc", "abc", "official", "", 0.0), "CORRECT"),
        (("abc", "abd", "official_x", "", 0.3), "STAMP_INTERFERENCE"),
        (("abc", "abd", "photocopy", "table", 0.3), "LOW_DPI"),
        (("abc", "abd", None, "transactions", 0.3), "TABLE_BOUNDARY"),
        (("қабы", "кабы", None, None, 0.25), "MIXED_LANGUAGE"),
        (("abcdefghijkl", "abc", None, None, 0.75), "FONT_ANOMALY"),
        (("abcdefghijkl", "abcdefxxxxxx", None, None, 0.5), "UNCLASSIFIED"),
    ]
    rows = spark.createDataFrame([c for c, _ in cases], schema).withColumn("mode", errors.failure_mode())
    assert [r["mode"] for r in rows.collect()] == [m for _, m in cases]


def test_six_digits_round_the_stored_number(spark):
    values = [k / n for n in (7, 64, 128, 640, 1280) for k in range(2 * n)] + [-0.0, -1 / 128, 1234567.0078125, 5e-7, 1.5e-6]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", errors.six_digits("v").alias("t")).collect()
    assert [r["t"] for r in got] == [f"{r['v']:.6f}" for r in got]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "v double")
    assert [r["t"] for r in odd.select(errors.six_digits("v").alias("t")).collect()] == ["nan", "inf", "-inf", None]


def test_failure_table_rounds_as_its_sql(spark):
    rows = spark.createDataFrame([("a", 1 / 128, "CORRECT"), ("b", None, "CORRECT")], "sample_id string, cer double, failure_mode string")
    assert [r["cer"] for r in errors.failure_table(rows).orderBy("id").collect()] == ["0.007812", None]


def test_letter_marks_are_the_single_functions(spark):
    texts = ["қазақ тілі", "ӨМҮР", "москва", "ÄÖ\u00a0 x\n", " é ", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    full, rare = F.coalesce("t", F.lit("")), "äçèéñöüқ"
    each = F.struct(text.infer_language(full).alias("inferred"), text.has_rare(full, rare).alias("has_rare"), text.rare_present(full, rare).alias("present"))
    got = rows.select(text.letter_marks("t", rare).alias("m"), each.alias("e"), text.rare_present("t", rare).alias("p")).collect()
    assert all(r["m"] == r["e"] for r in got)
    assert [r["m"]["inferred"] for r in got] == ["kazakh", "kyrgyz_or_kazakh"] + ["russian_or_other"] * 5
    assert [r["p"] for r in got] == [["қ"], [], [], ["ä", "ö"], ["é"], [], None]


def test_a_text_is_put_into_lower_case_once(spark):
    """Not for every letter: in a lambda a function of the text would be evaluated anew for each."""
    from lexigauge.plans import queries

    plan = queries.QUERIES["infer_language"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and "regexp_replace" not in plan


def test_nan_free(spark):
    rows = spark.createDataFrame([("", ""), ("", "x"), ("x", ""), (None, None)], "reference string, prediction string")
    for r in metrics.with_metrics(rows).collect():
        assert not any(isinstance(v, float) and math.isnan(v) for v in r)
