"""Aggregates of per-record metrics, overall and by slice, and the promotion gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text

#: The gate's thresholds.
GATE = {
    "max_cer": 0.10,
    "max_rare_char_cer": 0.15,
    "min_exact_match_short": 0.80,
    "max_empty_rate": 0.05,
    "max_too_short_rate": 0.05,
    "length_ratio_min": 0.70,
    "length_ratio_max": 1.30,
    "strong_result_cer": 0.05,
    "strong_result_rare_char_cer": 0.08,
    "strong_result_chrf": 0.90,
    "strong_result_exact_match_short": 0.90,
    "smoke_fail_cer": 0.25,
}


def _means(metrics: DataFrame) -> dict[str, Column]:
    """What is averaged over the records that have it, by reported name."""
    named = {"cer": "cer", "wer": "wer", "chrf": "chrf", "rare_char_cer": "rare_char_cer", "exact_match": "exact_match"}
    out = {name: F.col(c) for name, c in named.items() if c in metrics.columns}
    out["exact_match_short"] = F.when(F.col("bucket") == "short", F.col("exact_match"))
    out |= {
        "length_ratio": F.col("length_ratio"),
        "empty_prediction_rate": F.col("empty"),
        "too_short_rate": F.col("too_short"),
        "too_long_rate": F.col("too_long"),
        "latency_ms_per_crop": F.col("latency_ms"),
    }
    if "invalid_charset" in metrics.columns:
        out["invalid_charset_rate"] = F.col("invalid_charset")
    return out


def summary_columns(metrics: DataFrame) -> list[Column]:
    """One aggregate per reported metric; null where no record counts. Macro and micro CER both."""
    out = [F.avg(c).alias(f"val_rec_{name}") for name, c in _means(metrics).items()]
    micro = (F.sum("edits") / F.greatest(F.lit(1), F.sum("ref_len"))).alias("val_rec_cer_micro")
    return [F.count(F.lit(1)).cast("double").alias("val_rec_count"), out[0], micro, *out[1:]]


def partial_sums(metrics: DataFrame, key: str) -> DataFrame:
    """Sums per ``key`` that can be added up over parts of the records, and become a summary in the end."""
    sums = [F.struct(F.sum(c).alias("s"), F.count(c).alias("n")).alias(name) for name, c in _means(metrics).items()]
    return metrics.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.sum("edits").alias("_edits"), F.sum("ref_len").alias("_ref_len"), *sums)


def from_partials(partials: DataFrame, key: str) -> DataFrame:
    """The summary of all records whose partial sums are there: the same columns as by ``summary_columns``."""
    names = [c for c in partials.columns if c not in (key, "_n", "_edits", "_ref_len", "batch")]
    mean = lambda name: F.try_divide(F.sum(f"{name}.s"), F.sum(f"{name}.n")).alias(f"val_rec_{name}")
    micro = (F.sum("_edits") / F.greatest(F.lit(1), F.sum("_ref_len"))).alias("val_rec_cer_micro")
    out = [mean(n) for n in names]
    return partials.groupBy(key).agg(F.sum("_n").cast("double").alias("val_rec_count"), out[0], micro, *out[1:])


def legacy_summary(records: DataFrame, rare: str = text.RARE_CHARS) -> DataFrame:
    """One row of the older metrics: WER over characters, chrF with beta 2, rare counts, CER of records with rare letters."""
    r, h = F.col("ref_n"), F.col("hyp_n")
    rows = records.withColumn("ref_n", text.normalize("reference")).withColumn("hyp_n", text.normalize("prediction"))
    rows = rows.withColumn("cer", M.cer(r, h)).withColumn("length_ratio", M.length_ratio(r, h))
    rows = rows.withColumn("wer", M.wer_legacy(r, h)).withColumn("chrf", M.chrf(r, h, 2.0))
    count = lambda c: sum((text.count_char(F.lower(c), x) for x in rare), F.lit(0))
    both = sum((F.least(text.count_char(F.lower("reference"), x), text.count_char(F.lower("prediction"), x)) for x in rare), F.lit(0))
    mean = lambda c, name: F.avg(c).alias(name)
    return rows.agg(
        F.count(F.lit(1)).alias("count"),
        mean("cer", "cer"),
        mean("wer", "wer"),
        mean(M.ned_similarity(r, h), "ned_similarity"),
        mean("chrf", "chrf"),
        mean(M.exact_match(r, h), "exact_match"),
        mean("length_ratio", "length_ratio"),
        F.sum(count("reference")).alias("rare_char_gt_count"),
        F.sum(count("prediction")).alias("rare_char_predicted_count"),
        F.sum(both).alias("rare_char_correct_count"),
        mean(F.when(text.has_rare("reference", rare), F.col("cer")), "rare_char_cer"),
        mean((h == "").cast("double"), "empty_prediction_rate"),
        mean((F.col("length_ratio") < 0.70).cast("double"), "too_short_rate"),
        mean((F.col("length_ratio") > 1.30).cast("double"), "too_long_rate"),
    )


#: Length buckets from short to long.
BUCKETS = ("short", "medium", "long", "very_long")


def in_bucket_order(table: DataFrame, bucket: str = "bucket") -> DataFrame:
    """A table by length bucket, from short to long; others come last."""
    at = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col(bucket))
    return table.withColumn("bucket_no", F.when(at > 0, at.cast("int"))).orderBy(F.col("bucket_no").asc_nulls_last(), bucket)


def overall(metrics: DataFrame) -> DataFrame:
    """One row; with no records the count is 0 and everything else null."""
    return metrics.agg(*summary_columns(metrics))


def by_slice(metrics: DataFrame, key: str) -> DataFrame:
    """One row per value of ``key`` (null counts as ``unknown``), in order of its text."""
    value = F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias(key)
    return metrics.groupBy(value).agg(*summary_columns(metrics)).orderBy(key)


def by_all_slices(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """The overall row and every key's slices from one pass: (slice, value, metrics...)."""
    named = metrics.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("unknown")) for k in keys})
    grouped = named.groupingSets([[F.col(k)] for k in keys] + [[]], *[F.col(k) for k in keys])
    kind, value = F.lit("overall"), F.lit("all")
    for k in keys:
        kind, value = F.when(F.col(k).isNotNull(), F.lit(k)).otherwise(kind), F.coalesce(F.col(k), value)
    rows = grouped.agg(*summary_columns(metrics))
    return rows.select(kind.alias("slice"), value.alias("value"), *[c for c in rows.columns if c not in keys])


def gate(summary: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Adds status, promote and reasons to every row of metrics; a missing CER fails."""
    t = GATE | (thresholds or {})
    value = lambda name: F.col(f"val_rec_{name}") if f"val_rec_{name}" in summary.columns else F.lit(None).cast("double")
    cer, rare, short, chrf = value("cer"), value("rare_char_cer"), value("exact_match_short"), value("chrf")
    ratio = value("length_ratio")
    rules = lambda pairs: F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in pairs]))
    fails = rules(
        [
            (cer > t["max_cer"], "val_rec_cer exceeds max_cer"),
            (rare > t["max_rare_char_cer"], "val_rec_rare_char_cer exceeds max_rare_char_cer"),
            (short < t["min_exact_match_short"], "val_rec_exact_match_short below min_exact_match_short"),
            (value("empty_prediction_rate") > t["max_empty_rate"], "val_rec_empty_prediction_rate exceeds max_empty_rate"),
            (value("too_short_rate") > t["max_too_short_rate"], "val_rec_too_short_rate exceeds max_too_short_rate"),
            (
                (ratio < t["length_ratio_min"]) | (ratio > t["length_ratio_max"]),
                "val_rec_length_ratio outside configured range",
            ),
        ]
    )
    warns = rules(
        [
            (cer > t["strong_result_cer"], "val_rec_cer above strong_result_cer"),
            (rare > t["strong_result_rare_char_cer"], "val_rec_rare_char_cer above strong_result_rare_char_cer"),
            (chrf < t["strong_result_chrf"], "val_rec_chrf below strong_result_chrf"),
            (
                short < t["strong_result_exact_match_short"],
                "val_rec_exact_match_short below strong_result_exact_match_short",
            ),
        ]
    )
    smoke = cer > t["smoke_fail_cer"]
    judged = summary.withColumn("_fails", fails).withColumn("_warns", warns)
    status = (
        F.when(cer.isNull(), "FAIL")
        .when(smoke, "SMOKE_FAIL")
        .when(F.size("_fails") > 0, "FAIL")
        .when(F.size("_warns") > 0, "WARN")
        .otherwise("PASS")
    )
    reasons = (
        F.when(cer.isNull(), F.array(F.lit("missing val_rec_cer")))
        .when(smoke, F.array(F.lit("smoke fail: val_rec_cer exceeds smoke_fail_cer")))
        .when(F.size("_fails") > 0, F.col("_fails"))
        .otherwise(F.col("_warns"))
    )
    return (
        judged.withColumn("status", status)
        .withColumn("reasons", reasons)
        .withColumn("promote", F.col("status").isin("PASS", "WARN"))
        .drop("_fails", "_warns")
    )


def exportable(gated: DataFrame) -> DataFrame:
    """The rows that may be exported: only those that pass outright."""
    return gated.where("status = 'PASS'")


def percent_table(metrics: DataFrame, key: str, baseline_cer: float | None = None, digits: int | None = None) -> DataFrame:
    """Rates in percent by ``key``, share of all records and, given a baseline, the difference to it."""
    pct = lambda c: F.avg(c) * 100
    columns = {
        "n": F.count(F.lit(1)),
        "mean_ref_length": F.avg("ref_len"),
        "cer": pct("cer"),
        "wer": pct("wer"),
        "sr": pct("exact_match"),
        "empty_rate": pct("empty"),
        "too_short_rate": pct("too_short"),
        "too_long_rate": pct("too_long"),
        "mean_length_ratio": F.avg("length_ratio"),
    }
    if "chrf" in metrics.columns:
        columns["chrf"] = F.avg("chrf")
    named = F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias(key)
    out = metrics.groupBy(named).agg(*[c.alias(n) for n, c in columns.items()])
    total = out.agg(F.sum("n").alias("_total"))
    out = out.crossJoin(total).withColumn("share", F.col("n") / F.col("_total")).drop("_total")  # one row
    if baseline_cer is not None:
        out = out.withColumn("cer_delta_pp", F.col("cer") - baseline_cer)
    if digits is not None:
        out = out.withColumns({c: F.bround(c, digits) for c, t in out.dtypes if t == "double" and c != "share"})
    return out


def coverage(records: DataFrame, keys: list[str]) -> DataFrame:
    """(dimension, value, count) for every key, from one pass."""
    named = records.select(*[F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias(k) for k in keys])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).alias("value")) for k in keys]))
    return named.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("count"))
