"""Intervals, bootstrap, ranking and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import column, words
from .windows import numbered, running_total

#: Fixed value: the normal quantile of a 95 % interval.
Z95 = 1.959963984540054


def wilson(k: Column | str, n: Column | str) -> Column:
    """struct(lo, hi) in percent, within 0 and 100; zeros for no trials."""
    k, n = column(k), column(n)
    p, z2 = k / n, Z95 * Z95
    below = 1 + z2 / n
    centre = (p + z2 / (2 * n)) / below
    margin = Z95 * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n) / below
    some = lambda c: F.when(n > 0, c * 100).otherwise(0.0)
    return F.struct(
        some(F.greatest(F.lit(0.0), centre - margin)).alias("lo"), some(F.least(F.lit(1.0), centre + margin)).alias("hi")
    )


def page_partials(metrics: DataFrame, page: str = "source_page_id") -> DataFrame:
    """Sums per page from which every resampled statistic can be formed; chrF's where ``metrics`` has it."""
    n_words = F.greatest(F.lit(1), F.size(words("ref_n")))
    sums = [
        F.count(F.lit(1)).alias("crops"),
        F.sum("edits").alias("cer_num"),
        F.sum(F.greatest(F.lit(1), F.col("ref_len"))).alias("cer_den"),
        F.sum(F.col("wer") * n_words).alias("wer_num"),
        F.sum(n_words).alias("wer_den"),
        F.sum("exact_match").alias("em_sum"),
    ]
    if "chrf" in metrics.columns:
        sums.append(F.sum("chrf").alias("chrf_sum"))
    return metrics.groupBy(F.col(page).alias("page")).agg(*sums)


#: What is resampled, as (numerator, denominator) of the partials.
RESAMPLED = {
    "cer": ("cer_num", "cer_den"),
    "wer": ("wer_num", "wer_den"),
    "chrf": ("chrf_sum", "crops"),
    "exact_match": ("em_sum", "crops"),
}


def bootstrap(partials: DataFrame, replicates: int = 1000, seed: int = 42, resampled: dict[str, tuple[str, str]] = RESAMPLED) -> DataFrame:
    """(metric, mean, median, std, lo, hi) over resamples of whole pages, for what ``partials`` has sums of.

    Replicate b takes as its i-th page the one numbered md5(seed|b|i) modulo the pages, in page order;
    so any engine draws the same. Draws are counted before they meet the pages.
    """
    spark = partials.sparkSession
    pages = numbered(partials, ["page"], "idx")
    total = pages.count()
    draws = spark.range(replicates * total).select(
        F.floor(F.col("id") / max(1, total)).alias("b"), (F.col("id") % max(1, total)).alias("i")
    )
    key = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col("b").cast("string"), F.col("i").cast("string")))
    drawn = draws.select("b", (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % max(1, total)).alias("idx"))
    drawn = drawn.groupBy("b", "idx").agg(F.count(F.lit(1)).alias("times"))
    sums = drawn.join(pages, "idx").groupBy("b").agg(
        *[F.sum(F.col(c) * F.col("times")).alias(c) for c in partials.columns if c != "page"]
    )
    each = sums.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("metric"), (F.col(num) / F.greatest(F.lit(1), F.col(den))).alias("v"))
                    for name, (num, den) in resampled.items()
                    if num in partials.columns
                ]
            )
        ).alias("e")
    ).select("e.*")
    return each.groupBy("metric").agg(
        F.avg("v").alias("mean"),
        F.median("v").alias("median"),
        F.stddev_pop("v").alias("std"),
        F.percentile("v", F.lit(0.025)).alias("lo"),
        F.percentile("v", F.lit(0.975)).alias("hi"),
    )


def cer_bucket(cer: Column | str = "cer") -> Column:
    cer = column(cer)
    return (
        F.when(cer <= 0, "cer_0_exact_match")
        .when(cer <= 0.05, "cer_0_to_0.05")
        .when(cer <= 0.10, "cer_0.05_to_0.10")
        .when(cer <= 0.20, "cer_0.10_to_0.20")
        .otherwise("cer_above_0.20")
    )


def confidence(metrics: DataFrame, by: Column) -> DataFrame:
    """Count, mean, median and spread of ``score`` by a key; rows without a score don't count."""
    return (
        metrics.where("score is not null")
        .groupBy(by.alias("group"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg("score").alias("mean_confidence"),
            F.median("score").alias("median_confidence"),
            F.stddev_pop("score").alias("std_confidence"),
        )
    )


def auroc(metrics: DataFrame) -> DataFrame:
    """One row: how well 1 - score tells erroneous records, ties counted half; null for one class.

    Ranks come from counts per distinct score, added up in ranges of the score.
    """
    rows = metrics.where("score is not null").select((1 - F.col("score")).alias("s"), (1 - F.col("exact_match")).alias("y"))
    tied = rows.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    ranked = running_total(tied, ["s"], "n", "upto").withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2)
    total = ranked.agg(F.sum("n").alias("n"), F.sum("pos").alias("p"), F.sum(F.col("pos") * F.col("rank")).alias("r"))
    other = F.col("n") - F.col("p")
    value = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * other)
    return total.select(F.when((F.col("p") > 0) & (other > 0), value).alias("auroc"))


def calibration(metrics: DataFrame, bins: int = 10) -> DataFrame:
    """A row per filled bin of ``score``: count, accuracy, mean confidence, their distance, weight."""
    rows = metrics.where("score is not null")
    # bins are closed below, the last one on both sides; boundaries as decimals, not as products
    number = F.lit(0)
    for k in range(1, bins):
        number = number + (F.col("score") >= F.lit(k / bins)).cast("int")
    out = rows.groupBy(number.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.avg("exact_match").alias("accuracy"), F.avg("score").alias("mean_confidence")
    )
    out = out.withColumn("abs_diff", F.abs(F.col("accuracy") - F.col("mean_confidence")))
    return out.withColumn("weight", F.col("count") / F.sum("count").over(Window.partitionBy()))


def expected_calibration_error(metrics: DataFrame, bins: int = 10) -> DataFrame:
    return calibration(metrics, bins).agg(F.sum(F.col("weight") * F.col("abs_diff")).alias("ece"))


def latency(rows: DataFrame, name: str = "latency_ms") -> DataFrame:
    return rows.agg(
        F.avg(name).alias("mean"),
        F.percentile(name, F.lit(0.5)).alias("p50"),
        F.percentile(name, F.lit(0.95)).alias("p95"),
        F.min(name).alias("min"),
        F.max(name).alias("max"),
    )
