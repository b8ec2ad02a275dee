"""Error analysis: confusions, suffixes, failure modes, hard cases and examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics, text

#: Letters that mark a mixed-language line.
MIXED_LETTERS = "қңәүұ"
#: Degradations and layouts with a lower bar for hard cases.
HARD_DEGRADATIONS = ("phone_photo", "low_dpi_scan", "old_paper")
HARD_LAYOUTS = ("tables_transactional", "forms")
MISSING, INSERTED = "<missing>", "<inserted>"


def substitutions(records: DataFrame, top: int | None = 50) -> DataFrame:
    """(ground_truth, predicted, count) of characters that differ at the same position.

    Ties are in order of the characters. ``top`` of None returns all.
    """
    diff = metrics.positional_diff(text.normalize("reference"), text.normalize("prediction"))
    rows = records.select(F.explode(F.filter(diff, lambda d: d["status"] != "match")).alias("d")).select(
        F.when(F.col("d.reference") == "", INSERTED).otherwise(F.col("d.reference")).alias("ground_truth"),
        F.when(F.col("d.prediction") == "", MISSING).otherwise(F.col("d.prediction")).alias("predicted"),
    )
    counted = rows.groupBy("ground_truth", "predicted").agg(F.count(F.lit(1)).alias("count"))
    if top is None:
        return counted
    return counted.orderBy(F.desc("count"), "ground_truth", "predicted").limit(top)


def rare_confusion(records: DataFrame, rare: str = text.RARE_CHARS) -> DataFrame:
    """(ref_char, hyp_char, count) of rare characters that the prediction has otherwise, by position."""
    r, h = F.lower(text.normalize("reference")), F.lower(text.normalize("prediction"))
    wrong = F.filter(
        metrics.positional_diff(r, h),
        lambda d: (d["status"] != "match") & d["reference"].isin(*rare),
    )
    rows = records.select(F.explode(wrong).alias("d"))
    hyp = F.when(F.col("d.prediction") == "", MISSING).otherwise(F.col("d.prediction"))
    return rows.groupBy(F.col("d.reference").alias("ref_char"), hyp.alias("hyp_char")).agg(F.count(F.lit(1)).alias("count"))


def rare_counts(records: DataFrame, rare: str = text.RARE_CHARS) -> DataFrame:
    """(char, gt, predicted, correct): occurrences, and the smaller of both within each record."""
    r, h = F.lower("reference"), F.lower("prediction")
    each = F.array(
        *[
            F.struct(
                F.lit(c).alias("char"), text.count_char(r, c).alias("gt"), text.count_char(h, c).alias("predicted")
            )
            for c in rare
        ]
    )
    rows = records.select(F.explode(each).alias("e")).select("e.*")
    return rows.groupBy("char").agg(
        F.sum("gt").alias("gt"), F.sum("predicted").alias("predicted"), F.sum(F.least("gt", "predicted")).alias("correct")
    )


def rare_recall(records: DataFrame, rare: str = text.RARE_CHARS) -> DataFrame:
    share = F.when(F.col("gt") > 0, F.col("correct") / F.col("gt")).otherwise(0.0)
    return rare_counts(records, rare).withColumn("recall", share)


def rare_prf(records: DataFrame, rare: str = text.RARE_CHARS) -> DataFrame:
    """One row: precision, recall and F1 of all rare characters as bags; 0 without any."""
    total = rare_counts(records, rare).agg(*[F.sum(c).alias(f"{c}_count") for c in ("gt", "predicted", "correct")])
    part = lambda by: F.when(F.col(by) > 0, F.col("correct_count") / F.col(by)).otherwise(0.0)
    out = total.withColumn("precision", part("predicted_count")).withColumn("recall", part("gt_count"))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def suffix_errors(records: DataFrame, top: int | None = 100) -> DataFrame:
    """(suffix, count): last three letters of reference words that differ at their position."""
    pairs = F.arrays_zip(
        text.words(text.normalize("reference")).alias("r"), text.words(text.normalize("prediction")).alias("h")
    )
    rows = records.select(F.explode(pairs).alias("p")).where(
        "p.r is not null and p.h is not null and p.r <> p.h and char_length(p.r) >= 3"
    )
    counted = rows.groupBy(F.expr("right(p.r, 3)").alias("suffix")).agg(F.count(F.lit(1)).alias("count"))
    return counted if top is None else counted.orderBy(F.desc("count"), "suffix").limit(top)


def failure_mode(cer: Column | str = "cer", ref: str = "reference", hyp: str = "prediction") -> Column:
    cer = text.column(cer)
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    has = lambda c, *parts: low(c).rlike("|".join(parts))
    short = F.char_length(hyp) < F.greatest(F.lit(5.0), F.char_length(ref) * 0.5)
    return (
        F.when(cer < 0.05, "CORRECT")
        .when(has("degradation_profile", "stamp", "official"), "STAMP_INTERFERENCE")
        .when(has("degradation_profile", "low", "dpi", "phone", "photo"), "LOW_DPI")
        .when(has("layout_type", "table", "transaction"), "TABLE_BOUNDARY")
        .when(low(ref).rlike(f"[{MIXED_LETTERS}]") & (cer > 0.15), "MIXED_LANGUAGE")
        .when(short, "FONT_ANOMALY")
        .otherwise("UNCLASSIFIED")
    )


def failure_distribution(classified: DataFrame) -> DataFrame:
    return classified.groupBy("failure_mode").agg(F.count(F.lit(1)).alias("count"), F.avg("cer").alias("mean_cer"))


def six_digits(number: Column | str) -> Column:
    """Six digits after the point as C's ``%.6f`` gives them; null stays null.

    The number as it is stored is rounded, a true tie to the even digit (1/128 is 0.007812); ``format_string`` rounds
    its shortest decimal form, ties up. Numbers of 1e10 and more have zeros behind their 17th digit.
    """
    x = text.column(number).cast("double")
    infinite = F.when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.when(F.isnan(x), "nan").otherwise(F.coalesce(infinite, F.call_function("format_number", x, F.lit("0.000000"))))


def failure_table(classified: DataFrame) -> DataFrame:
    """(id, cer with six digits, failure_mode, image_url) of every record, for a CSV file."""
    return classified.select(
        F.coalesce(F.col("sample_id").cast("string"), F.lit("")).alias("id"),
        six_digits("cer").alias("cer"),
        "failure_mode",
        F.coalesce(F.col("image_url").cast("string") if "image_url" in classified.columns else F.lit(""), F.lit("")).alias("image_url"),
    )


def is_hard(cer: Column | str = "cer") -> Column:
    """Whether the record is worth another look: a lower bar for hard pages and layouts."""
    cer = text.column(cer)
    degradation, layout = F.coalesce("degradation_profile", F.lit("")), F.coalesce("layout_type", F.lit(""))
    return (
        (cer > 0.25)
        | (degradation.isin(*HARD_DEGRADATIONS) & (cer > 0.15))
        | (layout.isin(*HARD_LAYOUTS) & (cer > 0.20))
    )


def hard_reasons(min_cer: float = 0.10, min_rare_cer: float = 0.15, rare: str = text.RARE_CHARS) -> Column:
    """Names of the reasons that hold, on the texts as they are; no reason, no hard case."""
    ref, hyp = F.col("reference"), F.col("prediction")
    empty = F.trim(hyp) == ""
    short = F.char_length(hyp) < F.char_length(ref) * 0.7
    rules = [
        ("high_cer", metrics.cer(ref, hyp) >= min_cer),
        ("rare_char_failure", metrics.rare_char_cer(ref, hyp, rare) >= min_rare_cer),
        ("empty_prediction", empty),
        ("too_short_prediction", ~empty & short),
        ("table_or_form", F.lower(F.coalesce("layout_type", F.lit(""))).rlike("table|form")),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))


def qualitative(records: DataFrame, per_group: int = 10, rare: str = text.RARE_CHARS) -> DataFrame:
    """Examples of five kinds, ``per_group`` of each, records in ``pos`` order where nothing else decides."""
    ref, hyp = F.col("reference"), F.col("prediction")
    wrong = F.exists(
        metrics.positional_diff(ref, hyp), lambda d: (d["status"] != "match") & d["reference"].isin(*rare)
    )
    short = (F.trim(hyp) == "") | (F.char_length(hyp) < F.char_length(ref) * 0.7)
    row = F.struct(*records.columns, metrics.cer(ref, hyp).alias("cer"))
    rare_ref = ref.rlike(f"[{rare}]")
    cer, pos = F.col("r.cer"), F.col("pos")
    # (name, who belongs, order): each record is scored once, then stands in every group it belongs to
    groups = [
        ("best_line_predictions", F.lit(True), cer),
        ("worst_line_failures", F.lit(True), -cer),
        ("rare_character_successes", rare_ref & (ref == hyp), F.lit(0.0)),
        ("rare_character_substitutions", rare_ref & wrong, F.lit(0.0)),
        ("empty_or_too_short_failures", short, F.lit(0.0)),
    ]
    rows = records.select("pos", "sample_id", row.alias("r"), *[who.alias(f"g{k}") for k, (_, who, _) in enumerate(groups)])
    member = F.array_compact(
        F.array(*[F.when(F.col(f"g{k}"), F.struct(F.lit(name).alias("name"), rank.alias("rank"))) for k, (name, _, rank) in enumerate(groups)])
    )
    rows = rows.select("pos", "sample_id", "r", F.explode(member).alias("g"))
    best = Window.partitionBy("g.name").orderBy("g.rank", "pos")
    rows = rows.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= per_group)
    once = Window.partitionBy("g.name", "sample_id").orderBy("pos")
    rows = rows.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    return rows.select("r.*", F.col("g.name").alias("qualitative_group"))


def page_diagnosis(pages: DataFrame) -> DataFrame:
    """Page metrics and an error type for each page (reference, prediction); pages are long, so their distance goes by bit vectors."""
    rows = pages.withColumn("gt_n", text.normalize("reference")).withColumn("pred_n", text.normalize("prediction"))
    rows = (
        rows.withColumn("gt_len", F.char_length("gt_n"))
        .withColumn("pred_len", F.char_length("pred_n"))
        .withColumn("length_ratio", metrics.length_ratio("gt_n", "pred_n"))
        .withColumn("cer", metrics.long_distance("gt_n", "pred_n") / F.greatest(F.lit(1), F.col("gt_len")))
        .withColumn("wer", metrics.wer_page("gt_n", "pred_n"))
        .withColumn("bag", metrics.bag_of_words("gt_n", "pred_n"))
    )
    cer, ratio, f1 = F.col("cer"), F.col("length_ratio"), F.col("bag.f1")
    kind = (
        F.when(F.col("pred_n") == "", "empty_prediction")
        .when((ratio < 0.70) & (cer > 0.25), "detection_miss_or_too_short")
        .when((ratio > 1.30) & (cer > 0.25), "duplicate_or_noise_text")
        .when((f1 >= 0.75) & (cer >= 0.30), "order_issue")
        .when((f1 < 0.50) & ratio.between(0.70, 1.30) & (cer >= 0.30), "recognizer_or_bad_crop_failure")
        .when(cer < 0.15, "acceptable")
        .otherwise("mixed")
    )
    return rows.withColumn("error_type", kind).drop("gt_n", "pred_n")


def page_summary(diagnosed: DataFrame) -> DataFrame:
    """One row: means, medians and a map of error types to counts."""
    types = diagnosed.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))
    types = types.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_type", "n")))).alias("error_type_counts"))
    means = diagnosed.agg(
        F.count(F.lit(1)).alias("page_count"),
        F.avg("cer").alias("mean_cer"),
        F.median("cer").alias("median_cer"),
        F.avg("wer").alias("mean_wer"),
        F.avg("bag.f1").alias("mean_word_bag_f1"),
        F.avg("length_ratio").alias("mean_length_ratio"),
    )
    return means.crossJoin(types)  # one row each
