"""A registered query for every operator, over the whole of the driver's tables."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, metrics, text
from ..operators import (
    audit,
    edit_operations,
    errors,
    evaluate,
    leaderboard,
    pages,
    reading_order,
    relations,
    sampling,
    statistics,
)
from . import more
from . import records as R

QUERIES = {}
PARTIALS = ["page", "crops", "cer_num", "cer_den", "em_sum"]
SLICES = ["language", "layout_type", "degradation_profile", "role"]


def query(function):
    """Registers a query; doubles are rounded to six digits so that engines agree."""

    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = function(spark, sf_dir)
        return out.select(*[F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

    QUERIES[function.__name__] = run
    return run


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _scored(spark: SparkSession, sf_dir: str, chrf: bool = False) -> DataFrame:
    return metrics.with_metrics(R.records(spark, sf_dir), R.RARE, chrf_score=chrf)


@query
def cer_by_lang(spark, sf_dir):
    rows = evaluate.by_slice(_scored(spark, sf_dir), "language")
    return rows.select("language", "val_rec_count", "val_rec_cer", "val_rec_cer_micro", "val_rec_exact_match", "val_rec_length_ratio")


@query
def metrics_overall(spark, sf_dir):
    return evaluate.overall(_scored(spark, sf_dir)).drop("val_rec_latency_ms_per_crop")


@query
def metrics_grouping_sets(spark, sf_dir):
    return evaluate.by_all_slices(_scored(spark, sf_dir), SLICES).drop("val_rec_latency_ms_per_crop")


@query
def metrics_chrf(spark, sf_dir):
    return evaluate.by_all_slices(_scored(spark, sf_dir, chrf=True), SLICES).drop("val_rec_latency_ms_per_crop")


@query
def norm_text(spark, sf_dir):
    n = text.normalize("text")
    return _documents(spark, sf_dir).select("doc_id", F.md5(n).alias("digest"), F.char_length(n).alias("n_norm"))


@query
def length_buckets(spark, sf_dir):
    rows = _documents(spark, sf_dir).select(
        text.length_bucket(text.normalize("text")).alias("bucket"), text.length_bucket3("text").alias("bucket3")
    )
    return rows.groupBy("bucket", "bucket3").agg(F.count(F.lit(1)).alias("n"))


@query
def infer_language(spark, sf_dir):
    rows = _documents(spark, sf_dir).select(text.letter_marks("text", R.RARE).alias("m"))
    return rows.groupBy("m.inferred", "m.has_rare", F.array_join("m.present", "").alias("present")).agg(F.count(F.lit(1)).alias("n"))


@query
def rare_char_cer(spark, sf_dir):
    return _scored(spark, sf_dir).select("sample_id", "rare_char_cer")


@query
def rare_prf(spark, sf_dir):
    return errors.rare_prf(R.records(spark, sf_dir), R.RARE)


@query
def rare_recall(spark, sf_dir):
    return errors.rare_recall(R.records(spark, sf_dir), R.RARE)


@query
def rare_confusion(spark, sf_dir):
    return errors.rare_confusion(R.records(spark, sf_dir), R.RARE)


@query
def substitutions_top50(spark, sf_dir):
    return errors.substitutions(R.records(spark, sf_dir), 50)


@query
def suffix_errors_top100(spark, sf_dir):
    return errors.suffix_errors(R.records(spark, sf_dir), 100)


@query
def failure_taxonomy(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("failure_mode", errors.failure_mode())
    return errors.failure_distribution(rows)


@query
def hardcases_a(spark, sf_dir):
    return _scored(spark, sf_dir).where(errors.is_hard()).select("sample_id", "cer")


@query
def hardcases_b_reasons(spark, sf_dir):
    rows = R.records(spark, sf_dir).withColumn("reasons", errors.hard_reasons(rare=R.RARE))
    return rows.where(F.size("reasons") > 0).select("sample_id", F.array_join("reasons", ",").alias("reasons"))


@query
def qualitative_top(spark, sf_dir):
    return errors.qualitative(R.records(spark, sf_dir), 10, R.RARE).select("qualitative_group", "sample_id", "cer")


@query
def wer_words(spark, sf_dir):
    return _scored(spark, sf_dir).select("sample_id", "wer")


@query
def wer_legacy(spark, sf_dir):
    return R.records(spark, sf_dir).select("sample_id", metrics.wer_legacy("reference", "prediction").alias("wer"))


@query
def ned_similarity(spark, sf_dir):
    return _scored(spark, sf_dir).select("sample_id", metrics.ned_similarity("ref_n", "hyp_n").alias("ned"))


@query
def chrf_b1(spark, sf_dir):
    return R.records(spark, sf_dir).select("sample_id", metrics.chrf("reference", "prediction", 1.0).alias("chrf"))


@query
def chrf_b2(spark, sf_dir):
    return R.records(spark, sf_dir).select("sample_id", metrics.chrf("reference", "prediction", 2.0).alias("chrf"))


@query
def bow_prf(spark, sf_dir):
    bag = metrics.bag_of_words("reference", "prediction")
    return R.records(spark, sf_dir).select("sample_id", bag.alias("b")).select("sample_id", "b.*")


@query
def page_error_types(spark, sf_dir):
    rows = errors.page_diagnosis(R.page_records(R.records(spark, sf_dir)))
    return rows.select("page_id", "gt_len", "pred_len", "length_ratio", "cer", F.col("bag.f1").alias("bow_f1"), "error_type")


@query
def gate(spark, sf_dir):
    rows = evaluate.by_slice(_scored(spark, sf_dir, chrf=True), "language")
    return evaluate.gate(rows).select("language", "status", "promote", F.array_join("reasons", "; ").alias("reasons"))


@query
def charset(spark, sf_dir):
    return audit.charset(_documents(spark, sf_dir))


@query
def char_histogram(spark, sf_dir):
    return audit.characters(_documents(spark, sf_dir))


@query
def dataset_audit(spark, sf_dir):
    return audit.audit(_documents(spark, sf_dir), ["lang", "source"], "text", R.RARE)


@query
def coverage(spark, sf_dir):
    return evaluate.coverage(R.records(spark, sf_dir), SLICES)


@query
def invalid_charset(spark, sf_dir):
    ascii_letters = "".join(map(chr, range(32, 127)))
    rows = R.records(spark, sf_dir).select("language", text.invalid_charset(text.normalize("prediction"), ascii_letters).alias("bad"))
    return rows.groupBy("language").agg(F.avg(F.col("bad").cast("double")).alias("invalid_charset_rate"))


def _zones(spark, sf_dir):
    recs = R.records(spark, sf_dir)
    shown = recs.where(f"{R.VARIANT} <> 7").select(F.col("sample_id").alias("line_id"), "prediction")
    return R.zone_boxes(recs), R.line_boxes(recs), shown


@query
def zone_lines_overlap(spark, sf_dir):
    zones, lines, _ = _zones(spark, sf_dir)
    return pages.zone_lines(zones, lines).select("zone_id", "line_id", "overlap")


@query
def zone_from_lines(spark, sf_dir):
    built = pages.zone_from_lines(*_zones(spark, sf_dir))
    return built.select("zone_id", F.md5("prediction").alias("digest"), F.array_join("line_ids", ",").alias("line_ids"), "line_count")


@query
def page_reconstruct(spark, sf_dir):
    zones = pages.zone_from_lines(*_zones(spark, sf_dir))
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    every = conversations.select(F.col("conv_id").cast("string").alias("page_id")).distinct()
    return pages.page_text(every, zones).select("page_id", F.md5("prediction").alias("digest"), "zone_count")


@query
def oracle_pages(spark, sf_dir):
    zones = R.zone_boxes(R.records(spark, sf_dir))
    shown = zones.where("zone_id not like '%:1'").select("zone_id", F.col("text").alias("prediction"))
    every = zones.select("page_id").distinct()
    return pages.oracle_pages(every, zones, shown).select("page_id", F.md5("prediction").alias("digest"), "zone_count", "failed_zone_rate")


@query
def geometric_order(spark, sf_dir):
    rows = R.line_boxes(R.records(spark, sf_dir)).withColumn("k", geometry.geometric_key("box"))
    simple = geometry.simple_key("box")["line"].alias("simple_line")
    return rows.select("line_id", F.col("k.line").alias("line"), F.col("k.y1").alias("y1"), F.col("k.x1").alias("x1"), simple)


@query
def column_gap(spark, sf_dir):
    rows = R.line_boxes(R.records(spark, sf_dir)).withColumnRenamed("line_id", "box_id")
    return pages.widest_gap(rows)


@query
def page_partials(spark, sf_dir):
    return statistics.page_partials(_scored(spark, sf_dir)).select(*PARTIALS)


@query
def page_partials_all(spark, sf_dir):
    return statistics.page_partials(_scored(spark, sf_dir, chrf=True))


@query
def bootstrap_ci(spark, sf_dir):
    return statistics.bootstrap(statistics.page_partials(_scored(spark, sf_dir)).select(*PARTIALS), replicates=200)


@query
def bootstrap_ci_1000(spark, sf_dir):
    return statistics.bootstrap(statistics.page_partials(_scored(spark, sf_dir, chrf=True)))


@query
def wilson(spark, sf_dir):
    rows = _scored(spark, sf_dir).groupBy("language").agg(
        F.sum("exact_match").cast("long").alias("k"), F.count(F.lit(1)).alias("n")
    )
    return rows.withColumn("w", statistics.wilson("k", "n")).select("language", "k", "n", "w.lo", "w.hi")


@query
def confidence_buckets(spark, sf_dir):
    return statistics.confidence(_scored(spark, sf_dir), statistics.cer_bucket())


@query
def confidence_by_outcome(spark, sf_dir):
    return statistics.confidence(_scored(spark, sf_dir), F.when(F.col("exact_match") == 1, "exact").otherwise("erroneous"))


@query
def auroc(spark, sf_dir):
    return statistics.auroc(_scored(spark, sf_dir))


@query
def ece(spark, sf_dir):
    return statistics.expected_calibration_error(_scored(spark, sf_dir))


@query
def calibration_bins(spark, sf_dir):
    return statistics.calibration(_scored(spark, sf_dir))


@query
def degradation_table(spark, sf_dir):
    return evaluate.percent_table(_scored(spark, sf_dir), "degradation_profile", baseline_cer=4.51)


@query
def text_length_table(spark, sf_dir):
    return evaluate.percent_table(_scored(spark, sf_dir), "bucket").select("bucket", "n", "mean_ref_length", "cer", "sr", "mean_length_ratio")


@query
def degradation_chrf(spark, sf_dir):
    return evaluate.percent_table(_scored(spark, sf_dir, chrf=True), "degradation_profile", baseline_cer=4.51)


@query
def text_length_chrf(spark, sf_dir):
    rows = evaluate.percent_table(_scored(spark, sf_dir, chrf=True), "bucket")
    return rows.select("bucket", "n", "mean_ref_length", "cer", "sr", "mean_length_ratio", "chrf")


def _manifest(spark, sf_dir):
    """Two rows per line of user turns, the later one without a profile on every fifth page."""
    recs = R.records(spark, sf_dir).where("role = 'user'")
    first = recs.select("sample_id", F.lit("first").alias("degradation_profile"), F.col("pos").alias("at"))
    later = F.when(F.col("conv_id") % 5 == 0, "").otherwise("later")
    return first.unionByName(recs.select("sample_id", later.alias("degradation_profile"), (F.col("pos") + 10**12).alias("at")))


@query
def join_verify(spark, sf_dir):
    return relations.join_report(R.records(spark, sf_dir), _manifest(spark, sf_dir), "sample_id")


@query
def dedupe_last(spark, sf_dir):
    rows = relations.with_manifest(R.records(spark, sf_dir), _manifest(spark, sf_dir), "sample_id", "degradation_profile", "at")
    return rows.select("sample_id", "degradation_profile", "matched")


@query
def unseen(spark, sf_dir):
    manifest = _manifest(spark, sf_dir)
    return relations.unseen(R.records(spark, sf_dir), manifest, "sample_id").select("sample_id")


@query
def stratified_round_robin(spark, sf_dir):
    rows = sampling.round_robin(R.records(spark, sf_dir), SLICES, 200, 42, "sample_id")
    return rows.select("sample_id", "language", "turn")


@query
def rare_preferring_sample(spark, sf_dir):
    return sampling.prefer_rare(R.records(spark, sf_dir), 120, 42, "reference", ["sample_id"], R.RARE).select("sample_id")


@query
def ntile_shards(spark, sf_dir):
    rows = relations.shards(R.records(spark, sf_dir).select("pos"), ["pos"], 7)
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))


@query
def shard_merge(spark, sf_dir):
    rows = R.records(spark, sf_dir).groupBy((F.col("conv_id") % 4).alias("shard")).agg(F.count(F.lit(1)).alias("count"))
    summaries = rows.select(
        "shard",
        "count",
        (F.col("count") * 0.25 + F.col("shard")).alias("elapsed_sec"),
        F.when(F.col("shard") > 1, F.col("shard") * 100).alias("peak_memory"),
        F.concat(F.lit("backend"), F.col("shard")).alias("backend"),
        F.lit("epoch_9").alias("checkpoint"),
    )
    return relations.merge_shards(summaries)


def _board(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("benchmark", F.col("language")).withColumn("model", F.col("degradation_profile"))
    return leaderboard.leaderboard(rows)


@query
def leaderboard_best(spark, sf_dir):
    return leaderboard.best(_board(spark, sf_dir)).select("benchmark", "model", "val_rec_cer", "val_rec_count")


@query
def metric_deltas(spark, sf_dir):
    board = _board(spark, sf_dir)
    return leaderboard.deltas(board.where("model = 'clean'"), board.where("model = 'old_paper'"))


@query
def running_best(spark, sf_dir):
    rows = _board(spark, sf_dir).withColumn("promote", F.col("val_rec_cer") < 0.6)
    return leaderboard.running_best(rows, "benchmark", "model").select("benchmark", "model", "best_before", "is_best")


@query
def running_total(spark, sf_dir):
    phases = _documents(spark, sf_dir).groupBy(F.col("source").alias("phase")).agg((F.sum(F.char_length("text")) / 1000).alias("size"))
    return relations.cumulative(phases, "phase", "size")


@query
def json_crop_specs(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    lines = F.split("text", "\n")
    rows = turns.select(
        F.expr("concat_ws(':', conv_id, turn)").alias("page_id"),
        F.transform(lines, lambda t, i: F.array(F.lit(0.0), i * 20.0, F.lit(100.0), i * 20.0 + 16)).alias("ocr_bboxes"),
        lines.alias("ocr_labels"),
        F.array().cast("array<string>").alias("ocr_region_ids"),
        F.to_json(
            F.array(
                F.struct(
                    F.col("text"),
                    F.array(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(400.0)).alias("bbox"),
                    F.when(F.col("turn") % 2 == 0, "table_cell").otherwise("body").alias("zone_type"),
                )
            )
        ).alias("zones_json"),
    )
    specs = audit.crop_specs(rows, ("line", "zone", "table_cell"))
    return specs.groupBy("page_id", "crop_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))


@query
def status_upsert(spark, sf_dir):
    models = _documents(spark, sf_dir).groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    number = F.regexp_extract("id", r"(\d+)", 1).cast("int")
    old = models.where(number < 12).select("id", F.lit("failed").alias("status"), "n")
    new = models.where(number.between(6, 15)).select("id", F.lit("completed").alias("status"), (F.col("n") * 2).alias("n"))
    config = models.where(number < 14).select("id", (100 - number).alias("pos"))
    return relations.upsert(old, new, config)


@query
def edit_ops(spark, sf_dir):
    return edit_operations.tallies(edit_operations.edit_counts(R.records(spark, sf_dir)), "language")


@query
def rare_label_ops(spark, sf_dir):
    with_ops = edit_operations.edit_operations(R.records(spark, sf_dir))
    return edit_operations.rare_label_counts(with_ops, {c: c for c in R.RARE}).drop("interval")


@query
def layout_aware_order(spark, sf_dir):
    boxes = R.line_boxes(R.records(spark, sf_dir)).withColumnRenamed("line_id", "box_id")
    return reading_order.reading_order(boxes.withColumns({"page_width": F.lit(600), "layout_type": F.lit("paragraph")}))


@query
def simple_order(spark, sf_dir):
    boxes = R.line_boxes(R.records(spark, sf_dir)).withColumnRenamed("line_id", "box_id")
    return reading_order.reading_order(boxes, "simple")


for _function in more.ALL:
    query(_function)
