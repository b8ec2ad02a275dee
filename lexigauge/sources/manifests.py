"""Manifests, predictions and label files: schemas, readers, validation and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

#: Fields that a recognition record must have, in the order in which they are named.
REQUIRED = (
    "sample_id", "image_path", "text", "language", "layout_type", "degradation_profile", "crop_type", "source_page_id",
)
MANIFEST = (
    ", ".join(f"{c} string" for c in REQUIRED)
    + ", bbox array<double>, region_id string, contains_rare_chars boolean, rare_chars array<string>, text_length_bucket string"
)
_META = (
    "struct<language string, layout_type string, degradation_profile string, crop_type string, "
    "source_page_id string, bbox array<double>, text_length_bucket string, latency_ms double>"
)
PREDICTIONS = (
    "checkpoint string, sample_id string, id string, image_path string, image_url string, reference string, "
    f"text string, prediction string, score double, latency_ms double, metadata {_META}"
)
PAGES = (
    "image_info array<struct<image_url string, matched_text_index int>>, text_info array<struct<text string, tag string>>, "
    "metadata struct<benchmark string, source_index int, language string, layout_type string, degradation_profile string>"
)
GROUPS = (
    "page_id string, source_image string, gt_text string, crop_ids array<string>, dataset string, language string, "
    "layout_type string, degradation_profile string, sort_mode string"
)


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """JSON lines with a given schema, never an inferred one; blank lines go, broken lines raise."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    return rows.dropna("all")


def missing_fields() -> Column:
    """Names of the required fields that are null or empty."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in REQUIRED]))


def validated(records: DataFrame) -> DataFrame:
    """Records with normalised text and a length bucket; a record without a required field raises when read."""
    bad = missing_fields()
    message = F.concat(F.lit("Recognition record is missing required fields: "), F.array_join(bad, ", "))
    checked = records.withColumn("sample_id", F.when(F.size(bad) > 0, F.raise_error(message)).otherwise(F.col("sample_id")))
    return _finished(checked)


def split_valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good records, rejected ones with the names of what they lack)."""
    marked = records.withColumn("missing", missing_fields())
    good = marked.where(F.size("missing") == 0).drop("missing")
    return _finished(good), marked.where(F.size("missing") > 0)


def _finished(records: DataFrame) -> DataFrame:
    out = records.withColumn("text", text.normalize("text"))
    given = F.col("text_length_bucket") if "text_length_bucket" in records.columns else F.lit(None).cast("string")
    return out.withColumn("text_length_bucket", F.coalesce(given, text.length_bucket("text")))


def load_manifest(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    rows = read_jsonl(spark, path, MANIFEST)
    return validated(rows) if validate else rows


def save_manifest(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    validated(records).write.mode(mode).json(path)


def load_predictions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Predictions of either form as (sample_id, reference, prediction, score, latency_ms, dimensions...).

    Latency may be a column or part of the metadata; dimensions without a value are ``unknown``.
    """
    rows = read_jsonl(spark, path, PREDICTIONS)
    dims = ("language", "layout_type", "degradation_profile", "crop_type", "source_page_id")
    return rows.select(
        F.coalesce("sample_id", "id", F.lit("")).alias("sample_id"),
        F.coalesce("reference", "text", F.lit("")).alias("reference"),
        F.coalesce("prediction", F.lit("")).alias("prediction"),
        "score",
        F.coalesce("latency_ms", "metadata.latency_ms").alias("latency_ms"),
        *[F.coalesce(f"metadata.{d}", F.lit("unknown")).alias(d) for d in dims],
        F.col("metadata.text_length_bucket").alias("text_length_bucket"),
    )


def write_labels(records: DataFrame, path: str) -> None:
    """``image_path<TAB>text`` lines."""
    validated(records).select(F.concat_ws("\t", "image_path", "text").alias("value")).write.text(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Records from tab-separated lines, cut at the first tab; a line without one raises with its content.

    A name that is empty gets the line's byte order in its file (``line`` counts lines of a partition).
    """
    lines = spark.read.text(path).where("value <> ''").withColumn("line", F.monotonically_increasing_id())
    at = F.instr("value", "\t")
    cut = lines.withColumn("_at", F.when(at == 0, F.raise_error(F.concat(F.lit("no tab separator in: "), "value")).cast("int")).otherwise(at))
    image = F.substring("value", F.lit(1), F.col("_at") - 1)
    stem = F.regexp_replace(F.substring_index("image_path", "/", -1), r"(?<=.)\.[^.]*$", "")
    rows = cut.select("line", image.alias("image_path"), F.substring("value", F.col("_at") + 1, F.length("value")).alias("raw"))
    return rows.select(
        F.coalesce(F.nullif(stem, F.lit("")), F.format_string("openocr_%06d", "line")).alias("sample_id"),
        "image_path",
        text.normalize("raw").alias("text"),
        *[F.lit("unknown").alias(c) for c in REQUIRED[3:]],
        text.length_bucket(text.normalize("raw")).alias("text_length_bucket"),
    )


def read_csv(spark: SparkSession, path: str, schema: str, keep: str | None = None) -> DataFrame:
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')
    return rows.where(keep) if keep else rows


def read_metric_documents(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """One row per JSON document, named after its folder."""
    rows = spark.read.schema(schema).json(pattern, multiLine=True)
    return rows.withColumn("checkpoint", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def write_csv(rows: DataFrame, path: str, quote_all: bool = False) -> None:
    """One CSV file with a header: for reports, whose rows are few."""
    rows.coalesce(1).write.csv(path, header=True, quoteAll=quote_all, escape='"')


def write_counts(counts: DataFrame, path: str, name: str) -> None:
    """A counter as CSV, the most frequent first, ties by name."""
    write_csv(counts.orderBy(F.desc("count"), name), path, quote_all=True)


def union_of_columns(frames: list[DataFrame]) -> DataFrame:
    """All rows under the union of their columns, in order of the names."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*sorted(out.columns))
