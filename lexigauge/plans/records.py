"""Recognition records, boxes and manifests derived from the driver's tables.

The driver has no predictions, so they are made: every line of every conversation turn is cut at
its full stops, each piece is a reference, and its prediction is damaged in one of eight ways that its place decides. The SQL side
makes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry

#: Letters beyond ASCII in the driver's tables, their plain forms, and the ones that stand for rare letters.
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
PLAIN = "ACEEEINOOUsaceeeinoou"
RARE = "äçèéñöü"
LANGUAGES = ("en", "de", "fr", "es")
DEGRADATIONS = ("clean", "phone_photo", "low_dpi_scan", "old_paper", "official_stamp", "photocopy", "unknown")
LAYOUTS = ("paragraph", "tables_transactional", "forms")
#: How many variants of damage there are.
VARIANTS = 8


def _named(names: tuple[str, ...], number: str) -> str:
    cases = " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names))
    return f"CASE ({number}) % {len(names)} {cases} END"


VARIANT = f"((conv_id * 31 + turn * 7 + line_no) % {VARIANTS})"
PREDICTION = f"""CASE {VARIANT}
    WHEN 0 THEN reference
    WHEN 1 THEN translate(reference, '{LETTERS}', '{PLAIN}')
    WHEN 2 THEN ''
    WHEN 3 THEN replace(reference, 'e', '')
    WHEN 4 THEN concat(reference, ' ', reference)
    WHEN 5 THEN replace(replace(reference, 'er', 're'), 'é', 'e')
    WHEN 6 THEN replace(lower(reference), 'a', 'o')
    ELSE replace(reference, ' ', '  ') END"""
DIMENSIONS = {
    "language": _named(LANGUAGES, "conv_id"),
    "degradation_profile": _named(DEGRADATIONS, "conv_id + turn"),
    "layout_type": _named(LAYOUTS, "conv_id + line_no"),
}
SCORE = "((conv_id * 37 + turn * 11 + line_no * 5) % 101) / 100.0D"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    lines = turns.select(
        "conv_id", "turn", "role", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"[.\n]")).alias("line_no", "reference")
    )
    return lines.select(
        "*",
        F.expr("concat_ws(':', conv_id, turn, line_no)").alias("sample_id"),
        F.col("conv_id").cast("string").alias("source_page_id"),
        F.expr("conv_id * 1000000L + turn * 1000 + line_no").alias("pos"),
        F.expr(PREDICTION).alias("prediction"),
        F.expr(SCORE).alias("score"),
        *[F.expr(e).alias(n) for n, e in DIMENSIONS.items()],
    )


def line_boxes(recs: DataFrame) -> DataFrame:
    """(page_id, line_id, box): two columns of lines, turns side by side."""
    x = "10.0D + (turn % 2) * 300"
    y = "floor(turn / 2) * 300 + line_no * 20 + (conv_id % 3) * 5"
    return recs.select(
        F.col("source_page_id").alias("page_id"),
        F.col("sample_id").alias("line_id"),
        geometry.box(F.expr(x), F.expr(y), F.expr(f"{x} + least(280, 10 + 5 * char_length(reference))"), F.expr(f"{y} + 16")).alias("box"),
    )


def zone_boxes(recs: DataFrame) -> DataFrame:
    """(page_id, zone_id, box, text, order, reading_order): a zone for each turn, as high as ten lines."""
    turns = recs.groupBy("conv_id", "turn").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "reference"))), lambda r: r["reference"]), " ").alias("text")
    )
    x = "5.0D + (turn % 2) * 300"
    y = "floor(turn / 2) * 300.0D"
    return turns.select(
        F.col("conv_id").cast("string").alias("page_id"),
        F.expr("concat_ws(':', conv_id, turn)").alias("zone_id"),
        geometry.box(F.expr(x), F.expr(y), F.expr(f"{x} + 290"), F.expr(f"{y} + 200")).alias("box"),
        "text",
        F.expr("CASE WHEN conv_id % 3 = 0 THEN CAST(turn AS INT) END").alias("order"),
        F.expr("CASE WHEN conv_id % 3 = 1 THEN CAST(-turn AS INT) END").alias("reading_order"),
    )


def page_records(recs: DataFrame) -> DataFrame:
    """(page_id, reference, prediction): each conversation's lines as one text; odd pages read their turns backwards."""
    row = F.struct("pos", "reference", "prediction")
    back = F.struct((-F.col("turn")).alias("t"), "line_no", "prediction")
    pages = recs.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("r"), F.array_sort(F.collect_list(back)).alias("b"))
    return pages.select(
        F.col("conv_id").alias("page_id"),
        F.array_join(F.transform("r", lambda x: x["reference"]), " ").alias("reference"),
        F.when(F.col("conv_id") % 2 == 0, F.array_join(F.transform("r", lambda x: x["prediction"]), " "))
        .otherwise(F.array_join(F.transform("b", lambda x: x["prediction"]), " "))
        .alias("prediction"),
    )
