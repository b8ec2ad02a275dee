"""What a dataset holds: dimensions, characters, charset, crops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def characters(rows: DataFrame, column: str = "text") -> DataFrame:
    """(char, count) over all texts; each text is counted in its row before anything is shuffled."""
    return (
        rows.select(F.explode(F.split(F.coalesce(F.col(column), F.lit("")), "")).alias("char"))
        .where("char <> ''")
        .groupBy("char")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def charset(rows: DataFrame, column: str = "text") -> DataFrame:
    """Distinct characters but line breaks, in code-point order."""
    return characters(rows, column).where(~F.col("char").isin("\n", "\r")).select("char").orderBy("char")


def audit(rows: DataFrame, dimensions: list[str], column: str = "text", rare: str = text.RARE_CHARS) -> DataFrame:
    """(section, name, count): rows, every dimension's values, rare letters and distinct characters."""
    from .evaluate import coverage

    dims = coverage(rows, dimensions).select(F.col("dimension").alias("section"), F.col("value").alias("name"), "count")
    chars = characters(rows, column)
    letters = rows.sparkSession.createDataFrame([(c,) for c in rare], "char string").join(chars, "char", "left")
    total = rows.agg(F.count(F.lit(1)).alias("count"))
    return (
        total.select(F.lit("rows").alias("section"), F.lit("all").alias("name"), "count")
        .unionByName(dims)
        .unionByName(letters.select(F.lit("rare").alias("section"), F.col("char").alias("name"), F.coalesce("count", F.lit(0).cast("long")).alias("count")))
        .unionByName(chars.agg(F.count(F.lit(1)).alias("count")).select(F.lit("distinct_chars").alias("section"), F.lit("all").alias("name"), "count"))
    )


ZONES = "array<struct<text string, bbox array<double>, zone_type string, type string>>"


def crop_specs(pages: DataFrame, include: tuple[str, ...] = ("line", "zone")) -> DataFrame:
    """(page_id, crop_type, region_id, text, bbox): lines from the page's arrays, zones from its JSON."""
    lines = (
        pages.select("page_id", F.posexplode(F.arrays_zip("ocr_bboxes", "ocr_labels", "ocr_region_ids")).alias("i", "l"))
        .where("trim(l.ocr_labels) <> '' and l.ocr_bboxes is not null")
        .select(
            "page_id",
            F.lit("line").alias("crop_type"),
            F.coalesce("l.ocr_region_ids", F.format_string("line_%04d", "i")).alias("region_id"),
            F.col("l.ocr_labels").alias("text"),
            F.col("l.ocr_bboxes").alias("bbox"),
        )
    )
    kind = F.coalesce("z.zone_type", "z.type", F.lit("zone"))
    zones = (
        pages.select("page_id", F.posexplode(F.from_json("zones_json", ZONES)).alias("i", "z"))
        .where("trim(z.text) <> '' and size(z.bbox) > 0")
        .select(
            "page_id",
            text.infer_crop_type(kind).alias("crop_type"),
            F.format_string("zone_%04d", "i").alias("region_id"),
            F.trim("z.text").alias("text"),
            F.col("z.bbox").alias("bbox"),
        )
    )
    return lines.unionByName(zones).where(F.col("crop_type").isin(*include))
