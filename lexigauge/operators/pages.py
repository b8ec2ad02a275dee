"""Rebuilding zone and page text from lines, zones and predictions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, text
from .windows import numbered

ZONE_TYPES = ("zone", "table_cell", "field")


def ordered_text(key: Column, value: Column, separator: str = "\n") -> Column:
    """Aggregate: the non-blank values in order of ``key``, white space collapsed."""
    rows = F.array_sort(F.collect_list(F.struct(key.alias("key"), text.normalize(value).alias("text"))))
    return F.array_join(F.transform(F.filter(rows, lambda r: r["text"] != ""), lambda r: r["text"]), separator)


def zone_lines(zones: DataFrame, lines: DataFrame, min_overlap: float = 0.5) -> DataFrame:
    """(zone columns, line_id, line_box, overlap) for lines that lie in a zone of their page.

    ``zones`` has page_id, zone_id and box; ``lines`` page_id, line_id and box. The page is the hash
    key; cheap comparisons of edges come before the ratio.
    """
    own = lines.select("page_id", "line_id", F.col("box").alias("line_box"))
    pairs = zones.join(own, "page_id").where(geometry.meets("line_box", "box"))
    return pairs.withColumn("overlap", geometry.overlap_ratio("line_box", "box")).where(F.col("overlap") >= min_overlap)


def zone_from_lines(
    zones: DataFrame, lines: DataFrame, predictions: DataFrame, min_overlap: float = 0.5, separator: str = "\n"
) -> DataFrame:
    """prediction, line_ids and line_count for every zone; a zone without lines has an empty prediction.

    ``predictions`` (line_id, prediction) may lack lines: they add no text but stay listed.
    """
    found = zone_lines(zones, lines, min_overlap).join(predictions, "line_id", "left")
    key = F.struct(geometry.geometric_key("line_box").alias("at"), F.col("line_id").alias("id"))
    built = found.groupBy("page_id", "zone_id").agg(
        ordered_text(key, F.col("prediction"), separator).alias("prediction"),
        F.transform(F.array_sort(F.collect_list(key)), lambda k: k["id"]).alias("line_ids"),
        F.count(F.lit(1)).alias("line_count"),
    )
    empty = F.array().cast("array<string>")
    return zones.join(built, ["page_id", "zone_id"], "left").withColumns(
        {
            "prediction": F.coalesce("prediction", F.lit("")),
            "line_ids": F.coalesce(F.col("line_ids").cast("array<string>"), empty),
            "line_count": F.coalesce("line_count", F.lit(0).cast("long")),
        }
    )


def evaluable_zones(zones: DataFrame) -> DataFrame:
    """Zones of the types that hold text (no type counts as one) whose text is not a bracketed mark."""
    kind = F.coalesce("crop_type", F.lit("zone"))
    return zones.where(kind.isin(*ZONE_TYPES) & ~text.is_structural(F.coalesce("text", F.lit(""))))


def page_text(pages: DataFrame, zones: DataFrame, separator: str = "\n") -> DataFrame:
    """``pages`` (page_id, ...) with the text of their zones (page_id, box, prediction) in geometric order."""
    built = zones.groupBy("page_id").agg(
        ordered_text(F.struct(geometry.geometric_key("box").alias("at"), F.col("zone_id").alias("id")), F.col("prediction"), separator).alias(
            "prediction"
        ),
        F.count(F.lit(1)).alias("zone_count"),
    )
    return pages.join(built, "page_id", "left").withColumns(
        {"prediction": F.coalesce("prediction", F.lit("")), "zone_count": F.coalesce("zone_count", F.lit(0).cast("long"))}
    )


def group_text(groups: DataFrame, predictions: DataFrame, separator: str = "\n") -> DataFrame:
    """Text of pages given as ordered lists of crops (page_id, crop_ids) and predictions (crop_id, prediction)."""
    crops = groups.select("page_id", F.posexplode("crop_ids").alias("pos", "crop_id"))
    built = crops.join(predictions, "crop_id", "left").groupBy("page_id").agg(
        ordered_text(F.col("pos"), F.col("prediction"), separator).alias("prediction"), F.count(F.lit(1)).alias("crop_count")
    )
    return groups.join(built, "page_id", "left").withColumn("prediction", F.coalesce("prediction", F.lit("")))


def oracle_pages(pages: DataFrame, zones: DataFrame, predictions: DataFrame) -> DataFrame:
    """Pages that have zones, their text in the zones' given order and the share of zones without a prediction."""
    seen = zones.join(predictions.withColumn("_has", F.lit(True)), "zone_id", "left")
    key = geometry.zone_order_key("order", "reading_order", "box", "zone_id")
    built = seen.groupBy("page_id").agg(
        ordered_text(key, F.col("prediction")).alias("prediction"),
        F.count(F.lit(1)).alias("zone_count"),
        F.sum(F.col("_has").isNull().cast("int")).alias("failed_zones"),
    )
    return pages.join(built, "page_id").withColumn("failed_zone_rate", F.col("failed_zones") / F.col("zone_count"))


def oracle_summary(scored: DataFrame) -> DataFrame:
    """One row for pages with their metrics: means over pages, and failed zones over all zones."""
    mean = lambda c: F.avg(c).alias(c)
    return scored.agg(
        F.count(F.lit(1)).alias("page_count"),
        F.sum("zone_count").alias("crop_count"),
        *[mean(c) for c in ("cer", "wer", "exact_match", "length_ratio") if c in scored.columns],
        F.avg((F.col("hyp_n") == "").cast("double")).alias("empty_prediction_rate"),
        (F.sum("failed_zones") / F.greatest(F.lit(1), F.sum("zone_count"))).alias("failed_zone_rate"),
    )


def full_page_text(groups: DataFrame, predictions: DataFrame, order: str = "pos") -> DataFrame:
    """``groups`` (page_id, pos, ...) with what a full-page model (model, id, prediction) read, for each model.

    A prediction is named after its page, or ``row_`` and the page's number in six digits, which wins.
    """
    pages = numbered(groups, [order], "_row").withColumn("_name", F.format_string("row_%06d", "_row"))
    by = lambda key, name: pages.join(
        predictions.select("model", F.col("id").alias(key), F.col("prediction").alias(name)), key
    ).select("page_id", "model", name)
    models = predictions.select("model").distinct()
    found = by("_name", "_numbered").join(by("page_id", "_named"), ["page_id", "model"], "full")
    found = found.select("page_id", "model", F.coalesce("_numbered", "_named").alias("prediction"))
    every = groups.join(models)  # a list of models, one row each
    return every.join(found, ["page_id", "model"], "left").withColumn("prediction", F.coalesce("prediction", F.lit("")))


def model_pages(groups: DataFrame, line_predictions: DataFrame, page_predictions: DataFrame, separator: str = "\n") -> DataFrame:
    """(page_id, model, eval_mode, reference, prediction) of models that read lines and models that read pages.

    ``groups`` has page_id, pos, gt_text and crop_ids; line predictions model, crop_id and prediction.
    """
    crops = groups.select("page_id", F.posexplode("crop_ids").alias("at", "crop_id"))
    built = crops.join(line_predictions, "crop_id").groupBy("page_id", "model").agg(
        ordered_text(F.col("at"), F.col("prediction"), separator).alias("prediction")
    )
    every = groups.select("page_id", "gt_text").join(line_predictions.select("model").distinct())
    lines = every.join(built, ["page_id", "model"], "left")
    whole = full_page_text(groups.select("page_id", "pos", "gt_text"), page_predictions)
    parts = [
        rows.select("page_id", "model", F.lit(mode).alias("eval_mode"), F.col("gt_text").alias("reference"), F.coalesce("prediction", F.lit("")).alias("prediction"))
        for rows, mode in ((lines, "pipeline_line"), (whole, "full_page"))
    ]
    return parts[0].unionByName(parts[1])


def detected_pages(pages: DataFrame, detect, recognise) -> DataFrame:
    """``pages`` (page_id, ...) with zones that ``detect`` finds and ``recognise`` reads.

    ``detect`` gives for a page's row (a dictionary) its zones as (zone_id, x1, y1, x2, y2, content);
    ``recognise`` the text of a content. Both run where the page is; a page without zones is empty.
    """
    schema = f"page_id {dict(pages.dtypes)['page_id']}, zone_id string, x1 double, y1 double, x2 double, y2 double, prediction string"

    def run(frames):
        for frame in frames:
            rows = [
                (page["page_id"], str(zone), float(x1), float(y1), float(x2), float(y2), recognise(content))
                for page in frame.to_dict("records")
                for zone, x1, y1, x2, y2, content in detect(page)
            ]
            yield pd.DataFrame(rows, columns=["page_id", "zone_id", "x1", "y1", "x2", "y2", "prediction"])

    zones = pages.mapInPandas(run, schema).withColumn("box", geometry.box("x1", "y1", "x2", "y2"))
    return page_text(pages, zones)


def widest_gap(boxes: DataFrame) -> DataFrame:
    """(page_id, gap, after): the widest step between neighbouring box centers, the first of equal ones."""
    from pyspark.sql import Window

    order = Window.partitionBy("page_id").orderBy("cx", "box_id")
    rows = boxes.withColumn("cx", geometry.center_x("box"))
    rows = rows.withColumn("gap", F.lead("cx").over(order) - F.col("cx")).withColumn("after", F.row_number().over(order))
    return (
        rows.where("gap is not null")
        .groupBy("page_id")
        .agg(F.max(F.struct(F.col("gap"), (-F.col("after")).alias("neg"))).alias("m"))
        .select("page_id", F.col("m.gap").alias("gap"), (-F.col("m.neg")).alias("after"))
    )
