from pyspark.sql import functions as F

from lexigauge.functions import geometry, text
from lexigauge.operators import pages, reading_order


def boxes(spark, rows, page="p"):
    df = spark.createDataFrame([(page, i, *b) for i, b in enumerate(rows)], "page_id string, box_id int, x1 double, y1 double, x2 double, y2 double")
    return df.select("page_id", "box_id", geometry.box("x1", "y1", "x2", "y2").alias("box"))


def order(df, mode="layout_aware", width=600, layout="paragraph"):
    out = reading_order.reading_order(df.withColumns({"page_width": F.lit(width), "layout_type": F.lit(layout)}), mode)
    return [r["box_id"] for r in out.orderBy("position").collect()]


def test_two_columns_read_one_after_the_other(spark):
    rows = [(10.0, y, 200.0, y + 20.0) for y in (10.0, 50.0, 90.0)] + [(400.0, y, 590.0, y + 20.0) for y in (12.0, 52.0, 92.0)]
    assert order(boxes(spark, rows)) == [0, 1, 2, 3, 4, 5]


def test_overlapping_lines_keep_their_order(spark):
    rows = [(10.0, 40.0, 500.0, 80.0), (12.0, 10.0, 498.0, 50.0), (11.0, 70.0, 499.0, 110.0)]
    assert order(boxes(spark, rows)) == [1, 0, 2]


def test_tables_read_by_row(spark):
    rows = [(300.0, 10.0, 400.0, 30.0), (10.0, 11.0, 110.0, 31.0), (10.0, 60.0, 110.0, 80.0), (300.0, 61.0, 400.0, 81.0)]
    assert order(boxes(spark, rows), layout="exam_table") == [1, 0, 2, 3]


def test_unknown_mode_raises(spark):
    import pytest

    with pytest.raises(ValueError):
        reading_order.reading_order(boxes(spark, []), "other")


def _line(spark, page, name, corners):
    return spark.createDataFrame([(page, name, *corners)], "page_id string, line_id string, x1 double, y1 double, x2 double, y2 double").select(
        "page_id", "line_id", geometry.box("x1", "y1", "x2", "y2").alias("box")
    )


def test_zone_takes_its_page_s_lines(spark):
    zones = _line(spark, "p1", "z", (0.0, 0.0, 100.0, 50.0)).withColumnRenamed("line_id", "zone_id")
    lines = _line(spark, "p1", "l1", (5.0, 5.0, 90.0, 20.0)).unionByName(_line(spark, "p2", "l2", (5.0, 5.0, 90.0, 20.0)))
    lines = lines.unionByName(_line(spark, "p1", "l3", (5.0, 200.0, 90.0, 220.0))).unionByName(_line(spark, "p1", "l4", (5.0, 25.0, 90.0, 40.0)))
    shown = spark.createDataFrame([("l1", " one  two ")], "line_id string, prediction string")
    row = pages.zone_from_lines(zones, lines, shown).first()
    assert (row["prediction"], row["line_ids"], row["line_count"]) == ("one two", ["l1", "l4"], 2)
    far = _line(spark, "p9", "z9", (0.0, 0.0, 1.0, 1.0)).withColumnRenamed("line_id", "zone_id")
    row = pages.zone_from_lines(far, lines, shown).first()
    assert (row["prediction"], row["line_ids"], row["line_count"]) == ("", [], 0)


def test_half_even_rounding_of_line_keys(spark):
    df = boxes(spark, [(0.0, 30.0, 5.0, 40.0), (0.0, 18.0, 5.0, 28.0)])
    assert [r[0] for r in df.orderBy("box_id").select(geometry.geometric_key("box")["line"]).collect()] == [2.0, 2.0]


def test_box_forms(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], None, None, None, None), (None, 1.0, 2.0, 10.0, 20.0)], "b array<double>, x double, y double, w double, h double")
    got = [tuple(r[0]) for r in df.select(geometry.box_of_array("b", "x", "y", "w", "h")).collect()]
    assert got == [(1.0, 2.0, 3.0, 4.0), (1.0, 2.0, 11.0, 22.0)]


def test_structural_text_and_zone_types(spark):
    rows = [("[stamp]", "zone"), ("text", None), ("text", "line"), ("a [b]", "field")]
    df = spark.createDataFrame(rows, "text string, crop_type string")
    assert [r["text"] for r in pages.evaluable_zones(df).collect()] == ["text", "a [b]"]


def test_group_text_keeps_order_and_counts_missing(spark):
    groups = spark.createDataFrame([("p", ["b", "a", "c"])], "page_id string, crop_ids array<string>")
    shown = spark.createDataFrame([("a", "2"), ("b", "1")], "crop_id string, prediction string")
    row = pages.group_text(groups, shown).first()
    assert (row["prediction"], row["crop_count"]) == ("1\n2", 3)


def test_text_fallbacks(spark):
    df = spark.createDataFrame([(None, "", "r")], "text string, gt_text string, reference string")
    assert df.select(text.zone_text()).first()[0] == "r"
    info = spark.createDataFrame([([("q", "mask"), ("a", "no_mask"), ("b", "no_mask")],)], "i array<struct<text string, tag string>>")
    assert tuple(info.select(*text.prompt_and_reference("i")).first()) == ("q", "b")
    assert info.select(text.page_reference("i")).first()[0] == "a b"
    ids = spark.range(1).select(text.page_id(F.lit("a/b"), F.lit(7)), text.page_id(F.lit("d"), F.lit(12345678)))
    assert tuple(ids.first()) == ("a__b_000007", "d_12345678")
