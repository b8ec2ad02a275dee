import json

import pytest

from lexigauge.operators import audit, inference, leaderboard, relations, sampling, statistics, windows
from lexigauge.sources import images, manifests, reports
from lexigauge.streaming import monitor


def test_shards_are_contiguous_and_even(spark):
    rows = relations.shards(spark.range(17), ["id"], 5).groupBy("shard").count().orderBy("shard").collect()
    assert [r["count"] for r in rows] == [4, 4, 3, 3, 3]
    few = relations.shards(spark.range(2), ["id"], 5).orderBy("id").collect()
    assert [r["shard"] for r in few] == [0, 1]


def test_running_totals_over_many_partitions(spark):
    rows = windows.running_total(spark.range(0, 1000, 1, 16), ["id"], "id", "t").collect()
    assert all(r["t"] == r["id"] * (r["id"] + 1) // 2 for r in rows)


def test_samples_nest_and_cover(spark):
    rows = spark.range(200).selectExpr("id", "cast(id % 7 as string) as s")
    full, small = sampling.nested(rows, ["s"], [70, 14], 1, "id")
    assert {r["s"]: r["count"] for r in full.groupBy("s").count().collect()} == {str(k): 10 for k in range(7)}
    assert {r["id"] for r in small.collect()} <= {r["id"] for r in full.collect()}
    assert small.count() == 14


def test_rare_preferring_sample(spark):
    rows = spark.createDataFrame([(k, "қ" if k < 5 else "x") for k in range(50)], "id int, text string")
    got = sampling.prefer_rare(rows, 9, 3, "text", ["id"]).collect()
    assert len(got) == 9 and sum(r["text"] == "қ" for r in got) == 3
    assert sampling.prefer_rare(rows, 48, 3, "text", ["id"]).count() == 48
    assert sampling.prefer_rare(rows, 60, 3, "text", ["id"]).count() == 50


def test_auroc_edges(spark):
    schema = "score double, exact_match double"
    assert statistics.auroc(spark.createDataFrame([(0.1, 1.0), (0.9, 1.0)], schema)).first()[0] is None
    assert statistics.auroc(spark.createDataFrame([(0.9, 1.0), (0.1, 0.0), (None, 0.0)], schema)).first()[0] == 1.0
    assert statistics.auroc(spark.createDataFrame([(0.5, 1.0), (0.5, 0.0)], schema)).first()[0] == 0.5


def test_wilson_of_nothing(spark):
    assert tuple(spark.range(1).select(statistics.wilson("id", "id").alias("w")).first()["w"]) == (0.0, 0.0)


def test_checkpoints_in_numeric_order(spark):
    names = ["epoch_10.pth", "latest.pth", "epoch_9.pth", "best.pth"]
    df = spark.createDataFrame([(n,) for n in names], "name string").orderBy(leaderboard.checkpoint_key("name"))
    assert [r["name"] for r in df.collect()] == ["epoch_9.pth", "epoch_10.pth", "best.pth", "latest.pth"]


def test_defaults_are_marked(spark):
    row = leaderboard.rename_metrics(spark.createDataFrame([(0.1, None)], "a double, b double"), {"a": "cer"}, {"b": 2.0, "c": 3.0}).first()
    assert (row["cer"], row["b"], row["c"], row["defaulted"]) == (0.1, 2.0, 3.0, ["b", "c"])


RECORD = {
    "sample_id": "s1", "image_path": "a/b.png", "text": " x  y ", "language": "kk", "layout_type": "l",
    "degradation_profile": "d", "crop_type": "line", "source_page_id": "p",
}


def test_manifest_round_trip_and_validation(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text(json.dumps(RECORD) + "\n\n" + json.dumps(RECORD | {"sample_id": "s2", "text": "", "language": None}) + "\n")
    rows = manifests.load_manifest(spark, str(path), validate=False)
    good, bad = manifests.split_valid(rows)
    assert [r["text"] for r in good.collect()] == ["x y"]
    assert bad.first()["missing"] == ["text", "language"]
    with pytest.raises(Exception, match="text, language"):
        manifests.load_manifest(spark, str(path)).collect()
    manifests.save_manifest(good, str(tmp_path / "out"))
    assert manifests.load_manifest(spark, str(tmp_path / "out")).first()["text_length_bucket"] == "short"


def test_label_files(spark, tmp_path):
    good = manifests.validated(spark.createDataFrame([RECORD], manifests.MANIFEST.split(", bbox")[0]))
    manifests.write_labels(good, str(tmp_path / "labels"))
    row = manifests.read_labels(spark, str(tmp_path / "labels")).first()
    assert (row["sample_id"], row["image_path"], row["text"], row["language"]) == ("b", "a/b.png", "x y", "unknown")
    (tmp_path / "bad.txt").write_text("no tab here\n")
    with pytest.raises(Exception, match="no tab"):
        manifests.read_labels(spark, str(tmp_path / "bad.txt")).collect()


def test_crop_specs(spark):
    zones = json.dumps([{"text": "z", "bbox": [0, 0, 1, 1], "type": "table_cell"}, {"text": " ", "bbox": [0, 0, 1, 1]}, {"text": "q", "bbox": []}])
    schema = "page_id string, ocr_bboxes array<array<double>>, ocr_labels array<string>, ocr_region_ids array<string>, zones_json string"
    df = spark.createDataFrame([("p", [[0.0, 0.0, 1.0, 1.0], [0.0, 1.0, 1.0, 2.0]], ["a", " "], [], zones)], schema)
    got = sorted((r["crop_type"], r["text"], r["region_id"]) for r in audit.crop_specs(df, ("line", "zone", "table_cell")).collect())
    assert got == [("line", "a", "line_0000"), ("table_cell", "z", "zone_0000")]


def test_inference_failures_are_not_text(spark):
    def make():
        def model(images, prompts):
            if "bad" in images:
                raise OSError("unreadable")
            return [i.upper() for i in images]

        return model

    inference.register_backend("upper", make)
    rows = spark.createDataFrame([("a", None), ("bad", None), ("c", None)], "image_url string, prompt string").coalesce(1)
    done = inference.predict(rows, inference.backend_factory("upper"))
    got = done.collect()
    assert [r["prediction"] for r in got] == ["A", "", "C"]
    assert got[1]["error"] == "OSError: unreadable" and inference.summary(done).first()["failed"] == 1
    with pytest.raises(ValueError):
        inference.backend_factory("none")


def test_tar_members(spark, tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "x.tar", "w") as tar:
        for name in ("a.png", "b.txt"):
            info = tarfile.TarInfo(name)
            info.size = 2
            tar.addfile(info, io.BytesIO(b"hi"))
    row = images.read_tar_members(spark, str(tmp_path / "x.tar"), r"\.png$").collect()
    assert len(row) == 1 and row[0]["image_path"].endswith("x.tar::a.png") and bytes(row[0]["content"]) == b"hi"


def test_reports(spark):
    df = spark.createDataFrame([("g|h", 1.5, None)], "a string, b double, c string")
    assert "| g\\|h | 1.5000 |  |" in reports.markdown_table(df, "T")
    ex = spark.createDataFrame([("best", "s", "<b>", "x", 0.5)], "qualitative_group string, sample_id string, reference string, prediction string, cer double")
    assert "&lt;b&gt;" in reports.html_examples(ex, "t")


def test_stream_sees_each_file_once(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()

    def put(name, prediction):
        row = {"checkpoint": name, "sample_id": "1", "reference": "abc def", "prediction": prediction}
        (folder / f"{name}.jsonl").write_text(json.dumps(row) + "\n")

    def drain():
        monitor.watch_predictions(spark, str(folder), str(tmp_path / "state"), lambda t, n: seen.extend(t.collect()), every=None).awaitTermination()

    put("epoch_1", "abc def")
    drain()
    put("epoch_2", "xxx")
    drain()
    drain()
    assert [(r["checkpoint"], r["status"], r["is_best"]) for r in seen] == [("epoch_1", "PASS", True), ("epoch_2", "SMOKE_FAIL", False)]


def test_stream_gates_whole_checkpoints(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    for part, prediction in enumerate(("abc def", "xxx xxx")):
        row = {"checkpoint": "epoch_1", "sample_id": str(part), "reference": "abc def", "prediction": prediction}
        (folder / f"part{part}.jsonl").write_text(json.dumps(row) + "\n")
        monitor.watch_predictions(spark, str(folder), str(tmp_path / "state"), lambda t, n: seen.extend(t.collect()), every=None).awaitTermination()
    assert [(r["val_rec_count"], round(r["val_rec_cer"], 4), r["status"]) for r in seen] == [(1.0, 0.0, "PASS"), (2.0, 0.4286, "SMOKE_FAIL")]
