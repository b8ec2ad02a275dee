"""Notices that differ in a word are told apart."""

from lexigauge.llm import queries


def test_only_the_license_that_is_there(spark, tmp_path):
    line = "This work is licensed under the GNU General Public License, version {}."
    three, two, gap = line.format(3), line.format(2), " filler words in between the notices of this text "
    texts = [f"a b {three} c d", f"a b {two} c d", three + gap + two, f"{two} {three}", "Released under the MIT License."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op3_license_scan"](spark, str(tmp_path)).collect()
    both = [(3, "GPL-2.0"), (3, "GPL-3.0")]
    want = [(0, "GPL-3.0"), (1, "GPL-2.0"), (2, "GPL-2.0"), (2, "GPL-3.0"), *both, (4, "MIT")]
    assert sorted((r["doc_id"], r["license"]) for r in rows) == want
    assert {r["containment"] for r in rows} == {1.0} and {r["n_places"] for r in rows if r["doc_id"] == 2} == {1}
