import base64
import hashlib
import random
import zlib

import pytest

from lexigauge.llm import warc

PAGES = [
    (5, "http://x.com/b", "same"), (3, "http://x.com/a\r\nWARC-Type: resource", "same"), (4, "http://a.x.com/", None), (7, None, ""),
    (8, "no scheme", "é" * 1000), (9, "http://x.com/b", "other"), (None, "http://x.com/b", "same"), (None, "u", "alone"), (9, "http://x.com/b", "other"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id bigint, url string, html string, refers_to string, n int").repartition(3)


def test_histories(pages):
    rows = warc.warc_histories(pages).collect()
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    wanted = []
    for i, _, h in PAGES:
        data, response = (h or "").encode(), first.get(h or "")
        kind = "response" if i == response else "revisit"
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        wanted.append((str(i), len(data), digest, kind, str(None if i == response else response)))
    got = [(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in rows]
    assert sorted(got) == sorted(wanted)
    keys = [(r["url_key"], r["capture_time"], r["page_id"] is not None, r["page_id"] or 0) for r in rows]
    assert keys == sorted(keys)
    assert warc.warc_histories(pages.limit(0)).count() == 0


def test_small_payloads_are_not_revisited(pages):
    kinds = {r["record_type"] for r in warc.warc_histories(pages, min_revisit_bytes=5).collect() if r["payload_bytes"] < 5}
    assert kinds == {"response"}


def test_archives_are_gzip_members_at_their_offsets(pages):
    for row in warc.write_archives(pages, run_bytes=10, segment_bytes=100).collect():
        content = bytes(row["content"])
        for lo, hi in zip(row["offsets"], row["offsets"][1:]):
            fields, http, payload = warc.read_record(zlib.decompress(content[lo:hi], 31))
            assert fields["WARC-Type"] == "revisit" or len(payload) == int(http["Content-Length"])
        assert row["offsets"][-1] == len(content)


def test_damaged_records_raise():
    good = warc.write_record(1, "http://x/", b"payload", False, None)
    with pytest.raises(ValueError):
        warc.read_record(good.replace(b"payload", b"pay1oad"))
    with pytest.raises(ValueError):
        warc.read_record(good[:-5])


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 8, 33])
def test_loser_tree(k):
    rnd = random.Random(k)
    runs = [sorted(rnd.randint(0, 50) for _ in range(rnd.randint(0, 20))) for _ in range(k)]
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("http://WWW.x.com/A?b") == "com,x,www)/A?b"
    assert warc.url_key("plain") == "plain"
