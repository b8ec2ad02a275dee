"""WARC archives: writing with revisits, reading back, and the external merge of capture indexes.

Writing. Each task buffers captures, sorts them by URL key and time and writes them as a run: records
in order, each a gzip member, in segments of bounded size. Segments are rows of a staged table, so
any store that Spark can write will do and a lost executor's run is written again, the same.

Reading parses every record of every segment and checks each response's digest against its payload.

Merging. The index entries (no payloads) are dealt out by ranges of (URL key, time, page id), as an
external merge is done by many tasks at once: the ranges cut every run into slices, and a task merges
its slices with a loser tree, log2(slices) comparisons an entry. The slices come as they were written
and are never sorted again: where an entry is not behind the one before it, another slice begins. The
number of ranges follows the number of entries, so a task holds about MERGE_ENTRIES of them, however
large the runs are; they stay Arrow columns but for their keys. Read partition after partition the
histories are in global order. A url with very many captures is split by time among tasks.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged

RUN_BYTES = 32 << 20
SEGMENT_BYTES = 4 << 20
MIN_REVISIT_BYTES = 0
#: Index entries that a merging task holds, about.
MERGE_ENTRIES = 100_000
#: Captures without a time of their own are this many seconds after it as their page id says.
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    """Base32 SHA-1, upper case, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def url_key(url: str) -> str:
    """The url with its host's labels reversed, so that a domain's captures are neighbours."""
    scheme, mark, rest = url.partition("://")
    if not mark:
        return url
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:]


def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    value = record_id.removeprefix("<urn:x-page:").removesuffix(">")
    return None if value == "null" else int(value)


def capture_time(page_id: int | None) -> str:
    return (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 32))).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_record(page_id: int | None, url: str, payload: bytes, revisit: bool, refers_to: int | None) -> bytes:
    """A response record, or a revisit that has the response's HTTP header and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + END
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {capture_time(page_id)}",
        # a line break or another control character would end the header
        f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    return "\r\n".join(head).encode() + END + body + END


def read_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of a record; raises if it is not whole."""
    head, _, rest = data.partition(END)
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if not version.startswith("WARC/") or rest[size:] != END:
        raise ValueError(f"a damaged record: {fields.get('WARC-Record-ID')}")
    http, _, payload = rest[:size].partition(END)
    headers = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    if fields["WARC-Type"] == "response" and f"sha1:{payload_digest(payload)}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"a payload that is not its digest's: {fields['WARC-Record-ID']}")
    return fields, headers, payload


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# ---------------------------------------------------------------- writing

ARCHIVE = "archive string, run string, segment int, offsets array<int>, content binary"
_ARCHIVE = pa.schema(
    [
        ("archive", pa.string()),
        ("run", pa.string()),
        ("segment", pa.int32()),
        ("offsets", pa.list_(pa.int32())),
        ("content", pa.binary()),
    ]
)


def _write_runs(run_bytes: int, segment_bytes: int):
    def segments(captures: list[tuple], run: str) -> Iterator[pa.RecordBatch]:
        captures.sort(key=lambda c: c[0])
        members, size, number = [], 0, 0
        for k, (_, page_id, url, payload, revisit, refers) in enumerate(captures):
            members.append(_gzip(write_record(page_id, url, payload, revisit, refers)))
            size += len(members[-1])
            if size >= segment_bytes or k == len(captures) - 1:
                offsets = [0]
                for m in members:
                    offsets.append(offsets[-1] + len(m))
                name = f"{run}-{number:05d}.warc.gz"
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], f.type) for x, f in zip((name, run, number, offsets, b"".join(members)), _ARCHIVE, strict=True)],
                    schema=_ARCHIVE,
                )
                members, size, number = [], 0, number + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held, captures = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, payload, revisit, refers = (batch.column(c)[row].as_py() for c in range(5))
                captures.append(((url_key(url), capture_time(page_id), page_id or 0), page_id, url, payload, revisit, refers))
                held += len(payload)
                if held >= run_bytes:
                    yield from segments(captures, f"run-{task:06d}-{n:04d}")
                    captures, held, n = [], 0, n + 1
        if captures:
            yield from segments(captures, f"run-{task:06d}-{n:04d}")

    return run


def _sha(html: Column) -> Column:
    return F.unhex(F.sha2(html, 256))


def write_archives(
    pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES, run_bytes: int = RUN_BYTES, segment_bytes: int = SEGMENT_BYTES
) -> DataFrame:
    """A staged table of archive segments, one record for each row of ``pages`` (page_id, url, html).

    Of payloads that are equal (by SHA-256 and length) and have ``min_revisit_bytes`` at least, the
    capture with the smallest page id is the response and the others revisit it.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    seen = staged(rows.select("page_id", _sha(F.col("html")).alias("sha"), F.octet_length("html").alias("n")), "warc-payloads")
    first = seen.groupBy("sha", "n").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("c")).where("c > 1")
    later = (
        seen.join(first, ["sha", "n"])
        .where(F.col("n") >= min_revisit_bytes)
        .where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "refers_to")
        .distinct()
    )
    rows = rows.withColumn("_own", _sha(F.col("html")))
    marked = rows.join(later, rows["page_id"].eqNullSafe(later["_id"]) & (F.col("_own") == F.col("_sha")), "left").select(
        "page_id", "url", F.col("html").cast("binary").alias("payload"), F.col("_sha").isNotNull().alias("revisit"), "refers_to"
    )
    return staged(marked.mapInArrow(_write_runs(run_bytes, segment_bytes), ARCHIVE), "warc-archives")


# ---------------------------------------------------------------- reading and merging

ENTRY = (
    "url_key string, capture_time string, page_id bigint, run string, seq int, url string, record_type string, "
    "payload_bytes bigint, payload_digest string, refers_to bigint, archive string, offset int, length int"
)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    return pa.schema([(n, kinds[t]) for n, t in (part.split() for part in ddl.split(", "))])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield made()
            held = []
    if held:
        yield made()


def read_archives(archives: DataFrame) -> DataFrame:
    """An index entry for every record, in archive order within each run's segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for row in batch.to_pylist():
                    content, offsets = row["content"], row["offsets"]
                    for seq, (lo, hi) in enumerate(zip(offsets, offsets[1:])):
                        fields, http, _ = read_record(zlib.decompress(content[lo:hi], 31))
                        url = fields["WARC-Target-URI"]
                        refers = fields.get("WARC-Refers-To")
                        yield (
                            url_key(url),
                            fields["WARC-Date"],
                            _page_id(fields["WARC-Record-ID"]),
                            f"{row['run']}/{row['segment']}",
                            seq,
                            url,
                            fields["WARC-Type"],
                            int(http["Content-Length"]),
                            fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                            None if refers is None else _page_id(refers),
                            row["archive"],
                            lo,
                            hi - lo,
                        )

        yield from _batches(rows(), _arrow(ENTRY))

    return archives.mapInArrow(run, ENTRY)


class LoserTree:
    """Merges sorted runs: each inner node remembers the loser of its match, the winner moves up."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key = runs, key
        self.n = max(1, len(runs))
        self.at = [0] * len(runs)
        self.heads = [self._head(k) for k in range(len(runs))]
        self.losers = [-1] * self.n
        for k in range(len(runs)):
            self._play(k)

    def _head(self, k: int):
        run = self.runs[k]
        return (0, self.key(run[self.at[k]]), k) if self.at[k] < len(run) else (1, None, k)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x[0] < y[0] or (x[0] == y[0] == 0 and x[1:] < y[1:])

    def _play(self, k: int) -> None:
        """Moves run k's head up from its leaf; the overall winner ends in node 0."""
        node = (k + self.n) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # the first to come waits for its opponent
                self.losers[node] = k
                return
            if self._less(other, k):
                self.losers[node], k = k, other
            node //= 2
        self.losers[0] = k

    def __iter__(self):
        if not self.runs:
            return
        while self.heads[self.losers[0]][0] == 0:
            k = self.losers[0]
            yield self.runs[k][self.at[k]]
            self.at[k] += 1
            self.heads[k] = self._head(k)
            self._play(k)


def _keys(batch: pa.RecordBatch) -> list[tuple]:
    """What orders the entries: a null page id comes before all others."""
    keys, times, ids = (batch.column(c).to_pylist() for c in ("url_key", "capture_time", "page_id"))
    return [(k, t, i is not None, i or 0) for k, t, i in zip(keys, times, ids, strict=True)]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, keys = [], []
    slices: list[list[int]] = []  # row numbers, each list in order
    newest: dict[str, list[int]] = {}
    for batch in batches:
        at = len(keys)
        keys += _keys(batch)
        held.append(batch)
        for row, run in enumerate(batch.column("run").to_pylist(), at):
            own = newest.get(run)
            if own is None or keys[own[-1]] > keys[row]:
                own = newest[run] = []
                slices.append(own)
            own.append(row)
    if held:
        order = pa.array(list(LoserTree(slices, keys.__getitem__)), pa.int64())
        table = pa.Table.from_batches(held)
        for lo in range(0, len(order), 10_000):
            yield from table.take(order.slice(lo, 10_000)).combine_chunks().to_batches()


def merge_indexes(entries: DataFrame, partitions: int | None = None) -> DataFrame:
    """The entries in global order of (url_key, capture_time, page_id): partition by partition, row by row."""
    n = partitions or max(shuffle_partitions(entries.sparkSession), -(-entries.count() // MERGE_ENTRIES))
    return entries.repartitionByRange(n, "url_key", "capture_time", "page_id").mapInArrow(_merge, ENTRY)


def warc_histories(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes an archive of ``pages`` (page_id, url, html), reads it back and merges its indexes.

    One row per row of ``pages``: page_id, payload_bytes and payload_digest of the full payload,
    record_type, refers_to, and the index entry (url_key, capture_time, url, run, seq, archive,
    offset, length), in global order of url key, time and page id. Null html is an empty payload, a
    null url an empty one (characters that a header can't hold are percent-encoded). A null page id
    comes back as null and is no response if an equal payload has an id. Rows that repeat a page id
    and its payload are the same kind of record each. An empty table gives no rows; other columns of
    ``pages`` are ignored.
    """
    return merge_indexes(staged(read_archives(write_archives(pages, min_revisit_bytes)), "warc-index"))
