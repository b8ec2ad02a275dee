"""Byte-level BPE: vocabularies, and encoding and decoding by a global shuffle of distinct words.

Encoding. Each block (the rows of one Arrow batch) cuts its texts into pre-tokens; the sequence of
pre-tokens stays with the block as positions in the block's own word list, and the word list is
dealt out by a hash of the word. There every distinct word of the corpus is encoded once, its ids go
back to the blocks that asked, and the blocks put the ids of their texts together by position. So
what is shuffled is a word list per block and not a row per pre-token; a word that every text uses
is one entry per block.

Decoding joins the ids with the table of token bytes. The table's size is the vocabulary's, so it is
the side that every worker holds, as an array by id; a join with one row per id would move four
times the text to look up the same.
"""

from __future__ import annotations

import base64
import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import shuffle_partitions, staged

#: One regular expression that takes a whole piece: pieces are cut before they come here.
WHOLE = r"(?s).+"
#: Text of one block: its pre-tokens and word list are a task's memory.
BLOCK_BYTES = 8 << 20


def ranks_of(data: bytes) -> dict[bytes, int]:
    """Ranks in the text form ``base64 rank``."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def _byte_letters() -> dict[str, int]:
    """The letters by which the JSON form of a byte-level vocabulary writes bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def ranks_of_json(data: bytes) -> tuple[dict[bytes, int], dict[str, int]]:
    """(ranks, special tokens) of a byte-level BPE in JSON form whose ids follow its merges."""
    doc = json.loads(data)
    model, letters = doc["model"], _byte_letters()
    special = {t["content"]: t["id"] for t in doc.get("added_tokens", [])}
    vocab = {k: v for k, v in model["vocab"].items() if k not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab[a + b] for a, b in merges]
    if made != sorted(made):
        raise ValueError("the vocabulary's ids do not follow the order of its merges")
    return {bytes(letters[c] for c in k): v for k, v in vocab.items()}, special


@lru_cache(maxsize=4)
def encoder(ranks_key: bytes, kind: str) -> tuple[tiktoken.Encoding, dict[str, int]]:
    """The BPE engine for a vocabulary file's content (cached for each worker process)."""
    ranks, special = (ranks_of(ranks_key), {}) if kind == "ranks" else ranks_of_json(ranks_key)
    return tiktoken.Encoding("own", pat_str=WHOLE, mergeable_ranks=ranks, special_tokens={}), special


def encode_piece(enc: tiktoken.Encoding, piece: bytes) -> list[int]:
    return enc._core_bpe.encode_single_piece(piece)


def token_table(enc: tiktoken.Encoding) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all tokens, offsets by id): the vocabulary's token-byte table."""
    values = enc._mergeable_ranks
    by_id = {i: b for b, i in values.items()}
    parts = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return np.frombuffer(b"".join(parts), np.uint8), offsets


def decode(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> bytes:
    data, offsets = table
    starts = offsets[ids]
    return data[textvec.positions(starts, offsets[ids + 1] - starts)].tobytes()


# ---------------------------------------------------------------- the three steps of encoding

SEQUENCES = "block string, doc_ids array<bigint>, counts array<int>, codes binary"
WORD_LISTS = "block string, bucket int, codes binary, lengths binary, data binary"


def _packed(data: bytes) -> bytes:
    """Compressed here, so that the staged table and every shuffle carry the small form."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _planes(values: np.ndarray) -> bytes:
    """32-bit integers by byte plane, compressed: the high bytes are runs."""
    return _packed(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _from_planes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(_unpacked(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).reshape(-1).view("<u4")


def _bucket_of(words: pa.Array, buckets: int) -> np.ndarray:
    """A bucket for each word, by its bytes alone."""
    off, buf = _spans(words)
    return (textvec.span_hashes(buf, off[:-1], off[1:], textvec.IDENTITY) % np.uint64(buckets)).astype(np.int32)


def _spans(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return off, np.frombuffer(words.buffers()[2], np.uint8)


def _words_of(lengths: bytes, data: bytes) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum(_from_planes(lengths), dtype=np.int64)])
    return textvec.binary_array(np.frombuffer(_unpacked(data), np.uint8), bounds)


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int):
    """(name, ids, pre-tokens as an Arrow dictionary, their number by text) of each block.

    A block is named by what it holds, so every pass and every rerun of a task names it alike.
    """
    for batch in batches:
        for lo, hi, buf, off in textvec.chunks(batch.column("text"), block_bytes):
            bounds = textvec.pretokens(buf, off)
            coded = textvec.binary_array(buf, bounds).dictionary_encode()
            counts = np.diff(np.searchsorted(bounds[:-1], off)).astype(np.int32)
            ids = batch.column("doc_id").slice(lo, hi - lo).to_pylist()
            name = xxhash.xxh3_128()
            name.update(buf.tobytes())
            name.update(off.tobytes())
            name.update(str(ids).encode())
            yield name.hexdigest(), ids, coded, counts


def _cut_sequences(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, coded, counts in _blocks(batches, block_bytes):
            codes = _planes(coded.indices.to_numpy().astype(np.uint32))
            yield _record([(block, ids, counts.tolist(), codes)], _SEQUENCES)

    return run


def _cut_words(buckets: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, coded, _ in _blocks(batches, block_bytes):
            words = coded.dictionary
            if not len(words):
                continue
            bucket = _bucket_of(words, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            starts, flat = _spans(words)
            sizes = np.diff(starts)
            rows = []
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                own = order[cuts[b] : cuts[b + 1]]
                data = _packed(flat[textvec.positions(starts[own], sizes[own])].tobytes())
                rows.append((block, b, _planes(own), _planes(sizes[own]), data))
            yield _record(rows, _WORDS)  # one batch a block: a batch of one row costs as much as one of many

    return run


_SEQUENCES = pa.schema(
    [("block", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("codes", pa.binary())]
)
_WORDS = pa.schema(
    [("block", pa.string()), ("bucket", pa.int32()), ("codes", pa.binary()), ("lengths", pa.binary()), ("data", pa.binary())]
)


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )


_SCHEMA2 = pa.schema([("block", pa.string()), ("codes", pa.binary()), ("lengths", pa.binary()), ("data", pa.binary())])


#: Word lists that are looked up together.
LISTS = 64


def _encode_bucket(content: bytes, kind: str):
    """Encodes each distinct word of a bucket once; lists come and go, only the words' ids are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = PieceCache(encoder(content, kind)[0], limit=None)
        for batch in batches:
            for lo in range(0, batch.num_rows, LISTS):
                part = batch.slice(lo, LISTS)
                lists = [_words_of(a, b) for a, b in zip(part["lengths"].to_pylist(), part["data"].to_pylist(), strict=True)]
                coded = pa.concat_arrays(lists).dictionary_encode()
                flat, sizes = cache.flat(coded.dictionary)
                begin = np.cumsum(sizes) - sizes
                codes, at, rows = coded.indices.to_numpy(), 0, []
                for block, own, words in zip(part["block"].to_pylist(), part["codes"].to_pylist(), lists, strict=True):
                    mine = codes[at : at + len(words)]
                    at += len(words)
                    take = textvec.positions(begin[mine], sizes[mine])
                    rows.append((block, own, _planes(sizes[mine]), _planes(flat[take])))
                yield _record(rows, _SCHEMA2)

    return run


_SCHEMA3 = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_sha256", pa.string()),
        ("decoded_sha256", pa.string()),
    ]
)


def _reassemble(left: pa.Table, right: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, token ids of all texts of the block, bounds of each text)."""
    own = np.concatenate([_from_planes(x) for x in right["codes"].to_pylist()] or [np.zeros(0, np.uint32)])
    sizes = np.concatenate([_from_planes(x) for x in right["lengths"].to_pylist()] or [np.zeros(0, np.uint32)])
    ids = np.concatenate([_from_planes(x) for x in right["data"].to_pylist()] or [np.zeros(0, np.uint32)])
    size_of = np.zeros(int(own.max()) + 1 if len(own) else 0, np.int64)
    size_of[own] = sizes
    begin = np.zeros(len(size_of), np.int64)
    begin[own] = np.cumsum(sizes, dtype=np.int64) - sizes
    known = np.zeros(len(size_of), bool)
    known[own] = True
    doc_ids, flat, bounds = [], [], [0]
    for docs, counts, codes in zip(
        left["doc_ids"].to_pylist(), left["counts"].to_pylist(), left["codes"].to_pylist(), strict=True
    ):
        codes = _from_planes(codes)
        if len(codes) and (int(codes.max()) >= len(known) or not known[codes].all()):
            raise ValueError("a block's words are missing: the texts were not dealt out alike twice")
        n = size_of[codes]
        flat.append(ids[textvec.positions(begin[codes], n)])
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(counts)]
        doc_ids += docs
        bounds += (bounds[-1] + ends).tolist() if len(docs) else []
    return doc_ids, np.concatenate(flat) if flat else np.zeros(0, np.uint32), np.array(bounds)


def encode_blocks(docs: DataFrame, vocabulary: bytes, kind: str = "ranks", block_bytes: int = BLOCK_BYTES, stable: bool = False):
    """(sequences, encoded words), to be cogrouped by ``block``.

    The texts are read twice, once for each, instead of keeping the cut texts on disk; so ``docs`` must
    give the same partitions both times. A scan of files does (say so with ``stable``); anything else is
    written first. Blocks that don't meet their words raise. The vocabulary travels as the content of
    its file, whose size is fixed; executors read no path.
    """
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    rows = rows if stable else staged(rows, "bpe-texts")
    buckets = shuffle_partitions(docs.sparkSession)
    encoded = (
        rows.mapInArrow(_cut_words(buckets, block_bytes), WORD_LISTS)
        .groupBy("bucket")
        .applyInArrow(_encode_bucket(vocabulary, kind), "block string, codes binary, lengths binary, data binary")
    )
    return rows.mapInArrow(_cut_sequences(block_bytes), SEQUENCES), encoded


def encode(
    docs: DataFrame, vocabulary: bytes, kind: str = "ranks", block_bytes: int = BLOCK_BYTES, stable: bool = False
) -> DataFrame:
    """doc_id and ``ids`` (array of token ids) for each row of ``docs`` (doc_id, text)."""

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        doc_ids, flat, bounds = _reassemble(left, right)
        ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.astype(np.int32)))
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": ids})

    return _by_block(*encode_blocks(docs, vocabulary, kind, block_bytes, stable), join, "doc_id bigint, ids array<int>")


def _by_block(sequences: DataFrame, encoded: DataFrame, function, schema: str) -> DataFrame:
    return sequences.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(function, schema)


def round_trip(
    docs: DataFrame, vocabulary: bytes, kind: str = "ranks", block_bytes: int = BLOCK_BYTES, stable: bool = False
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row of ``docs`` (doc_id, text).

    The ids are digested as little-endian 32-bit integers; the decoded bytes come from the ids
    through the token-byte table. Null text counts as empty: no tokens. Texts of any length are one
    sequence. Repeated rows and null ids come back one for one; an empty table gives no rows; other
    columns of ``docs`` are ignored, whatever their names.
    """

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        doc_ids, flat, bounds = _reassemble(left, right)
        enc, _ = encoder(vocabulary, kind)
        table = token_table(enc)
        rows = []
        for doc, lo, hi in zip(doc_ids, bounds[:-1], bounds[1:], strict=True):
            ids = flat[lo:hi]
            rows.append(
                (
                    doc,
                    int(hi - lo),
                    hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                    hashlib.sha256(decode(ids, table)).hexdigest(),
                )
            )
        return pa.Table.from_batches([_record(rows, _SCHEMA3)] if rows else [], _SCHEMA3)

    return _by_block(
        *encode_blocks(docs, vocabulary, kind, block_bytes, stable),
        join,
        "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )


def read_vocabulary(path: str) -> bytes:
    """The content of a vocabulary file, read once on the driver."""
    with open(path, "rb") as file:
        return file.read()


class PieceCache:
    """Ids of distinct pieces, each encoded once; it holds ``limit`` pieces at most (None: all that come).

    A piece's ids are held as bytes: a list of integers is some five times as large.
    """

    def __init__(self, enc: tiktoken.Encoding, limit: int | None = 100_000):
        self.enc, self.limit, self.known = enc, limit, {}

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        known, out = self.known, []
        for p in pieces:
            got = known.get(p)
            if got is None:
                got = array("I", encode_piece(self.enc, p)).tobytes()
                if self.limit is None or len(known) < self.limit:
                    known[p] = got
            out.append(got)
        return out

    def flat(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, one after the other, and their numbers)."""
        held = self.ids(pieces.to_pylist())
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        return np.frombuffer(b"".join(held), np.uint32), sizes

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds by text) of a chunk of texts."""
        bounds = textvec.pretokens(buf, off)
        coded = textvec.binary_array(buf, bounds).dictionary_encode()
        flat, sizes = self.flat(coded.dictionary)
        begin = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        n = sizes[codes]
        upto = np.concatenate([[0], np.cumsum(n)])
        return flat[textvec.positions(begin[codes], n)], upto[np.searchsorted(bounds[:-1], off)]
