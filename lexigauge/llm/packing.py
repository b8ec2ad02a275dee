"""Hierarchical multi-length packing of documents into token sequences.

Each task packs its own documents, so nothing is shuffled and no group of documents meets in one
task. A document gives as many full windows as it holds; what is left over is routed to the
smallest tier (context size) that takes it. Every tier is packed into sequences of its own length, the
longest tier first: a tier's largest leftover opens a sequence, whose gap is filled from the shorter
tiers, the largest leftover that fits first; where none fits the shortest is cut, and what remains of
it is routed again. So short leftovers fill the gaps of long windows, and those that are not needed
there make up short sequences. A tier's last, partial sequence of a task is split at powers of two,
which need no padding.

Sequences of one length are dealt to step groups: a group has the same number of tokens at every
length, and the groups of a length have about the same attention cost.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import textvec
from .bpe import PieceCache, encoder
from .common import lean

#: Context sizes; the last is the window that long documents are cut at.
TIERS = (64, 128, 256, 512, 1024)
#: Leftovers that wait at most before they are packed: memory of a task.
POOL = 8192
#: Bytes of the texts that are cut into pre-tokens together: a task's memory, many times as much while they are cut.
CHUNK_BYTES = 1 << 19
#: Full windows of a step group, or as many tokens in shorter sequences.
GROUP = 8

SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("padded_length", pa.int64()),
        ("tier", pa.int64()),
        ("step_group", pa.int64()),
    ]
)
DDL = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, padded_length bigint, tier bigint, step_group bigint"
)


class Piece:
    """Consecutive ids of one document."""

    __slots__ = ("doc_id", "start", "ids", "total")

    def __init__(self, doc_id, start: int, ids: np.ndarray, total: int):
        self.doc_id, self.start, self.ids, self.total = doc_id, start, ids, total

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc_id, self.start, self.ids[:n], self.total),
            Piece(self.doc_id, self.start + n, self.ids[n:], self.total),
        )


class Leftovers:
    """Pieces by length; finds the largest that fits a gap."""

    def __init__(self):
        self.by_length: dict[int, list[Piece]] = {}
        self.lengths = 0  # bit n is set while a piece of n ids waits
        self.n = 0

    def add(self, piece: Piece) -> None:
        n = len(piece.ids)
        self.by_length.setdefault(n, []).append(piece)
        self.lengths |= 1 << n
        self.n += 1

    def _take(self, n: int) -> Piece:
        own = self.by_length[n]
        piece = own.pop()
        if not own:
            self.lengths &= ~(1 << n)
        self.n -= 1
        return piece

    def largest(self, most: int) -> Piece | None:
        fits = self.lengths & ((1 << (most + 1)) - 1)
        return self._take(fits.bit_length() - 1) if fits else None

    def smallest(self) -> Piece | None:
        return self._take((self.lengths & -self.lengths).bit_length() - 1) if self.n else None


class Tiers:
    """Leftovers by tier: each waits in the smallest tier that takes it."""

    def __init__(self, sizes: tuple[int, ...]):
        self.sizes = sizes
        self.pools = [Leftovers() for _ in sizes]

    def add(self, piece: Piece) -> None:
        self.pools[bisect_left(self.sizes, len(piece.ids))].add(piece)

    def __len__(self) -> int:
        return sum(p.n for p in self.pools)

    def filler(self, gap: int, tier: int) -> Piece | None:
        """What goes into a gap of a sequence of ``tier``: what fits from shorter tiers, then from its own; else what can be cut."""
        shorter, own = self.pools[:tier], self.pools[tier]
        for pool in shorter[::-1]:
            if piece := pool.largest(gap):
                return piece
        if piece := own.largest(gap):
            return piece
        for pool in [*shorter, own]:
            if piece := pool.smallest():
                return piece
        return None


def pack(waiting: Tiers, last: bool) -> Iterator[list[Piece]]:
    """Sequences of the tiers' lengths; what fills none stays, or is split at powers of two at the end."""
    for tier in reversed(range(len(waiting.sizes))):
        size, own = waiting.sizes[tier], waiting.pools[tier]
        while own.n:
            opened = own.largest(size)
            filled, used = [opened], len(opened.ids)
            while used < size and (piece := waiting.filler(size - used, tier)):
                if len(piece.ids) > size - used:
                    piece, rest = piece.cut(size - used)
                    waiting.add(rest)
                filled.append(piece)
                used += len(piece.ids)
            if used == size:
                yield filled
            elif last:
                yield from _powers(filled, used)
            else:
                for piece in filled:
                    waiting.add(piece)
                return


def _powers(pieces: list[Piece], used: int) -> Iterator[list[Piece]]:
    """Sequences whose lengths are the powers of two that make up ``used``."""
    queue = pieces[::-1]
    while used:
        size = 1 << (used.bit_length() - 1)
        filled, need = [], size
        while need:
            piece = queue.pop()
            if len(piece.ids) > need:
                piece, rest = piece.cut(need)
                queue.append(rest)
            filled.append(piece)
            need -= len(piece.ids)
        yield filled
        used -= size


class Packer:
    """Packs the documents of one task; ``rows`` hold the pieces of finished sequences."""

    def __init__(self, tiers: tuple[int, ...], first_id: int, group: int):
        self.tiers, self.window, self.group = tiers, tiers[-1], group
        self.next_id, self.leftovers = first_id, Tiers(tiers)
        self.next_group = first_id
        self.waiting: dict[int, list[tuple[int, list[tuple]]]] = {}  # (cost, rows) of sequences by padded length
        self.n_waiting = self.n_left = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, whole = len(ids), len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            self._emit([Piece(doc_id, start, ids[start : start + self.window], total)])
        if whole < total:
            self.leftovers.add(Piece(doc_id, whole, ids[whole:].copy(), total))
            self.n_left += 1
        if self.n_left >= POOL:
            self.flush(last=False)

    def flush(self, last: bool) -> None:
        for pieces in pack(self.leftovers, last):
            self._emit(pieces)
        self.n_left = len(self.leftovers)
        self.deal_groups()

    def deal_groups(self) -> None:
        """Deals the waiting sequences of each length to step groups, the costliest first, to and fro."""
        for length, sequences in sorted(self.waiting.items()):
            sequences.sort(key=lambda s: -s[0])
            n = -(-len(sequences) // (self.group * max(1, self.window // length)))
            for k, (_, rows) in enumerate(sequences):
                turn, at = divmod(k, n)
                group = self.next_group + (n - 1 - at if turn % 2 else at)
                self.rows += [(*r, group) for r in rows]
            self.next_group += n
        self.waiting, self.n_waiting = {}, 0

    def _emit(self, pieces: list[Piece]) -> None:
        used = sum(len(p.ids) for p in pieces)
        padded = used if used & (used - 1) == 0 else self.window
        tier = self.tiers[bisect_left(self.tiers, used)]
        offset, rows = 0, []
        for p in pieces:
            n = len(p.ids)
            crc = zlib.crc32(np.ascontiguousarray(p.ids, "<u4"))
            rows.append((p.doc_id, p.start, n, crc, p.total, self.next_id, offset, padded, tier))
            offset += n
        self.next_id += 1
        self.waiting.setdefault(padded, []).append((sum(len(p.ids) ** 2 for p in pieces), rows))
        self.n_waiting += 1
        if self.n_waiting >= 2 * POOL:
            self.deal_groups()

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA
        )


def _special_split(text: bytes, special: dict[bytes, int]) -> list[bytes | int]:
    """The text cut at the vocabulary's special tokens, leftmost first."""
    parts: list[bytes | int] = []
    while True:
        found = [(text.find(s), -len(s), s) for s in special if s in text]
        if not found:
            return [*parts, text] if text else parts
        at, _, s = min(found)
        if at:
            parts.append(text[:at])
        parts.append(special[s])
        text = text[at + len(s) :]


def tokenised(batch: pa.RecordBatch, cache: PieceCache, special: dict[bytes, int], end: int):
    """(doc_id, ids with the end id) for every row of a batch."""
    ids_of = batch.column("doc_id").to_pylist()
    for lo, hi, buf, off in textvec.chunks(batch.column("text"), CHUNK_BYTES):
        raw = buf.tobytes() if special else b""
        marked = any(s in raw for s in special)
        ids, bounds = cache.encode(buf, off)
        for k in range(hi - lo):
            own = ids[bounds[k] : bounds[k + 1]]
            if marked and any(s in (text := raw[off[k] : off[k + 1]]) for s in special):
                parts = []
                for part in _special_split(text, special):
                    if isinstance(part, int):
                        parts.append(np.array([part], np.uint32))
                    else:
                        piece = np.frombuffer(part, np.uint8)
                        parts.append(cache.encode(piece, np.array([0, len(piece)]))[0])
                own = np.concatenate(parts)
            yield ids_of[lo + k], np.append(own, np.uint32(end)).astype("<u4")


def pack_documents(docs: DataFrame, vocabulary: bytes, tiers: tuple[int, ...] = TIERS, end: int = 0) -> DataFrame:
    """One row per piece of each row of ``docs`` (doc_id, text).

    A document is its token ids (``vocabulary`` is the content of a byte-level BPE in JSON form, its
    special tokens recognised, none added) and the id ``end``. Returns doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset and, beyond these, padded_length, tier (the context
    size) and step_group. Every id lies in one piece. ``tiers`` ascend; with powers of two as tiers
    every sequence has a power of two as its length, so nothing is padded. Null or empty text is the end id alone. Repeated rows and null ids are
    packed as any others; an empty table gives no rows; other columns of ``docs`` are ignored.
    Sequence ids are unique over all tasks and the same when a task runs again.
    """
    if list(tiers) != sorted(set(tiers)) or tiers[0] < 1:
        raise ValueError("tiers are ascending context sizes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, special = encoder(vocabulary, "json")
        special = {k.encode(): v for k, v in special.items()}
        cache = PieceCache(enc)
        packer = Packer(tiers, TaskContext.get().partitionId() << 40, GROUP)
        for batch in batches:
            for doc_id, ids in tokenised(batch, cache, special, end):
                packer.add(doc_id, ids)
                if len(packer.rows) >= 20_000:
                    yield packer.batch()
        packer.flush(last=True)
        if packer.rows:
            yield packer.batch()

    return docs.select("doc_id", "text").mapInArrow(lean(run), DDL)
