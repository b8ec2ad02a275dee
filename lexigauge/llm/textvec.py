"""Vectorised text handling on Arrow buffers: words, hashes, shingles and pre-tokens.

Everything works on the UTF-8 bytes of many texts at once, in chunks that end where a text ends, so
memory follows the chunk size and the longest text and not the batch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
#: Bytes that one prefix sum of the hash spans at a time.
SEGMENT_BYTES = 1 << 18
#: Multipliers of a 64-bit mixer and the base of the rolling hash.
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
IDENTITY = np.arange(256, dtype=np.uint8)
FOLD = IDENTITY.copy()
FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


@cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


_powers: list[np.ndarray] = []


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n at least."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n, SEGMENT_BYTES) + 1
        tables = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of about ``size`` bytes or of one text."""
    buf, off = string_buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


@dataclass
class Words:
    """Words of a chunk in order; text k has words bounds[k] to bounds[k + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def words(buf: np.ndarray, off: np.ndarray, separator: np.ndarray = SEPARATOR) -> Words:
    n = len(buf)
    if n == 0:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64))
    inside = ~separator[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # a text's border is a word's border too
    some = off[1:] > off[:-1]
    at = off[:-1][some]
    first[at] = inside[at]
    at = off[1:][some] - 1
    last[at] = inside[at]
    starts = np.flatnonzero(first)
    return Words(starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = FOLD) -> np.ndarray:
    """64-bit hashes of the byte spans, the same wherever a span lies. ``fold`` maps bytes first."""
    values = _byte_values()[fold]
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + SEGMENT_BYTES, "right")))
        n = int(ends[j - 1] - base)
        power, inverse = _power_table(n)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values[buf[base : base + n]] * power[:n], dtype=np.uint64, out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    return mix(out)


@cache
def _place_factors(width: int) -> np.ndarray:
    return mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every window of ``width`` words and the bounds of each text's windows.

    A text with fewer words, but one at least, has its whole sequence as the only window.
    """
    n_words = np.diff(bounds)
    factors = _place_factors(width)
    n = len(hashes)
    counts = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(out_bounds[-1], np.uint64)
    if n >= width:
        full = hashes[: n - width + 1] * factors[0]
        for k in range(1, width):
            full += hashes[k : n - width + 1 + k] * factors[k]
        long = np.flatnonzero(n_words >= width)
        take = np.repeat(bounds[long] - out_bounds[long], counts[long]) + positions(out_bounds[long], counts[long])
        out[positions(out_bounds[long], counts[long])] = full[take]
    for k in np.flatnonzero((n_words > 0) & (n_words < width)):
        own = hashes[bounds[k] : bounds[k + 1]]
        out[out_bounds[k]] = (own * factors[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(out), out_bounds


def positions(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each (start, count), one after the other."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)


# Character classes of the pre-token pattern.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The code points of Unicode's White_Space property.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            table[c] = LETTER
        elif major == "N":
            table[c] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


def _code_points(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the characters that start at ``at`` (valid UTF-8)."""
    lead = buf[at].astype(np.uint32)
    point = lead.copy()
    for first, size, mask in ((0xC0, 2, 0x1F), (0xE0, 3, 0x0F), (0xF0, 4, 0x07)):
        rows = np.flatnonzero((lead >= first) & (lead < {2: 0xE0, 3: 0xF0, 4: 0x100}[size]))
        p = lead[rows] & mask
        for k in range(1, size):
            p = (p << np.uint32(6)) | (buf[at[rows] + k] & np.uint32(0x3F))
        point[rows] = p
    return point


def pretokens(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte positions where pre-tokens start, and the end: each text is cut without gaps.

    The cuts are those of the byte-level BPE pattern: contractions, letters, numbers and other
    characters with one space before them, and runs of white space that leave their last character
    to what follows.
    """
    n = len(buf)
    if n == 0:
        return np.zeros(1, np.int64)
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    lead = buf[at]
    kind = _classes()[:256][lead]
    wide = np.flatnonzero(lead >= 0x80)
    kind[wide] = _classes()[_code_points(buf, at[wide])]
    m = len(at)
    begins = np.zeros(m, bool)
    begins[np.searchsorted(at, off[:-1][off[1:] > off[:-1]])] = True
    start = begins.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last white space before something else: a space joins it, others stand alone
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~begins[1:]) + 1
    start[after - 1] = True
    start[after] = lead[after - 1] != 0x20
    # contractions
    quote = np.flatnonzero((lead == 0x27) & start)
    if len(quote):
        padded = np.concatenate([lead, np.zeros(3, np.uint8)])
        border = np.concatenate([begins, np.ones(3, bool)])
        one, two = padded[quote + 1], padded[quote + 2]
        free1 = ~border[quote + 1]
        free2 = free1 & ~border[quote + 2]
        short = quote[free1 & np.isin(one, np.frombuffer(b"stmd", np.uint8))]
        long = quote[
            free2
            & (((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)))
        ]
        start[short + 1] = False
        start[long + 1] = False
        nxt = np.concatenate([short + 2, long + 3])
        start[nxt[nxt < m]] = True
    return np.append(at[start], n)


def binary_array(buf: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The spans between neighbouring bounds as an Arrow array, without a copy."""
    return pa.Array.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(buf)]
    )
