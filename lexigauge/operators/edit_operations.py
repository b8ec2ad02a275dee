"""Deletions, substitutions and insertions of a pair: an alignment, so an Arrow function.

Of equally cheap alignments the one is taken that, read from the end, prefers a match or
substitution, then a deletion, then an insertion. Only the sum and the difference of deletions and
insertions are the same for every choice.

Pairs of similar size are aligned together, a matrix row of all of them at a time. Of a pair that is
too large for that only every k-th row is kept, k the root of their number; the way back makes the
rows between them again. So memory grows with length to the power of 1.5 and not 2.

Where only the numbers of operations are asked for (``edit_counts``) no way back is gone: a cell holds its
cost and the insertions of its own alignment, and a diagonal of many pairs is computed at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Cells of the matrices that are held at a time.
CELLS = 4_000_000
#: Characters of pairs that are counted at a time, and cells of their diagonals.
CHARS, DIAGONAL = 1_000_000, 16_384
NAMES = np.array(["sub", "del", "ins"], dtype=object)
SUB, DEL, INS = range(3)


def _next_row(row: np.ndarray, i: int, unlike: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Row i of the matrix from the one before; leading axes are pairs."""
    out = np.empty_like(row)
    out[..., 0] = i
    out[..., 1:] = np.minimum(row[..., 1:] + 1, row[..., :-1] + unlike)
    # an insertion costs one more than its left neighbour: a running minimum of cost less position
    return np.minimum.accumulate(out - steps, axis=-1) + steps


def _align_large(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """(operation, position in a, position in b) of every edit, from the end."""
    steps = np.arange(len(b) + 1, dtype=np.int32)
    every = max(1, int(len(a) ** 0.5))
    row, kept = steps, {0: steps}
    for i in range(1, len(a) + 1):
        row = _next_row(row, i, b != a[i - 1], steps)
        if i % every == 0:
            kept[i] = row
    out, i, j, rows, first = [], len(a), len(b), [], len(a) + 1
    while i or j:
        if i - 1 < first and i:
            first = (i - 1) // every * every
            rows = [kept[first]]
            for k in range(first + 1, i + 1):
                rows.append(_next_row(rows[-1], k, b != a[k - 1], steps))
        here = rows[i - first][j] if rows else j
        if i and j and here == rows[i - first - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            if a[i] != b[j]:
                out.append((SUB, i, j))
        elif i and here == rows[i - first - 1][j] + 1:
            i -= 1
            out.append((DEL, i, j))
        else:
            j -= 1
            out.append((INS, i, j))
    return out


def _align_together(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(pair, operation, position in a, position in b) of every edit, each pair's from the end."""
    la, lb = (np.array([len(x) for x in side]) for side in (a, b))
    n, m, pairs = int(la.max(initial=0)), int(lb.max(initial=0)), len(a)
    pa_, pb = np.full((pairs, n), 0x110000, np.uint32), np.full((pairs, m), 0x110001, np.uint32)
    for k in range(pairs):
        pa_[k, : la[k]], pb[k, : lb[k]] = a[k], b[k]
    cost = np.empty((n + 1, pairs, m + 1), np.int32)
    steps = np.arange(m + 1, dtype=np.int32)
    cost[0] = steps
    for i in range(1, n + 1):
        cost[i] = _next_row(cost[i - 1], i, pb != pa_[:, i - 1 : i], steps)
    i, j, left = la.copy(), lb.copy(), np.arange(pairs)
    found: list[tuple[np.ndarray, ...]] = []
    while len(left := left[(i[left] > 0) | (j[left] > 0)]):
        x, y = i[left], j[left]
        here = cost[x, left, y]
        x1, y1 = np.maximum(x - 1, 0), np.maximum(y - 1, 0)
        both = (x > 0) & (y > 0)
        unlike = np.ones(len(left), bool)
        unlike[both] = pa_[left[both], x1[both]] != pb[left[both], y1[both]]
        slant = both & (here == cost[x1, left, y1] + unlike)
        up = ~slant & (x > 0) & (here == cost[x1, left, y] + 1)
        i[left] -= slant | up
        j[left] -= ~up
        edit = ~slant | unlike
        op = np.where(slant, SUB, np.where(up, DEL, INS))
        found.append((left[edit], op[edit], i[left][edit], j[left][edit]))
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def _alike(a: np.ndarray, from_a: np.ndarray, b: np.ndarray, from_b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many characters, ``most`` at most, are the same in both from these places on; ``step`` of -1 goes backwards."""
    ends = np.cumsum(most)
    first = ends - most
    k = step * (np.arange(most.sum()) - np.repeat(first, most))
    unlike = np.append(np.flatnonzero(a[np.repeat(from_a, most) + k] != b[np.repeat(from_b, most) + k]), most.sum())
    return np.minimum(unlike[np.searchsorted(unlike, first)], ends) - first


def _trimmed(refs: list[str], hyps: list[str]) -> tuple[np.ndarray, ...]:
    """(a, b, start, from_a, from_b, n, m): all characters as numbers from 2 on, and what of each pair is left, by place and length.

    What both texts begin with is left out, ``start`` characters, and then what they end with: the way back begins with that.
    """
    la, lb = (np.fromiter(map(len, side), np.int64, len(side)) for side in (refs, hyps))
    a, b = (np.frombuffer("".join(side).encode("utf-32-le", "surrogatepass"), np.uint32) for side in (refs, hyps))
    number = np.zeros(0x110000, np.int32)
    number[a] = number[b] = 1
    number = np.cumsum(number, dtype=np.int32) + 1
    a, b = number[a], number[b]
    from_a, from_b = np.cumsum(la) - la, np.cumsum(lb) - lb
    start = _alike(a, from_a, b, from_b, np.minimum(la, lb), 1)
    end = _alike(a, from_a + la - 1, b, from_b + lb - 1, np.minimum(la, lb) - start, -1)
    return a, b, start, from_a + start, from_b + start, la - start - end, lb - start - end


def _lots(refs: list[str], hyps: list[str]) -> list[tuple[int, int]]:
    """Bounds of lots of pairs of some ``CHARS`` characters each."""
    ends, lots, at = np.cumsum([len(r) + len(h) for r, h in zip(refs, hyps, strict=True)], dtype=np.int64), [], 0
    while at < len(refs):
        to = max(at + 1, int(np.searchsorted(ends, CHARS + (ends[at - 1] if at else 0), "right")))
        lots.append((at, to))
        at = to
    return lots


def _only(pair: np.ndarray, count: np.ndarray, op: int) -> tuple[np.ndarray, ...]:
    """Edits, from the end, of pairs of which one side is empty and the other has ``count`` characters."""
    ends = np.cumsum(count)
    at = np.repeat(ends, count) - 1 - np.arange(count.sum())
    none = np.zeros(len(at), np.int64)
    return np.repeat(pair, count), np.full(len(at), op), *((at, none) if op == DEL else (none, at))


def _align_some(refs: list[str], hyps: list[str]) -> tuple[np.ndarray, ...]:
    a, b, start, from_a, from_b, n, m = _trimmed(refs, hyps)
    parts = [_only(own, size[own], op) for own, size, op in ((np.flatnonzero(m == 0), n, DEL), (np.flatnonzero(n == 0), m, INS))]
    own = lambda k: (a[from_a[k] : from_a[k] + n[k]], b[from_b[k] : from_b[k] + m[k]])
    held, high, wide = [], 0, 0

    def flush() -> None:
        if held:
            pair, *rest = _align_together(*map(list, zip(*map(own, held), strict=True)))
            parts.append((np.array(held)[pair], *rest))

    both = np.flatnonzero((n > 0) & (m > 0))
    for k in both[np.lexsort((m[both], n[both]))].tolist():
        size, other = int(n[k]), int(m[k])
        if (size + 1) * (other + 1) > CELLS:
            edits = np.array(_align_large(*own(k)), np.int64).reshape(-1, 3)
            parts.append((np.full(len(edits), k), *edits.T))
            continue
        high, wide = max(high, size), max(wide, other)
        if (len(held) + 1) * (high + 1) * (wide + 1) > CELLS:
            flush()
            held, high, wide = [], size, other
        held.append(k)
    flush()
    pair, op, i, j = (np.concatenate(c) for c in zip(*parts, strict=True))
    by = np.lexsort((np.arange(len(pair))[::-1], pair))
    return pair[by], op[by], i[by] + start[pair[by]], j[by] + start[pair[by]]


def align_all(refs: list[str], hyps: list[str]) -> tuple[np.ndarray, ...]:
    """(pair, operation, position in ref, position in hyp) of every edit, by pair and position."""
    parts = [(np.zeros(0, np.int64),) * 4]
    for at, to in _lots(refs, hyps):
        pair, *rest = _align_some(refs[at:to], hyps[at:to])
        parts.append((pair + at, *rest))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _count_together(a: np.ndarray, from_a: np.ndarray, n: np.ndarray, b: np.ndarray, from_b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edits, insertions) of pairs, given as places and lengths in ``a`` and ``b``, whose characters are numbers from 2 on.

    A cell is a number: cost, two bits for the last step and the insertions. So the least of three candidates is the
    cheapest and, of equally cheap ones, a slant before a deletion before an insertion.
    """
    height, width, pairs = int(n.max()), int(m.max()), len(n)
    low = width.bit_length()
    high = max(height + 1, width + 1, int(a.max(initial=0)), int(b.max(initial=0))).bit_length()
    kind = np.int32 if low + 2 + high < 32 else np.int64
    one, kept = 1 << low + 2, ~(3 << low)
    deleted, inserted = one + (1 << low), one + (2 << low) + 1
    i, j = np.arange(height)[:, None], np.arange(width)[::-1, None]
    rows = np.where(i < n, a[np.minimum(from_a + i, len(a) - 1)], 0).astype(kind) << low + 2
    columns = np.where(j < m, b[np.minimum(from_b + j, len(b) - 1)], 1).astype(kind) << low + 2
    two_ago, ago, now, part = (np.zeros((height + 1, pairs), kind) for _ in range(4))
    out, by = np.empty(pairs, kind), np.argsort(n + m, kind="stable")
    ends = np.searchsorted((n + m)[by], np.arange(height + width + 2))
    for d in range(1, height + width + 1):
        lo, hi = max(1, d - width), min(height, d - 1)
        if lo <= hi:
            x, y = part[lo : hi + 1], now[lo : hi + 1]
            np.bitwise_xor(rows[lo - 1 : hi], columns[width - d + lo : width - d + hi + 1], out=x)
            np.minimum(x, one, out=x)
            np.add(x, two_ago[lo - 1 : hi], out=x)
            np.add(ago[lo - 1 : hi], deleted, out=y)
            np.minimum(x, y, out=x)
            np.add(ago[lo : hi + 1], inserted, out=y)
            np.minimum(x, y, out=y)
            np.bitwise_and(y, kept, out=y)
        if d <= width:
            now[0] = d * one + d
        if d <= height:
            now[d] = d * one
        done = by[ends[d] : ends[d + 1]]
        out[done] = now[n[done], done]
        two_ago, ago, now = ago, now, two_ago
    return out >> low + 2, out & (1 << low) - 1


def _count_some(refs: list[str], hyps: list[str]) -> np.ndarray:
    """A row of deletions, one of substitutions and one of insertions."""
    a, b, _, from_a, from_b, n, m = _trimmed(refs, hyps)
    edits, inserted = np.maximum(n, m), np.where(n == 0, m, 0)
    left = np.flatnonzero((n > 0) & (m > 0))
    left = left[np.argsort((n + m)[left], kind="stable")]
    while len(left):
        cells = (np.maximum.accumulate(n[left]) + 1) * np.arange(1, len(left) + 1)
        k = max(1, int(np.searchsorted(cells, DIAGONAL, "right")))
        own, left = left[:k], left[k:]
        edits[own], inserted[own] = _count_together(a, from_a[own], n[own], b, from_b[own], m[own])
    deleted = n - m + inserted
    return np.stack([deleted, edits - deleted - inserted, inserted])


def count_all(refs: list[str], hyps: list[str]) -> np.ndarray:
    """Deletions, substitutions and insertions of every pair, a row each: the numbers of what ``align_all`` finds."""
    parts = [_count_some(refs[at:to], hyps[at:to]) for at, to in _lots(refs, hyps)]
    return np.concatenate([np.zeros((3, 0), np.int64), *parts], axis=1)


def align(ref: str, hyp: str) -> list[tuple[str, int, int]]:
    """(operation, position in ref, position in hyp) of every edit, in order."""
    _, op, i, j = align_all([ref], [hyp])
    return [(NAMES[o], x, y) for o, x, y in zip(op.tolist(), i.tolist(), j.tolist(), strict=True)]


OPS = "array<struct<op:string,ref_char:string,hyp_char:string>>"


def edit_operations(records: DataFrame) -> DataFrame:
    """``records`` with ``ops``: every edit with the characters it takes and gives."""

    @F.arrow_udf(OPS)
    def ops(ref: pa.Array, hyp: pa.Array) -> pa.Array:
        refs, hyps = ref.to_pylist(), hyp.to_pylist()
        pair, op, i, j = align_all(refs, hyps)
        taken = [None if o == INS else refs[k][x] for k, o, x in zip(pair.tolist(), op.tolist(), i.tolist(), strict=True)]
        given = [None if o == DEL else hyps[k][y] for k, o, y in zip(pair.tolist(), op.tolist(), j.tolist(), strict=True)]
        values = [pa.array(NAMES[op], pa.string()), pa.array(taken, pa.string()), pa.array(given, pa.string())]
        bounds = np.searchsorted(pair, np.arange(len(refs) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(values, ["op", "ref_char", "hyp_char"]))

    return records.withColumn("ops", ops(text.normalize("reference"), text.normalize("prediction")))


def edit_counts(records: DataFrame) -> DataFrame:
    """``records`` with ``ref_n``, the normalised reference, and ``counts``: its deletions, substitutions and insertions."""

    @F.arrow_udf("struct<del:int,sub:int,ins:int>")
    def counts(ref: pa.Array, hyp: pa.Array) -> pa.Array:
        rows = count_all(ref.to_pylist(), hyp.to_pylist())
        return pa.StructArray.from_arrays([pa.array(row, pa.int32()) for row in rows], ["del", "sub", "ins"])

    rows = records.withColumns({"ref_n": text.normalize("reference"), "hyp_n": text.normalize("prediction")})
    return rows.withColumn("counts", counts("ref_n", "hyp_n")).drop("hyp_n")


SUMS = ["n", "total_ref_chars", "deletions", "substitutions", "insertions"]


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    """Sums of operations by ``keys``, of rows that ``edit_counts`` or ``edit_operations`` made."""
    counted = "counts" in rows.columns
    n = lambda op: F.sum(F.col("counts")[op] if counted else F.size(F.filter("ops", lambda o: o["op"] == op)))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.char_length(F.col("ref_n") if counted else text.normalize("reference"))).alias("total_ref_chars"),
        n("del").alias("deletions"),
        n("sub").alias("substitutions"),
        n("ins").alias("insertions"),
    )


def _with_rates(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("total_errors", F.col("deletions") + F.col("substitutions") + F.col("insertions"))
    some = F.greatest(F.lit(1), F.col("total_errors"))
    return rows.withColumns(
        {f"{c[:-1]}_share": F.col(c) / some for c in ("deletions", "substitutions", "insertions")}
        | {"errors_per_ref_char": F.col("total_errors") / F.greatest(F.lit(1), F.col("total_ref_chars"))}
    )


def tallies(counted: DataFrame, *keys: str) -> DataFrame:
    """Sums of operations by ``keys`` (none: one row), their shares and rates."""
    return _with_rates(_sums(counted, *keys))


def tallies_by_all(counted: DataFrame, keys: list[str]) -> DataFrame:
    """(dimension, value, sums, shares and rates): all records, and every value of each key.

    Records are aligned once: their sums by all keys together are summed again for each. No records have a row too.
    """
    known = counted.withColumns({key: F.coalesce(F.col(key).cast("string"), F.lit("unknown")) for key in keys})
    of = lambda name, value: F.struct(F.lit(name).alias("dimension"), value.alias("value"))
    places = F.array(of("overall", F.lit("all")), *[of(key, F.col(key)) for key in keys])
    parts = _sums(known, *keys).select(F.explode(places).alias("p"), *SUMS).select("p.*", *SUMS)
    nothing = counted.sparkSession.range(1).select(
        F.lit("overall").alias("dimension"), F.lit("all").alias("value"), F.lit(0).cast("long").alias("n"), *[F.lit(None).cast("long").alias(c) for c in SUMS[1:]]
    )
    sums = parts.unionByName(nothing).groupBy("dimension", "value").agg(*[F.sum(c).alias(c) for c in SUMS])
    return _with_rates(sums)


def _by_label(with_ops: DataFrame, labels: dict[str, str], *keys: str) -> DataFrame:
    """Per key and label: reference characters, and deleted, substituted and inserted ones."""
    of = F.create_map(*[F.lit(x) for label, chars in labels.items() for c in chars for x in (c, label)])
    wanted = "".join(labels.values())
    refs = with_ops.select(
        *keys, F.explode(F.split(F.regexp_replace(F.lower(text.normalize("reference")), f"[^{wanted}]", ""), "")).alias("c")
    ).where("c <> ''").groupBy(*keys, of[F.col("c")].alias("label")).agg(F.count(F.lit(1)).alias("ref"))
    ops = with_ops.select(*keys, F.explode("ops").alias("o")).select(
        *keys, "o.op", F.lower(F.coalesce("o.ref_char", "o.hyp_char")).alias("c")
    ).where(F.col("c").isin(*wanted))
    n = lambda op: F.sum((F.col("op") == op).cast("long")).alias(op)
    counts = ops.groupBy(*keys, of[F.col("c")].alias("label")).agg(n("del"), n("sub"), n("ins"))
    rows = refs.join(counts, [*keys, "label"], "full").fillna(0, ["ref", "del", "sub", "ins"])
    return rows.withColumn("err", F.col("del") + F.col("sub"))


def rare_label_counts(with_ops: DataFrame, labels: dict[str, str] = text.RARE_LABELS) -> DataFrame:
    """Per label: reference characters, deleted, substituted and inserted ones, their shares, error rate and its interval."""
    from .statistics import wilson

    rows = _by_label(with_ops, labels)
    some = F.greatest(F.lit(1), F.col("err"))
    return rows.withColumns(
        {
            "error_rate": F.col("err") / F.greatest(F.lit(1), F.col("ref")),
            "deletion_share": F.col("del") / some,
            "substitution_share": F.col("sub") / some,
            "interval": wilson("err", "ref"),
        }
    )


def rare_label_bootstrap(
    with_ops: DataFrame, labels: dict[str, str] = text.RARE_LABELS, page: str = "source_page_id", replicates: int = 1000, seed: int = 42
) -> DataFrame:
    """(metric, mean, median, std, lo, hi) of every label's error rate over resamples of whole pages."""
    from .statistics import bootstrap

    names = list(labels)
    sums = _by_label(with_ops, labels, page).groupBy(page).agg(
        *[F.sum(F.when(F.col("label") == label, F.col(c))).alias(f"{c}{k}") for k, label in enumerate(names) for c in ("err", "ref")]
    )
    pages = with_ops.select(F.col(page).alias("page")).distinct().join(sums.withColumnRenamed(page, "page"), "page", "left")
    pages = pages.fillna(0, [c for c in pages.columns if c != "page"])
    return bootstrap(pages, replicates, seed, {label: (f"err{k}", f"ref{k}") for k, label in enumerate(names)})
