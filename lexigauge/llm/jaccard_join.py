"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are its distinct 5-word shingles. All documents with the same set are one class,
and classes are joined. Two sets can only be similar if they share most of the tokens of either; so
with the tokens in a global order from rare to frequent, a prefix of each set is enough to meet.

Counting. A block of documents counts its own tokens first and deals out the distinct ones by their
hash, so a token that a third of all documents hold is one entry a block. They come back with the
number of sets that hold them. A token that no other set holds can't be shared: it counts against the
set's allowance of missing tokens, and a set that has more such tokens than the allowance is done,
which ends the matter for most documents.

Signatures. Of the remaining tokens each set takes a prefix. Rare tokens are indexed singly. Tokens of
the frequent classes are indexed as combinations of k tokens (k = 2, then 3), because single ones
would bring together everything that shares a common passage: the class is split by hash into groups
whose number follows the size of the sets, and all k-combinations within a group are signatures. A
group of c prefix tokens lets k - 1 of them go unanswered, so the prefix is extended until the rest
exceeds the allowance: then two similar sets share a signature for certain (see ``signatures``).

Linking. All that meet in a signature are compared with the signature's smallest member, and linked
if the exact intersection of their sets says so: pairs in proportion to the members. Signatures whose
members are not all connected by then are open. What open signatures connect is a family; the largest
component of each is compared with the others, and these among themselves, block against block:
intersections of whole blocks are one matrix product, a pair is never a row, and of the links only
those come back that connect something.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .common import lean, lean_group, shuffle_partitions, staged, text_key, without
from .components import components

WIDTH = 5
#: The similarity as a ratio of integers: 100 * intersection >= 80 * union.
PERCENT = 80
#: Sets that hold a token: up to which number it is indexed singly, and in pairs; beyond, in threes.
CLASS_BOUNDS = (16, 1024)
#: Sets whose sizes differ by more than this factor are never similar; sizes are banded by it.
BAND = 1.3
GROUP_TOKENS = 3
#: Tokens and sets of a block: a task's memory, some 130 bytes a token while the block is dealt out.
BLOCK_TOKENS = 400_000
BLOCK_SETS = 20_000
#: Bytes of the texts that are cut into words together.
CHUNK_BYTES = 1 << 19
#: Sets and tokens of one side of a comparison of blocks.
PAIR_SETS, PAIR_TOKENS = 512, 1_000_000

#: A set with fewer tokens is only similar to an equal one, and that is its class (3 of 4 are too few).
LEAST = 4


#: A token's bucket has its lowest byte, whatever the number of buckets; the other seven are written.
LOW = 256


def _buckets(partitions: int) -> int:
    return LOW * -(-partitions // LOW)


def _bucket_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return (tokens % np.uint64(LOW) + LOW * (textvec.mix(tokens) % np.uint64(buckets // LOW))).astype(np.int64)


def _bytes7(tokens: np.ndarray) -> bytes:
    """The upper seven bytes of each token, plane by plane."""
    return np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, 1:].T).tobytes()


def _tokens7(data: bytes, low: int) -> np.ndarray:
    """Tokens from their upper seven bytes and the lowest, which all of them share."""
    n = len(data) // 7
    out = np.empty((n, 8), np.uint8)
    out[:, 1:] = np.frombuffer(data, np.uint8).reshape(7, n).T
    out[:, 0] = low
    return out.reshape(-1).view(np.uint64)


# ---------------------------------------------------------------- counting

CUT = pa.schema(
    [
        ("bucket", pa.int32()),
        ("block", pa.string()),
        ("doc_ids", pa.list_(pa.int64())),
        ("texts", pa.list_(pa.int64())),
        ("of_doc", pa.list_(pa.int32())),
        ("sizes", pa.list_(pa.int32())),
        ("keys", pa.list_(pa.int64())),
        ("added", pa.binary()),
        ("again", pa.binary()),
        ("codes", pa.binary()),
        ("tokens", pa.binary()),
        ("holders", pa.binary()),
    ]
)
CUT_DDL = (
    "bucket int, block string, doc_ids array<bigint>, texts array<bigint>, of_doc array<int>, sizes array<int>, keys array<bigint>, "
    "added binary, again binary, codes binary, tokens binary, holders binary"
)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )


class Block:
    """Documents of one task: their distinct sets, and which set each has."""

    def __init__(self, place: str = ""):
        self.place = place
        self.doc_ids: list = []
        self.texts: list[int] = []
        self.of_doc: list[int] = []
        self.number: dict[tuple[int, int], int] = {}
        self.sets: list[np.ndarray] = []
        self.tokens = 0

    def add(self, doc_id, tokens: np.ndarray, text: int = 0) -> None:
        """``tokens``: the sorted distinct shingles, none for an empty text; ``text`` comes back with the id."""
        if len(tokens):
            # two sums of independently mixed tokens, and the size, stand for the set
            key = (
                int(textvec.mix(tokens).sum(dtype=np.uint64)),
                int(textvec.mix(tokens ^ textvec.MIX_A).sum(dtype=np.uint64)) ^ len(tokens),
            )
            at = self.number.get(key)
            if at is None:
                at = self.number[key] = len(self.sets)
                self.sets.append(tokens)
                self.tokens += len(tokens)
        else:
            at = -1
        self.doc_ids.append(doc_id)
        self.texts.append(text)
        self.of_doc.append(at)

    def rows(self, buckets: int) -> pa.RecordBatch:
        """The block's own row, and a row of distinct tokens for each bucket.

        The block numbers its tokens as they come, set by set. So a set is a run of numbers that it
        adds (``added`` is how many) and those that earlier sets had (``again``).
        """
        keys = np.array([k for pair in self.number for k in pair], np.uint64).view(np.int64)
        sizes = np.fromiter(map(len, self.sets), np.int32, len(self.sets))
        name = xxhash.xxh3_128(keys.tobytes() + repr((self.place, self.doc_ids)).encode()).hexdigest()
        own = int(name[:8], 16) % buckets
        row = (own, name, self.doc_ids, self.texts, self.of_doc, sizes.tolist(), keys.tolist())
        if not self.sets:
            return _rows([(*row, b"", b"", None, None, None)], CUT)
        flat = np.concatenate(self.sets)
        order = np.argsort(flat)
        flat = flat[order]
        starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        holders = np.diff(np.append(starts, len(flat)))
        first = np.minimum.reduceat(order, starts)
        new = np.zeros(len(flat), bool)
        new[first] = True
        code = (np.cumsum(new) - 1)[first]
        codes = np.empty(len(flat), np.uint32)
        codes[order] = np.repeat(code, holders)
        del order
        added = np.add.reduceat(new, np.cumsum(sizes) - sizes, dtype=np.int64)
        out = [(*row, _ints(added), _ints(codes[~new]), None, None, None)]
        tokens = flat[starts]
        del flat, new, codes, starts, first
        bucket = _bucket_of(tokens, buckets)
        by = np.argsort(bucket << 32 | code)
        cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
        tokens, code, holders = tokens[by], code[by], holders[by]
        del bucket, by
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            lo, hi = cuts[b], cuts[b + 1]
            steps = np.diff(code[lo:hi], prepend=0)
            out.append((b, name, *[None] * 7, _ints(steps), _bytes7(tokens[lo:hi]), _ints(holders[lo:hi])))
        return _rows(out, CUT)


def _ints(values: np.ndarray) -> bytes:
    """32-bit integers by byte plane, compressed: they are small, so most of their bits say nothing."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True) if planes else b""


def _from_ints(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, "<u4")
    planes = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).reshape(-1).view("<u4")


def _cut(buckets: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # partition and number: equal rows elsewhere are another block, a task that runs again has the same
        task, number = TaskContext.get().partitionId(), 0
        block = Block(f"{task}:{number}")
        for batch in batches:
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
            for lo, hi, buf, off in textvec.chunks(batch.column("text"), CHUNK_BYTES):
                w = textvec.words(buf, off)
                sh, bounds = textvec.shingles(textvec.span_hashes(buf, w.starts, w.ends), w.bounds, width)
                for k in range(hi - lo):
                    own = np.unique(sh[bounds[k] : bounds[k + 1]])
                    block.add(ids[lo + k], own, keys[lo + k])
                    if block.tokens >= BLOCK_TOKENS or len(block.doc_ids) >= BLOCK_SETS:
                        yield block.rows(buckets)
                        number += 1
                        block = Block(f"{task}:{number}")
        if block.doc_ids:
            yield block.rows(buckets)

    return run


def _count_bucket(group: pa.Table) -> pa.Table:
    """The tokens of a bucket that two sets or more hold, and how many; the blocks' own rows pass."""
    out = [group.filter(pc.is_null(group["tokens"])).cast(CUT)]
    lists = group.filter(pc.is_valid(group["tokens"]))
    if not lists.num_rows:
        return out[0]
    bucket = lists["bucket"][0].as_py()
    parts = [_tokens7(t, bucket % LOW) for t in lists["tokens"].to_pylist()]
    flat = np.concatenate(parts)
    n = np.concatenate([_from_ints(h) for h in lists["holders"].to_pylist()]).astype(np.int64)
    order = np.argsort(flat)
    ordered = flat[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    total = np.add.reduceat(n[order], first)
    holders = np.empty(len(flat), np.int64)
    holders[order] = np.repeat(total, np.diff(np.append(first, len(ordered))))
    del ordered, order, n
    rows, at = [], 0
    for block, tokens, steps in zip(lists["block"].to_pylist(), parts, lists["codes"].to_pylist(), strict=True):
        mine = holders[at : at + len(tokens)]
        at += len(tokens)
        hit = mine > 1
        if hit.any():
            codes = np.cumsum(_from_ints(steps), dtype=np.int64)[hit]
            rows.append((bucket, block, *[None] * 7, _ints(np.diff(codes, prepend=0)), _bytes7(tokens[hit]), _ints(mine[hit])))
    if rows:
        out.append(pa.Table.from_batches([_rows(rows, CUT)]))
    return pa.concat_tables(out)


# ---------------------------------------------------------------- sets and signatures

SETS = "cid bigint, n int, tokens binary, holders binary"


def _assemble(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sets that may have a partner, from a block's classes (left) and its own row and shared tokens (right)."""
    out = []
    for r in right.filter(pc.is_null(right["tokens"])).to_pylist():
        sizes, added, again = np.array(r["sizes"], np.int64), _from_ints(r["added"]).astype(np.int64), _from_ints(r["again"])
        tokens, holders = np.zeros(int(added.sum()), np.uint64), np.zeros(int(added.sum()), np.uint32)
        for t in right.filter(pc.is_valid(right["tokens"])).to_pylist():
            codes = np.cumsum(_from_ints(t["codes"]), dtype=np.int64)
            tokens[codes] = _tokens7(t["tokens"], t["bucket"] % LOW)
            holders[codes] = _from_ints(t["holders"])
        ends, past = np.cumsum(added), np.cumsum(sizes - added)
        for at, n, cid in zip(left["at"].to_pylist(), left["n"].to_pylist(), left["cid"].to_pylist(), strict=True):
            codes = np.concatenate([np.arange(ends[at] - added[at], ends[at]), again[past[at] - sizes[at] + added[at] : past[at]]])
            shared = codes[holders[codes] > 0]
            if 100 * len(shared) >= PERCENT * n:
                t = tokens[shared]
                by = np.argsort(t)
                out.append((cid, n, t[by].tobytes(), holders[shared[by]].astype("<u4").tobytes()))
    columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
    return pa.table(
        {
            "cid": pa.array(columns[0], pa.int64()),
            "n": pa.array(columns[1], pa.int32()),
            "tokens": pa.array(columns[2], pa.binary()),
            "holders": pa.array(columns[3], pa.binary()),
        }
    )


def signatures(tokens: np.ndarray, holders: np.ndarray, n: int) -> np.ndarray:
    """The signatures of a set of ``n`` tokens of which ``tokens`` are held by others too.

    Why similar sets A and B meet. At least ceil(0.8 n) tokens of A are in B, so at most
    ``allowance`` of A's tokens are missing there, those that no other set holds included. Let A's
    prefix be the one that ends first in the global order; B's prefix then holds every token of B up
    to there. If no signature were shared, then of each group of c prefix tokens of a class k at most
    k - 1 would be in B and c - k + 1 or more missing; the prefix is just so long that this adds up
    to more than the allowance. Both sets use the same groups, since both sign for the band of either.
    From LEAST tokens on a set always has that many: its groups, three in all or a third of a fifth
    of 1.69 n in either class, keep back fewer than are left over. Smaller sets are similar to equal ones only.
    """
    allowance = n - -(-PERCENT * n // 100) - (n - len(tokens))
    if allowance < 0 or n < LEAST:
        return np.zeros(0, np.uint64)
    order = np.lexsort((tokens, holders))
    tokens, holders = tokens[order], holders[order]
    k = 1 + np.searchsorted(CLASS_BOUNDS, holders, "left")  # 1, 2 or 3 tokens together
    band = int(math.log(n) / math.log(BAND))
    found = []
    for b in (band, band + 1):
        groups = max(1, math.ceil((100 - PERCENT) / 100 * BAND ** (b + 1) / GROUP_TOKENS))
        group = (textvec.mix(tokens) % np.uint64(groups)).astype(np.int64) * 4 + k
        group[k == 1] = 0
        # the rank of each token in its group; from the k-th on a token adds to what must be missing
        by = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], group[by][1:] != group[by][:-1]])) if len(by) else by
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
        missing = np.cumsum(rank >= k - 1)
        end = int(np.searchsorted(missing, allowance + 1)) + 1
        single = k[:end] == 1
        found.append(textvec.mix(tokens[:end][single]))
        rest = np.flatnonzero(~single)
        if len(rest):
            rest = rest[np.argsort(group[rest], kind="stable")]
            edges = np.flatnonzero(np.concatenate([[True], group[rest][1:] != group[rest][:-1], [True]]))
            seed = textvec.mix(np.array([b + 1], np.uint64))[0]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                size = int(k[rest[lo]])
                if hi - lo >= size:
                    own = textvec.mix(tokens[rest[lo:hi]] ^ seed)
                    picks = np.array(list(combinations(range(hi - lo), size)))
                    found.append(textvec.mix(own[picks].sum(1, dtype=np.uint64) + np.uint64(size)))
    return np.unique(np.concatenate(found))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cids, sizes = batch.column("cid").to_pylist(), batch.column("n").to_pylist()
        tokens, holders = batch.column("tokens"), batch.column("holders")
        found, owner = [], []
        for row, (cid, n) in enumerate(zip(cids, sizes, strict=True)):
            s = signatures(
                np.frombuffer(tokens[row].as_py(), np.uint64), np.frombuffer(holders[row].as_py(), "<u4"), n
            )
            found.append(s)
            owner.append((cid, n, len(s)))
        if found:
            counts = np.array([c for _, _, c in owner])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(found).view(np.int64)),
                    pa.array(np.repeat(np.array([c for c, _, _ in owner], np.int64), counts)),
                    pa.array(np.repeat(np.array([n for _, n, _ in owner], np.int32), counts)),
                ],
                names=["sig", "cid", "n"],
            )


# ---------------------------------------------------------------- linking


def _intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, na, nb = (batch.column(c).to_pylist() for c in ("a", "b", "na", "nb"))
        ta, tb = batch.column("ta"), batch.column("tb")
        keep = []
        for row in range(batch.num_rows):
            x, y = np.frombuffer(ta[row].as_py(), np.uint64), np.frombuffer(tb[row].as_py(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= PERCENT * (na[row] + nb[row] - both))
        at = np.flatnonzero(keep)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(a, np.int64)[at]), pa.array(np.array(b, np.int64)[at])], names=["a", "b"]
        )


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of sets that are similar."""
    of = lambda side: sets.select(
        F.col("cid").alias(side), F.col("n").alias(f"n{side}"), F.col("tokens").alias(f"t{side}")
    )
    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(lean(_intersect), "a bigint, b bigint")


def _near_sizes(x: str, y: str):
    return (100 * F.least(x, y) >= PERCENT * F.greatest(x, y)) & (F.col("a") != F.col("b"))


def _with_hub(signed: DataFrame) -> DataFrame:
    """Pairs of each signature's member and its smallest one, sizes permitting, once each."""
    hubs = signed.groupBy("sig").agg(F.min(F.struct("cid", "n")).alias("hub"))
    met = signed.join(hubs, "sig").select(F.col("hub.cid").alias("a"), F.col("hub.n").alias("nx"), F.col("cid").alias("b"), "n")
    return met.where(_near_sizes("nx", "n")).select("a", "b").distinct()


def _still_open(signed: DataFrame, members: DataFrame) -> DataFrame:
    """``signed`` with components, for the signatures that members of two components or more have."""
    known = signed.join(members.select(F.col("id").alias("cid"), "component"), "cid", "left").withColumn(
        "component", F.coalesce("component", "cid")
    )
    known = staged(known, "jaccard-known")
    several = known.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    return staged(known.join(several.select("sig"), "sig"), "jaccard-open")


def _dealt(left: DataFrame) -> DataFrame:
    """(cid, component, key, side): where each set of an open family is compared.

    A family is what open signatures connect. Its largest component needs no comparisons within; all
    others are compared with each other and with it. Both parts are split by hash into blocks of
    bounded size, and every pair of blocks that matters is a group of its own.
    """
    hubs = left.groupBy("sig").agg(F.min("cid").alias("a"))
    family = components(left.join(hubs, "sig").select("a", F.col("cid").alias("b")).distinct())
    members = left.groupBy("cid").agg(F.min("n").alias("n"), F.min("component").alias("component"))
    members = members.join(family.select(F.col("id").alias("cid"), F.col("component").alias("family")), "cid")
    members = staged(members, "jaccard-members")
    parts = members.groupBy("family", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    parts = staged(parts, "jaccard-parts")
    size = lambda c, t: F.ceil(F.greatest(F.col(c) / PAIR_SETS, F.col(t) / PAIR_TOKENS)).cast("int")
    families = parts.groupBy("family").agg(
        F.max(F.struct("c", "t", "component")).alias("main"), F.sum("c").alias("c"), F.sum("t").alias("t")
    )
    families = families.select(
        "family",
        F.col("main.component").alias("main"),
        size("main.c", "main.t").alias("main_blocks"),
        (F.col("c") - F.col("main.c")).alias("rest"),
        (F.col("t") - F.col("main.t")).alias("rest_tokens"),
    ).withColumn("rest_blocks", size("rest", "rest_tokens"))
    placed = members.join(families, "family").withColumn("in_main", F.col("component") == F.col("main"))
    blocks = F.when(F.col("in_main"), F.col("main_blocks")).otherwise(F.col("rest_blocks"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("cid"), blocks.cast("long")).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    where = lambda kind, i, j, side: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side")
    )
    own = F.col("block")
    among = F.transform(
        upto("rest_blocks"), lambda j: where(0, F.least(own, j), F.greatest(own, j), 0)
    )
    return placed.select(
        "cid",
        "component",
        "family",
        F.explode(
            F.when(F.col("in_main"), F.transform(upto("rest_blocks"), lambda i: where(1, i, own, 1))).otherwise(
                F.concat(among, F.transform(upto("main_blocks"), lambda j: where(1, own, j, 0)))
            )
        ).alias("at"),
    ).select("cid", "component", "family", "at.kind", "at.i", "at.j", "at.side")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of every set of ``a`` with every set of ``b`` (distinct sorted tokens)."""
    fa, fb = np.concatenate(a), np.concatenate(b)
    ra, rb = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    both = np.intersect1d(fa, fb)
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, len(both), 4096):
        part = both[lo : lo + 4096]
        tables = []
        for flat, row, n in ((fa, ra, len(a)), (fb, rb, len(b))):
            at = np.searchsorted(part, flat)
            at[at == len(part)] = 0
            hit = part[at] == flat
            table = np.zeros((n, len(part)), np.float32)
            table[row[hit], at[hit]] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out.astype(np.int64)


def _compare_blocks(group: pa.Table) -> pa.Table:
    """Links between components, no more than connect what the group can connect."""
    side = group["side"].to_numpy()
    cid, n, component = (group[c].to_numpy().astype(np.int64) for c in ("cid", "n", "component"))
    sets = [np.frombuffer(t, np.uint64) for t in group["tokens"].to_pylist()]
    left = np.flatnonzero(side == 0)
    right = left if group["kind"][0].as_py() == 0 else np.flatnonzero(side == 1)
    found: list[tuple[int, int]] = []
    if len(left) and len(right):
        both = overlaps([sets[k] for k in left], [sets[k] for k in right])
        near = 100 * both >= PERCENT * (n[left][:, None] + n[right][None, :] - both)
        near &= component[left][:, None] != component[right][None, :]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(*np.nonzero(near), strict=True):
            i, j = int(left[x]), int(right[y])
            p, q = root(int(component[i])), root(int(component[j]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                found.append((min(int(cid[i]), int(cid[j])), max(int(cid[i]), int(cid[j]))))
    a, b = zip(*found, strict=True) if found else ([], [])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that are done; staged tables hold what is needed."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def link_classes(sets: DataFrame) -> DataFrame:
    """Verified links (a, b) between classes: not all of them, but enough that components are exact."""
    spark = sets.sparkSession
    signed = staged(sets.mapInArrow(lean(_sign), "sig bigint, cid bigint, n int"), "jaccard-signed")
    crowded = signed.groupBy("sig").count().where("count > 1").select("sig")
    signed = staged(signed.join(crowded, "sig"), "jaccard-met")
    release(spark)
    links = staged(_verified(_with_hub(signed), sets), "jaccard-links1")
    release(spark)
    dealt = staged(_dealt(_still_open(signed, components(links))), "jaccard-dealt")
    rows = dealt.join(sets.select("cid", "n", "tokens"), "cid")
    more = rows.groupBy("family", "kind", "i", "j").applyInArrow(lean_group(_compare_blocks), "a bigint, b bigint")
    return links.unionByName(staged(more, "jaccard-links2"))


def jaccard_join(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id for each row of ``docs`` (doc_id, text).

    Words are runs of anything but white space (space, and the control characters 9 to 13), A-Z
    lower-cased; a text with fewer than ``width`` words, but one at least, is one shingle. Documents
    link when 100 * intersection >= 80 * union; ``component_id`` is the smallest doc_id that links
    reach. ``class_id`` is the smallest doc_id with the same set. Null text, and text without words,
    has 0 shingles and is its own component. Rows that repeat an id come back one for one: equal
    sets are one class however their ids are; a null id stands for no one unless its component has
    no other. An empty table gives no rows; other columns of ``docs`` are ignored. Shingles are
    compared as 64-bit hashes.
    """
    return _joined(docs, width).drop("key")


def _joined(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``jaccard_join`` with the key of each row's text."""
    spark = docs.sparkSession
    buckets = _buckets(shuffle_partitions(spark))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", text_key("text").alias("key"))
    cut = rows.mapInArrow(lean(_cut(buckets, width)), CUT_DDL)
    counted = cut.groupBy("bucket").applyInArrow(lean_group(_count_bucket), CUT_DDL)
    counted = counted.withColumn("kind", F.col("tokens").isNotNull().cast("int"))
    counted = staged(counted, "jaccard-counted", ["kind"])
    release(spark)
    blocks = counted.where("kind = 0")
    # classes: the same set may be in many blocks; one of them sends it on
    local = blocks.select("block", F.posexplode("sizes").alias("at", "n"), "keys").select(
        "block", "at", "n", F.col("keys")[F.col("at") * 2].alias("k1"), F.col("keys")[F.col("at") * 2 + 1].alias("k2")
    )
    classes = local.groupBy("n", "k1", "k2").agg(F.min(F.struct("block", "at")).alias("home"))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes")
    homes = classes.select(F.col("home.block").alias("block"), F.col("home.at").alias("at"), "n", "cid")
    marked = counted.select("bucket", "block", "sizes", "added", "again", "codes", "tokens", "holders")
    sets = homes.groupBy("block").cogroup(marked.groupBy("block")).applyInArrow(lean_group(_assemble), SETS)
    sets = staged(sets, "jaccard-sets")
    release(spark)
    links = link_classes(sets)
    member = components(links).withColumnRenamed("id", "cid")
    of_class = classes.select("n", "k1", "k2", "cid").join(member, "cid", "left").select(
        "n", "k1", "k2", "cid", F.coalesce("component", "cid").alias("component")
    )
    documents = blocks.select(F.arrays_zip("doc_ids", "texts", "of_doc").alias("docs"), "sizes", "keys").select(
        F.explode("docs").alias("d"), "sizes", "keys"
    )
    documents = documents.select(
        F.col("d.doc_ids").alias("doc_id"),
        F.col("d.texts").alias("key"),
        F.when(F.col("d.of_doc") >= 0, F.col("sizes")[F.col("d.of_doc")]).alias("n"),
        F.when(F.col("d.of_doc") >= 0, F.col("keys")[F.col("d.of_doc") * 2]).alias("k1"),
        F.when(F.col("d.of_doc") >= 0, F.col("keys")[F.col("d.of_doc") * 2 + 1]).alias("k2"),
    )
    empty = documents.where("n is null").select(
        "doc_id",
        F.lit(0).cast("long").alias("n_shingles"),
        F.col("doc_id").alias("class_id"),
        F.col("doc_id").alias("component_id"),
        "key",
    )
    full = staged(documents.where("n is not null").join(of_class, ["n", "k1", "k2"]), "jaccard-documents")
    ids = full.groupBy("cid", "component").agg(F.min("doc_id").alias("class_id"))
    least = ids.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = ids.join(least, "component").select("cid", "class_id", "component_id")
    return full.join(named, "cid").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), "class_id", "component_id", "key"
    ).unionByName(empty)


def one_per_component(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one whose id names it. Null ids stay.

    Each row goes by its own text, whatever other rows its id has. If the naming id has several texts
    in its component, the one with the least key stays.
    """
    result = staged(_joined(docs.select("doc_id", "text")), "jaccard-result")
    naming = result.where("doc_id = component_id and n_shingles > 0").select("doc_id", "key")
    several = naming.groupBy("doc_id").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last")
    more = naming.join(several, "doc_id").where("key > first").select("doc_id", "key")
    gone = staged(result.where("doc_id <> component_id").select("doc_id", "key").unionByName(more), "jaccard-dropped")
    return without(docs, gone, "text")
