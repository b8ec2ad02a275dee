"""Exact duplicates by deterministic block naming (DataFrame operations only).

Every text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted and
get integer names; then adjacent names are paired, the distinct pairs are sorted and named in
turn, and so on until one name is left for each document. Two documents have the same name and
the same number of blocks exactly when their texts are equal.

Shuffles. The text itself moves once: distinct blocks, combined map-side first, so a text that a
third of all rows share leaves each task once. Documents find their blocks' names through the
pair (xxhash64, length) of a block; the names table is checked for pairs that two different
blocks share, and if there is one the names are joined by content instead, so a hash never
decides that two texts are equal. All later rounds move integers only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, staged

BLOCK_BYTES = 16_384


def _blocks(block_bytes: int):
    """Array of the blocks of ``norm``; an empty text has one empty block."""
    raw = F.col("norm").cast("binary")
    last = F.greatest(F.ceil(F.octet_length("norm") / F.lit(block_bytes)), F.lit(1)).cast("int") - 1
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.substring(raw, i * F.lit(block_bytes) + F.lit(1), F.lit(block_bytes)),
    )


def _named(distinct_rows: DataFrame, *keys: str) -> DataFrame:
    """Integer names for distinct rows: partition number and rank in the partition's sort order.

    Equal content has one name; which one depends on the number of partitions. No result shows a name.
    """
    return distinct_rows.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _name_blocks(rows: DataFrame, norm: DataFrame, block_bytes: int, by_content: bool) -> DataFrame:
    """(rid, doc_id, sha, n_blocks, i, name) for every block of every row."""
    names = norm.select(F.explode(_blocks(block_bytes)).alias("b")).select(F.xxhash64("b").alias("h"), "b").distinct()
    names = _named(names, "b").withColumn("len", F.octet_length("b"))
    if by_content:
        # the rare way: names are joined by the block itself
        names = staged(names, "dedup-names")
        flat = rows.select(
            "rid", "doc_id", "sha", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("i", "b")
        )
        return flat.join(names.select("b", "name"), "b").drop("b")
    names = staged(names.select("h", "len", "name"), "dedup-names")
    if not names.groupBy("h", "len").count().where("count > 1").isEmpty():
        return None
    flat = rows.select(
        "rid", "doc_id", "sha", F.size("address").alias("n_blocks"), F.posexplode("address").alias("i", "at")
    ).select("rid", "doc_id", "sha", "n_blocks", "i", F.col("at.h").alias("h"), F.col("at.len").alias("len"))
    return flat.join(names, ["h", "len"]).drop("h", "len")


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, by_content: bool = False) -> DataFrame:
    """(rid, doc_id, sha, n_blocks, name) per row of ``docs`` (doc_id, text).

    Rows with equal text (after lower-casing A-Z; null counts as empty) and no others agree in
    (n_blocks, name). ``rid`` tells repeated rows apart.
    """
    norm = docs.select("doc_id", ascii_lower(F.coalesce(F.col("text"), F.lit(""))).alias("norm"))
    kept = ["rid", "doc_id", "sha"]
    rows = norm.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        F.unhex(F.sha2("norm", 256)).alias("sha"),
        *(
            [_blocks(block_bytes).alias("blocks")]
            if by_content
            else [
                F.transform(
                    _blocks(block_bytes),
                    lambda b: F.struct(F.xxhash64(b).alias("h"), F.octet_length(b).alias("len")),
                ).alias("address")
            ]
        ),
    )
    rows = staged(rows, "dedup-rows")
    seq = _name_blocks(rows, norm, block_bytes, by_content)
    if seq is None:
        return identities(docs, block_bytes, by_content=True)
    seq = staged(seq, "dedup-level0")
    single = seq.where("n_blocks = 1").select(*kept, "n_blocks", "name")
    longest = seq.agg(F.max("n_blocks")).first()[0] or 1
    if longest == 1:
        return single
    names = seq.where("n_blocks > 1").select("rid", "n_blocks", "i", "name")
    done, left, level = [], longest, 1
    while left > 1:
        pairs = names.groupBy("rid", "n_blocks", F.shiftright("i", 1).alias("i")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("z"),
        )
        pairs = staged(pairs, f"dedup-pairs{level}")
        # documents with another number of blocks are never equal: they may share names
        named = _named(pairs.select("a", "z").distinct(), "a", "z")
        names = staged(pairs.join(named, ["a", "z"]).select("rid", "n_blocks", "i", "name"), f"dedup-level{level}")
        ends = F.col("n_blocks") <= F.lit(1 << level)
        done.append(names.where(ends).select("rid", "name"))
        names = names.where(~ends)
        left, level = (left + 1) // 2, level + 1
    multi = done[0]
    for part in done[1:]:
        multi = multi.unionByName(part)
    first = seq.where("n_blocks > 1 and i = 0").drop("name", "i")
    return single.unionByName(first.join(multi, "rid").select(*kept, "n_blocks", "name"))


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays; a null doc_id is smaller than any
    other, and of rows that repeat the same doc_id and text exactly one is marked kept. Null text
    counts as empty, and empty texts form one group. An empty table gives no rows. Other columns
    of ``docs`` are ignored, whatever their names.
    """
    ids = staged(identities(docs, block_bytes), "dedup-ids")
    groups = ids.groupBy("n_blocks", "name").agg(
        F.max(F.struct("doc_id", "rid")).alias("best"), F.count(F.lit(1)).alias("group_size")
    )
    return ids.join(groups, ["n_blocks", "name"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text another row has; the row with the largest doc_id stays.

    All columns of ``docs`` come back. Rows that repeat a doc_id and its text leave one row.
    """
    result = staged(exact_dedup(docs.select("doc_id", "text")), "dedup-result")
    if result.groupBy("doc_id").count().where("count > 1").isEmpty():
        # written first, so that Spark knows its size when it chooses how to join
        gone = staged(result.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")), "dedup-dropped")
        return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")
    # repeated doc_ids: the text tells which rows of an id go
    sha = F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256)
    keep = result.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    rows = docs.withColumn("_own", sha)
    rows = rows.join(keep, rows["doc_id"].eqNullSafe(keep["_id"]) & (F.col("_own") == F.col("_sha")), "left_semi")
    return rows.dropDuplicates(["doc_id", "_own"]).drop("_own")
