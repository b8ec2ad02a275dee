"""Joins with verification, deduplication, merges and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_filled
from .windows import numbered, running_total


def keep_last(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """One row per key, the one with the largest ``pos``; combined map-side."""
    columns = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(F.col(key).alias("_k")).agg(F.max_by(columns, pos).alias("r")).select("r.*")


def keep_first(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    columns = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by(columns, pos).alias("r")).select("r.*")


def with_manifest(predictions: DataFrame, manifest: DataFrame, key: str, attribute: str, pos: str) -> DataFrame:
    """``predictions`` with ``attribute`` from the manifest's last row of the key, else their own, else unknown."""
    own = keep_last(manifest, key, pos).select(F.col(key), F.col(attribute).alias("_theirs"), F.lit(True).alias("matched"))
    joined = predictions.join(own, key, "left")
    value = F.coalesce(first_filled("_theirs", attribute), F.lit("unknown"))
    return joined.withColumn(attribute, value).withColumn("matched", F.coalesce("matched", F.lit(False))).drop("_theirs")


def join_report(predictions: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """One row: predictions, matched and unmatched, and the manifest's duplicate keys."""
    keys = manifest.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    found = predictions.join(keys, key, "left").agg(
        F.count(F.lit(1)).alias("predictions"),
        F.count("_n").alias("matched"),
        F.sum(F.col("_n").isNull().cast("long")).alias("unmatched"),
    )
    return found.crossJoin(keys.agg(F.sum(F.col("_n") - 1).alias("duplicate_keys")))  # one row each


def upsert(existing: DataFrame, updates: DataFrame, config: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``existing`` overwritten by ``updates``, in ``config``'s order (id, pos); others go."""
    columns = [c for c in existing.columns if c != key]
    new = updates.select(key, F.struct(*columns).alias("_new"))
    old = existing.select(key, F.struct(*columns).alias("_old"))
    merged = old.join(new, key, "full").join(config.select(key, "pos"), key)
    return merged.select(key, "pos", F.coalesce("_new", "_old").alias("r")).select(key, "pos", "r.*").orderBy("pos")


def statuses(config: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Each configured model with completed or failed, as it has predictions or none."""
    have = predictions.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("n") > 0, "completed").otherwise("failed")
    return config.join(have, key, "left").withColumn("status", state).withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def shards(rows: DataFrame, order: list[str], count: int) -> DataFrame:
    """``rows`` with a shard from 0: contiguous, sizes differing by one at most, larger ones first."""
    placed = numbered(rows, order, "_idx")
    total = placed.count()
    base, extra = divmod(total, count)
    large = extra * (base + 1)
    at = F.col("_idx")
    shard = F.when(at < large, F.floor(at / max(1, base + 1))).otherwise(extra + F.floor((at - large) / max(1, base)))
    return placed.withColumn("shard", shard.cast("long")).drop("_idx")


def merge_shards(summaries: DataFrame) -> DataFrame:
    """One row from shard summaries (shard, count, elapsed_sec, peak_memory, backend, checkpoint)."""
    total = summaries.agg(
        F.sum("count").alias("count"),
        F.max("elapsed_sec").alias("elapsed_sec"),
        F.max("peak_memory").alias("peak_memory"),
        F.max_by("backend", "shard").alias("backend"),
        F.max_by("checkpoint", "shard").alias("checkpoint"),
    )
    per = F.when(F.col("count") > 0, F.bround(F.col("elapsed_sec") / F.col("count") * 1000, 3))
    return total.withColumn("latency_per_page_ms", per)


def unseen(found: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return found.join(seen, key, "left_anti")


def cumulative(phases: DataFrame, order: str, size: str) -> DataFrame:
    """Running total of ``size`` in ``order`` (a total order), rounded at each step's end; by ranges, not in one task."""
    return running_total(phases, [order], size, "cumulative").withColumn("cumulative", F.bround("cumulative", 3))


def union_shards(shards: list[DataFrame], order: str) -> DataFrame:
    """All rows of the shards, one shard after the other, each in its own order (``shard`` and ``order`` tell it)."""
    out = shards[0].withColumn("shard", F.lit(0))
    for k, rows in enumerate(shards[1:], 1):
        out = out.unionByName(rows.withColumn("shard", F.lit(k)), allowMissingColumns=True)
    return out.orderBy("shard", order)


def union_tagged(frames: dict[str, DataFrame], name: str) -> DataFrame:
    """All rows under the union of their columns, with the name of the table each came from."""
    parts = [rows.withColumn(name, F.lit(k)) for k, rows in frames.items()]
    out = parts[0]
    for rows in parts[1:]:
        out = out.unionByName(rows, allowMissingColumns=True)
    return out
