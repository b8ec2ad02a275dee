"""Samples by the order of a seeded hash: the same rows on any engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import RARE_CHARS, has_rare
from .windows import numbered


def draw(seed: int, *keys: str) -> Column:
    """The hash that orders rows: md5 of the seed and the row's keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def shuffled_take(rows: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """``n`` rows, the first in hash order; a top-n, not a sort of all."""
    return rows.withColumn("_d", draw(seed, *keys)).orderBy("_d", *keys).limit(n).drop("_d")


def fixed_size(rows: DataFrame, n: int, seed: int, pos: str, *keys: str) -> DataFrame:
    """``n`` rows by hash, in the order they had (``pos``)."""
    return shuffled_take(rows, n, seed, *keys).orderBy(pos)


def first_rows(rows: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first ``n`` rows in ``order``, or all."""
    return rows if n is None else rows.orderBy(*order).limit(n)


def split_rows(rows: DataFrame, split: str, limit: int | None, *order: str) -> DataFrame:
    """The first ``limit`` rows (None: all) with their number in ``_index`` and the split's name in ``_split``."""
    return numbered(first_rows(rows, limit, *order), list(order), "_index").withColumn("_split", F.lit(split))


def round_robin(rows: DataFrame, strata: list[str], n: int, seed: int, *keys: str) -> DataFrame:
    """``n`` rows that take turns among the strata (in order), each stratum in hash order.

    Only the first n of a stratum can be taken, which lets Spark cut each task's ranks short.
    """
    named = [F.coalesce(F.col(s).cast("string"), F.lit("unknown")).alias(f"_s{k}") for k, s in enumerate(strata)]
    marks = [f"_s{k}" for k in range(len(strata))]
    tagged = rows.select("*", *named, draw(seed, *keys).alias("_d"))
    ranked = tagged.withColumn("round_no", F.row_number().over(Window.partitionBy(*marks).orderBy("_d", *keys)))
    return ranked.where(F.col("round_no") <= n).orderBy("round_no", *marks).limit(n).drop("_d", *marks)


def prefer_rare(rows: DataFrame, n: int, seed: int, text: str, keys: list[str], rare: str = RARE_CHARS) -> DataFrame:
    """``n`` rows of which a third, one at least, has rare characters as far as there are such; all if n is as large."""
    tagged = rows.withColumn("_rare", has_rare(text, rare))
    counts = tagged.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_rare").cast("int")).alias("r")).first()
    total, with_rare = counts["n"], counts["r"] or 0
    if n >= total:
        return rows
    if not with_rare:
        return shuffled_take(rows, n, seed, *keys)
    take_rare = min(with_rare, max(1, n // 3))
    take_other = min(total - with_rare, n - take_rare)
    take_rare += n - take_rare - take_other  # what is missing comes from the rest
    first = shuffled_take(tagged.where("_rare"), take_rare, seed, *keys)
    return first.unionByName(shuffled_take(tagged.where("not _rare"), take_other, seed, *keys)).drop("_rare")


def nested(rows: DataFrame, strata: list[str], sizes: list[int], seed: int, *keys: str) -> list[DataFrame]:
    """Samples of falling size, each drawn from the one before."""
    out, left = [], rows
    for size in sizes:
        left = round_robin(left, strata, size, seed, *keys).drop("round_no")
        out.append(left)
    return out
