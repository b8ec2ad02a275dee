"""Totals and numbers over a global order, without a single-task window."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fixed(df: DataFrame) -> DataFrame:
    """The rows as they are now, written to the cluster's ``spark.checkpoint.dir``.

    Partition numbers must not change between two uses of a range partitioning, nor when an executor
    is lost. A local folder is taken only where that setting is unset.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="lexigauge-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to each, in ``order`` (a total order).

    Rows are dealt out by ranges of ``order``; each task adds up its own and gets the total of the
    ranges before it, a row per partition, from the driver.
    """
    parts = fixed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = sorted((r["_part"], r["t"]) for r in parts.groupBy("_part").agg(F.sum(value).alias("t")).collect())
    kind = dict(parts.agg(F.sum(value).alias("t")).dtypes)["t"]
    before, total = [], 0.0 if kind == "double" else 0
    for part, own in sums:
        before.append((part, total))
        total += own or 0
    starts = df.sparkSession.createDataFrame(before, f"_part int, _before {kind}")
    local = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        parts.join(F.broadcast(starts), "_part")
        .withColumn(name, F.sum(value).over(local) + F.col("_before"))
        .drop("_part", "_before")
    )


def numbered(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """``df`` with each row's number from 0 in ``order`` (a total order)."""
    out = running_total(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", name)
    return out.withColumn(name, F.col(name) - 1).drop("_one")
