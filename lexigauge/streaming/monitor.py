"""Watching a folder of prediction files: each new batch goes through the same functions as a table does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import metrics
from ..operators import evaluate
from ..sources import manifests


def watch_predictions(
    spark: SparkSession,
    folder: str,
    state: str,
    sink: Callable[[DataFrame, int], None],
    every: str | None = "300 seconds",
    thresholds: dict[str, float] | None = None,
) -> StreamingQuery:
    """Evaluates and gates the checkpoints of new files under ``folder``; ``sink`` gets (table, batch number).

    A checkpoint's files may arrive in several batches: the sums of each batch are kept beside ``state``,
    and the gate sees the checkpoint's rows of all batches so far. ``is_best`` marks the promoted
    checkpoint with the least CER of all that were seen. ``state`` is the streaming checkpoint: it knows
    which files were seen, and a batch that runs again overwrites its own sums, so a restart neither
    skips nor repeats a row. Without ``every`` what is there is processed and the query ends.
    """
    rows = spark.readStream.schema(manifests.PREDICTIONS).json(folder)
    sums = f"{state.rstrip('/')}-sums"

    def one(batch: DataFrame, number: int) -> None:
        records = batch.select(
            F.coalesce("checkpoint", F.lit("unknown")).alias("checkpoint"),
            F.coalesce("reference", "text", F.lit("")).alias("reference"),
            F.coalesce("prediction", F.lit("")).alias("prediction"),
        )
        own = evaluate.partial_sums(metrics.with_metrics(records), "checkpoint")
        own.write.mode("overwrite").parquet(f"{sums}/batch={number}")
        kept = spark.read.schema(own.schema.add("batch", "long")).parquet(sums).where(F.col("batch") <= number)
        now = kept.where(F.col("batch") == number).select("checkpoint").distinct()
        gated = evaluate.gate(evaluate.from_partials(kept, "checkpoint"), thresholds)
        best = running_best(gated).select(F.col("checkpoint").alias("_best"))
        gated = gated.join(best, gated["checkpoint"] == F.col("_best"), "left")
        gated = gated.withColumn("is_best", F.col("_best").isNotNull()).drop("_best")
        sink(gated.join(now, "checkpoint", "left_semi"), number)

    writer = rows.writeStream.foreachBatch(one).option("checkpointLocation", state)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def running_best(gated: DataFrame) -> DataFrame:
    """The promoted checkpoint with the least CER so far; on a stream, in complete mode."""
    row = F.struct("checkpoint", "val_rec_cer", "status")
    return gated.where("promote").groupBy().agg(F.min_by(row, F.struct("val_rec_cer", "checkpoint")).alias("best")).select("best.*")


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and tumbling window with a watermark. An extension: nothing of the kind was asked to be matched."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", size).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )
