"""Comparing models, checkpoints and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import summary_columns

COMPARED = ("val_rec_cer", "val_rec_wer", "val_rec_chrf", "val_rec_exact_match")


def leaderboard(metrics: DataFrame, benchmark: str = "benchmark", model: str = "model") -> DataFrame:
    """Metrics of every benchmark and model in one pass."""
    return metrics.groupBy(benchmark, model).agg(*summary_columns(metrics))


def best(board: DataFrame, by: str = "benchmark", cer: str = "val_rec_cer", tie: str = "model") -> DataFrame:
    """Of each group the row with the least CER (rows without one don't compete), ties by ``tie``."""
    row = F.struct(*[F.col(c) for c in board.columns if c != by])
    rows = board.where(F.col(cer).isNotNull()).groupBy(by).agg(F.min_by(row, F.struct(cer, tie)).alias("r"))
    return rows.select(by, "r.*")


def ordered(board: DataFrame, by: str = "benchmark", cer: str = "val_rec_cer") -> DataFrame:
    """By group and CER; no CER, and one of exactly 0 (nothing was scored), go as 1."""
    return board.orderBy(by, F.coalesce(F.nullif(F.col(cer), F.lit(0.0)), F.lit(1.0)))


#: The columns of a leaderboard file, in their order.
FILE_COLUMNS = (
    "benchmark", "model", "status", "val_rec_count", "val_rec_cer", "val_rec_wer", "val_rec_chrf", "val_rec_exact_match",
    "val_rec_rare_char_cer", "val_rec_latency_ms_per_crop", "error",
)


def file_rows(board: DataFrame) -> DataFrame:
    """The board with a leaderboard file's columns; what it lacks is null."""
    return board.select(*[F.col(c) if c in board.columns else F.lit(None).cast("string").alias(c) for c in FILE_COLUMNS])


def deltas(current: DataFrame, baseline: DataFrame, key: str = "benchmark") -> DataFrame:
    """Differences of the metrics both sides have, and the relative reduction of CER."""
    names = [c for c in COMPARED if c in current.columns and c in baseline.columns]
    both = current.select(key, *[F.col(c).alias(f"c_{c}") for c in names]).join(
        baseline.select(key, *[F.col(c).alias(f"b_{c}") for c in names]), key
    )
    out = [(F.col(f"c_{c}") - F.col(f"b_{c}")).alias(f"{c}_delta") for c in names]
    if "val_rec_cer" in names:
        less = F.col("b_val_rec_cer") - F.col("c_val_rec_cer")
        out.append((less / F.greatest(F.lit(1e-12), F.col("b_val_rec_cer"))).alias("cer_relative_reduction"))
    return both.select(key, *out)


def checkpoint_key(name: Column | str) -> Column:
    """Epochs by number, other checkpoints after them, the latest last."""
    name = F.col(name) if isinstance(name, str) else name
    epoch = F.regexp_extract(name, r"epoch_(\d+)", 1)
    return F.when(epoch != "", epoch.cast("long")).when(F.contains(name, F.lit("latest")), F.lit(10**12)).otherwise(F.lit(10**11))


def running_best(history: DataFrame, run: str, order: str, cer: str = "val_rec_cer") -> DataFrame:
    """Each evaluation with the least CER of its run so far among those the gate promotes, and whether it improves on it."""
    before = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("promote"), F.col(cer))
    rows = history.withColumn("best_before", F.min(own).over(before))
    better = F.col("promote") & (F.col("best_before").isNull() | (F.col(cer) < F.col("best_before")))
    return rows.withColumn("is_best", F.coalesce(better, F.lit(False)))


def rename_metrics(row: DataFrame, names: dict[str, str], defaults: dict[str, float] | None = None) -> DataFrame:
    """Metric columns renamed; a default stands in for a metric that is missing or null, and is marked as such."""
    out = row.withColumnsRenamed({k: v for k, v in names.items() if k in row.columns})
    filled = [k for k in defaults or {} if k in out.columns]
    missing = F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in filled], F.lit(None).cast("string")))
    absent = [k for k in defaults or {} if k not in out.columns]
    out = out.withColumn("defaulted", F.concat(missing, F.array(*[F.lit(k) for k in absent]).cast("array<string>")))
    for k, v in (defaults or {}).items():
        out = out.withColumn(k, F.coalesce(F.col(k), F.lit(v)) if k in filled else F.lit(v))
    return out
