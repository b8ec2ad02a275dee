"""Assets of an evaluation: which there are, how large, in what order they are fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Endings of files that hold weights, and of those that hold data.
WEIGHT_SUFFIXES = (".safetensors", ".bin", ".pdparams", ".pdopt", ".pt", ".pth", ".onnx", ".gguf")
DATA_SUFFIXES = (".parquet", ".arrow", ".jsonl", ".zip", ".tar", ".tar.gz")
GB = 1024**3


def local_dir(path: Column | str, root: str | None) -> Column:
    """A path below ``external`` goes below ``root``; others, and all without a root, stay."""
    c = text.column(path)
    if root is None:
        return c
    rest = F.regexp_extract(c, "^external(?:/(.*))?$", 1)
    moved = F.when(rest == "", F.lit(root)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), rest))
    return F.when(c.rlike("^external(/|$)"), moved).otherwise(c)


def asset_rows(datasets: DataFrame, models: DataFrame, benchmarks: DataFrame, root: str | None = None, future: bool = False) -> DataFrame:
    """Datasets, models and benchmarks (id, local_dir, and role for models) under one set of columns, with kind and status.

    Models without a folder go; our own ones are still to be trained unless ``future``.
    """
    pending = (F.coalesce("role", F.lit("")) == "ours") & F.lit(not future)
    kinds = [
        (datasets, F.lit("dataset"), F.lit(None)),
        (models.where("local_dir is not null"), F.when(pending, "future_checkpoint").otherwise("model"), F.when(pending, "pending_training")),
        (benchmarks, F.lit("external_benchmark"), F.lit(None)),
    ]
    parts = [
        rows.withColumns({"kind": kind, "status": status.cast("string"), "local_dir": local_dir("local_dir", root)})
        for rows, kind, status in kinds
    ]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def chosen(assets: DataFrame, patterns: list[str]) -> DataFrame:
    """The assets of which id, role, kind or name match a shell pattern; no pattern takes all."""
    names = [c for c in ("id", "role", "kind", "display_name") if c in assets.columns]
    return assets.where(text.matches_any(patterns, *names))


def sizes(files: DataFrame, weights: tuple[str, ...] = WEIGHT_SUFFIXES, data: tuple[str, ...] = DATA_SUFFIXES) -> DataFrame:
    """Per asset of ``files`` (id, path, size): files, those of known size, and GB in all, of weights and of data."""

    def ends(suffixes: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for s in suffixes:
            out = out | F.col("path").endswith(s)
        return out

    gb = lambda c: F.bround(F.coalesce(F.sum(c), F.lit(0)) / GB, 3)
    return files.groupBy("id").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.count("size").alias("known_size_file_count"),
        F.coalesce(F.sum("size"), F.lit(0).cast("long")).alias("total_bytes"),
        gb("size").alias("total_gb"),
        gb(F.when(ends(weights), F.col("size"))).alias("weights_gb"),
        gb(F.when(ends(data), F.col("size"))).alias("data_gb"),
    )


def fits(sized: DataFrame, free_gb: float, reserve_gb: float = 0.0) -> DataFrame:
    """One row: GB that all assets take, what would be left, and whether they fit."""
    total = sized.agg(F.coalesce(F.sum("total_gb"), F.lit(0.0)).alias("total_gb"))
    return total.withColumn("left_gb", F.lit(float(free_gb)) - F.col("total_gb")).withColumn("fits", F.col("left_gb") >= reserve_gb)


def status_counts(rows: DataFrame) -> DataFrame:
    """One row: all assets, those with metadata and with weights, system dependencies and pending ones."""
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0).cast("long"))
    return rows.agg(
        F.count(F.lit(1)).alias("count"),
        n(F.col("metadata_ready")).alias("metadata_ready"),
        n(F.col("weights_ready")).alias("weights_ready"),
        n(F.col("kind") == "system").alias("system_dependencies"),
        n(F.col("kind") == "future_checkpoint").alias("pending_training"),
    )


def phase_assets(phases: DataFrame, assets: DataFrame) -> DataFrame:
    """(phase, phase_pos, pos, id, total_gb) of ``phases`` (phase, phase_pos, ids, metadata_only), in their order.

    Unknown ids go, and phases of metadata alone have no assets.
    """
    wanted = phases.where(~F.coalesce("metadata_only", F.lit(False))).select("phase", "phase_pos", F.posexplode("ids").alias("pos", "id"))
    return wanted.join(assets.select("id", "total_gb"), "id").orderBy("phase_pos", "pos")


def phase_totals(phases: DataFrame, assets: DataFrame) -> DataFrame:
    """(phase, phase_pos, estimated_gb) of every phase, 0 for one without assets."""
    sums = phase_assets(phases, assets).groupBy("phase").agg(F.bround(F.sum(F.coalesce("total_gb", F.lit(0.0))), 3).alias("gb"))
    return phases.join(sums, "phase", "left").select("phase", "phase_pos", F.coalesce("gb", F.lit(0.0)).alias("estimated_gb"))
