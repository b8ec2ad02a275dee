"""Connected components of links between integers, by alternating star operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, staged

#: Edges that a task holds at a time when it connects them by itself.
CHUNK = 1 << 18


def _smallest(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours v, for edges (u, v)."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = _smallest(down)
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")


def connected(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From every vertex to the smallest one that these edges connect it with, but for the smallest."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(ids))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def _stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    part = pa.Table.from_batches(held)
    u, v = connected(part["u"].to_numpy(), part["v"].to_numpy())
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _connect(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= chunk:
                yield _stars(held)
                held, rows = [], 0
        if held:
            yield _stars(held)

    return run


def _connected(edges: DataFrame, count: int, chunk: int) -> DataFrame:
    """Edges of the same components, connected as far as a task sees them: about ``chunk`` a task."""
    return edges.coalesce(-(-count // chunk)).mapInArrow(lean(_connect(chunk)), "u bigint, v bigint")


def components(links: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(id, component) for every id of ``links`` (a, b): the smallest id that links reach.

    Every round keeps the components and at most the number of links; before the first and after each,
    tasks connect the edges that they hold, ``chunk`` at a time. So links that fit one chunk need no
    round, and others about the logarithm of the longest path between what tasks have connected. A
    vertex with very many links is aggregated map-side and, in the join, is split by adaptive
    execution. No link or component comes to the driver. Nulls and loops are no links.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = staged(edges, "components-0")
    before, k = None, 0
    while count := edges.count():
        one = count <= chunk
        edges = staged(_connected(edges, count, chunk), f"components-c{k}")
        if one:
            break
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, k = state, k + 1
        large = staged(_large_star(edges).distinct(), f"components-l{k}")
        edges = staged(_small_star(large).distinct(), f"components-s{k}")
    # every vertex now points to its component's smallest, which points to none
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
