"""What the training-data operators share: input tables, staged tables, word rules."""

from __future__ import annotations

import atexit
import ctypes
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, and the letters that lower-casing touches.
WORD_SEPARATORS = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SEPARATOR_PATTERN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader (any store Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver can reach.

    It is the cluster's ``spark.checkpoint.dir``; a local one is made only where that is unset and
    all executors are this machine's one process. Elsewhere other executors couldn't read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lexigauge-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit; the folder belongs to the cluster then
        pass


#: Staged tables that are still there, in the order in which they were written.
_live: list[str] = []


def staged(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    A lost executor costs a re-read of the files and nothing upstream of them. The table goes at the
    session's end, or with the ``scratch`` it was written in.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexigauge/{label}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _live.append(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, and_before: int = 0) -> Iterator[None]:
    """Tables that are staged inside, but for the last one, are removed at the end.

    The block's result is what it staged last; nothing that is used later may read the others.
    ``and_before`` tables that were staged just before go too.
    """
    before = len(_live) - and_before
    yield
    for path in _live[before:-1]:
        _remove(spark, path)
    del _live[before:-1]


@cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # the C library has no such function
        return lambda pad: 0


def give_back() -> None:
    """Hands the memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def lean(run: Callable) -> Callable:
    """``run``, a function of Arrow batches, after whose last batch the worker gives its memory back.

    A worker outlives its task and idles while others of its executor run. What it has freed and kept is
    missing there: 100 MB and more after a task that read texts.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return own


#: Bytes of a group's tables from which on memory is given back after it.
LARGE_GROUP = 1 << 20


def lean_group(function: Callable) -> Callable:
    """``function``, of a group's Arrow tables, after which the worker gives its memory back; see ``lean``."""

    def one(left: pa.Table) -> pa.Table:
        out = function(left)
        if left.nbytes >= LARGE_GROUP:
            give_back()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = function(left, right)
        if left.nbytes + right.nbytes >= LARGE_GROUP:
            give_back()
        return out

    return one if function.__code__.co_argcount == 1 else two


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver's as a plan of built-in functions, whose size Spark knows."""
    names = [part.split()[0] for part in schema.split(", ")]
    data = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(data), f"array<struct<{schema}>>")))


def text_key(*columns: str) -> Column:
    """Hash of a row's texts, null like empty: with the id it tells rows apart that share an id."""
    return F.xxhash64(*[F.coalesce(F.col(c), F.lit("")) for c in columns])


def without(docs: DataFrame, judged: DataFrame, *columns: str) -> DataFrame:
    """The rows of ``docs`` that ``judged`` (doc_id, key) doesn't name; ``key`` is ``text_key`` of ``columns``.

    For verdicts that rows of equal id and equal ``columns`` share. Null ids match null ids.
    """
    gone = judged.select(F.col("doc_id").alias("_gone"), F.col("key").alias("_gone_key")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("_gone")) & (text_key(*columns) == F.col("_gone_key"))
    return docs.join(gone, same, "left_anti")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. ``lower`` does just that to text that is all ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
