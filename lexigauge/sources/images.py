"""Page images: plain files and members of tar archives, as binary columns."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("image_path"), "content")


def read_tar_members(spark: SparkSession, path: str, wanted: str | None = None) -> DataFrame:
    """(image_path as ``tar::member``, content) for members that match the regular expression ``wanted``.

    Archives come through Spark's own reader; each is opened once.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for frame in frames:
            for name, content in zip(frame.path, frame.content, strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for member in tar:
                        if member.isfile() and (wanted is None or re.search(wanted, member.name)):
                            data = tar.extractfile(member).read()
                            yield pd.DataFrame({"image_path": [f"{name}::{member.name}"], "content": [data]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "image_path string, content binary")
