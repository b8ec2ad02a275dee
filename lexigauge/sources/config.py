"""Small files that the driver reads: YAML settings, model lists, charsets, named benchmarks, JSON documents."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import manifests

#: Benchmarks by name, as (manifest below the asset root, role).
BENCHMARKS = {
    "kazakhocr_cyrillic": ("manifests/kazakhocr_cyrillic.jsonl", "Kazakh Cyrillic OCR transfer benchmark"),
    "kohtd": ("manifests/kohtd.jsonl", "Kazakh handwritten transfer check"),
}
MODELS = "id string, display_name string, type string, checkpoint string, languages array<string>"


def read_yaml(path: str) -> dict:
    """The settings of a file; an empty one has none."""
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def model_rows(spark: SparkSession, settings: dict) -> DataFrame:
    """The ``models`` of the settings: the name is the id and the type ``unknown`` where none is given."""
    rows = [
        (str(m["id"]), str(m.get("display_name", m["id"])), str(m.get("type", "unknown")), m.get("checkpoint"), [str(x) for x in m.get("languages", [])])
        for m in settings.get("models", [])
    ]
    return spark.createDataFrame(rows, MODELS)


def reads_whole_pages(types: tuple[str, ...], model_type: Column | str = "type") -> Column:
    """Whether a model of this type reads pages, not lines."""
    return F.coalesce((F.col(model_type) if isinstance(model_type, str) else model_type).isin(*types), F.lit(False))


def read_charset(path: str) -> str:
    """All characters of a file but line breaks, each once, in code-point order."""
    return "".join(sorted(set(Path(path).read_text(encoding="utf-8")) - set("\r\n")))


def benchmark_manifest(spark: SparkSession, name: str, root: str, schema: str = manifests.PAGES) -> DataFrame:
    if name not in BENCHMARKS:
        raise KeyError(f"unknown benchmark {name!r}; one of {', '.join(sorted(BENCHMARKS))}")
    return manifests.read_jsonl(spark, f"{root.rstrip('/')}/{BENCHMARKS[name][0]}", schema)


def write_json_document(row: DataFrame, path: str) -> None:
    """The only row of a table as one JSON document; letters stay letters."""
    rows = row.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a document is one row")
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(rows[0].asDict(recursive=True), ensure_ascii=False, indent=2, default=str) + "\n", encoding="utf-8")
