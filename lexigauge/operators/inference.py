"""Running a recogniser over rows: Arrow batches, one model per worker, errors kept beside the text."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A backend is made once per worker and maps (image references, prompts) to texts.
Backend = Callable[[list[str], list[str]], list[str]]
_REGISTRY: dict[str, Callable[[], Backend]] = {}
BATCH = 32


def register_backend(name: str, make: Callable[[], Backend]) -> None:
    _REGISTRY[name] = make


def backend_factory(name: str) -> Callable[[], Backend]:
    if name not in _REGISTRY:
        raise ValueError(f"unknown backend {name!r}; one of {', '.join(sorted(_REGISTRY)) or 'none'}")
    return _REGISTRY[name]


def echo(rows: DataFrame) -> DataFrame:
    """The reference as prediction: a test double for any recogniser."""
    return rows.withColumn("prediction", F.coalesce("reference", F.lit(""))).withColumn("error", F.lit(None).cast("string"))


#: What stands in place of a text that took too long or failed, where marks are wanted.
TIMEOUT, FAILED = "[TIMEOUT]", "[FAILED]"
#: Fields that hold a recogniser's text, in order of preference.
TEXT_FIELDS = ("markdown", "text", "content", "rec_text", "transcription")


def text_of(output) -> str:
    """The text in whatever a recogniser returns: lists line by line, of a record its text field, else all it holds."""
    if output is None or isinstance(output, str):
        return output or ""
    if isinstance(output, dict):
        named = next((output[f] for f in TEXT_FIELDS if output.get(f)), None)
        if named is not None:
            return str(named)
        parts = [text_of(v) for v in output.values() if isinstance(v, (str, list, tuple, dict))]
    elif isinstance(output, (list, tuple)):
        parts = list(map(text_of, output))
    else:
        held = [getattr(output, f) for f in ("markdown", "text", "content", "res", "json", "data") if hasattr(output, f)]
        parts = [text_of(v) for v in held if not callable(v)]
        if not parts:
            return str(output)
    return "\n".join(p for p in parts if p)


def predict(
    rows: DataFrame, make: Callable[[], Backend], batch: int = BATCH, timeout: float | None = 30.0, retry: bool = True, marks: bool = False
) -> DataFrame:
    """``rows`` (image_url, prompt, ...) with prediction, latency_ms and error.

    If a batch fails its rows are tried one by one, each for ``timeout`` seconds at most; without
    ``retry`` the whole batch has failed. A row that fails has an empty prediction and the error's text,
    so failures are never scored as text; with ``marks`` its prediction is TIMEOUT or FAILED.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, prediction string, latency_ms double, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()

        def one(image: str, prompt: str) -> tuple[str, str | None]:
            answer: list = []

            def work() -> None:
                try:
                    answer.append((text_of(list(model([image], [prompt]))[0]), None))
                except Exception as e:
                    answer.append((FAILED if marks else "", f"{type(e).__name__}: {e}"))

            own = threading.Thread(target=work, daemon=True)
            own.start()
            own.join(timeout)
            return answer[0] if answer else (TIMEOUT if marks else "", f"TimeoutError: more than {timeout} seconds")

        for frame in frames:
            texts, times, errors = [], [], []
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                images, prompts = part.image_url.tolist(), part.prompt.fillna("").tolist()
                began = time.perf_counter()
                try:
                    got, failed = list(map(text_of, model(images, prompts))), [None] * len(part)
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} texts for {len(part)} images")
                except Exception as e:
                    if retry:
                        got, failed = map(list, zip(*map(one, images, prompts), strict=True))
                    else:
                        got, failed = [FAILED if marks else ""] * len(part), [f"{type(e).__name__}: {e}"] * len(part)
                spent = (time.perf_counter() - began) * 1000 / max(1, len(part))
                texts += got
                errors += failed
                times += [spent] * len(part)
            yield frame.assign(prediction=texts, latency_ms=times, error=errors)

    return rows.mapInPandas(run, schema)


def summary(predicted: DataFrame) -> DataFrame:
    return predicted.agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("latency_ms").alias("elapsed_ms"),
        F.avg("latency_ms").alias("latency_per_row_ms"),
        F.sum(F.col("error").isNotNull().cast("long")).alias("failed"),
    )
