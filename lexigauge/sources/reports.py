"""Markdown and HTML from small collected tables."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

MOST_ROWS = 10_000


def _small(rows: DataFrame) -> list[dict]:
    got = [r.asDict(recursive=True) for r in rows.limit(MOST_ROWS + 1).collect()]
    if len(got) > MOST_ROWS:
        raise ValueError(f"a report takes {MOST_ROWS} rows at most; aggregate or choose first")
    return got


def _cell(value) -> str:
    return "" if value is None else f"{value:.4f}" if isinstance(value, float) else str(value)


def markdown_table(rows: DataFrame, title: str | None = None) -> str:
    head = rows.columns
    lines = [f"# {title}", ""] if title else []
    lines += ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    for r in _small(rows):
        lines.append("| " + " | ".join(_cell(r[c]).replace("|", "\\|") for c in head) + " |")
    return "\n".join(lines) + "\n"


def html_examples(rows: DataFrame, title: str) -> str:
    """Examples with their group, texts and CER; the texts are escaped."""
    parts = [f"<html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>"]
    for r in _small(rows.select("qualitative_group", "sample_id", "reference", "prediction", "cer")):
        parts.append(
            f"<section><h2>{escape(r['qualitative_group'])}: {escape(str(r['sample_id']))}</h2>"
            f"<pre>{escape(r['reference'] or '')}</pre><pre>{escape(r['prediction'] or '')}</pre><p>CER {r['cer']:.4f}</p></section>"
        )
    return "".join(parts) + "</body></html>"
