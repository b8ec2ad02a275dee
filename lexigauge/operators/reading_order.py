"""Layout-aware reading order of a page's boxes.

Grouping into rows is greedy: whether a box joins a row depends on the boxes placed before it. No join
expresses that, so a page's boxes are ordered together in a grouped Arrow function; a page is small.
"""

from __future__ import annotations

from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry

#: Parts of layout names whose pages read row by row.
ROW_LAYOUTS = ("table", "form", "receipt", "worksheet", "exam", "schedule")
MODES = ("simple", "layout_aware")
Box = tuple  # (x1, y1, x2, y2, id)


def _cx(b: Box) -> float:
    return (b[0] + b[2]) / 2


def _cy(b: Box) -> float:
    return (b[1] + b[3]) / 2


def _extent(b: Box, axis: int) -> float:
    return max(1, b[axis + 2] - b[axis])


def _overlap(a: Box, b: Box, axis: int) -> float:
    shared = max(0, min(a[axis + 2], b[axis + 2]) - max(a[axis], b[axis]))
    return shared / max(1, min(_extent(a, axis), _extent(b, axis)))


def rows_of(boxes: list[Box], min_y: float = 0.5, max_x: float = 0.3) -> list[list[Box]]:
    """Rows of boxes side by side: each box goes to the first row all of whose boxes it stands beside."""
    rows: list[list[Box]] = []
    for b in sorted(boxes, key=lambda b: (_cy(b), _cx(b))):
        beside = lambda row, b=b: all(_overlap(b, m, 1) >= min_y and _overlap(b, m, 0) <= max_x for m in row)
        target = next((row for row in rows if beside(row)), None)
        if target is None:
            rows.append([b])
        else:
            target.append(b)
    for row in rows:
        row.sort(key=lambda b: (_cx(b), b[0]))
    return sorted(rows, key=lambda row: median(map(_cy, row)))


def columns_of(boxes: list[Box], page_width: float, least: int = 4) -> list[list[Box]]:
    """Two columns if the widest step between centers is clear and both sides are filled, else one."""
    if len(boxes) < least or page_width <= 0:
        return [boxes]
    by_x = sorted(boxes, key=_cx)
    steps = [_cx(b) - _cx(a) for a, b in zip(by_x, by_x[1:])]
    cut = max(range(len(steps)), key=steps.__getitem__)
    clear = steps[cut] >= max(0.15 * page_width, 0.75 * median(_extent(b, 0) for b in by_x))
    left, right = by_x[: cut + 1], by_x[cut + 1 :]
    filled = min(len(left), len(right)) >= max(2, int(0.20 * len(boxes)))
    return [left, right] if clear and filled else [boxes]


def reads_by_row(boxes: list[Box], page_width: float, layout: str) -> bool:
    if any(part in layout for part in ROW_LAYOUTS):
        return True
    if len(boxes) < 10 or page_width <= 0:
        return False
    rows = rows_of(boxes)
    narrow = sum(_extent(b, 0) < 0.45 * page_width for b in boxes) / len(boxes)
    return narrow >= 0.65 and sum(len(r) >= 3 for r in rows) >= max(2, int(0.15 * len(rows)))


def layout_order(boxes: list[Box], page_width: float, layout: str) -> list[Box]:
    """Columns one after the other as far as they split, rows within."""
    out: list[Box] = []
    waiting = [boxes]
    while waiting:
        region = waiting.pop()
        if len(region) > 1 and not reads_by_row(region, page_width, layout):
            parts = columns_of(region, page_width)
            if len(parts) > 1:
                waiting += reversed(parts)  # the left one is next
                continue
        out += [b for row in rows_of(region) for b in row]
    return out


def reading_order(boxes: DataFrame, mode: str = "layout_aware") -> DataFrame:
    """(page_id, box_id, position) for boxes (page_id, box_id, box, page_width, layout_type)."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    if mode == "simple":
        key = F.struct(geometry.simple_key("box").alias("at"), F.col("box_id").alias("id"))
        page = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(key)).alias("sorted"))
        return page.select("page_id", F.posexplode("sorted").alias("position", "k")).select(
            "page_id", F.col("k.id").alias("box_id"), F.col("position").cast("long").alias("position")
        )

    def order(page: pd.DataFrame) -> pd.DataFrame:
        own = list(zip(page.x1, page.y1, page.x2, page.y2, page.box_id, strict=True))
        own.sort(key=lambda b: b[4])  # rows arrive in any order
        ids = [b[4] for b in layout_order(own, page.page_width.iloc[0] or 0, (page.layout_type.iloc[0] or "").lower())]
        return pd.DataFrame({"page_id": page.page_id.iloc[0], "box_id": ids, "position": range(len(ids))})

    kinds = dict(boxes.dtypes)
    flat = boxes.select("page_id", "box_id", "box.*", "page_width", "layout_type")
    return flat.groupBy("page_id").applyInPandas(
        order, f"page_id {kinds['page_id']}, box_id {kinds['box_id']}, position bigint"
    )
