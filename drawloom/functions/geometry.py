"""Boxes (x0, y0, x1, y1) as columns; y grows downwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from drawloom.config import RULES, Rules

SIDES = ("x0", "y0", "x1", "y1")


def box(prefix: str = "") -> dict[str, Column]:
    return {s: F.col(f"{prefix}{s}") for s in SIDES}


def width(b: dict[str, Column]) -> Column:
    return b["x1"] - b["x0"]


def height(b: dict[str, Column]) -> Column:
    return b["y1"] - b["y0"]


def area(b: dict[str, Column]) -> Column:
    return F.greatest(width(b), F.lit(0.0)) * F.greatest(height(b), F.lit(0.0))


def is_wide(b: dict[str, Column]) -> Column:
    return width(b) >= height(b)


def _shared(a: dict[str, Column], b: dict[str, Column], low: str, high: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(a[high], b[high]) - F.greatest(a[low], b[low]))


def x_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Shared width over the smaller width."""
    least = F.least(width(a), width(b))
    return F.when(least > 0, _shared(a, b, "x0", "x1") / least).otherwise(F.lit(0.0))


def y_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    least = F.least(height(a), height(b))
    return F.when(least > 0, _shared(a, b, "y0", "y1") / least).otherwise(F.lit(0.0))


def overlap_ratio(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Shared area over the smaller area."""
    shared = _shared(a, b, "x0", "x1") * _shared(a, b, "y0", "y1")
    return shared / F.greatest(F.least(area(a), area(b)), F.lit(1e-9))


def zone(b: dict[str, Column], page_width: Column, page_height: Column, p: Rules = RULES) -> Column:
    """Where the centre of a box lies; the right strip comes first, so a right edge is never reached."""
    cx, cy = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2
    edge = (cy < page_height * p["zones"]["edge"]["y"]) | (cx < page_width * p["zones"]["edge"]["x"][0]) | (cx > page_width * p["zones"]["edge"]["x"][1])
    return (
        F.when(cx > page_width * p["zones"]["title"]["x"], "title-block/right")
        .when(cy > page_height * p["zones"]["title"]["y"], "title-block/bottom")
        .when(edge, "edge")
        .otherwise("drawing")
    )


def sub_box(b: dict[str, Column], length: Column, start: Column, end: Column) -> Column:
    """The part of a span's box that its characters start:end take."""
    n = F.greatest(length, F.lit(1))
    s = F.greatest(F.lit(0), F.least(start, n))
    e = F.greatest(s + 1, F.least(end, n))
    wide = is_wide(b)
    return F.struct(
        F.when(wide, b["x0"] + width(b) * s / n).otherwise(b["x0"]).alias("x0"),
        F.when(wide, b["y0"]).otherwise(b["y0"] + height(b) * s / n).alias("y0"),
        F.when(wide, b["x0"] + width(b) * e / n).otherwise(b["x1"]).alias("x1"),
        F.when(wide, b["y1"]).otherwise(b["y0"] + height(b) * e / n).alias("y1"),
    )


def relative(b: dict[str, Column], page_width: Column, page_height: Column) -> dict[str, Column]:
    w, h = F.greatest(page_width, F.lit(1.0)), F.greatest(page_height, F.lit(1.0))
    return {"x0": b["x0"] / w, "y0": b["y0"] / h, "x1": b["x1"] / w, "y1": b["y1"] / h}
