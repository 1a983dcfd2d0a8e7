"""Which marks a marked-up document gets: selection, style, order.  Drawing them is left to a consumer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawloom.functions import geometry as G
from drawloom.functions import text as T
from drawloom.operators.placement import running_index
from drawloom.operators.scope import IGNORED_KINDS

RATING_ORDER = ("Low", "Medium", "High")
# Outline colours by change.
OUTLINES = {"added": (0, 188, 212, 255), "removed": (34, 160, 90, 255), "moved": (230, 97, 181, 255)}
MODIFIED_OUTLINE = (220, 50, 50, 255)
# Words that hint at tables on a page.
STRONG_TABLE_TERMS = tuple("assembly catalog item qty quantity description material reference part spec schedule bom bill manufacturer model vendor".split())
SCHEDULE_FAMILIES = ("schedule", "switch_schedule", "fiber_schedule")
LARGE_PAGE = 1_200_000
MOST_MARKS = 120


def passes_rating(rating: Column, least: str = "Medium") -> Column:
    rank = lambda c: F.array_position(F.array(*map(F.lit, RATING_ORDER)), c)
    return rank(rating) >= rank(F.lit(least.title()))


def precise(b: dict[str, Column]) -> Column:
    """Whether a box is as tight as a line of text, upright or turned."""
    w, h = F.abs(G.width(b)), F.abs(G.height(b))
    return (w > 0) & (h > 0) & ~((w > 180) & (h > 35)) & ~((h > 180) & (w > 35)) & (w <= 220) & (h <= 180) & (w * h <= 9000)


def mark_style(kind: Column, share: Column, has_rows: Column) -> Column:
    return F.when(has_rows, "row").when((share >= 0.12) | kind.isin(*IGNORED_KINDS), "corners").otherwise("outline")


def outline(change: Column) -> Column:
    colour = F.array(*map(F.lit, MODIFIED_OUTLINE))
    for name, value in OUTLINES.items():
        colour = F.when(change == name, F.array(*map(F.lit, value))).otherwise(colour)
    return colour


def markers(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """Marks of changes (doc_id, page_num, seq, kind, change, has_rows, x0..y1) with style and outline, without near-equals.

    A mark that covers over .92 of the smaller area with an earlier one of its
    colour goes; at most 120 a page stay, the report's limit.
    """
    from drawloom.operators.match import suppress_overlaps

    share = G.area(G.box()) / (width * height)
    style = mark_style(F.col("kind"), share, F.col("has_rows"))
    styled = boxes.withColumn("style", F.when(share > 0.45, "corners").otherwise(style)).withColumn("outline", outline(F.col("change")))
    styled = styled.withColumn("colour", F.array_join("outline", ",")).withColumn("priority", F.lit(0))
    kept = suppress_overlaps(styled, most=0.92, keys=["doc_id", "page_num", "colour"])
    order = Window.partitionBy("doc_id", "page_num").orderBy("seq")
    return kept.withColumn("n_", F.row_number().over(order)).filter(F.col("n_") <= MOST_MARKS).drop("n_", "priority", "colour")


def table_gate(n_words: Column, text: Column, family: Column, area: Column) -> Column:
    """Whether a page is worth a search for tables."""
    from drawloom.operators.diff import keyword_hits
    from drawloom.operators.scope import TABLE_TERMS

    n = T.normalize_text(F.substring(text, 1, 5000))
    hints, strong = keyword_hits(n, TABLE_TERMS), keyword_hits(n, STRONG_TABLE_TERMS)
    return (hints > 0) & (
        F.when(F.coalesce(family, F.lit("")).isin(*SCHEDULE_FAMILIES), F.lit(True))
        .when(area >= LARGE_PAGE, (strong >= 4) & (n_words <= 1200))
        .otherwise(~((n_words > 1800) & (strong < 3)))
    )


def review_order(documents: DataFrame) -> DataFrame:
    """(position, sheet_id, title, status) of a review package: changed documents by sheet, then the others."""
    changed = F.col("status") == "changed"
    shown = documents.filter(changed | F.col("status").isin("added", "removed", "review_needed"))
    keys = {"k1_": ~changed, "k2_": F.coalesce("sheet_id", F.lit("")), "k3_": F.coalesce("title", F.lit("")), "k4_": F.col("status")}
    placed = running_index(shown.withColumns(keys), list(keys))
    return placed.select((F.col("index") + 1).alias("position"), "sheet_id", "title", "status")
