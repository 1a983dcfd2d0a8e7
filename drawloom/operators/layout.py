"""From words to rows, cells and regions.

``words`` are (doc_id, page_num, seq, x0, y0, x1, y1, word).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawloom.functions import text as T

ROW_ID = re.compile(r"\b(?=[a-z0-9-]*[a-z])(?=[a-z0-9-]*\d)[a-z0-9]+(?:-[a-z0-9]+){1,5}\b", re.I)
LEADING_ID = re.compile(r"^\s*(?:\d+\b|[a-z]{1,6}-\d)", re.I)
ROWS = (
    "doc_id {doc_id}, page_num {page_num}, row_index int, x0 double, y0 double, x1 double, y1 double, "
    "cells array<string>, text string, normalized_text string, key string"
)
ROW_COLUMNS = ["doc_id", "page_num", "row_index", "x0", "y0", "x1", "y1", "cells", "text", "normalized_text", "key"]


def words_to_rows(words: DataFrame) -> DataFrame:
    """Add row_index: words in order of their centres join a row while its mean centre is near.

    The tolerance is .75 of the page's median word height, at least 3.  The
    mean moves with each word, so the words of a page are walked in order;
    pages follow each other in a task, and no page is held.
    """
    own = Window.partitionBy("doc_id", "page_num")
    near = F.greatest(F.lit(3.0), 0.75 * F.median(F.col("y1") - F.col("y0")).over(own))
    rows = words.withColumn("near_", near).withColumn("c_", (F.col("y0") + F.col("y1")) / 2)
    rows = rows.withColumn("first_", F.row_number().over(own.orderBy("c_", "x0", "seq")) == 1)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total, n = 0, 0.0, 0
        for batch in batches:
            out = []
            for first, c, most in zip(*[batch.column(x).to_pylist() for x in ("first_", "c_", "near_")], strict=True):
                if first:
                    index, total, n = 0, 0.0, 0
                elif abs(c - total / n) > most:
                    index, total, n = index + 1, 0.0, 0
                total, n = total + c, n + 1
                out.append(index)
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], pa.array(out, pa.int32())], names=[*names, "row_index"])

    names = list(words.columns)
    schema = ", ".join(f"{c} {k}" for c, k in words.dtypes) + ", row_index int"
    return rows.select(*names, "first_", "c_", "near_").mapInArrow(walk, schema)


def row_cells(words: DataFrame) -> DataFrame:
    """Cells (doc_id, page_num, row_index, cell, text, x0..y1): a gap over 1.5 median heights, at least 18, splits."""
    row = ["doc_id", "page_num", "row_index"]
    order = Window.partitionBy(*row).orderBy("x0", "seq")
    limit = F.greatest(F.lit(18.0), 1.5 * F.median(F.col("y1") - F.col("y0")).over(Window.partitionBy(*row)))
    gap = F.col("x0") - F.lag("x1").over(order)
    marked = words.withColumn("new_", (F.coalesce(gap, F.lit(0.0)) > limit).cast("int"))
    cell = F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("cell", cell)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "seq", "word"))), lambda w: w["word"]), " ")
    return marked.groupBy(*row, "cell").agg(
        F.trim(text).alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    ).filter("text <> ''")


def structured_rows(cells: DataFrame) -> DataFrame:
    """Rows with their cells in order, box, normalised text and key."""
    row = ["doc_id", "page_num", "row_index"]
    parts = F.array_sort(F.collect_list(F.struct("cell", "text")))
    rows = cells.groupBy(*row).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.transform(parts, lambda p: p["text"]).alias("cells")
    )
    rows = rows.withColumn("text", F.array_join("cells", " ")).filter(F.length("text") >= 2)
    rows = rows.withColumn("normalized_text", T.normalize_text(F.col("text")))
    return rows.withColumn("key", T.row_key(F.col("cells"), F.col("text"))).select(ROW_COLUMNS)


def merge_continuations(rows: DataFrame) -> DataFrame:
    """Fold short rows that continue the row above into it; each is compared with the merged row, so a page is one group."""

    def key(cells: list[str], text: str) -> str:
        seed = "|".join(cells[:3]) if cells else text
        return hashlib.sha1(" ".join(seed.lower().split()).encode()).hexdigest()[:12]

    def continues(above: dict, row: dict) -> bool:
        text = row["text"].strip()
        if not text:
            return False
        if text.startswith("("):
            return bool(ROW_ID.search(above["text"]))
        if LEADING_ID.match(text) or ROW_ID.search(text):
            return False
        short = len(text.split()) <= 6 or len(text) <= 36
        close = abs(row["x0"] - above["x0"]) <= 36 and 0.0 <= row["y0"] - above["y1"] <= 18.0
        return short and close and bool(ROW_ID.search(above["text"]))

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for row in rows.sort_values("row_index").to_dict("records"):
            row["cells"] = list(row["cells"])
            if not out or not continues(out[-1], row):
                out.append(row)
                continue
            above = out[-1]
            above["cells"] += row["cells"] or [row["text"]]
            above["text"] = " ".join(t for t in (above["text"], row["text"]) if t)
            above["normalized_text"] = " ".join(above["text"].lower().split())
            above["key"] = key(above["cells"], above["text"])
            for side, f in (("x0", min), ("y0", min), ("x1", max), ("y1", max)):
                above[side] = f(above[side], row[side])
        return pd.DataFrame(out, columns=ROW_COLUMNS)

    return rows.groupBy("doc_id", "page_num").applyInPandas(page, ROWS.format(**dict(rows.dtypes)))


def merge_close_regions(regions: DataFrame, reach: float = 80.0) -> DataFrame:
    """Join regions of one kind whose boxes lie within ``reach`` of a seed region, the seed being the first left over."""

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        rest = rows.sort_values(["y0", "x0", "region_id"], kind="stable").to_dict("records")
        out = []
        while rest:
            seed = rest.pop(0)
            def near(r: dict, s: dict = seed) -> bool:
                apart_x = max(r["x0"] - s["x1"], s["x0"] - r["x1"])
                apart_y = max(r["y0"] - s["y1"], s["y0"] - r["y1"])
                return r["kind"] == s["kind"] and max(apart_x, apart_y) <= reach

            own = [seed, *(r for r in rest if near(r))]
            rest = [r for r in rest if not near(r)]
            merged = dict(seed, text="\n".join(r["text"] for r in own))
            for side, f in (("x0", min), ("y0", min), ("x1", max), ("y1", max)):
                merged[side] = f(r[side] for r in own)
            out.append(merged)
        return pd.DataFrame(out, columns=list(rows.columns))

    return regions.groupBy("doc_id", "page_num").applyInPandas(page, regions.schema)


def top_regions(regions: DataFrame, most: int = 8) -> DataFrame:
    """The ``most`` longest general regions of each page; others all stay."""
    own = Window.partitionBy("doc_id", "page_num", "kind").orderBy(F.desc(F.length("text")), "region_id")
    ranked = regions.withColumn("n_", F.row_number().over(own))
    return ranked.filter((F.col("kind") != "general") | (F.col("n_") <= most)).drop("n_")


def mask_components(masks: DataFrame, *, tile: int = 16, least: float = 30.0, most: int = 72) -> DataFrame:
    """Boxes of 8-connected changed tiles of masks (id, width, height, changed array<int> of pixel numbers).

    A tile is changed if a pixel of it is; boxes under ``least`` area are
    dropped and the ``most`` largest stay.
    """

    def boxes(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                tiles = {(int(p) // r.width // tile, int(p) % r.width // tile) for p in r.changed}
                found = []
                while tiles:
                    stack = [tiles.pop()]
                    group = list(stack)
                    while stack:
                        y, x = stack.pop()
                        near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & tiles
                        tiles -= near
                        stack += near
                        group += near
                    ys, xs = [t[0] for t in group], [t[1] for t in group]
                    box = (min(xs) * tile, min(ys) * tile, min(r.width, (max(xs) + 1) * tile), min(r.height, (max(ys) + 1) * tile))
                    if (box[2] - box[0]) * (box[3] - box[1]) >= least:
                        found.append(box)
                found.sort(key=lambda b: (-(b[2] - b[0]) * (b[3] - b[1]), b))
                rows += [(r.id, *map(float, b)) for b in found[:most]]
            yield pd.DataFrame(rows, columns=["id", "x0", "y0", "x1", "y1"])

    kind = dict(masks.dtypes)["id"]
    return masks.select("id", "width", "height", "changed").mapInPandas(boxes, f"id {kind}, x0 double, y0 double, x1 double, y1 double")


def average_hash(rasters: DataFrame) -> DataFrame:
    """(id, fingerprint): 64 bits, one for each grey value of an 8x8 raster that reaches the mean."""
    mean = F.aggregate("grey", F.lit(0.0), lambda a, x: a + x) / F.size("grey")
    bits = F.transform("grey", lambda x: F.when(x >= mean, "1").otherwise("0"))
    hexed = lambda start: F.lpad(F.lower(F.conv(F.array_join(F.slice(bits, start, 32), ""), 2, 16)), 8, "0")
    return rasters.select("id", F.concat(hexed(1), hexed(33)).alias("fingerprint"))


