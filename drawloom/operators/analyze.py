"""Page analysis from words: the source of text, ruled tables and tables below a header.

``words`` are (doc_id, page_num, seq, x0, y0, x1, y1, word), ``pages``
(doc_id, page_num, width, height).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawloom.functions import geometry as G
from drawloom.functions import text as T
from drawloom.operators import layout, scope
from drawloom.operators.annotate import table_gate
from drawloom.operators.diff import keyword_hits

PAGE = ["doc_id", "page_num"]
#: Fewest native characters of a page that is not sent to OCR.
NATIVE = 20
#: OCR words under this confidence are dropped.
LEAST_CONFIDENCE = 20.0
#: How far lines may miss each other and still cross, in points.
TOUCH = 3.0


def ocr_words(raw: DataFrame, pages: DataFrame) -> DataFrame:
    """Words of an OCR result (doc_id, page_num, seq, text, conf, left, top, width, height), in points of the page.

    ``pages`` also have px_width and px_height.  Blank words and words under
    LEAST_CONFIDENCE go; a confidence that is no number keeps its word.
    """
    size = pages.select(*PAGE, *[(F.col(a) / F.greatest(F.col(f"px_{a}"), F.lit(1))).alias(f"{a}_") for a in ("width", "height")])
    word, sure = T.squeeze(F.coalesce("text", F.lit(""))), F.trim("conf").try_cast("double")
    kept = raw.withColumn("word", word).filter((F.col("word") != "") & ~F.coalesce(sure < LEAST_CONFIDENCE, F.lit(False))).join(size, PAGE)
    x, y = F.col("left") * F.col("width_"), F.col("top") * F.col("height_")
    return kept.select(
        *PAGE, "seq", x.alias("x0"), y.alias("y0"), (x + F.col("width") * F.col("width_")).alias("x1"), (y + F.col("height") * F.col("height_")).alias("y1"), "word"
    )


def text_sources(pages: DataFrame) -> DataFrame:
    """Add text_source, ocr_attempted and warnings to pages with native_text, ocr_text and ocr_error (both null without OCR)."""
    filled = lambda c: F.length(F.trim(F.coalesce(c, F.lit(""))))
    tried = filled("native_text") < NATIVE
    read = tried & (filled("ocr_text") > 0)
    broken = tried & ~read & F.col("ocr_error").isNotNull()
    warning = F.when(broken, F.array(F.concat(F.lit("OCR unavailable or failed: "), "ocr_error"))).otherwise(F.array().cast("array<string>"))
    return pages.select("*", F.when(read, "ocr").otherwise("native").alias("text_source"), tried.alias("ocr_attempted"), warning.alias("warnings"))


def ruled_tables(rulings: DataFrame) -> DataFrame:
    """Tables (doc_id, page_num, table_index, x0..y1, row_count, col_count) of drawn lines (doc_id, page_num, x0..y1).

    A table is a set of connected lines with at least two across and two down;
    its rows and columns are the gaps between them.  Tables come in reading
    order.  Lines connect page by page, so a page is one group.
    """

    def page(lines: pd.DataFrame) -> pd.DataFrame:
        box = lines[["x0", "y0", "x1", "y1"]].to_numpy(float)
        low, high = np.minimum(box[:, :2], box[:, 2:]), np.maximum(box[:, :2], box[:, 2:])
        label, before = np.arange(len(box)), np.full(len(box), -1)
        while not np.array_equal(label, before):  # each line takes the lowest label that it touches
            before = label.copy()
            for i in range(len(box)):
                meets = ((low - TOUCH <= high[i]) & (high + TOUCH >= low[i])).all(axis=1)
                label[meets] = label[meets].min()
        out = []
        for one in np.unique(label):
            own = label == one
            across = own & (high[:, 1] - low[:, 1] <= 1) & (high[:, 0] - low[:, 0] > 1)
            down = own & (high[:, 0] - low[:, 0] <= 1) & (high[:, 1] - low[:, 1] > 1)
            rows, columns = (len(np.unique(np.round(at))) - 1 for at in (low[across, 1], low[down, 0]))
            if rows >= 1 and columns >= 1:
                out.append((*low[own].min(axis=0), *high[own].max(axis=0), rows, columns))
        out.sort(key=lambda t: (t[1], t[0], t[3], t[2]))
        found = pd.DataFrame(out, columns=["x0", "y0", "x1", "y1", "row_count", "col_count"])
        found.insert(0, "table_index", range(len(found)))
        found.insert(0, "page_num", lines["page_num"].iloc[0])
        found.insert(0, "doc_id", lines["doc_id"].iloc[0])
        return found

    kinds = dict(rulings.dtypes)
    schema = f"doc_id {kinds['doc_id']}, page_num {kinds['page_num']}, table_index int, x0 double, y0 double, x1 double, y1 double, row_count int, col_count int"
    return rulings.select(*PAGE, *G.SIDES).groupBy(*PAGE).applyInPandas(page, schema)


def _hits(c: Column) -> Column:
    return keyword_hits(T.normalize_text(c), scope.TABLE_TERMS)


def table_regions(tables: DataFrame, words: DataFrame, pages: DataFrame) -> DataFrame:
    """Regions (doc_id, page_num, region_id, kind, x0..y1, text, confidence, n_rows, row_count, col_count) of ruled tables.

    ``pages`` also have page_text and family, which decide whether a page is
    searched at all.  Page borders and tables with almost no text are dropped.
    """
    count = words.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n_words_"))
    shown = pages.join(count, PAGE, "left").fillna(0, ["n_words_"])
    shown = shown.filter(table_gate(F.col("n_words_"), F.col("page_text"), F.col("family"), F.col("width") * F.col("height")))
    t = tables.join(shown.select(*PAGE, (F.col("width") * F.col("height")).alias("area_")), PAGE)
    t = t.filter((G.area(G.box()) / F.greatest("area_", F.lit(1.0)) <= 0.60) | (F.col("row_count") > 6))
    t = t.withColumn("region_id", F.concat(F.lit("page-"), F.col("page_num").cast("string"), F.lit("-table-"), F.col("table_index").cast("string")))
    box = t.select(*PAGE, "region_id", *[F.col(s).alias(f"t_{s}") for s in G.SIDES])
    inside = words.join(box, PAGE).filter(
        F.col("x0").between(F.col("t_x0") - 2, F.col("t_x1") + 2) & F.col("y0").between(F.col("t_y0") - 2, F.col("t_y1") + 2)
    )
    # Rows of words are found region by region: the region takes the place of the page.
    clustered = layout.words_to_rows(inside.select(F.struct(*PAGE, "region_id").alias("doc_id"), F.lit(0).alias("page_num"), "seq", *G.SIDES, "word"))
    rows = layout.structured_rows(layout.row_cells(clustered))
    listed = F.array_sort(F.collect_list(F.struct("row_index", "text", "cells")))
    grouped = rows.groupBy("doc_id").agg(F.transform(listed, lambda r: F.struct(r["text"].alias("text"), r["cells"].alias("cells"))).alias("rows_"))
    grouped = grouped.select("doc_id.*", "rows_").withColumn("text", F.array_join(F.transform("rows_", lambda r: r["text"]), "\n"))
    found = t.join(grouped, [*PAGE, "region_id"]).filter(F.length("text") >= 10)
    kind = F.when(scope.table_score(F.col("rows_"), F.col("text"))["is_scope"], "bom-like").otherwise("table-like")
    sure = F.least(F.lit(0.98), 0.55 + 0.05 * F.col("row_count") + 0.03 * _hits(F.col("text")))
    return found.select(*PAGE, "region_id", kind.alias("kind"), *G.SIDES, "text", sure.alias("confidence"), F.size("rows_").alias("n_rows"), "row_count", "col_count")


def header_score(text: Column) -> Column:
    """How many words of a scope table's header a row has; none if it looks like a title block."""
    words = F.array_distinct(F.split(T.normalize_text(text), " "))
    shared = lambda terms: F.size(F.array_intersect(words, F.array(*map(F.lit, terms))))
    return F.when((shared(scope.NOISE_HEADERS) >= 2) & (shared(scope.TABLE_HEADERS) < 3), 0).otherwise(shared(scope.TABLE_HEADERS))


def header_tables(cells: DataFrame) -> DataFrame:
    """Tables below a header row, from cells (doc_id, page_num, row_index, cell, text, x0..y1) outside of other tables.

    A row with two header words starts a table.  It goes down through the cells
    whose middle lies within 20 units of the header's width, until a gap of 2.8
    header heights or a row of under three cells beside the header.  A row that
    an accepted table has used starts none.  Result: (doc_id, page_num,
    table_index, header_row, row_indexes, x0..y1, text, confidence).
    """
    ids = [*PAGE, "header_row"]
    row = cells.groupBy(*PAGE, "row_index").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell", "text"))), lambda c: c["text"]), " ").alias("row_text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    ).filter(F.length("row_text") >= 2)
    heads = row.filter(header_score(F.col("row_text")) >= 2).select(
        *PAGE, F.col("row_index").alias("header_row"), F.col("x0").alias("h_x0"), F.col("x1").alias("h_x1"), F.greatest(F.lit(4.0), F.col("y1") - F.col("y0")).alias("h_")
    )
    whole = row.select(*PAGE, "row_index", F.col("y0").alias("top"), F.col("y1").alias("bottom"))
    below = cells.join(heads, PAGE).filter("row_index >= header_row").filter((F.col("x0") + F.col("x1")) / 2 >= F.col("h_x0") - 20)
    below = below.filter((F.col("x0") + F.col("x1")) / 2 <= F.col("h_x1") + 20)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("cell", "text"))), lambda c: c["text"])
    clipped = below.groupBy(*ids, "h_x0", "h_x1", "h_", "row_index").agg(
        parts.alias("cells"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )
    clipped = clipped.join(whole, [*PAGE, "row_index"]).withColumn("text", F.array_join("cells", " "))
    order = Window.partitionBy(*ids).orderBy("row_index")
    shared = F.greatest(F.lit(0.0), F.least("x1", "h_x1") - F.greatest("x0", "h_x0")) / F.greatest(F.least(F.col("x1") - F.col("x0"), F.col("h_x1") - F.col("h_x0")), F.lit(1e-9))
    far = F.coalesce(F.col("top") - F.lag("bottom").over(order) > 2.8 * F.col("h_"), F.lit(False))
    ends = far | ((shared < 0.20) & (F.size("cells") < 3))
    kept = clipped.withColumn("end_", ends.cast("int")).withColumn("ended_", F.sum("end_").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("ended_ = 0")
    listed = F.array_sort(F.collect_list(F.struct("row_index", "text", "cells")))
    made = kept.groupBy(*ids).agg(
        listed.alias("rows_"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )
    plain = F.transform("rows_", lambda r: F.struct(r["text"].alias("text"), r["cells"].alias("cells")))
    text = F.array_join(F.transform("rows_", lambda r: r["text"]), " ")
    made = made.withColumn("text", text).withColumn("hits_", _hits(text))
    good = scope.table_score(plain, F.col("text"))["is_scope"] & (F.col("hits_") >= 2) & (F.size("rows_") >= 2) & (F.length(T.normalize_text(F.col("text"))) >= 12)
    made = made.filter(good).select(
        *ids, F.transform("rows_", lambda r: r["row_index"]).alias("row_indexes"), *G.SIDES, F.array_join(F.transform("rows_", lambda r: r["text"]), "\n").alias("text"),
        F.least(F.lit(0.94), 0.62 + 0.04 * F.col("hits_") + 0.02 * F.least(F.size("rows_"), F.lit(6))).alias("confidence"),
    )
    entry = F.struct("header_row", "row_indexes", *G.SIDES, "text", "confidence")
    paged = made.groupBy(*PAGE).agg(F.array_sort(F.collect_list(entry)).alias("all_"))  # a page has few headers
    kind = dict(paged.dtypes)["all_"]
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(kind).alias("out"))

    def step(acc: Column, t: Column) -> Column:
        taken = F.struct(F.concat(acc["used"], t["row_indexes"]).alias("used"), F.concat(acc["out"], F.array(t)).alias("out"))
        return F.when(F.array_contains(acc["used"], t["header_row"]), acc).otherwise(taken)

    chosen = paged.select(*PAGE, F.aggregate("all_", start, step, lambda acc: acc["out"]).alias("out_"))
    return chosen.select(*PAGE, F.posexplode("out_").alias("table_index", "t_")).select(*PAGE, "table_index", "t_.*")


def analyze_pages(pages: DataFrame, native: DataFrame, ocr: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with text_source, n_regions and warnings; regions) from both kinds of words and ruled tables.

    Pages are (doc_id, page_num, width, height, native_text, ocr_text,
    ocr_error, family).  The words of the chosen source are searched for ruled
    tables, then, outside of these, for tables below a header.
    """
    known = text_sources(pages).withColumn("page_text", F.when(F.col("text_source") == "ocr", F.col("ocr_text")).otherwise(F.col("native_text")))
    chosen = known.select(*PAGE, "text_source")
    words = reduce(
        lambda a, b: a.unionByName(b),
        [w.join(chosen.filter(F.col("text_source") == s), PAGE, "left_semi") for s, w in (("native", native), ("ocr", ocr))],
    )
    ruled = table_regions(tables, words, known)
    box = ruled.select(*PAGE, *[F.col(s).alias(f"t_{s}") for s in G.SIDES])
    held = (F.col("t_x0") <= F.col("x0")) & (F.col("t_y0") <= F.col("y0")) & (F.col("t_x1") >= F.col("x1")) & (F.col("t_y1") >= F.col("y1"))
    free = words.join(words.join(box, PAGE).filter(held).select(*PAGE, "seq"), [*PAGE, "seq"], "left_anti")
    headed = header_tables(layout.row_cells(layout.words_to_rows(free)))
    name = F.concat(F.lit("page-"), F.col("page_num").cast("string"), F.lit("-word-bom-"), F.col("table_index").cast("string"))
    headed = headed.select(*PAGE, name.alias("region_id"), F.lit("bom-like").alias("kind"), *G.SIDES, "text", "confidence", F.size("row_indexes").alias("n_rows"))
    regions = ruled.select(headed.columns).unionByName(headed)
    counts = regions.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n_regions"))
    return known.join(counts, PAGE, "left").fillna(0, ["n_regions"]), regions
