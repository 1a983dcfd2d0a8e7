"""Differences between two revisions: pages, regions and rows.

Rows are (pair_id, region_id, row_index, cells, text, normalized_text, key).
"""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher
from functools import partial, reduce
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawloom.functions import geometry as G
from drawloom.functions import text as T
from drawloom.functions.similarity import ratio, sequence_ratios
from drawloom.operators.assign import cut, greedy_pairs

#: Header words of columns that hold ids.
ID_HEADERS = (
    "id", "item", "item no", "item number", "part", "part no", "part number", "device", "device id", "equipment",
    "equipment id", "tag", "tag id", "model", "port", "switch / port",
)
ROW_ID = r"(?i)\b((?=[a-z0-9-]*[a-z])(?=[a-z0-9-]*[0-9])[a-z0-9]+(?:-[a-z0-9]+){1,5})\b"
REGION = ["pair_id", "region_id"]
STRUCTURED = ("table-like", "bom-like")


def align_pages(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pair_id, before_index, after_index, score) of pages (pair_id, page_index, fingerprint, preview, width, height).

    Score: .55 hash, .35 text, .10 size (either way up), less .03 of the
    distance; from .45 on, greedily, higher page numbers first on ties.  Pages
    without partner have a null on the other side.

    A pair of documents is one group.  Texts are compared only while their best
    bound leads, so mostly once a page and not once a pair of pages.
    """
    kinds = dict(before.dtypes)
    schema = f"pair_id {kinds['pair_id']}, before_index {kinds['page_index']}, after_index {dict(after.dtypes)['page_index']}, score double"
    need = ["pair_id", "page_index", "fingerprint", "preview", "width", "height"]
    sides = [df.select(need).withColumns({c: F.col(c).cast("double") for c in ("width", "height")}).groupBy("pair_id") for df in (before, after)]
    return sides[0].cogroup(sides[1]).applyInPandas(_aligned, schema)


def _aligned(key: tuple, before: pd.DataFrame, after: pd.DataFrame) -> pd.DataFrame:
    """Rows of ``align_pages`` for one pair of documents: a heap holds bounds of scores, which are refined when they lead."""
    b, a = ([(r.page_index, _halves(r.fingerprint), r.preview or "", r.width, r.height) for r in df.itertuples(index=False)] for df in (before, after))
    pages = max([p[0] for p in (*b, *a)]) + 1
    letters: dict[str, Counter] = {}

    def value(i: int, j: int, text: float) -> float:
        x, y = b[i], a[j]
        hashes = 0.0 if x[1] is None or y[1] is None else 1 - ((x[1][0] ^ y[1][0]).bit_count() + (x[1][1] ^ y[1][1]).bit_count()) / 64
        apart = min(abs(x[3] - y[3]) + abs(x[4] - y[4]), abs(x[3] - y[4]) + abs(x[4] - y[3]))
        size = 0.0 if apart != apart else max(0.0, 1 - apart / max(x[3] + x[4] + y[3] + y[4], 1.0))
        return hashes * 0.55 + text * 0.35 + size * 0.10 - abs(x[0] - y[0]) / max(pages, 1) * 0.03

    def text(i: int, j: int, step: int) -> float:
        """The most the texts can be alike: by lengths, by letters, exactly."""
        x, y = b[i][2], a[j][2]
        if x == y:
            return 1.0
        if step == 2:
            return ratio(x, y)
        if step == 0:
            return 2.0 * min(len(x), len(y)) / (len(x) + len(y))
        for t in (x, y):
            if t not in letters:
                letters[t] = Counter(t)
        return 2.0 * sum((letters[x] & letters[y]).values()) / (len(x) + len(y))

    heap = [(-value(i, j, text(i, j, 0)), -b[i][0], -a[j][0], i, j, 2 if b[i][2] == a[j][2] else 0) for i in range(len(b)) for j in range(len(a))] if key[0] is not None else []
    heapify(heap)
    left, right, out = set(range(len(b))), set(range(len(a))), []
    while heap and -heap[0][0] >= 0.45:
        bound, _, _, i, j, step = heappop(heap)
        if i not in left or j not in right:
            continue
        if step == 2:
            left.remove(i)
            right.remove(j)
            out.append((key[0], b[i][0], a[j][0], -bound))
        else:
            heappush(heap, (-value(i, j, text(i, j, step + 1)), -b[i][0], -a[j][0], i, j, step + 1))
    out += [(key[0], b[i][0], None, None) for i in sorted(left)] + [(key[0], None, a[j][0], None) for j in sorted(right)]
    return pd.DataFrame(out, columns=["pair_id", "before_index", "after_index", "score"]).astype({"before_index": object, "after_index": object, "score": float})


def _halves(fingerprint: str | None) -> tuple[int, int] | None:
    """The halves of a hash as numbers, of each its leading hexadecimal digits; null where there is none."""
    if not fingerprint:
        return None
    first, second = (re.match("[0-9a-fA-F]*", x).group() for x in (fingerprint[:8], fingerprint[8:16]))
    return int(first or "0", 16), int(second or "0", 16)


def region_scores(before: DataFrame, after: DataFrame, least: float = 0.0) -> DataFrame:
    """Scores of regions of one kind on one page pair (pair_id): (pair_id, kind, b_region_id, a_region_id, score, text_ratio).

    Regions are (pair_id, region_id, kind, x0..y1, width, height,
    normalized_text, header, anchors, n_rows); the weights depend on the kind.
    """
    keys = ["pair_id", "kind"]
    b = before.select(*keys, *[F.col(c).alias(f"b_{c}") for c in before.columns if c not in keys])
    a = after.select(*keys, *[F.col(c).alias(f"a_{c}") for c in after.columns if c not in keys])
    both = b.repartition(*keys).join(a, keys)  # a page is few bytes but much work
    overlap = G.overlap_ratio(*[G.relative(G.box(f"{s}_"), F.col(f"{s}_width"), F.col(f"{s}_height")) for s in "ba"])
    most = F.greatest("b_n_rows", "a_n_rows")
    rows = F.when(most > 0, 1 - F.abs(F.col("b_n_rows") - F.col("a_n_rows")) / F.greatest(most, F.lit(1))).otherwise(0.0)
    same = T.jaccard(F.col("b_anchors"), F.col("a_anchors"))
    both = both.withColumn("overlap_", overlap).withColumn("rows_", rows).withColumn("same_", same)
    overlap, rows, same = F.col("overlap_"), F.col("rows_"), F.col("same_")

    def weighed(text: Column, header: Column) -> Column:
        return (
            F.when(F.col("kind") == "bom-like", same * 0.42 + header * 0.23 + overlap * 0.20 + text * 0.10 + rows * 0.05)
            .when(F.col("kind") == "table-like", same * 0.24 + header * 0.18 + overlap * 0.33 + text * 0.18 + rows * 0.07)
            .otherwise(overlap * 0.45 + text * 0.40 + rows * 0.15)
        )

    # Only pairs that equal texts would lift to ``least`` are compared as texts.
    hopeful = both.filter(weighed(F.lit(1.0), F.lit(1.0)) >= least - 1e-9)
    texts = {"text": (F.col("b_normalized_text"), F.col("a_normalized_text")), "header": (F.col("b_header"), F.col("a_header"))}
    both = hopeful.withColumn("ratios_", sequence_ratios(texts)).withColumn("text_ratio", F.col("ratios_.text"))
    score = weighed(F.col("ratios_.text"), F.col("ratios_.header"))
    return both.withColumn("score", score).filter(F.col("score") >= least).select(*keys, "b_region_id", "a_region_id", "score", "text_ratio")


def match_regions(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pair_id, kind, b_region_id, a_region_id, score, change): greedy from .45 on, the rest removed or added."""
    scored = cut(region_scores(before, after, least=0.45))
    order = [F.desc("score"), F.col("b_region_id"), F.col("a_region_id")]
    taken = greedy_pairs(scored, ["pair_id", "b_region_id"], ["pair_id", "a_region_id"], order)
    change = F.when(F.col("text_ratio") > 0.995, "unchanged").otherwise("modified")
    out = taken.withColumn("change", change).drop("text_ratio")
    gone = before.select("pair_id", "kind", F.col("region_id").alias("b_region_id")).join(taken, ["pair_id", "b_region_id"], "left_anti")
    new = after.select("pair_id", "kind", F.col("region_id").alias("a_region_id")).join(taken, ["pair_id", "a_region_id"], "left_anti")
    out = out.unionByName(gone.withColumn("change", F.lit("removed")), allowMissingColumns=True)
    return out.unionByName(new.withColumn("change", F.lit("added")), allowMissingColumns=True)


def embedded_ids(c: Column) -> Column:
    """Distinct hyphenated tokens with letters and digits, compact, of four characters at least."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(ROW_ID), F.lit(1)), T.normalized_cell)
    good = F.filter(found, lambda t: (F.length(t) >= 4) & ~t.startswith("rev") & ~t.rlike("^data[0-9]+$"))
    return F.array_distinct(good)


def _looks_id(cell: Column) -> Column:
    n = T.normalized_cell(cell)
    return (F.length(n) >= 2) & ((n.rlike("[a-z]") & n.rlike("[0-9]")) | n.rlike("^[0-9]{3,}$"))


def row_anchors(cells: Column, text: Column, header: Column) -> Column:
    """What may identify a row, the best first: cells under id headers, embedded ids, the first cell, id-like cells."""
    titled = F.transform(
        F.sequence(F.lit(0), F.size(cells) - 1),
        lambda i: F.struct(F.get(cells, i).alias("cell"), T.squeeze(F.lower(F.translate(F.coalesce(F.get(header, i), F.lit("")), "_", " "))).alias("head")),
    )
    titled = F.when(F.size(cells) > 0, titled).otherwise(F.slice(titled, 1, 0))
    by_head = F.filter(titled, lambda x: (x["head"].isin(*ID_HEADERS) | x["head"].rlike(" (id|no|number)$")) & _looks_id(x["cell"]))
    by_head = F.transform(by_head, lambda x: T.normalized_cell(x["cell"]))
    inside = F.flatten(F.transform(F.slice(cells, 1, 6), embedded_ids))
    named = F.filter(F.transform(cells, T.normalized_cell), lambda n: n != "")
    likely = F.transform(F.filter(F.slice(cells, 1, 4), _looks_id), T.normalized_cell)
    return F.array_distinct(F.concat(by_head, embedded_ids(text), inside, F.slice(named, 1, 1), likely))


def changed_cells(before: Column, after: Column) -> Column:
    """(index, before, after) of significant changes of rows with equally many cells; null otherwise."""
    both = F.filter(
        F.transform(
            F.arrays_zip(before.alias("b"), after.alias("a")), lambda x, i: F.struct(i.alias("at"), x["b"].alias("before"), x["a"].alias("after"))
        ),
        lambda x: T.normalized_cell(x["before"]) != T.normalized_cell(x["after"]),
    )
    return F.when(F.size(before) == F.size(after), both)


BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def _edited(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """Places of the cells that differ when two rows are compared as sequences."""
    out = []
    for b, a in zip(before, after, strict=True):
        codes = [c for c in SequenceMatcher(None, list(b), list(a)).get_opcodes() if c[0] != "equal"]
        out.append(([i for _, i1, i2, _, _ in codes for i in range(i1, i2)], [j for _, _, _, j1, j2 in codes for j in range(j1, j2)]))
    return pd.DataFrame(out, columns=["before", "after"])


def changed_boxes(rows: DataFrame) -> DataFrame:
    """Add before_boxes and after_boxes to row pairs: the boxes of the cells that changed.

    Rows have b_ and a_ cells, cell_boxes, box and normalized_text.  Rows with
    equally many cells are compared cell by cell, others as sequences; where
    the texts differ but no cell box is known the row's box stands in.
    """
    cells = {s: F.transform(F.col(f"{s}_cells"), T.normalized_cell) for s in "ba"}
    same = F.size("b_cells") == F.size("a_cells")
    places = F.transform(F.filter(F.transform(F.arrays_zip(cells["b"].alias("b"), cells["a"].alias("a")), lambda x, i: F.struct(i.alias("i"), (x["b"] != x["a"]).alias("d"))), lambda x: x["d"]), lambda x: x["i"])
    none = F.array().cast("array<int>")
    blank = F.array().cast("array<string>")
    edited = F.pandas_udf(_edited, "before array<int>, after array<int>")(F.when(same, blank).otherwise(cells["b"]), F.when(same, blank).otherwise(cells["a"]))
    differs = F.col("b_normalized_text") != F.col("a_normalized_text")
    empty = (F.size("b_cells") == 0) & (F.size("a_cells") == 0)
    out = rows.withColumn("places_", F.when(same, F.struct(places.alias("before"), places.alias("after"))).otherwise(edited))
    for s, name in (("b", "before"), ("a", "after")):
        boxes = F.col(f"{s}_cell_boxes")
        found = F.array_compact(F.transform(F.coalesce(F.col(f"places_.{name}"), none), partial(F.get, boxes)))
        whole = empty | ((F.size(found) == 0) & differs)
        out = out.withColumn(f"{name}_boxes", F.when(whole, F.array(f"{s}_box")).otherwise(found))
    return out.drop("places_")


DIFF = "{keys}, change_type string, before_index int, after_index int, before_text string, after_text string, row_key string, confidence double"


def compare_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row differences of matched regions (pair_id, region_id): moved, modified, removed, added.

    Rows that share a unique anchor are matched by joins.  Where a region has
    too few anchors (under two, unless it has at most three rows) its rows are
    compared as a sequence of texts, in a function per region.
    """
    b, a = cut(_anchored(before, "b")), cut(_anchored(after, "a"))  # read by many branches
    unique = lambda df, s: df.groupBy(*REGION, "anchor").agg(F.count(F.lit(1)).alias("n_"), F.max(f"{s}_row_index").alias(f"{s}_row_index"))
    ub, ua = unique(_exploded(b, "b"), "b"), unique(_exploded(a, "a"), "a")
    common = ub.filter("n_ = 1").drop("n_").join(ua.filter("n_ = 1").drop("n_"), [*REGION, "anchor"])
    counts = _count(before, "nb").join(_count(after, "na"), REGION, "full")
    usable = common.groupBy(*REGION).agg(F.count(F.lit(1)).alias("shared")).join(counts, REGION)
    usable = cut(usable.filter((F.col("shared") >= 2) | (F.least(F.coalesce("nb", F.lit(0)), F.coalesce("na", F.lit(0))) <= 3)).select(*REGION))
    by_anchor = _anchored_diffs(b.join(usable, REGION), a.join(usable, REGION), common.join(usable, REGION))
    rest = lambda df: df.join(usable, REGION, "left_anti")
    return by_anchor.unionByName(_sequence_diffs(rest(before), rest(after)))


def _count(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(*REGION).agg(F.count(F.lit(1)).alias(name))


def _anchored(rows: DataFrame, s: str) -> DataFrame:
    own = Window.partitionBy(*REGION)
    header = F.min_by("cells", "row_index").over(own)
    first, n = F.min("row_index").over(own), F.count(F.lit(1)).over(own)
    blank = F.array().cast("array<string>")
    use = F.when((n > 1) & (F.col("row_index") != first), header).otherwise(blank)
    rows = rows.withColumn("anchors", row_anchors(F.col("cells"), F.col("text"), use))
    return rows.select(*REGION, *[F.col(c).alias(f"{s}_{c}") for c in ("row_index", "cells", "text", "normalized_text", "key", "anchors")])


def _exploded(rows: DataFrame, s: str) -> DataFrame:
    return rows.select(*REGION, f"{s}_row_index", F.explode(f"{s}_anchors").alias("anchor"))


def _same_content() -> Column:
    cells = lambda s: F.filter(F.transform(F.col(f"{s}_cells"), T.normalized_cell), lambda c: c != "")
    return (F.col("b_normalized_text") == F.col("a_normalized_text")) | ((F.size(cells("b")) > 0) & (cells("b") == cells("a")))


def _out(df: DataFrame, change: Column, key: Column, confidence: Column) -> DataFrame:
    have = lambda c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind)
    return df.select(
        *REGION, change.alias("change_type"), have("b_row_index", "int").alias("before_index"), have("a_row_index", "int").alias("after_index"),
        F.coalesce(have("b_text", "string"), F.lit("")).alias("before_text"), F.coalesce(have("a_text", "string"), F.lit("")).alias("after_text"),
        key.alias("row_key"), confidence.cast("double").alias("confidence"),
    )


def _anchored_diffs(b: DataFrame, a: DataFrame, common: DataFrame) -> DataFrame:
    exploded = b.select(*REGION, "b_row_index", F.posexplode("b_anchors").alias("i", "anchor")).join(common.drop("b_row_index"), [*REGION, "anchor"])
    pairs = exploded.groupBy(*REGION, "b_row_index").agg(F.min_by("a_row_index", "i").alias("a_row_index"))
    joined = cut(pairs.join(b, [*REGION, "b_row_index"]).join(a, [*REGION, "a_row_index"]))
    same = _same_content()
    moved = same & (F.col("b_row_index") != F.col("a_row_index"))
    both = F.concat_ws(":", "b_key", "a_key")
    matched = joined.filter(moved | (~same & (F.col("b_normalized_text") != F.col("a_normalized_text"))))
    out = _out(matched, F.when(moved, "moved").otherwise("modified"), both, F.when(moved, 0.90).otherwise(0.82))
    left = b.join(joined.select(*REGION, "b_row_index"), [*REGION, "b_row_index"], "left_anti")
    right = a.join(joined.select(*REGION, "a_row_index").distinct(), [*REGION, "a_row_index"], "left_anti")
    nth = lambda df, s: df.withColumn("nth_", F.row_number().over(Window.partitionBy(*REGION, f"{s}_normalized_text").orderBy(f"{s}_row_index"))).withColumn("text_", F.col(f"{s}_normalized_text"))
    late = cut(nth(left, "b").join(nth(right, "a"), [*REGION, "text_", "nth_"]))
    out = out.unionByName(_out(late, F.lit("moved"), both, F.lit(0.90)))
    gone = left.join(late.select(*REGION, "b_row_index"), [*REGION, "b_row_index"], "left_anti")
    new = right.join(late.select(*REGION, "a_row_index"), [*REGION, "a_row_index"], "left_anti")
    out = out.unionByName(_out(gone, F.lit("removed"), F.col("b_key"), F.lit(0.88)))
    return out.unionByName(_out(new, F.lit("added"), F.col("a_key"), F.lit(0.88)))


def _sequence_diffs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row differences by the sequence of texts; junk is ignored as in the default matcher."""
    schema = DIFF.format(keys=", ".join(f"{k} {dict(before.dtypes)[k]}" for k in REGION))

    def region(key: tuple, b: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        rows_b = b.sort_values("row_index").to_dict("records")
        rows_a = a.sort_values("row_index").to_dict("records")
        texts = [[r["normalized_text"] for r in rows] for rows in (rows_b, rows_a)]
        out: list[tuple] = []

        def gone(r: dict, confidence: float) -> None:
            out.append((*key, "removed", r["row_index"], None, r["text"], "", r["key"], confidence))

        def new(r: dict, confidence: float) -> None:
            out.append((*key, "added", None, r["row_index"], "", r["text"], r["key"], confidence))

        for op, i1, i2, j1, j2 in SequenceMatcher(None, *texts).get_opcodes() if texts[0] != texts[1] else ():
            if op == "delete":
                [gone(r, 0.88) for r in rows_b[i1:i2]]
            elif op == "insert":
                [new(r, 0.88) for r in rows_a[j1:j2]]
            elif op == "replace":
                n = min(i2 - i1, j2 - j1)
                for x, y in zip(rows_b[i1 : i1 + n], rows_a[j1 : j1 + n], strict=True):
                    out.append((*key, "modified", x["row_index"], y["row_index"], x["text"], y["text"], f"{x['key']}:{y['key']}", 0.82))
                [gone(r, 0.85) for r in rows_b[i1 + n : i2]]
                [new(r, 0.85) for r in rows_a[j1 + n : j2]]
        columns = [*REGION, "change_type", "before_index", "after_index", "before_text", "after_text", "row_key", "confidence"]
        frame = pd.DataFrame(out, columns=columns)
        return frame.astype({"before_index": "Int32", "after_index": "Int32"})

    need = [*REGION, "row_index", "text", "normalized_text", "key"]
    return before.select(need).groupBy(*REGION).cogroup(after.select(need).groupBy(*REGION)).applyInPandas(region, schema)


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, change): added, removed, modified or unchanged rows of two keyed snapshots, in one shuffle."""
    b = before.select(*keys, F.struct(*values).alias("b_"))
    a = after.select(*keys, F.struct(*values).alias("a_"))
    change = (
        F.when(F.col("b_").isNull(), "added")
        .when(F.col("a_").isNull(), "removed")
        .when(F.col("b_").eqNullSafe(F.col("a_")), "unchanged")
        .otherwise("modified")
    )
    return b.join(a, keys, "full").select(*keys, change.alias("change"), F.col("b_").alias("before"), F.col("a_").alias("after"))


def cell_diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, field, before, after) of every changed cell, values as text."""
    text = lambda df: df.select(*keys, *[F.col(v).cast("string").alias(v) for v in values])
    long = lambda df, name: text(df).unpivot(keys, values, "field", name)
    joined = long(before, "before").join(long(after, "after"), [*keys, "field"])
    return joined.filter(~F.col("before").eqNullSafe(F.col("after")))


def document_status(has_regressed: Column, review_pages: Column, changed_pages: Column) -> Column:
    """Review first, then changes, else unchanged."""
    return F.when(has_regressed | (review_pages > 0), "review_needed").when(changed_pages > 0, "changed").otherwise("unchanged")


def document_confidence(pages: DataFrame) -> DataFrame:
    """(pair_id, confidence): the mean of page confidences to three digits."""
    return pages.groupBy("pair_id").agg(F.bround(F.avg("confidence"), 3).alias("confidence"))


def near_boxes(boxes: DataFrame, regions: DataFrame, reach: float = 0.0) -> DataFrame:
    """Boxes that come within ``reach`` of a region of their page."""
    r = regions.select("page_id", *[F.col(s).alias(f"r_{s}") for s in G.SIDES])
    meets = (F.col("x0") <= F.col("r_x1") + reach) & (F.col("r_x0") <= F.col("x1") + reach)
    meets &= (F.col("y0") <= F.col("r_y1") + reach) & (F.col("r_y0") <= F.col("y1") + reach)
    return boxes.join(r, (boxes["page_id"] == r["page_id"]) & meets, "left_semi")


def keyword_hits(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.lower(c).contains(w).cast("int") for w in words], F.lit(0))
