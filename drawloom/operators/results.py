"""From differences to results: pages, pairs of documents, and the flat row sets that reports start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawloom.operators.diff import document_status
from drawloom.operators.scope import IGNORED_KINDS, compare_status

ENDS = ["pair_id", "before_index", "after_index"]
#: Where a page without partner stands among the others.
FAR = 10_000
OCR_NOTE = "OCR fallback was used on at least one page"


def page_diffs(aligned: DataFrame, before: DataFrame, after: DataFrame, regions: DataFrame, boxes: DataFrame) -> DataFrame:
    """One row per aligned page (pair_id, before_index, after_index): its change, confidence and counts.

    ``before`` and ``after`` are page analyses (pair_id, page_index,
    text_source, n_regions, warnings, failed); a page without analysis failed.
    ``regions`` (ENDS, in_scope, emphasized, confidence) and ``boxes`` (ENDS)
    are what the page comparison found.  Pages on one side only are added or
    removed, failed ones go to review, and scope regions or boxes modify.
    """

    def side(df: DataFrame, s: str) -> DataFrame:
        named = [F.col(c).alias(f"{s}_{c}") for c in ("text_source", "n_regions", "warnings", "failed")]
        return df.select("pair_id", F.col("page_index").alias(f"{s}_index"), *named)

    scoped = regions.filter("in_scope").groupBy(*ENDS).agg(F.avg("confidence").alias("mean_"), F.count(F.lit(1)).alias("scope_"), F.count_if("emphasized").alias("marked_"))
    found = boxes.groupBy(*ENDS).agg(F.count(F.lit(1)).alias("boxes_"))
    rows = aligned.join(side(before, "before"), ENDS[:2], "left").join(side(after, "after"), [ENDS[0], ENDS[2]], "left")
    rows = rows.join(scoped, ENDS, "left").join(found, ENDS, "left").fillna(0, ["scope_", "marked_", "boxes_"])
    new, gone = F.col("before_index").isNull(), F.col("after_index").isNull()
    lost = {s: F.coalesce(f"{s}_failed", F.lit(True)) for s in ("before", "after")}
    failed = lost["before"] | lost["after"]
    alone = new | gone | failed
    change = F.when(new, "added").when(gone, "removed").when(failed, "review_needed")
    change = change.when((F.col("scope_") > 0) | (F.col("boxes_") > 0), "modified").otherwise("unchanged")
    mean = F.coalesce("mean_", F.when(F.col("boxes_") > 0, 0.7).otherwise(0.95))
    confidence = F.when(new | gone, 1.0).when(failed, 0.0).otherwise(F.bround(mean, 3))

    def source(s: str, missing: Column) -> Column:
        return F.when(missing, "none").when(lost[s], "analysis_failed").otherwise(F.col(f"{s}_text_source"))

    shown = {s: ~lost[s] & (F.col(f"{s}_n_regions") > 0) for s in lost}
    structured = F.when(new, shown["after"]).when(gone, shown["before"]).when(failed, F.lit(False)).otherwise(shown["before"] | shown["after"])
    none = F.array().cast("array<string>")
    notes = (
        F.when(new, F.array(F.lit("page exists only in after document")))
        .when(gone, F.array(F.lit("page exists only in before document")))
        .when(failed, F.array(F.lit("page analysis failed; manual review needed")))
        .otherwise(F.concat(*[F.coalesce(f"{s}_warnings", none) for s in lost]))
    )
    place = [F.coalesce(F.col(x), FAR + F.coalesce(F.col(y), F.lit(0))) for x, y in (ENDS[1:], ENDS[:0:-1])]
    nth = F.row_number().over(Window.partitionBy("pair_id").orderBy(*place))
    return rows.select(
        *ENDS, F.concat(F.lit("Page "), nth.cast("string")).alias("page_label"), change.alias("change_type"), confidence.alias("confidence"),
        F.when(alone, F.lit(1)).otherwise(F.col("boxes_")).cast("long").alias("global_box_count"),
        F.when(alone, F.lit(1)).otherwise(F.col("marked_")).cast("long").alias("emphasized_box_count"),
        structured.alias("structured"), source("before", new).alias("text_source_before"), source("after", gone).alias("text_source_after"), notes.alias("notes"),
    )


def pair_results(pages: DataFrame) -> DataFrame:
    """(pair_id, status, changed, document_confidence, changed_pages, structured_pages, ocr_used, warnings) of compared pairs."""
    changed = F.col("change_type") != "unchanged"
    sure = F.col("confidence").cast("decimal(9, 6)")  # exact sums, whatever the order of the pages
    ocr = (F.col("text_source_before") == "ocr") | (F.col("text_source_after") == "ocr")
    out = pages.groupBy("pair_id").agg(
        F.count_if(changed).alias("changed_pages"), F.count_if(F.col("change_type") == "review_needed").alias("review_"),
        F.bround(F.avg(sure), 3).cast("double").alias("document_confidence"), F.count_if("structured").alias("structured_pages"),
        F.max(ocr).alias("ocr_used"), F.sum(F.when(changed, F.col("global_box_count")).otherwise(0)).alias("visual_diff_count"),
    )
    status = document_status(F.lit(False), F.col("review_"), F.col("changed_pages"))
    warnings = F.when(F.col("ocr_used"), F.array(F.lit(OCR_NOTE))).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("status", status).withColumn("changed", F.col("changed_pages") > 0).withColumn("warnings", warnings)
    return out.drop("review_")


def diff_counts(regions: DataFrame, rows: DataFrame) -> DataFrame:
    """(pair_id, schedule_row_diff_count, title_block_diff_count, only_titles): what regions and their rows add up to.

    ``regions`` are (pair_id, region_kind, change_type, in_scope, n_row_diffs), ``rows`` (pair_id, is_scope_diff).
    A scope region without row differences counts as a row.
    """
    title, changed = F.col("region_kind").isin(*IGNORED_KINDS), F.col("change_type") != "unchanged"
    whole = F.col("in_scope") & (F.col("n_row_diffs") == 0)
    by_region = regions.groupBy("pair_id").agg(
        F.count_if(title).alias("title_block_diff_count"), F.count_if(whole).alias("whole_"),
        F.coalesce(F.bool_and(F.when(changed, title)), F.lit(False)).alias("only_titles"),
    )
    by_row = rows.groupBy("pair_id").agg(F.count_if("is_scope_diff").alias("rows_"))
    both = by_region.join(by_row, "pair_id", "full")
    n = lambda c: F.coalesce(c, F.lit(0))
    return both.select(
        "pair_id", (n("whole_") + n("rows_")).alias("schedule_row_diff_count"), n("title_block_diff_count").alias("title_block_diff_count"),
        F.coalesce("only_titles", F.lit(False)).alias("only_titles"),
    )


def flat_row_sets(decisions: DataFrame, pages: DataFrame, regions: DataFrame, rows: DataFrame) -> dict[str, DataFrame]:
    """documents, pages, regions and rows, each with the sheet of its pair.

    ``decisions`` are (pair_id, status, confidence, sheet_id, sheet_title,
    family, revision_status, ...).  Matched pairs take their status from the
    comparison; others keep that of the decision and have zero counts.
    """
    sheet = decisions.select("pair_id", "sheet_id", "sheet_title", "family")
    known = decisions.withColumnsRenamed({"status": "decided_", "confidence": "sure_"})
    every = known.join(pair_results(pages), "pair_id", "left").join(diff_counts(regions, rows), "pair_id", "left")
    compared = (F.col("decided_") == "matched") & F.col("status").isNotNull()
    counts = ("changed_pages", "schedule_row_diff_count", "title_block_diff_count", "visual_diff_count", "structured_pages")
    by_result = compare_status(
        F.col("changed"), F.col("status") == "review_needed", F.coalesce("schedule_row_diff_count", F.lit(0)),
        F.coalesce("only_titles", F.lit(False)), F.col("visual_diff_count"), F.col("family"),
    )
    documents = every.select(
        *[c for c in decisions.columns if c not in ("status", "confidence")],
        F.when(compared, F.col("status")).otherwise(F.col("decided_")).alias("status"),
        F.when(compared, by_result).otherwise(F.col("decided_")).alias("compare_status"),
        F.when(compared, F.col("changed")).otherwise(F.col("decided_").isin("added", "removed")).alias("changed"),
        F.when(compared, F.col("document_confidence")).otherwise(F.bround("sure_", 3)).alias("document_confidence"),
        *[F.when(compared, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).alias(c) for c in counts],
        F.when(compared, F.col("ocr_used")).otherwise(F.lit(False)).alias("ocr_used"),
        F.when(compared, F.size("warnings")).otherwise(F.lit(0)).alias("warning_count"),
    )
    return {"documents": documents, **{n: df.join(sheet, "pair_id") for n, df in (("pages", pages), ("regions", regions), ("rows", rows))}}
