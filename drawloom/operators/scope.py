"""What counts as a change of scope: predicates over text, row changes, regions and boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawloom.functions import geometry as G
from drawloom.functions import text as T

# Words and phrases of drawing texts.
SCOPE_TERMS = tuple("""
    access ap badge bom cable camera card cat6 circuit control controller device door equipment fiber function idf
    intercom location make manufacturer mdf model mount mounting network panel part patch port qty quantity reader router
    schedule server switch tag type wap wireless
""".split())
NON_SCOPE_TERMS = tuple("""
    approved checked client consultant copyright date drawn drawing engineer issue issued legal owner professional project
    revision revisions rev scale seal sheet signature title
""".split())
LEGEND_TERMS = (
    "abbreviation", "abbreviations", "autodesk docs", "construction note", "designator", "device legend", "drawing index",
    "equipment number", "legend", "note #", "refer to drawing", "sequential", "sheet index", "sheet type", "symbols",
)
HEADER_TERMS = tuple("""
    item qty quantity description remarks comment material part schedule bom bill length width height port tag device model
    manufacturer type make mounting function
""".split())
SPECIFIC_TERMS = ("model", "make", "manufacturer", "part", "device", "switch", "port", "equipment")
METADATA_TERMS = tuple("""
    revision revisions rev title sheet drawing drawn checked project date issue issued scale client owner approved number
""".split())
TABLE_TERMS = tuple("""
    item catalog code qty quantity description remarks comment material part reference schedule spec bom bill length mark
    name size unit vendor width height port tag device model manufacturer type
""".split())
TABLE_HEADERS = tuple("""
    assembly catalog code item qty quantity description material part reference spec device model manufacturer make name
    size type unit vendor function location mounting port switch tag equipment equip idf mdf
""".split())
NOISE_HEADERS = tuple("""
    revision revisions rev date drawing sheet title project scale drawn checked approved issue issued
""".split())

# Patterns.
NUMBERED = r"\b(?:idf|mdf|sw|switch|port|cam|camera|wap|ap|reader|fiber)[-_ ]?[a-z0-9]*[0-9]+[a-z0-9_.-]*\b"
MODEL = r"(?i)\b((?=[a-z0-9_.-]*[a-z])(?=[a-z0-9_.-]*[0-9])[a-z0-9][a-z0-9_.-]{2,})\b"
DATE = r"\b(?:[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}|[0-9]{4}[/.-][0-9]{1,2}[/.-][0-9]{1,2})\b"
INDEX_ROW = r"(?i)^\s*DT[0-9]{4}\b"
REVISION_ONLY = r"(?i)^\s*(?:rev(?:ision)?\.?\s*)?[a-z0-9]{1,3}\s*$"
REVISION_LOG = r"(?i)\b(?:revised|revision|issued?|gmp issue|for bid|bid issue|addendum)\b"
SCOPE_KINDS = ("bom-like", "table-like")
IGNORED_KINDS = ("metadata-like", "title-block-like")


def word_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)))


def _shared(words: Column, terms: tuple[str, ...]) -> Column:
    return F.size(F.array_intersect(words, F.array(*map(F.lit, terms))))


def model_tokens(c: Column) -> Column:
    """Tokens of four characters at least with letters and digits that are no sheet number and no date."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(MODEL), F.lit(1)), lambda t: F.lower(F.trim(t, F.lit("._-"))))
    return F.filter(found, lambda t: (F.length(t) >= 4) & ~t.rlike("^(?:dt|ee|et|el|e)[0-9]{3,5}$") & ~t.rlike(f"^{DATE}$"))


def has_signal(c: Column) -> Column:
    n = T.normalize_text(c)
    return (_shared(word_set(n), SCOPE_TERMS) > 0) | n.rlike(NUMBERED)


def has_specific_signal(c: Column) -> Column:
    n = T.normalize_text(c)
    return n.rlike(NUMBERED) | (((_shared(word_set(n), SPECIFIC_TERMS) > 0) | has_signal(n)) & (F.size(model_tokens(n)) > 0))


def header_only(c: Column) -> Column:
    words = word_set(c)
    few = F.array_contains(words, F.lit("schedule")) & (F.size(words) <= 3) & (F.size(model_tokens(c)) == 0)
    plain = (_shared(words, HEADER_TERMS) >= 2) & ~F.exists(words, lambda w: w.rlike("^[0-9]+$"))
    return (F.size(words) >= 2) & (few | plain)


def metadata_noise(c: Column) -> Column:
    n = T.normalize_text(c)
    words = word_set(n)
    dated = n.rlike(DATE) & ~has_signal(F.regexp_replace(n, DATE, " "))
    shared = _shared(words, NON_SCOPE_TERMS)
    return (
        (n == "") | n.rlike(INDEX_ROW) | dated | n.rlike(REVISION_ONLY) | (shared == F.size(words))
        | ((shared >= 2) & ~has_signal(n)) | (n.rlike(r"\bdt[0-9]{4}\b") & ~has_signal(n))
    )


def index_or_title(c: Column) -> Column:
    n = T.normalize_text(c)
    return n.rlike(INDEX_ROW) | n.contains("sheet index") | n.contains("project information")


def revision_log(c: Column) -> Column:
    n = T.normalize_text(c)
    return n.rlike(REVISION_LOG) & (n.rlike(DATE) | n.rlike(r"\brev(?:ision)?\b"))


def legend_text(c: Column) -> Column:
    n = T.normalize_text(c)
    return reduce(lambda a, b: a | b, [n.contains(t) for t in LEGEND_TERMS])


def change_in_scope(before: Column, after: Column, context: Column) -> Column:
    """Whether a changed cell value matters, by itself or in its row."""
    both = F.concat_ws(" ", before, after)
    differs = T.normalized_cell(before) != T.normalized_cell(after)
    return differs & ~metadata_noise(both) & (has_specific_signal(both) | has_specific_signal(context))


def row_in_scope(kind: Column, change: Column, before: Column, after: Column, cells: Column | None = None) -> Column:
    """Whether a row change matters; ``cells`` are its changed cells (before, after), else the whole texts count."""
    context = F.concat_ws(" ", before, after)
    gate = kind.isin(*SCOPE_KINDS) & ~index_or_title(before) & ~index_or_title(after) & ~revision_log(context)
    gate &= ~legend_text(context) & ~header_only(context) & ~(metadata_noise(context) & ~has_signal(context))
    whole = change_in_scope(before, after, context)
    if cells is not None:
        by_cell = F.exists(cells, lambda x: change_in_scope(x["before"], x["after"], context))
        whole = F.when(F.coalesce(F.size(cells), F.lit(0)) > 0, by_cell).otherwise(whole)
    changed = F.when(change == "added", after).otherwise(before)
    single = has_specific_signal(changed) & ~header_only(changed) & ~metadata_noise(changed)
    return gate & F.when(change == "modified", whole).otherwise(single)


def text_in_scope(c: Column) -> Column:
    """Whether a row or a region without rows has scope content."""
    return ~index_or_title(c) & ~header_only(c) & ~legend_text(c) & has_specific_signal(c) & ~metadata_noise(c)


def region_in_scope(kind: Column, change: Column, n_row_diffs: Column, n_scope_rows: Column, before: Column, after: Column) -> Column:
    """Rows decide where there are row changes; else only regions that are neither tables nor general text."""
    both = F.concat_ws(" ", before, after)
    by_text = ~kind.isin("general", *SCOPE_KINDS) & ~legend_text(both) & ~header_only(both)
    by_text &= ~(metadata_noise(both) & ~has_signal(both)) & has_specific_signal(both)
    return (change != "unchanged") & ~kind.isin(*IGNORED_KINDS) & F.when(n_row_diffs > 0, n_scope_rows > 0).otherwise(by_text)


def table_score(rows: Column, text: Column) -> Column:
    """(is_scope, header_hits, noise_hits) of a region's row texts and cells, array of struct(text, cells)."""
    split = lambda c: F.array_distinct(F.split(T.normalize_text(c), " "))
    header = split(F.array_join(F.transform(F.slice(rows, 1, 3), lambda r: r["text"]), " "))
    head, noise = _shared(header, TABLE_HEADERS), _shared(header, NOISE_HEADERS)
    n_text = T.normalize_text(text)
    in_text = reduce(lambda a, b: a + b, [n_text.contains(t).cast("int") for t in TABLE_HEADERS])
    data = F.when(F.size(rows) > 1, F.slice(rows, F.lit(2), F.size(rows))).otherwise(rows)
    modelled = lambda r: F.exists(r["cells"], lambda c: c.rlike(r"\p{L}") & c.rlike("[0-9]"))
    n_model = F.size(F.filter(data, modelled))
    n_scope = F.size(F.filter(data, lambda r: modelled(r) | (_shared(split(r["text"]), TABLE_HEADERS) > 0)))
    index_rows = F.size(F.filter(rows, lambda r: F.upper(F.trim(r["text"])).startswith("DT")))
    index = (F.size(rows) >= 3) & (index_rows >= F.greatest(F.lit(2), F.floor(F.size(rows) / 2)))
    good = ((head >= 2) & (n_scope >= 1) & (in_text >= 2)) | ((head >= 1) & (in_text >= 1) & (n_scope >= 3) & (n_model >= 2))
    scope = (F.size(rows) > 0) & ~index & ~((noise >= 2) & (head < 3)) & good
    return F.struct(scope.alias("is_scope"), head.alias("header_hits"), noise.alias("noise_hits"), n_model.alias("model_rows"))


def block_kind(rows: Column, text: Column, box: dict[str, Column], page_width: Column, page_height: Column) -> Column:
    """(kind, confidence) of a text block: bill of material, title block, metadata or general."""
    n = T.normalize_text(text)
    hits = lambda terms: reduce(lambda a, b: a + b, [n.contains(t).cast("int") for t in terms])
    meta, table = hits(METADATA_TERMS), hits(TABLE_TERMS)
    score = table_score(rows, text)
    bom = (F.size(rows) >= 2) & (score["is_scope"] | ((score["header_hits"] >= 2) & (table >= 3) & (score["model_rows"] >= 1)))
    right, top, low = box["x0"] > page_width * 0.60, box["y0"] < page_height * 0.45, box["y0"] > page_height * 0.60
    made = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("double").alias("confidence"))
    return (
        F.when(bom, made("bom-like", F.least(F.lit(0.96), 0.64 + 0.04 * F.least(score["header_hits"], F.lit(4)) + 0.02 * F.least(F.size(rows), F.lit(8)))))
        .when((table >= 2) & right & top, made("metadata-like", F.least(F.lit(0.88), 0.52 + 0.04 * table)))
        .when((meta > 0) & (right | low), made("title-block-like", F.least(F.lit(0.95), 0.58 + 0.06 * meta)))
        .when(meta > 0, made("metadata-like", F.least(F.lit(0.88), 0.50 + 0.05 * meta)))
        .otherwise(made("general", F.lit(0.40)))
    )


def attach_notes(regions: DataFrame) -> DataFrame:
    """(doc_id, page_num, note_id, region_id): notes left of or above a bill of material, each to the first that takes it.

    Regions are (doc_id, page_num, region_id, kind, x0..y1, text); the order of bills is that of region_id.
    """
    page = ["doc_id", "page_num"]
    note = (F.col("kind") != "bom-like") & F.col("text").rlike(r"(?i)^\s*notes?\b")
    boms = regions.filter("kind = 'bom-like'").select(*page, "region_id", *[F.col(s).alias(f"b_{s}") for s in G.SIDES])
    notes = regions.filter(note).select(*page, F.col("region_id").alias("note_id"), *[F.col(s).alias(f"n_{s}") for s in G.SIDES])
    b, n = G.box("b_"), G.box("n_")
    apart_x = F.greatest(F.lit(0.0), F.greatest(b["x0"], n["x0"]) - F.least(b["x1"], n["x1"]))
    apart_y = F.greatest(F.lit(0.0), F.greatest(b["y0"], n["y0"]) - F.least(b["y1"], n["y1"]))
    left = (n["x1"] <= b["x0"]) & (apart_x <= F.greatest(F.lit(110.0), G.width(b) * 0.18)) & ((G.overlap_ratio(b, n) > 0) | (apart_y <= 28.0))
    above = (n["y1"] <= b["y0"]) & (apart_y <= F.greatest(F.lit(72.0), G.height(b) * 0.30)) & (F.least(b["x1"], n["x1"]) > F.greatest(b["x0"], n["x0"]))
    near = boms.join(notes, page).filter(left | above)
    first = Window.partitionBy(*page, "note_id").orderBy("region_id")
    return near.withColumn("n_", F.row_number().over(first)).filter("n_ = 1").select(*page, "note_id", "region_id")


def visual_boxes(boxes: DataFrame, regions: DataFrame, words: DataFrame, width: float, height: float) -> DataFrame:
    """Boxes of visual change that matter: small, outside title and footer, on no title text, near scope text.

    ``boxes`` and ``regions`` (kind, text) and ``words`` (text) have page_id and x0..y1.
    """
    box = G.box()
    share = G.area(box) / (width * height)
    cx, cy = (box["x0"] + box["x1"]) / 2, (box["y0"] + box["y1"]) / 2
    zone = ((cx > width * 0.64) & (cy > height * 0.45)) | (cy > height * 0.84)
    kept = boxes.filter((share > 0) & (share <= 0.035) & ~zone)
    side = lambda df: df.select("page_id", *[F.col(s).alias(f"r_{s}") for s in G.SIDES])
    noise = side(regions.filter(F.col("kind").isin(*IGNORED_KINDS)))
    kept = kept.join(noise, (kept["page_id"] == noise["page_id"]) & (G.overlap_ratio(box, G.box("r_")) > 0.15), "left_anti")

    def grown(margin: float) -> dict[str, Column]:
        edge = F.greatest
        return {
            "x0": edge(F.lit(0.0), box["x0"] - margin), "y0": edge(F.lit(0.0), box["y0"] - margin),
            "x1": F.least(F.lit(width), box["x1"] + margin), "y1": F.least(F.lit(height), box["y1"] + margin),
        }

    def near(df: DataFrame, margin: float) -> DataFrame:
        other = side(df)
        return kept.join(other, (kept["page_id"] == other["page_id"]) & (G.overlap_ratio(grown(margin), G.box("r_")) > 0), "left_semi")

    least = min(width, height)
    scope = regions.filter(~F.col("kind").isin(*IGNORED_KINDS) & text_in_scope(F.col("text")))
    said = words.filter(has_specific_signal(F.col("text")) & ~metadata_noise(F.col("text")))
    return near(scope, max(18.0, least * 0.025)).unionByName(near(said, max(24.0, least * 0.03))).distinct()


def compare_status(changed: Column, review: Column, schedule_rows: Column, only_titles: Column, visual: Column, family: Column) -> Column:
    """The status of a compared document."""
    drawn = family.isin("overall_plan", "area_plan", "detail", "mdf_idf_layout")
    return (
        F.when(review, "review_needed")
        .when(~changed, "unchanged")
        .when(schedule_rows > 0, "schedule_bom_changed")
        .when(only_titles & (visual <= 3), "title_revision_only")
        .when((visual > 0) & drawn, "drawing_scope_changed")
        .otherwise("scope_changed")
    )


def report_sections(documents: DataFrame, pages: DataFrame, regions: DataFrame, rows: DataFrame) -> dict[str, DataFrame]:
    """The sections of a revision report.

    ``documents`` have status, changed and compare_status, ``pages``
    change_type and global_box_count, ``regions`` region_kind, ``rows`` is_scope_diff.
    """
    moved = F.col("changed") | F.col("compare_status").isin("schedule_bom_changed", "drawing_scope_changed", "scope_changed")
    parts = {
        "Sheet Map": documents,
        "Changed Sheets": documents.filter(moved),
        "Schedule Row Diffs": rows.filter("is_scope_diff"),
        "Title Block Diffs": regions.filter(F.col("region_kind").isin(*IGNORED_KINDS)),
        "Visual Page Diffs": pages.filter("change_type <> 'unchanged' or coalesce(global_box_count, 0) > 0"),
        "Added Sheets": documents.filter("status = 'added'"),
        "Removed Sheets": documents.filter("status = 'removed'"),
        "Review Needed": documents.filter("status = 'review_needed' or compare_status = 'compare_failed'"),
    }
    counts = [df.agg(F.lit(name).alias("section"), F.count(F.lit(1)).alias("rows")) for name, df in parts.items()]
    return parts | {"Run Summary": reduce(lambda a, b: a.unionByName(b), counts)}
