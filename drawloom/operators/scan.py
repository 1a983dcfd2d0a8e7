"""Tag extraction from positioned text.

``spans`` are (doc_id, page_num, span_id, text, x0, y0, x1, y1, size), ``pages``
(doc_id, page_num, width, height).  All pages are handled in one plan, keyed by
(doc_id, page_num); only exclusive stacking, which depends on order, runs in a
function per page.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawloom import config
from drawloom.config import RULES, Rules
from drawloom.functions import geometry as G
from drawloom.functions import tags as N
from drawloom.functions import text as T
from drawloom.operators.assign import cut

PAGE = ["doc_id", "page_num"]
TAG_COLUMNS = [
    *PAGE, "full_tag", "root", "component", "tag_class", "method", "source_spans", "source_text", "x0", "y0", "x1", "y1",
]


#: Side of the square cells in which roots and children look for each other.
CELL = 64.0


def dealt(spans: DataFrame) -> DataFrame:
    """Spans by pages over many tasks: a file of them is few bytes but much work."""
    return spans.repartition(*PAGE)


def with_norm(spans: DataFrame) -> DataFrame:
    return spans.withColumn("norm", T.normalize_token(F.col("text"))).filter(F.trim("text") != "")


def classified(spans: DataFrame, p: Rules = RULES) -> DataFrame:
    """Spans with norm and what it looks like: root (its canonical form or null), child, isa_child and compact."""
    if "compact" in spans.columns:
        return spans
    norm = F.col("norm")
    return dealt(spans if "norm" in spans.columns else with_norm(spans)).select(
        "*", F.when(N.looks_root(norm, p), N.canonical_root(norm)).alias("root"), N.looks_child(norm, p).alias("child"),
        N.looks_isa_child(norm, p).alias("isa_child"), N.compact_child(norm).alias("compact"),
    )


def _cells(low: Column, high: Column, side: Column | float) -> Column:
    """The numbers of the cells that low..high touches."""
    return F.sequence(F.floor(low / side), F.greatest(F.floor(low / side), F.floor(high / side)))


def line_tags(spans: DataFrame, p: Rules = RULES) -> DataFrame:
    """The first size-service-number tag of each span."""
    upper = F.upper("text")
    noisy = reduce(lambda a, b: a | b, [upper.contains(w) for w in config.LINE_NOISE])
    found = spans.withColumn("t", N.line_tag(upper)).filter(F.col("t").isNotNull() & ~noisy)
    numbered = F.concat("t.root", "t.component").rlike("[0-9]") | F.col("t.component").isin(*config.LINE_WORD_COMPONENTS)
    return _tags(found.filter(~F.col("t.root").isin(*p["grammar"]["deny"]) & numbered), F.lit("line:size-prefix"))


def _tags(found: DataFrame, method: Column) -> DataFrame:
    return found.select(
        *PAGE, "t.full_tag", "t.root", "t.component", "t.tag_class", method.alias("method"),
        F.array("span_id").alias("source_spans"), F.col("text").alias("source_text"), *G.SIDES,
    )


def hyphen_tags(spans: DataFrame, existing: DataFrame | None = None, p: Rules = RULES) -> DataFrame:
    """Every pre-joined tag of each span that no existing tag has at the same place."""
    tokens = F.explode(F.regexp_extract_all("norm", F.lit(f"({config.FULL_HYPHEN})"), F.lit(1)))
    found = spans.withColumn("token", tokens).withColumn("t", N.full_hyphen_tag(F.col("token"), p))
    out = _tags(found.filter("t is not null"), F.col("t.method"))
    if existing is None:
        return out
    place = [*PAGE, "full_tag", F.bround("x0").alias("rx"), F.bround("y0").alias("ry")]
    known = existing.select(*place).distinct()
    keyed = out.withColumn("rx", F.bround("x0")).withColumn("ry", F.bround("y0"))
    return keyed.join(known, [*PAGE, "full_tag", "rx", "ry"], "left_anti").select(TAG_COLUMNS)


def stacked_pairs(spans: DataFrame, p: Rules = RULES) -> DataFrame:
    """(parent, child) span ids: each root takes the best child below or right of it, each child once.

    Scores of possible pairs come from a join of roots and children of one page
    in neighbouring strips; the exclusive choice goes root by root in reading order.
    """
    spans = classified(spans, p)
    a = spans.filter("root is not null").select(*PAGE, *[F.col(c).alias(f"a_{c}") for c in ("span_id", "size", *G.SIDES)])
    b = spans.filter("child").select(*PAGE, *[F.col(c).alias(f"b_{c}") for c in ("span_id", "size", *G.SIDES)])
    pa, ch = G.box("a_"), G.box("b_")
    wide = G.is_wide(pa)
    line = F.when(wide, G.height(pa)).otherwise(G.width(pa))
    end = F.when(wide, pa["y1"]).otherwise(pa["x1"])
    a = a.withColumn("wide", wide).withColumn("strip", F.explode(_cells(end - 0.3 * line, end + p["stack"]["gap"] * line, CELL)))
    across = F.when(G.is_wide(ch), ch["y0"]).otherwise(ch["x0"])
    b = b.withColumn("wide", G.is_wide(ch)).withColumn("strip", F.floor(across / CELL))
    gap = F.when(wide, ch["y0"] - pa["y1"]).otherwise(ch["x0"] - pa["x1"])
    overlap = F.when(wide, G.x_overlap(pa, ch)).otherwise(G.y_overlap(pa, ch))
    size = F.abs(F.col("a_size") - F.col("b_size")) / F.greatest(F.col("a_size"), F.lit(1.0))
    near = (gap >= -0.3 * line) & (gap <= p["stack"]["gap"] * line) & (overlap >= p["stack"]["overlap"])
    pairs = a.join(b, [*PAGE, "wide", "strip"]).filter((F.col("a_span_id") != F.col("b_span_id")) & near)
    scored = pairs.select(
        *PAGE, "a_span_id", "b_span_id", F.col("a_y0"), F.col("a_x0"),
        (gap * (1.0 - 0.5 * overlap) + 5.0 * size).alias("score"),
    )

    def choose(page: pd.DataFrame) -> pd.DataFrame:
        used: set[int] = set()
        rows = []
        page = page.sort_values(["a_y0", "a_x0", "a_span_id", "score", "b_span_id"], kind="stable")
        for _, own in page.groupby(["a_y0", "a_x0", "a_span_id"], sort=False):
            free = own[~own["b_span_id"].isin(used)]
            if len(free):
                best = free.iloc[0]
                used.add(best["b_span_id"])
                rows.append((best["doc_id"], best["page_num"], best["a_span_id"], best["b_span_id"]))
        return pd.DataFrame(rows, columns=["doc_id", "page_num", "parent", "child"])

    kinds = dict(spans.dtypes)
    schema = f"doc_id {kinds['doc_id']}, page_num {kinds['page_num']}, parent {kinds['span_id']}, child {kinds['span_id']}"
    scored = scored.repartition(4 * scored.sparkSession.sparkContext.defaultParallelism, *PAGE)  # few bytes, much work
    return scored.groupBy(*PAGE).applyInPandas(choose, schema)


def stacked_tags(spans: DataFrame, pairs: DataFrame, p: Rules = RULES) -> DataFrame:
    spans = classified(spans, p)
    a = spans.filter("root is not null").select(*PAGE, F.col("span_id").alias("parent"), *[F.col(c).alias(f"a_{c}") for c in ("text", "root", *G.SIDES)])
    b = spans.filter("child").select(*PAGE, F.col("span_id").alias("child"), *[F.col(c).alias(f"b_{c}") for c in ("text", "norm", "isa_child", "compact", *G.SIDES)])
    both = pairs.join(a, [*PAGE, "parent"]).join(b, [*PAGE, "child"])
    isa = F.col("b_isa_child")
    component = F.when(isa, F.col("b_compact")).otherwise(F.col("b_norm"))
    return _paired(both, component, F.when(isa, "instrument").otherwise("equipment"), F.when(isa, "stacked:isa").otherwise("stacked:equip"))


def _paired(both: DataFrame, component: Column, kind: Column, method: Column) -> DataFrame:
    root = F.col("a_root")
    return both.select(
        *PAGE, F.concat_ws("-", root, component).alias("full_tag"), root.alias("root"), component.alias("component"),
        kind.alias("tag_class"), method.alias("method"), F.array("parent", "child").alias("source_spans"),
        F.concat_ws(" / ", "a_text", "b_text").alias("source_text"),
        F.least("a_x0", "b_x0").alias("x0"), F.least("a_y0", "b_y0").alias("y0"),
        F.greatest("a_x1", "b_x1").alias("x1"), F.greatest("a_y1", "b_y1").alias("y1"),
    )


def inferred_tags(spans: DataFrame, p: Rules = RULES) -> DataFrame:
    """A bare code takes its nearest root on the page and a number in reading order for root and code."""
    spans, reach = spans if "compact" in spans.columns else cut(classified(spans, p)), p["bare"]["reach"]  # else filters would go below the dealing
    a = spans.filter("root is not null").select(
        *PAGE, F.col("span_id").alias("parent"), *[F.col(c).alias(f"a_{c}") for c in ("text", "root", *G.SIDES)]
    )
    b = spans.filter(F.col("norm").isin(*p["bare"]["codes"])).select(
        *PAGE, F.col("span_id").alias("child"), *[F.col(c).alias(f"b_{c}") for c in ("text", "norm", *G.SIDES)]
    )
    for i, (low, high) in enumerate((("x0", "x1"), ("y0", "y1"))):  # a root lies in the child's cell or beside it
        a = a.withColumn(f"cell_{i}", F.floor((F.col(f"a_{low}") + F.col(f"a_{high}")) / 2 / reach))
        middle = (F.col(f"b_{low}") + F.col(f"b_{high}")) / 2
        b = b.withColumn(f"cell_{i}", F.explode(_cells(middle - reach, middle + reach, reach)))
    pa, ch = G.box("a_"), G.box("b_")
    dx = F.abs((ch["x0"] + ch["x1"]) / 2 - (pa["x0"] + pa["x1"]) / 2)
    dy = F.abs((ch["y0"] + ch["y1"]) / 2 - (pa["y0"] + pa["y1"]) / 2)
    distance = (
        F.sqrt(dx * dx + dy * dy)
        + F.when(dy < F.greatest(G.height(pa), G.height(ch)) * 4, -60).otherwise(0)
        + F.when(dx < F.greatest(G.width(pa), G.width(ch)) * 2, -40).otherwise(0)
        + F.when(G.width(pa) > 15 * F.greatest(G.width(ch), G.height(ch), F.lit(1.0)), 150).otherwise(0)
    )
    near = a.join(b, [*PAGE, "cell_0", "cell_1"]).filter((F.col("parent") != F.col("child")) & (dx <= reach) & (dy <= reach))
    near = near.repartition(4 * near.sparkSession.sparkContext.defaultParallelism, *PAGE)  # both windows run in it
    own = Window.partitionBy(*PAGE, "child").orderBy("distance", "parent")
    best = near.withColumn("distance", distance).withColumn("n", F.row_number().over(own)).filter("n = 1")
    order = Window.partitionBy(*PAGE, "a_root", "b_norm").orderBy("b_y0", "b_x0", "child")
    best = best.withColumn("nth", F.row_number().over(order))
    component = F.concat("b_norm", F.lpad(F.col("nth").cast("string"), 3, "0"))
    return _paired(best, component, F.lit("instrument"), F.lit("inferred:bare-isa"))


def standalone_tags(spans: DataFrame, pairs: DataFrame, p: Rules = RULES) -> DataFrame:
    """Instrument children that no root took, and every root once a page."""
    spans = classified(spans, p)
    taken = pairs.select(*PAGE, F.col("child").alias("span_id"))
    child, root = F.col("compact"), F.col("root")
    free = spans.filter("isa_child").join(taken, [*PAGE, "span_id"], "left_anti")
    once = Window.partitionBy(*PAGE, child, F.bround("x0"), F.bround("y0")).orderBy("span_id")
    free = free.withColumn("n", F.row_number().over(once)).filter("n = 1")
    free = free.withColumn("t", F.struct(child.alias("full_tag"), F.lit("").alias("root"), child.alias("component"), F.lit("instrument").alias("tag_class")))
    first = Window.partitionBy(*PAGE, root).orderBy("span_id")
    roots = spans.filter("root is not null").withColumn("n", F.row_number().over(first)).filter("n = 1")
    roots = roots.withColumn("t", F.struct(root.alias("full_tag"), root.alias("root"), F.lit("").alias("component"), F.lit("equipment").alias("tag_class")))
    return _tags(free, F.lit("standalone:isa")).unionByName(_tags(roots, F.lit("standalone:asset")))


def extract_tags(spans: DataFrame, p: Rules = RULES) -> DataFrame:
    """All tags of all pages, unscored."""
    spans = cut(classified(spans, p))  # every extractor reads it
    pairs = cut(stacked_pairs(spans, p))
    placed = stacked_tags(spans, pairs, p).unionByName(inferred_tags(spans, p)).unionByName(standalone_tags(spans, pairs, p))
    placed = cut(placed)
    return cut(placed.unionByName(hyphen_tags(spans, placed, p)).unionByName(line_tags(spans, p)))


def page_roles(spans: DataFrame, p: Rules = RULES) -> DataFrame:
    """legend/reference where at least two markers stand in the page's text; markers may cross spans."""
    ordered = F.array_sort(F.collect_list(F.struct("span_id", F.lower("text").alias("text"))))
    joined = spans.groupBy(*PAGE).agg(F.array_join(F.transform(ordered, lambda s: s["text"]), " ").alias("all_text"))
    hits = reduce(lambda a, b: a + b, [F.col("all_text").contains(m).cast("int") for m in p["page"]["legend"]])
    return joined.select(*PAGE, F.when(hits >= 2, "legend/reference").otherwise("process/drawing").alias("page_role"))


def score_tags(tags: DataFrame, p: Rules = RULES) -> DataFrame:
    """Add zone, confidence, rating and evidence to tags with page sizes, page_role and sheet_id.

    Terms are added in a fixed order, so equal evidence gives equal sums.
    """
    w = p["score"]["weights"]
    bases = F.create_map(*[F.lit(x) for method, weight in w.items() if ":" in method for x in (method, weight)])
    tags = tags.withColumn("zone", G.zone(G.box(), F.col("width"), F.col("height"), p))
    instrument = F.col("tag_class") == "instrument"
    noisy = reduce(lambda a, b: a | b, [F.lower("source_text").contains(m) for m in p["page"]["noise"]])
    agreement = F.col("source_agreement") if "source_agreement" in tags.columns else F.lit("native-only")
    title = F.col("zone").startswith("title-block")
    steps = [
        [(F.col("zone") == "drawing", w["drawing_zone_bonus"], "drawing zone"), (title, w["title_block_penalty"], "title-block penalty"), (F.col("zone") == "edge", w["edge_zone_penalty"], "edge zone")],
        [(F.col("page_role") == "legend/reference", w["legend_page_penalty"], "legend page penalty"), (F.lit(True), w["process_page_bonus"], "process page")],
        [(F.col("sheet_id").startswith("PAGE_"), w["unmapped_sheet_penalty"], "unmapped sheet"), (F.lit(True), w["mapped_sheet_bonus"], "mapped sheet")],
        [(noisy, w["noisy_context_penalty"], "noisy context")],
        [(instrument & (T.alpha_prefix(F.col("root")) == "VG"), w["valve_group_penalty"], "valve group review")],
        [(instrument & N.instrument_code(F.col("component")).isin(*p["score"]["review"]), w["custom_code_penalty"], "custom code review")],
        [(agreement == "matched", w["matched_source_bonus"], "native/ocr agreement"), (agreement == "ocr-only", w["ocr_only_penalty"], "ocr only"), (agreement == "conflict", w["source_conflict_penalty"], "source conflict")],
    ]
    total = F.coalesce(F.try_element_at(bases, "method"), F.lit(w["unknown"]))
    notes = []
    for step in steps:
        value, note = F.lit(None).cast("double"), F.lit(None).cast("string")
        for test, weight, text in reversed(step):
            value, note = F.when(test, F.lit(weight)).otherwise(value), F.when(test, F.lit(text)).otherwise(note)
        total = total + F.coalesce(value, F.lit(0.0))
        notes.append(note)
    total = F.greatest(F.lit(0.05), F.least(F.lit(0.99), total))
    scored = tags.withColumn("confidence", total).withColumn("evidence", F.concat_ws("; ", *notes))
    return scored.withColumn("rating", N.rating(F.col("confidence"), p))


def repetition_bump(tags: DataFrame, p: Rules = RULES) -> DataFrame:
    """Raise tags that occur more than once on a sheet."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "sheet_id", "full_tag"))
    counted = tags.withColumn("repeats", n)
    more = F.least(F.lit(p["score"]["repeat"][1]), F.lit(p["score"]["repeat"][0]) * F.col("repeats"))
    raised = F.when(F.col("repeats") > 1, F.least(F.lit(0.99), F.col("confidence") + more)).otherwise(F.col("confidence"))
    note = F.when(F.col("repeats") > 1, F.concat("evidence", F.lit("; repeated x"), "repeats")).otherwise(F.col("evidence"))
    counted = counted.withColumn("confidence", raised).withColumn("evidence", note)
    return counted.withColumn("rating", N.rating(F.col("confidence"), p))


def tag_order(seq: str = "seq") -> list[Column]:
    """The order in which one tag beats another; ``seq`` breaks exact ties."""
    return [F.desc("confidence"), N.method_rank(F.col("method")), F.col("sheet_id"), F.col("page_num"), F.col("full_tag"), F.col(seq)]


def dedupe(tags: DataFrame, *, by_location: bool = False, seq: str = "seq") -> DataFrame:
    """The best tag of each (sheet, page, tag), or also of each rounded place."""
    key = ["doc_id", "sheet_id", "page_num", "full_tag", *([F.bround("x0"), F.bround("y0")] if by_location else [])]
    best = F.row_number().over(Window.partitionBy(*key).orderBy(*tag_order(seq)))
    return tags.withColumn("nth_", best).filter("nth_ = 1").drop("nth_")


def fuse_sources(native: DataFrame, ocr: DataFrame, p: Rules = RULES) -> DataFrame:
    """Native tags with OCR tags of the same key merged in, and the OCR tags that no native tag has.

    The last of several native tags with one key takes the match.
    """
    key = ["doc_id", "page_num", "sheet_id", "tag_class", "full_tag"]
    last = Window.partitionBy(*key).orderBy(F.desc("seq"))
    native = native.withColumn("last_", F.row_number().over(last) == 1)
    seen = ocr.groupBy(*key).agg(
        F.count(F.lit(1)).alias("hits_"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "source_text"))), lambda s: s["source_text"]).alias("texts_"),
    )
    joined = native.join(seen, key, "left")
    hit = F.col("last_") & F.col("hits_").isNotNull()
    gain = F.aggregate(F.sequence(F.lit(1), F.coalesce("hits_", F.lit(1)).cast("int")), F.col("confidence"), lambda c, _: F.least(F.lit(0.99), c + p["score"]["weights"]["matched_source_bonus"]))
    text = F.aggregate(
        F.coalesce("texts_", F.array().cast("array<string>")),
        F.col("source_text"),
        lambda acc, t: F.when((t == "") | F.contains(acc, t), acc).otherwise(F.concat(acc, F.lit(" | OCR: "), t)),
    )
    note = F.when(F.col("evidence").contains("native/ocr agreement"), F.col("evidence")).otherwise(
        F.concat_ws("; ", F.nullif("evidence", F.lit("")), F.lit("native/ocr agreement"))
    )
    changes = {
        "confidence": gain, "source_text": text, "evidence": note,
        "text_source": F.lit("native+ocr"), "source_agreement": F.lit("matched"),
    }
    merged = joined.select(
        *[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in native.columns if c not in ("last_", "rating")]
    )
    merged = merged.withColumn("rating", N.rating(F.col("confidence"), p))
    return merged.unionByName(ocr.join(native.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def sheet_map(spans: DataFrame, pages: DataFrame, page_text: DataFrame, p: Rules = RULES) -> DataFrame:
    """(doc_id, page_num, sheet_id): file names count 100, labels 60, title-block tokens 50 and their place,
    else a single preferred token 30 or a single token 25; the first of equals."""
    files = page_text.select(*PAGE, F.posexplode(F.regexp_extract_all("text", F.lit(config.DWG_FILE), F.lit(1))).alias("i", "sheet"))
    files = files.select(*PAGE, F.upper("sheet").alias("sheet_id"), F.lit(100.0).alias("score"), F.struct(F.lit(0).alias("k"), F.col("i").cast("long").alias("i")).alias("seq"))
    label = F.regexp_extract("text", config.SHEET_LABEL, 1)
    labels = page_text.filter(label != "").select(*PAGE, F.upper(label).alias("sheet_id"), F.lit(60.0).alias("score"), F.struct(F.lit(1).alias("k"), F.lit(0).cast("long").alias("i")).alias("seq"))
    tokens = with_norm(spans).filter(F.col("norm").rlike(config.SHEET_ID)).join(pages, PAGE)
    titled = (F.col("x0") > F.col("width") * p["sheet"]["corner"]["x"]) | (F.col("y0") > F.col("height") * p["sheet"]["corner"]["y"])
    place = (F.col("x0") + F.col("x1")) / 2 / F.greatest("width", F.lit(1.0)) + (F.col("y0") + F.col("y1")) / 2 / F.greatest("height", F.lit(1.0))
    by_place = tokens.filter(titled).select(*PAGE, F.col("norm").alias("sheet_id"), (50 + place).alias("score"), F.struct(F.lit(2).alias("k"), F.col("span_id").cast("long").alias("i")).alias("seq"))
    strong = files.unionByName(labels).unionByName(by_place)
    preferred = reduce(lambda a, b: a | b, [F.col("norm").startswith(x) for x in p["sheet"]["prefixes"]], F.lit(False))
    only = tokens.groupBy(*PAGE).agg(
        F.collect_set(F.when(preferred, F.col("norm"))).alias("good"), F.collect_set("norm").alias("every")
    )
    weak = only.select(
        *PAGE,
        F.when(F.size("good") == 1, F.col("good")[0]).when(F.size("every") == 1, F.col("every")[0]).alias("sheet_id"),
        F.when(F.size("good") == 1, 30.0).otherwise(25.0).alias("score"),
        F.struct(F.lit(3).alias("k"), F.lit(0).cast("long").alias("i")).alias("seq"),
    )
    every = strong.unionByName(weak.filter("sheet_id is not null"))
    best = Window.partitionBy(*PAGE).orderBy(F.desc("score"), "seq")
    return every.withColumn("n", F.row_number().over(best)).filter("n = 1").select(*PAGE, "sheet_id")


def scan(spans: DataFrame, pages: DataFrame, sheets: DataFrame, *, mode: str = "instrument", p: Rules = RULES) -> DataFrame:
    """Scored, mode-filtered tags with repetition counted, one row each; ``seq`` is the reading order of a page's tags."""
    tags = extract_tags(spans, p).join(pages.select(*PAGE, "width", "height"), PAGE)
    tags = tags.join(page_roles(with_norm(spans), p), PAGE).join(sheets, PAGE, "left")
    tags = tags.withColumn("sheet_id", F.coalesce("sheet_id", F.concat(F.lit("PAGE_"), F.col("page_num").cast("string"))))
    scored = score_tags(tags, p)
    if mode != "all":
        scored = scored.filter(F.col("tag_class") == mode)
    reading = Window.partitionBy(*PAGE).orderBy("y0", "x0", "full_tag", "method", "source_spans")
    return repetition_bump(scored.withColumn("seq", F.row_number().over(reading).cast("long")), p)


#: Why a page goes to OCR or not.
OCR_REASONS = {
    "heavy": "image-heavy or image-only page with weak native text",
    "mixed": "mixed raster/vector page with sparse native text",
    "vector": "dense vector page with sparse native text",
    "none": "native text sufficient",
}


def ocr_decision(pages: DataFrame, mode: str = "auto") -> DataFrame:
    """Add needs_ocr, ocr_reason and vector_suspicion to page counters.

    Weak text: under 10 words, 40 characters or 5 spans.  Image-heavy: 30 % of
    the page, or any image with weak text.  Mixed: images, few spans, drawings.
    """
    if mode not in ("auto", "always", "off"):
        raise ValueError("the OCR mode is auto, always or off")
    weak = (F.col("word_count") < 10) | (F.col("char_count") < 40) | (F.col("span_count") < 5)
    heavy = (F.col("image_coverage") >= 0.30) | ((F.col("image_count") > 0) & weak)
    mixed = (F.col("image_count") > 0) & (F.col("span_count") < 40) & (F.col("drawing_count") > 15)
    vector = (F.col("drawing_count") > 600) & (F.col("word_count") < 35)
    out = pages.withColumn("vector_suspicion", vector)
    if mode == "off":
        return out.withColumn("needs_ocr", F.lit(False)).withColumn("ocr_reason", F.lit("disabled by the OCR mode"))
    if mode == "always":
        return out.withColumn("needs_ocr", F.lit(True)).withColumn("ocr_reason", F.lit("forced by the OCR mode"))
    reason = F.when(heavy, OCR_REASONS["heavy"]).when(mixed, OCR_REASONS["mixed"]).when(vector, OCR_REASONS["vector"])
    out = out.withColumn("ocr_reason", F.coalesce(reason, F.lit(OCR_REASONS["none"])))
    return out.withColumn("needs_ocr", heavy | mixed | vector)


def rating_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


def summarize_profiles(profiles: DataFrame) -> DataFrame:
    """Counts, mean words to one digit and span sums of page profiles, in one row."""
    return profiles.agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if("needs_ocr").alias("ocr_needed"),
        F.count_if("used_ocr").alias("ocr_used"),
        F.count_if(F.coalesce("ocr_warning", F.lit("")) != "").alias("warnings"),
        F.coalesce(F.bround(F.avg("word_count"), 1), F.lit(0.0)).alias("avg_words"),
        F.coalesce(F.sum("span_count"), F.lit(0)).alias("native_spans"),
    )


def scan_summary(tags: DataFrame) -> DataFrame:
    """The counts of a scan report, in one row."""
    best = F.countDistinct("sheet_id", "page_num", "full_tag")
    return tags.agg(
        F.count(F.lit(1)).alias("detections"),
        F.countDistinct("full_tag").alias("unique_tags"),
        F.countDistinct("sheet_id").alias("unique_sheets"),
        (F.count(F.lit(1)) - best).alias("duplicates_collapsed"),
        *[F.count_if(F.col("rating") == r).alias(r.lower()) for r in ("High", "Medium", "Low")],
        F.count_if(F.col("rating") != "High").alias("review"),
    )


REPORT_ZONES = ("drawing", "edge", "title-block/bottom", "title-block/right")
REPORT_CLASSES = ("instrument", "equipment", "line")


def report_order(tags: DataFrame) -> DataFrame:
    """By page, sheet, zone, class, confidence and tag."""
    rank = lambda c, names: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col(c)), F.lit(0)), F.lit(9))
    return tags.orderBy(
        "page_num", "sheet_id", rank("zone", REPORT_ZONES), rank("tag_class", REPORT_CLASSES), F.desc("confidence"), "full_tag"
    )


def grouped_spans(spans: DataFrame) -> DataFrame:
    """Tag-like texts of 2 to 6 neighbouring spans of a line, as spans of their own.

    Lines are built in reading order: a span joins the first line whose last
    span it shares a line with.  That order matters, so a page is one group.
    """
    import re

    like = re.compile(config.TAG_LIKE)
    schema = "doc_id {doc_id}, page_num {page_num}, text string, x0 double, y0 double, x1 double, y1 double, size double, grouped_from array<{span_id}>".format(
        **dict(spans.dtypes)
    )

    def normal(text: str) -> str:
        for d in T.DASHES:
            text = text.replace(d, "-")
        return " ".join(text.upper().split()).strip(T.EDGE_MARKS)

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        items = [r for r in rows.to_dict("records") if r["text"].strip()]
        wide = lambda s: s["x1"] - s["x0"] >= s["y1"] - s["y0"]
        tall = lambda s: s["y1"] - s["y0"]

        def same_line(a: dict, b: dict) -> bool:
            if wide(a) != wide(b):
                return False
            lo, hi = ("y0", "y1") if wide(a) else ("x0", "x1")
            la, lb = a[hi] - a[lo], b[hi] - b[lo]
            shared = max(0.0, min(a[hi], b[hi]) - max(a[lo], b[lo])) / max(1.0, min(la, lb))
            return shared >= 0.45 or abs((a[lo] + a[hi]) / 2 - (b[lo] + b[hi]) / 2) <= max(la, lb)

        lines: list[list[dict]] = []
        for s in sorted(items, key=lambda s: (*((s["y0"], s["x0"]) if wide(s) else (s["x0"], s["y0"])), s["span_id"])):
            home = next((line for line in lines if same_line(line[-1], s)), None)
            if home is None:
                lines.append([s])
            else:
                home.append(s)
        out = []
        for line in lines:
            line.sort(key=lambda s: (*((s["x0"], s["y0"]) if wide(s) else (s["y0"], s["x0"])), s["span_id"]))
            gaps = [b["x0"] - a["x1"] if wide(a) else b["y0"] - a["y1"] for a, b in zip(line, line[1:], strict=False)]
            sizes = [max(tall(a), tall(b), 1.0) for a, b in zip(line, line[1:], strict=False)]
            joined = [-0.5 * h <= g <= max(22.0, 3.0 * h) for g, h in zip(gaps, sizes, strict=True)]
            for start in range(len(line)):
                for end in range(start + 2, min(len(line), start + 6) + 1):
                    if not all(joined[start : end - 1]):
                        break
                    window = line[start:end]
                    text = re.sub(r"\s*-\s*", "-", " ".join(s["text"] for s in window))
                    text = " ".join(re.sub(r'\s*"\s*', '"', text).split())
                    norm = normal(text)
                    if len(norm) >= 4 and any(c.isdigit() for c in norm) and like.search(norm):
                        box = [f(s[k] for s in window) for k, f in (("x0", min), ("y0", min), ("x1", max), ("y1", max))]
                        size = max(s["size"] for s in window)
                        out.append((window[0]["doc_id"], window[0]["page_num"], text, *box, size, [s["span_id"] for s in window]))
        return pd.DataFrame(out, columns=["doc_id", "page_num", "text", "x0", "y0", "x1", "y1", "size", "grouped_from"])

    return spans.groupBy(*PAGE).applyInPandas(page, schema)
