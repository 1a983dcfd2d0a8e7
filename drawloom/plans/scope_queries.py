"""Queries of scope predicates and report sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawloom.functions import geometry as G
from drawloom.operators import scan, scope
from drawloom.operators.assign import cut
from drawloom.plans import inputs as I
from drawloom.plans import ordered_sql as O
from drawloom.plans import scan_queries
from drawloom.plans.registry import Registry

QUERIES = Registry()
_TEXT = """case p_partkey % 12 when 0 then 'Switch SW-12 model ' || p_brand || 'x9' when 1 then 'Revision issued 3/4/2024' when 2 then 'rev B' when 3 then 'Legend of ' || p_name
  when 4 then 'Item Qty Description' when 5 then 'DT0100 ' || p_name when 6 then 'drawn checked approved' when 7 then 'camera cam-7 at door' when 8 then 'part ab-12cd' when 9 then '2024-01-02'
  when 10 then 'schedule' else p_type end"""
_T = {"k": "p_partkey", "t": _TEXT}
_WORDS = "list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+'))"
_NUMBERED = "'\\b(?:idf|mdf|sw|switch|port|cam|camera|wap|ap|reader|fiber)[-_ ]?[a-z0-9]*[0-9]+[a-z0-9_.-]*\\b'"


def _hits(terms: tuple[str, ...]) -> str:
    return f"len(list_intersect(w, [{', '.join(repr(t) for t in terms)}]))"


@QUERIES(f"""
with s as (select k, lower(t) as t, {_WORDS} as w from {I.derived_sql("part", _T)}),
g as (select *, {_hits(scope.SCOPE_TERMS)} > 0 or regexp_matches(t, {_NUMBERED}) as signal from s)
select k, signal, contains(t, 'legend') as legend,
  (regexp_matches(t, '\\b(revised|revision|issued?|gmp issue|for bid|bid issue|addendum)\\b') and (regexp_matches(t, '[0-9]+[/.-][0-9]+[/.-][0-9]+') or regexp_matches(t, '\\brev(ision)?\\b'))) as revision_log,
  regexp_matches(t, '^\\s*dt[0-9]{{4}}\\b') as index_row,
  len(w) >= 2 and {_hits(scope.HEADER_TERMS)} >= 2 and len(list_filter(w, lambda x: regexp_matches(x, '^[0-9]+$'))) = 0 as header_only from g""")
def scope_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.derived(I.table(spark, sf_dir, "part"), _T)
    t = F.col("t")
    return rows.select(
        "k", scope.has_signal(t).alias("signal"), scope.legend_text(t).alias("legend"), scope.revision_log(t).alias("revision_log"),
        scope.index_or_title(t).alias("index_row"), scope.header_only(t).alias("header_only"),
    )


def _facts(texts: str) -> str:
    """CTEs of table ``facts``: what the distinct texts t of ``texts`` look like."""
    numbered = f"regexp_matches({{0}}, {_NUMBERED})".format
    words = "list_distinct(regexp_extract_all({0}, '[a-z0-9]+'))".format
    has = lambda w, terms: f"len(list_intersect({w}, [{', '.join(repr(t) for t in terms)}]))"
    date = "([0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}|[0-9]{4}[/.-][0-9]{1,2}[/.-][0-9]{1,2})"
    model = f"""len(list_filter(list_transform(regexp_extract_all(n, '[a-z0-9][a-z0-9_.-]{{2,}}'), lambda x: trim(x, '._-')), lambda x: regexp_matches(x, '[a-z]') and regexp_matches(x, '[0-9]')
      and length(x) >= 4 and not regexp_matches(x, '^(dt|ee|et|el|e)[0-9]{{3,5}}$') and not regexp_matches(x, '^{date}$')))"""
    undated = f"regexp_replace(n, '\\b{date}\\b', ' ', 'g')"
    signal = lambda n: f"({has(words(n), scope.SCOPE_TERMS)} > 0 or {numbered(n)})"
    return f"""
normal as (select distinct t, trim(regexp_replace(lower(coalesce(t, '')), '\\s+', ' ', 'g')) as n from ({texts})),
counts as (select *, {words("n")} as w, {model} as models, {signal("n")} as signal, {numbered("n")} as numbered from normal),
facts as (select t, signal, numbered or (({has("w", scope.SPECIFIC_TERMS)} > 0 or signal) and models > 0) as specific,
  regexp_matches(n, '^\\s*dt[0-9]{{4}}\\b') or contains(n, 'sheet index') or contains(n, 'project information') as titled,
  regexp_matches(n, '\\b(revised|revision|issued?|gmp issue|for bid|bid issue|addendum)\\b') and (regexp_matches(n, '\\b{date}\\b') or regexp_matches(n, '\\brev(ision)?\\b')) as log,
  {" or ".join(f"contains(n, '{x}')" for x in scope.LEGEND_TERMS)} as legend,
  len(w) >= 2 and ((list_contains(w, 'schedule') and len(w) <= 3 and models = 0) or ({has("w", scope.HEADER_TERMS)} >= 2 and len(list_filter(w, lambda x: regexp_matches(x, '^[0-9]+$'))) = 0)) as header,
  n = '' or regexp_matches(n, '^\\s*dt[0-9]{{4}}\\b') or (regexp_matches(n, '\\b{date}\\b') and not {signal(undated)}) or regexp_matches(n, '^\\s*(rev(ision)?\\.?\\s*)?[a-z0-9]{{1,3}}\\s*$')
    or {has("w", scope.NON_SCOPE_TERMS)} = len(w) or ({has("w", scope.NON_SCOPE_TERMS)} >= 2 and not signal) or (regexp_matches(n, '\\bdt[0-9]{{4}}\\b') and not signal) as noise from counts)"""


_CELL = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')".format
_CHANGED_ROWS = f"""(select k, t, case when k % 2 = 0 then t || ' zz-99x' else t end as a, case when k % 5 = 0 then 'general' else 'bom-like' end as kind,
  case k % 3 when 0 then 'added' when 1 then 'removed' else 'modified' end as change from {I.derived_sql("part", _T)})"""


@QUERIES(f"""
with rows_ as {_CHANGED_ROWS},{_facts("select t from rows_ union select a from rows_ union select t || ' ' || a from rows_")}
select k, r.t, change, kind = 'bom-like' and not b.titled and not a.titled and not c.log and not c.legend and not c.header and not (c.noise and not c.signal)
  and case change when 'modified' then {_CELL("r.t")} <> {_CELL("r.a")} and not c.noise and c.specific when 'added' then a.specific and not a.header and not a.noise else b.specific and not b.header and not b.noise end as in_scope
from rows_ r join facts b on b.t = r.t join facts a on a.t = r.a join facts c on c.t = r.t || ' ' || r.a""")
def scope_row_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row changes matter, of table rows made from the texts."""
    rows = I.derived(I.table(spark, sf_dir, "part"), _T)
    after = F.when(F.col("k") % 2 == 0, F.concat("t", F.lit(" zz-99x"))).otherwise(F.col("t"))
    kind = F.when(F.col("k") % 5 == 0, "general").otherwise("bom-like")
    change = F.when(F.col("k") % 3 == 0, "added").when(F.col("k") % 3 == 1, "removed").otherwise("modified")
    return rows.select("k", "t", change.alias("change"), scope.row_in_scope(kind, change, F.col("t"), after).alias("in_scope"))


_BLOCK = {"k": "n_nationkey", "t": "case n_nationkey % 4 when 0 then 'Item qty ' || n_name when 1 then 'Drawing title ' || n_name when 2 then 'Scale sheet date' else n_name end", "x0": "cast(n_nationkey * 40 as double)", "y0": "cast(n_nationkey * 37 % 100 * 8 as double)"}


def _contained(terms: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"cast(contains(t, '{x}') as int)" for x in terms) + ")"


@QUERIES(f"""
with s as (select k, lower(t) as t, x0, y0 from {I.derived_sql("nation", _BLOCK)}), h as (select *, {_contained(scope.METADATA_TERMS)} as meta, {_contained(scope.TABLE_TERMS)} as tab from s)
select k, case when tab >= 2 and x0 > 600 and y0 < 360 then 'metadata-like' when meta > 0 and (x0 > 600 or y0 > 480) then 'title-block-like' when meta > 0 then 'metadata-like' else 'general' end as kind,
  round(case when tab >= 2 and x0 > 600 and y0 < 360 then least(0.88::double, 0.52::double + 0.04::double * tab) when meta > 0 and (x0 > 600 or y0 > 480) then least(0.95::double, 0.58::double + 0.06::double * meta)
  when meta > 0 then least(0.88::double, 0.50::double + 0.05::double * meta) else 0.40::double end, 6) as confidence from h""")
def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.derived(I.table(spark, sf_dir, "nation"), _BLOCK)
    none = F.array().cast("array<struct<text:string,cells:array<string>>>")
    corner = {"x0": F.col("x0"), "y0": F.col("y0")}
    found = rows.withColumn("b", scope.block_kind(none, F.col("t"), corner, F.lit(1000.0), F.lit(800.0)))
    return found.select("k", "b.kind", F.round("b.confidence", 6).alias("confidence"))


_STATUS = {
    "k": "o_orderkey", "changed": "o_orderkey % 3 > 0", "review": "o_orderkey % 17 = 0", "schedule_rows": "o_orderkey % 4", "only_titles": "o_orderkey % 5 = 0", "visual": "o_orderkey % 7",
    "family": "case o_orderkey % 2 when 0 then 'detail' else 'schedule' end",
}


@QUERIES(f"""
select k, case when review then 'review_needed' when not changed then 'unchanged' when schedule_rows > 0 then 'schedule_bom_changed' when only_titles and visual <= 3 then 'title_revision_only'
  when visual > 0 and family = 'detail' then 'drawing_scope_changed' else 'scope_changed' end as status from {I.derived_sql("orders", _STATUS)}""")
def compare_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.derived(I.table(spark, sf_dir, "orders"), _STATUS)
    c = F.col
    return rows.select("k", scope.compare_status(c("changed"), c("review"), c("schedule_rows"), c("only_titles"), c("visual"), c("family")).alias("status"))


@QUERIES(f"""
with d as (select k, case when k % 9 = 0 then 'added' when k % 11 = 0 then 'removed' when review then 'review_needed' else 'matched' end as status, changed from {I.derived_sql("orders", _STATUS)})
select 'Sheet Map' as section, count(*) as "rows" from d union all select 'Changed Sheets', count(*) from d where changed union all select 'Added Sheets', count(*) from d where status = 'added'
union all select 'Removed Sheets', count(*) from d where status = 'removed' union all select 'Review Needed', count(*) from d where status = 'review_needed'
union all select 'Schedule Row Diffs', count(*) from events where event_id % 4 = 0 union all select 'Title Block Diffs', count(*) from nation where n_nationkey % 2 = 0
union all select 'Visual Page Diffs', count(*) from supplier where s_suppkey % 3 = 0 or s_suppkey % 2 > 0""")
def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = "case when k % 9 = 0 then 'added' when k % 11 = 0 then 'removed' when review then 'review_needed' else 'matched' end as status"
    documents = I.derived(I.table(spark, sf_dir, "orders"), _STATUS).selectExpr("k", "changed", status, "'none' as compare_status")
    rows = I.table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 4 = 0 as is_scope_diff")
    regions = I.table(spark, sf_dir, "nation").selectExpr("case when n_nationkey % 2 = 0 then 'title-block-like' else 'general' end as region_kind")
    pages = I.table(spark, sf_dir, "supplier").selectExpr("case when s_suppkey % 3 = 0 then 'modified' else 'unchanged' end as change_type", "s_suppkey % 2 as global_box_count")
    return scope.report_sections(documents, pages, regions, rows)["Run Summary"]


_GROWN = "{{'x0': greatest(0.0::double, b.x0 - {0}), 'y0': greatest(0.0::double, b.y0 - {0}), 'x1': least(1000.0::double, b.x1 + {0}), 'y1': least(800.0::double, b.y1 + {0})}}".format
_SEEN = f"(select *, case when span_id % 10 = 0 then 'title-block-like' else 'bom-like' end as kind, 'device ' || text as said from {I.SPANS_SQL} where not contains(text, '-'))"


@QUERIES(f"""
with regions as {_SEEN},{_facts(f"select said as t from regions union select text from {I.SPANS_SQL}")},
boxes as (select page_num as page_id, span_id, x0, y0, x1, y1, (x1 - x0) * (y1 - y0) / 800000.0::double as share, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy from {I.SPANS_SQL} where contains(text, '-')),
kept as (select *, {_GROWN("20.0::double").replace("b.", "")} as g, {_GROWN("24.0::double").replace("b.", "")} as h from boxes b where share > 0 and share <= 0.035 and not ((cx > 640 and cy > 360) or cy > 672)
  and not exists (select 1 from regions r where r.kind = 'title-block-like' and r.page_num = b.page_id and {O.shared_area("b.", "r.")} > 0.15))
select page_id, span_id, x0, y0, x1, y1 from kept b where exists (select 1 from regions r join facts f on f.t = r.said where r.kind = 'bom-like' and r.page_num = b.page_id
    and not f.titled and not f.header and not f.legend and f.specific and not f.noise and {O.shared_area("b.g.", "r.")} > 0)
  or exists (select 1 from {I.SPANS_SQL} r join facts f on f.t = r.text where r.page_num = b.page_id and f.specific and not f.noise and {O.shared_area("b.h.", "r.")} > 0)""")
def visual_change_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = I.spans(spark, sf_dir).withColumn("page_id", F.col("page_num"))
    boxes = spans.filter("contains(text, '-')").select("page_id", "span_id", *G.SIDES)
    kind = F.when(F.col("span_id") % 10 == 0, "title-block-like").otherwise("bom-like")
    regions = spans.filter("not contains(text, '-')").withColumn("kind", kind).withColumn("text", F.concat(F.lit("device "), "text"))
    return scope.visual_boxes(boxes, regions, spans, I.WIDTH, I.HEIGHT)


@QUERIES(f"""
with b as (select * from {I.SPANS_SQL} where span_id % 4 = 0), n as (select * from {I.SPANS_SQL} where span_id % 4 <> 0),
p as (select b.doc_id, b.page_num, n.span_id as note_id, b.span_id as region_id, row_number() over (partition by b.doc_id, b.page_num, n.span_id order by b.span_id) as rn
  from b join n on {O.same_page("b", "n")}, lateral (select greatest(0.0::double, greatest(b.x0, n.x0) - least(b.x1, n.x1)) as dx, greatest(0.0::double, greatest(b.y0, n.y0) - least(b.y1, n.y1)) as dy) d
  where (n.x1 <= b.x0 and dx <= greatest(110.0::double, (b.x1 - b.x0) * 0.18::double) and ({O.shared_area("b.", "n.")} > 0 or dy <= 28))
    or (n.y1 <= b.y0 and dy <= greatest(72.0::double, (b.y1 - b.y0) * 0.30::double) and least(b.x1, n.x1) > greatest(b.x0, n.x0)))
select doc_id, page_num, note_id, region_id from p where rn = 1""")
def attached_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = I.spans(spark, sf_dir)
    kind = F.when(F.col("span_id") % 4 == 0, "bom-like").otherwise("general")
    return scope.attach_notes(spans.select("doc_id", "page_num", F.col("span_id").alias("region_id"), kind.alias("kind"), F.concat(F.lit("Notes: "), "text").alias("text"), *G.SIDES))


@QUERIES(scan_queries.WORKBOOK_SQL)
def scan_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of a scan report in one table: section, row_index and its columns."""
    from drawloom.operators import report

    spans, pages = I.spans(spark, sf_dir), I.pages(spark, sf_dir)
    sheets = spark.createDataFrame([], "doc_id long, page_num int, sheet_id string")
    tags = cut(scan.dedupe(scan.scan(spans, pages, sheets, mode="all")))  # both sections read it
    shown = tags.select("sheet_id", "page_num", "full_tag", "root", "component", "confidence", "rating", "source_text", "seq")
    parts = {"Scan Results": shown, "Review Queue": shown.filter("rating <> 'High'")}
    return report.flatten_sections(parts, ["page_num", "sheet_id", "full_tag", "seq"])
