"""Queries of model snapshots and page analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawloom.operators import analyze, layout, model, scope
from drawloom.plans import inputs as I
from drawloom.plans.registry import Registry

QUERIES = Registry()
_ELEMENTS = {
    "element_id": "p_partkey", "seq": "p_partkey", "category": "case p_partkey % 4 when 0 then 'Pipe Accessories' when 1 then 'Duct Accessories' when 2 then 'Walls' else 'Generic Models' end",
    "family": "case when p_partkey % 7 = 0 then null when p_partkey % 3 = 0 then p_type || ' Connector ' || p_brand else p_type end", "symbol_id": "p_partkey * 10",
}
_CATEGORIES = ["Pipe Accessories", "Duct Accessories"]
_KEPT = f"select * from {I.derived_sql('part', _ELEMENTS)} where category in ('Pipe Accessories', 'Duct Accessories') and contains(coalesce(family, ''), 'Connector')"


@QUERIES(f"select element_id, family from ({_KEPT})")
def model_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.scan_elements(I.derived(I.table(spark, sf_dir, "part"), _ELEMENTS), _CATEGORIES, "Connector").select("element_id", "family")


@QUERIES(f"select family, count(*) as instances from ({_KEPT}) group by 1")
def family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.family_counts(model.scan_elements(I.derived(I.table(spark, sf_dir, "part"), _ELEMENTS), _CATEGORIES, "Connector"))


_TERMS = ["promo", "brand#1"]
_CACHE = f"""(select family, symbol_id, place, seq from (select *, row_number() over (partition by family order by place, seq) as n from (
  select family, symbol_id, 0 as place, seq from ({_KEPT}) union all select family, symbol_id, 1, seq from {I.derived_sql('part', _ELEMENTS)}
  where contains(lower(family), 'promo') or contains(lower(family), 'brand#1'))) where n = 1 and coalesce(family, '') <> '')"""


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = I.derived(I.table(spark, sf_dir, "part"), _ELEMENTS)
    return model.symbol_cache(model.scan_elements(every, _CATEGORIES, "Connector"), every, _TERMS)


@QUERIES(f"select family, symbol_id, place from {_CACHE}")
def symbol_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache(spark, sf_dir).select("family", "symbol_id", "place")


_NAMES = {"name": "case s_suppkey % 4 when 0 then 'economy' when 1 then 'PROMO connector' when 2 then 'Brand#' || cast(s_nationkey as string) else s_name end"}


@QUERIES(f"""
with c as {_CACHE}, n as (select distinct name from {I.derived_sql("supplier", _NAMES)})
select name, (select arg_min(symbol_id, (lower(family) <> lower(trim(name)), place, seq)) from c where contains(lower(family), lower(trim(name)))) as symbol_id from n""")
def symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.find_symbols(I.derived(I.table(spark, sf_dir, "supplier"), _NAMES), _cache(spark, sf_dir))


_ROWS = {"row": "c_custkey", "type_name": "case c_custkey % 5 when 0 then ' ' when 1 then 'None' when 2 then ' ' || c_mktsegment else c_mktsegment || cast(c_nationkey as string) end"}


@QUERIES(f"""
with t as (select c_mktsegment as type_name, min(c_custkey) as symbol_id from customer group by 1), r as (select row, trim(type_name) as type_name from {I.derived_sql("customer", _ROWS)})
select row, type_name, symbol_id, case when symbol_id is null then 'Row ' || row || ': ''' || type_name || ''' not in project' end as error from r left join t using (type_name) where type_name not in ('', 'None')""")
def symbol_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = I.table(spark, sf_dir, "customer")
    types = customers.groupBy(F.col("c_mktsegment").alias("type_name")).agg(F.min("c_custkey").alias("symbol_id"))
    return model.place_symbols(I.derived(customers, _ROWS), types)


_PARAMETERS = {
    "element_id": "o_custkey % 300", "seq": "o_orderkey", "name": "case o_orderkey % 4 when 0 then ' Tag ' when 1 then 'TAG' when 2 then 'Flow' else 'Count' end",
    "kind": "case o_orderkey % 4 when 2 then 'double' when 3 then 'integer' else 'string' end", "read_only": "o_orderkey % 31 = 0",
    "value": "case o_orderkey % 4 when 2 then cast(o_orderkey % 97 as string) || '.5' when 3 then cast(o_orderkey % 9 as string) else o_orderpriority end",
    "display": "case when o_orderkey % 8 = 2 then cast(o_orderkey % 97 as string) || ' gpm' end",
}
_MAPPED = f"""(select element_id, lower(trim(name)) as name, arg_max(kind, seq) as kind, arg_max(value, seq) as value, arg_max(read_only, seq) as read_only,
  arg_max(case when kind = 'double' then coalesce(nullif(display, ''), value) else value end, seq) as shown from {I.derived_sql("orders", _PARAMETERS)} group by 1, 2)"""


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.parameter_maps(I.derived(I.table(spark, sf_dir, "orders"), _PARAMETERS))


@QUERIES(f"select element_id, string_agg(name || '=' || shown, ';' order by name) as params, coalesce(max(shown) filter (name = 'flow' and trim(shown) <> ''), max(shown) filter (name = 'tag'), '') as shown from {_MAPPED} group by 1")
def parameter_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters by name, and what stands for an element: its flow, else its tag."""
    maps = _maps(spark, sf_dir)
    listed = F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat(e["key"], F.lit("="), e["value"]["display"]))
    shown = model.shown_value(F.col("params"), F.col("params"), F.array(F.lit("Tag")), F.lit(" FLOW "))
    found = maps.withColumn("listed", F.array_join(listed, ";")).withColumn("shown", shown)
    return found.select("element_id", F.col("listed").alias("params"), "shown")


_CELLS = {
    "row_key": "c_custkey", "column": "case c_custkey % 3 when 0 then 'TAG ' when 1 then 'flow' else 'count' end",
    "value": "case c_custkey % 7 when 0 then '-' when 1 then null when 2 then ' 7.9' else c_mktsegment end",
}


@QUERIES(f"""
with m as {_MAPPED}, c as (select row_key, lower(trim("column")) as col, trim(value) as value from {I.derived_sql("customer", _CELLS)} where trim(value) not in ('', '-', 'None', 'null')),
p as (select 'tag' as col, unnest(['Tag', 'Missing']) as param, ['valve'] as families union all select 'flow', 'Flow', ['pump'] union all select 'count', 'Count', []),
i as (select distinct element_id, element_id as row_key, case element_id % 2 when 0 then 'Gate Valve' else 'Fan' end as family from m),
w as (select i.element_id, c.col, p.param, m.kind, m.read_only, c.value from i join c using (row_key) join p using (col) join m on m.element_id = i.element_id and m.name = lower(p.param)
  where len(families) = 0 or len(list_filter(families, lambda f: contains(lower(family), f))) > 0 or exists (select 1 from m x join p q on x.name = lower(q.param) where x.element_id = i.element_id and q.col = c.col))
select element_id, col as "column", param, kind, case kind when 'string' then upper(value) when 'integer' then cast(cast(trunc(try_cast(value as double)) as bigint) as varchar) else value end as value
from w where not read_only and (kind <> 'integer' or try_cast(value as double) is not null)""")
def initial_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = _maps(spark, sf_dir)
    none = F.map_filter("params", lambda k, v: F.lit(False))
    inserted = maps.select("element_id", F.col("element_id").alias("row_key"), F.when(F.col("element_id") % 2 == 0, "Gate Valve").otherwise("Fan").alias("family"), "params", none.alias("type_params"))
    mapping = spark.createDataFrame(
        [("Tag", ["Tag", "Missing"], ["valve"]), ("FLOW", ["Flow"], ["pump"]), ("count", ["Count"], [])], "column string, params array<string>, families array<string>"
    )
    return model.initial_writes(inserted, I.derived(I.table(spark, sf_dir, "customer"), _CELLS), mapping)


_OCR = {
    "doc_id": "0", "page_num": "cast(o_custkey % 40 as int)", "seq": "o_orderkey", "text": "case o_orderkey % 9 when 0 then ' ' when 1 then '  two   words ' else o_orderpriority end",
    "conf": "case o_orderkey % 6 when 0 then '19.5' when 1 then '' when 2 then 'n/a' else cast(o_orderkey % 101 as string) end",
    "left": "o_orderkey % 1600", "top": "o_orderkey % 1000", "width": "o_orderkey % 90", "height": "o_orderkey % 30",
}


@QUERIES(f"""
select doc_id, page_num, seq, "left" * (800.0::double / 1600) as x0, top * (600.0::double / 1200) as y0, "left" * (800.0::double / 1600) + width * (800.0::double / 1600) as x1,
  top * (600.0::double / 1200) + height * (600.0::double / 1200) as y1, trim(regexp_replace(text, '\\s+', ' ', 'g')) as word
from {I.derived_sql("orders", _OCR).replace(" as left", ' as "left"')} where trim(text) <> '' and coalesce(try_cast(trim(conf) as double), 99) >= 20""")
def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = I.derived(I.table(spark, sf_dir, "orders"), _OCR)
    pages = raw.select("doc_id", "page_num").distinct().selectExpr("*", "800d as width", "600d as height", "1600 as px_width", "1200 as px_height")
    return analyze.ocr_words(raw, pages)


_SOURCES = {
    "page_id": "page_id", "native_text": "case when page_id % 3 = 0 then url when page_id % 3 = 1 then '   short   ' else null end",
    "ocr_text": "case when page_id % 4 = 0 then null when page_id % 4 = 1 then '  ' else html end", "ocr_error": "case when page_id % 5 = 0 then 'no engine' end",
}


@QUERIES(f"""
with p as (select *, length(trim(coalesce(native_text, ''))) < 20 as tried, length(trim(coalesce(ocr_text, ''))) > 0 as have from {I.derived_sql("pages", _SOURCES)})
select page_id, case when tried and have then 'ocr' else 'native' end as text_source, tried as ocr_attempted, case when tried and not have and ocr_error is not null then ['OCR unavailable or failed: ' || ocr_error] else [] end as warnings from p""")
def text_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.text_sources(I.derived(I.table(spark, sf_dir, "pages"), _SOURCES)).select("page_id", "text_source", "ocr_attempted", "warnings")


#: One grid a supplier, two to a page, with some lines that cross nothing.
_GRID = {"s": "s_suppkey", "rows": "s_suppkey % 5 + 1", "cols": "s_nationkey % 4 + 1", "left": "cast(s_suppkey % 2 * 500 as double)"}


@QUERIES(f"""
with g as {I.derived_sql("supplier", _GRID).replace(" as left", ' as "left"')}
select 0 as doc_id, (s - s % 2) // 2 as page_num, cast(row_number() over (partition by (s - s % 2) // 2 order by "left") - 1 as int) as table_index, "left" as x0, 0.0::double as y0, "left" + cols * 50 as x1, cast(rows * 20 as double) as y1,
  cast(rows as int) as row_count, cast(cols as int) as col_count from g""")
def ruled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = I.derived(I.table(spark, sf_dir, "supplier"), _GRID)
    page = F.expr("(s - s % 2) div 2").alias("page_num")
    right, low = F.col("left") + F.col("cols") * 50, (F.col("rows") * 20).cast("double")
    line = lambda x0, y0, x1, y1: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    across = F.transform(F.sequence(F.lit(0), F.col("rows")), lambda i: line(F.col("left"), (i * 20).cast("double"), right, (i * 20).cast("double")))
    down = F.transform(F.sequence(F.lit(0), F.col("cols")), lambda i: line(F.col("left") + i * 50, F.lit(0.0), F.col("left") + i * 50, low))
    loose = F.array(line(F.col("left"), F.lit(400.0), right, F.lit(400.0)), line(F.col("left"), F.lit(500.0), F.col("left"), F.lit(600.0)))
    lines = grid.select(F.lit(0).alias("doc_id"), page, F.explode(F.concat(across, down, loose)).alias("l"))
    return analyze.ruled_tables(lines.select("doc_id", "page_num", "l.*"))


#: Tables of words, one a page: a header, up to six rows, and, further down, a line that does not belong to it.
_TABLE = {
    "doc_id": "0", "page_num": "cast((p_partkey - p_partkey % 8) / 8 as int)", "seq": "p_partkey", "r": "p_partkey % 8",
    "word": "case p_partkey % 8 when 0 then 'item' when 7 then 'footer note ' || p_brand else 'dev-' || cast(p_partkey as string) end",
    "qty": "case p_partkey % 8 when 0 then 'qty' else cast(p_size as string) end", "what": "case p_partkey % 8 when 0 then 'model' else p_type || cast(p_size as string) || 'x' end",
}


def _table_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.derived(I.table(spark, sf_dir, "part"), _TABLE)
    top = F.when(F.col("r") == 7, 700.0).otherwise(100.0 + F.col("r") * 14)
    word = lambda i, c, x: F.struct((F.col("seq") * 3 + i).alias("seq"), F.lit(x).alias("x0"), F.lit(x + 50.0).alias("x1"), F.col(c).alias("word"))
    parts = F.array(word(0, "word", 10.0), word(1, "qty", 110.0), word(2, "what", 210.0))
    return rows.select("doc_id", "page_num", top.alias("y0"), (top + 10).alias("y1"), F.explode(parts).alias("w")).select("doc_id", "page_num", "w.seq", "w.x0", "y0", "w.x1", "y1", "w.word")


@QUERIES(f"""
with t as {I.derived_sql("part", _TABLE)}, h as (select page_num, min(r) as first, max(r) filter (r < 7) as last, count(*) filter (r < 7) as n from t group by page_num),
x as (select t.page_num, string_agg(word || ' ' || qty || ' ' || what, chr(10) order by r) as text, list_sort(list(r)) as rs from t where r < 7 group by 1),
k as (select x.*, h.n, {" + ".join(f"cast(contains(lower(x.text), '{w}') as int)" for w in scope.TABLE_TERMS)} as hits from x join h using (page_num) where first = 0 and n >= 2)
select 0 as doc_id, page_num, 0 as table_index, 0 as header_row, cast(n as int) as n_rows, 100.0::double as y0, 100.0::double + (rs[len(rs)]) * 14 + 10 as y1, text, round(least(0.94::double, 0.62::double + 0.04::double * hits + 0.02::double * least(n, 6)), 9) as confidence from k""")
def header_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = layout.row_cells(layout.words_to_rows(_table_words(spark, sf_dir)))
    found = analyze.header_tables(cells)
    return found.select("doc_id", "page_num", "table_index", "header_row", F.size("row_indexes").alias("n_rows"), "y0", "y1", "text", F.round("confidence", 9).alias("confidence"))


def _ruled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words, pages and a ruled table around the words of every second page."""
    words = _table_words(spark, sf_dir)
    pages = words.groupBy("doc_id", "page_num").agg(F.array_join(F.array_sort(F.collect_list("word")), " ").alias("page_text")).selectExpr("*", "1000d as width", "800d as height", "'schedule' as family")
    tables = pages.filter("page_num % 2 = 0").selectExpr("doc_id", "page_num", "0 as table_index", "5d as x0", "95d as y0", "300d as x1", "200d as y1", "6 as row_count", "3 as col_count")
    return words, pages, tables


@QUERIES(f"""
with t as {I.derived_sql("part", _TABLE)}, g as (select page_num, string_agg(word || ' ' || qty || ' ' || what, chr(10) order by r) as text, count(*) as n, min(r) as first from t where r < 7 and page_num % 2 = 0 group by 1),
p as (select page_num, lower(string_agg(word || ' ' || qty || ' ' || what, ' ')) as all_text from t group by 1),
k as (select g.*, {" + ".join(f"cast(contains(lower(g.text), '{w}') as int)" for w in scope.TABLE_TERMS)} as hits from g join p using (page_num) where ({" + ".join(f"cast(contains(all_text, '{w}') as int)" for w in scope.TABLE_TERMS)}) > 0 and length(g.text) >= 10)
select page_num, 'page-' || page_num || '-table-0' as region_id, case when first = 0 and n >= 2 then 'bom-like' else 'table-like' end as kind, cast(n as int) as n_rows, text, round(least(0.98::double, 0.55::double + 0.05::double * 6 + 0.03::double * hits), 9) as confidence from k""")
def table_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, pages, tables = _ruled(spark, sf_dir)
    found = analyze.table_regions(tables, words, pages)
    return found.select("page_num", "region_id", "kind", "n_rows", "text", F.round("confidence", 9).alias("confidence"))


@QUERIES(f"""
with t as {I.derived_sql("part", _TABLE)}, g as (select page_num, count(*) filter (r < 7) as n, min(r) as first, sum(length(word || qty || what)) filter (r < 7) as size from t group by 1)
select page_num, 'native' as text_source, cast(case when page_num % 2 = 0 then (n > 0 and size > 5)::int else (first = 0 and n >= 2)::int end as bigint) as n_regions from g""")
def analyzed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with ruled tables on every second one, tables below a header elsewhere."""
    words, pages, tables = _ruled(spark, sf_dir)
    known = pages.selectExpr("doc_id", "page_num", "width", "height", "family", "page_text || repeat(' .', 20) as native_text", "cast(null as string) as ocr_text", "cast(null as string) as ocr_error")
    found, _ = analyze.analyze_pages(known, words, words.limit(0), tables)
    return found.select("page_num", "text_source", "n_regions")
