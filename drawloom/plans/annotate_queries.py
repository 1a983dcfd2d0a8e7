"""Queries of marks, gates and review order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawloom.functions import geometry as G
from drawloom.operators import annotate
from drawloom.plans import inputs as I
from drawloom.plans import ordered_sql as O
from drawloom.plans.registry import Registry

QUERIES = Registry()
_BOXES = {
    "k": "o_orderkey", "rating": "case o_orderkey % 3 when 0 then 'High' when 1 then 'Medium' else 'Low' end", "change": "case o_orderkey % 4 when 0 then 'added' when 1 then 'removed' when 2 then 'moved' else 'modified' end",
    "x0": "0.0d", "y0": "0.0d", "x1": "cast(o_orderkey % 250 as double)", "y1": "cast(o_custkey % 200 as double)",
}


@QUERIES(f"""
select k, rating <> 'Low' as shown, x1 > 0 and y1 > 0 and not (x1 > 180 and y1 > 35) and not (y1 > 180 and x1 > 35) and x1 <= 220 and y1 <= 180 and x1 * y1 <= 9000 as precise,
  case change when 'added' then '0,188,212,255' when 'removed' then '34,160,90,255' when 'moved' then '230,97,181,255' else '220,50,50,255' end as outline from {I.derived_sql("orders", _BOXES)}""")
def annotation_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.derived(I.table(spark, sf_dir, "orders"), _BOXES)
    return rows.select(
        "k", annotate.passes_rating(F.col("rating")).alias("shown"), annotate.precise(G.box()).alias("precise"), F.array_join(annotate.outline(F.col("change")), ",").alias("outline")
    )


_MARKS = f"""(select doc_id, page_num, span_id as seq, kind, change, span_id % 5 = 0 as has_rows, x0, y0, x1, y1,
  case when share > 0.45 then 'corners' when span_id % 5 = 0 then 'row' when share >= 0.12 or kind = 'title-block-like' then 'corners' else 'outline' end as style,
  case when change = 'added' then [0, 188, 212, 255] else [34, 160, 90, 255] end as outline
  from (select *, case when span_id % 3 = 0 then 'title-block-like' else 'general' end as kind, case when span_id % 2 = 0 then 'added' else 'removed' end as change,
    (x1 - x0) * (y1 - y0) / 800000.0::double as share from {I.SPANS_SQL}))"""


@QUERIES(f"""with recursive {O.kept_boxes(_MARKS, "doc_id, page_num, outline", "seq", 0.92)}
select * exclude (r) from (select *, row_number() over (partition by doc_id, page_num order by seq) as r from kept) where r <= 120""")
def page_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = I.spans(spark, sf_dir).selectExpr(
        "doc_id", "page_num", "span_id as seq", "case when span_id % 3 = 0 then 'title-block-like' else 'general' end as kind",
        "case when span_id % 2 = 0 then 'added' else 'removed' end as change", "span_id % 5 = 0 as has_rows", "x0", "y0", "x1", "y1",
    )
    return annotate.markers(spans, I.WIDTH, I.HEIGHT)


_GATE = {"k": "s_suppkey", "n_words": "s_suppkey * 97 % 2500", "text": "case s_suppkey % 4 when 0 then 'item qty description material bill' when 1 then 'notes' when 2 then 'unit size' else 'model vendor' end",
         "family": "case when s_suppkey % 5 = 0 then 'schedule' end", "area": "cast(s_suppkey % 3 * 700000 as double)"}


@QUERIES(f"""
with s as (select *, case k % 4 when 0 then 5 when 1 then 0 when 2 then 2 else 2 end as hints, case k % 4 when 0 then 5 when 3 then 2 else 0 end as strong from {I.derived_sql("supplier", _GATE)})
select k, hints > 0 and case when coalesce(family, '') = 'schedule' then true when area >= 1200000 then strong >= 4 and n_words <= 1200 else not (n_words > 1800 and strong < 3) end as searched from s""")
def table_search_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.derived(I.table(spark, sf_dir, "supplier"), _GATE)
    gate = annotate.table_gate(F.col("n_words"), F.col("text"), F.col("family"), F.col("area"))
    return rows.select("k", gate.alias("searched"))


_DOCS = {"sheet_id": "'DT' || lpad(cast(s_suppkey as string), 4, '0')", "title": "s_name", "status": "case s_suppkey % 4 when 0 then 'changed' when 1 then 'added' when 2 then 'unchanged' else 'review_needed' end"}


@QUERIES(f"""
select row_number() over (order by status <> 'changed', sheet_id, title, status) as position, sheet_id, title, status from {I.derived_sql("supplier", _DOCS)} where status <> 'unchanged'""")
def review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.review_order(I.derived(I.table(spark, sf_dir, "supplier"), _DOCS))
