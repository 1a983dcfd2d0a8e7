"""Queries of matrix synchronisation, placement and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawloom.operators import placement, report, sync
from drawloom.plans import inputs as I
from drawloom.plans.registry import Registry

QUERIES = Registry()
_SERVICE = "case " + " ".join(f"when contains(lower(p_type || ' ' || p_name), '{s.lower()}') then '{s}'" for s in sync.SERVICES) + " else 'Other' end"


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "part").withColumn("what", F.concat_ws(" ", "p_type", "p_name"))


@QUERIES(f"""
with g as (select {_SERVICE} as g, contains(lower(p_brand), '1') as ok from part), h as (select case when ok then g else 'Other' end as "group", count(*) as n from g group by 1)
select "group", n, row_number() over (order by "group" = 'Other', "group") - 1 as output_index from h""")
def group_filter_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = sync.group_rows(_matrix(spark, sf_dir), "what", filters=[("P_Brand", ["1"])])
    return sync.group_log(grouped).select("group", "n", F.col("output_index").cast("long").alias("output_index"))


_KEEP = {"k": "p_partkey", "a": "case when p_partkey % 3 = 0 then null else p_brand end", "b": "case when p_partkey % 2 = 0 then null else p_size end", "c": "p_name"}


@QUERIES(f"select k from {I.derived_sql('part', _KEEP)} where a is not null or b is not null")
def matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.keep_mapped_rows(I.derived(I.table(spark, sf_dir, "part"), _KEEP), ["A ", "B", "missing"]).select("k")


_MAPPING = {
    "col": "'col' || cast(p_size as string)", "params": "p_brand || ', ' || p_brand || ',x' || cast(p_partkey % 2 as string)",
    "f1": "case when p_partkey % 3 = 0 then 'Yes' else 'No' end", "f2": "case when p_partkey % 5 = 0 then ' yes ' else null end", "f3": "case when p_partkey % 400 = 0 then 'YES' end",
}


@QUERIES(f"""
with m as {I.derived_sql("part", _MAPPING)}, l as (select col, params, unnest([{{'f': 'f1', 'm': f1}}, {{'f': 'f2', 'm': f2}}, {{'f': 'f3', 'm': f3}}]) as x from m),
y as (select col, params, x.f as f from l where lower(trim(x.m)) = 'yes'), p as (select col, unnest(list_transform(string_split(params, ','), lambda s: trim(s))) as p from y where true)
select y.col as "column", array_to_string(list(distinct f order by f), ',') as families, (select array_to_string(list(distinct p order by p), ',') from p where p.col = y.col) as params from y group by y.col""")
def mapping_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sync.unpivot_mapping(I.derived(I.table(spark, sf_dir, "part"), _MAPPING), "col", "params", ["f1", "f2", "f3"])
    return found.select("column", F.array_join("families", ",").alias("families"), F.array_join(F.array_sort("params"), ",").alias("params"))


_REQUIRED = {
    "equipment_id": "' eq' || cast(o_custkey as string)", "seq": "o_orderkey",
    "connection_id": "case o_orderkey % 9 when 0 then '-' when 1 then 'None' when 2 then null when 3 then ' ca-' || cast(o_orderkey as string) else 'EL-' || cast(o_orderkey as string) end",
}
_ELEMENTS = {
    "element_id": "o_orderkey * 10 + 1", "equipment_id": "'EQ' || cast(o_custkey as string)", "seq": "o_orderkey",
    "connection_id": "case o_orderkey % 7 when 0 then 'none' when 1 then 'CA-' || cast(o_orderkey as string) when 2 then '' else 'el-' || cast(o_orderkey - o_orderkey % 2 as string) end",
}


@QUERIES(f"""
with r as (select upper(trim(equipment_id)) as e, upper(trim(connection_id)) as c, seq from {I.derived_sql("orders", _REQUIRED)} where trim(coalesce(connection_id, '')) not in ('-', 'None', '', 'null')),
m as (select upper(trim(equipment_id)) as e, upper(trim(coalesce(connection_id, ''))) as c, element_id, seq from {I.derived_sql("orders", _ELEMENTS)}),
k as (select *, case when c not in ('-', 'NONE', '', 'NULL') and row_number() over (partition by e, c order by seq desc) = 1 then c end as mk from m)
select coalesce(r.e, k.e) as equipment, coalesce(r.c, k.mk) as connection, coalesce(r.seq, -1) as row_seq, coalesce(element_id, -1) as element_id,
  case when r.seq is null then 'rogue' when element_id is null then 'insert' else 'match' end as action from r full join k on r.e = k.e and r.c = k.mk""")
def upsert_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = I.table(spark, sf_dir, "orders")
    found = sync.upsert_plan(I.derived(orders, _REQUIRED), I.derived(orders, _ELEMENTS))
    ids = [F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("row_seq", "element_id")]
    return found.select("equipment", "connection", *ids, "action")




@QUERIES("""
with l as (select l_orderkey as o, l_extendedprice as price, cast(l_orderkey % 5 as double) as len, cast(l_orderkey % 3 as double) as wid, l_partkey, l_suppkey, l_linenumber, l_quantity from lineitem),
s as (select *, count(*) over (partition by o) as n, row_number() over (partition by o order by l_linenumber, l_partkey, l_suppkey, l_quantity, price) - 1 as i from l),
d as (select *, greatest(0.333, greatest(len, wid) / (n + 1)) as spacing from s)
select o, i as slot, round(spacing, 6) as spacing, round(-((n - 1) * spacing) / 2.0 + i * spacing, 6) as step_offset from d""")
def even_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = I.table(spark, sf_dir, "lineitem").withColumn("len", (F.col("l_orderkey") % 5).cast("double")).withColumn("wid", (F.col("l_orderkey") % 3).cast("double"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    spaced = sync.even_spacing(rows, ["l_orderkey"], order, "len", "wid")
    slot = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("step_offset")) - 1
    return spaced.select(
        F.col("l_orderkey").alias("o"), slot.cast("long").alias("slot"), F.round("spacing", 6).alias("spacing"), F.round("step_offset", 6).alias("step_offset")
    )


@QUERIES("""
with r as (select p_partkey, row_number() over (order by p_partkey) - 1 as i from part)
select p_partkey, i as "index", cast(i // 13 as int) as grid_row, cast(i % 13 as int) as grid_col, cast(i % 13 as double) as x, -(i // 13) * 0.75::double as y from r""")
def grid_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = placement.grid_layout(I.table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"])
    return found.select("p_partkey", "index", "grid_row", "grid_col", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


@QUERIES("""
with r as (select s_suppkey, row_number() over (order by s_suppkey) - 1 as i, count(*) over () as n from supplier)
select s_suppkey, cast(case when i < 15 then 0 else least(1 + (i - 15) // 17, 3) end as int) as line, cast(case when i < 15 then i else (i - 15) % 17 end as int) as slot,
  case when n <= 15 then 'bus-15' when n <= 32 then 'bus-32' when n <= 49 then 'bus-49' else 'bus-66' end as bus from r""")
def bus_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = placement.running_index(I.table(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"])
    n = suppliers.agg(F.count(F.lit(1)).alias("n"))
    placed = suppliers.join(F.broadcast(n)).withColumn("p", placement.bus_slot(F.col("index")))
    return placed.select("s_suppkey", "p.line", "p.slot", placement.bus_size(F.col("n")).alias("bus"))


@QUERIES("select n_nationkey, coalesce(n_name, '') as title, cast(n_regionkey as varchar) as area from nation")
def first_source_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = I.table(spark, sf_dir, "nation")
    mapping = [("title_1", "title"), ("n_name", "title"), ("n_comment", "title"), ("n_regionkey", "area"), ("n_nationkey", "area")]
    chosen = placement.first_source(mapping, nation.columns)
    return nation.select("n_nationkey", *[F.coalesce(F.col(s).cast("string"), F.lit("")).alias(t) for t, s in chosen.items()])


@QUERIES("""
select l_returnflag as flag, l_linenumber % 3 as kind, count(*) as n, count(*) filter (case
  when l_partkey % 2 = 1 then false when l_linenumber % 3 = 2 then false else true end) as same from lineitem group by 1, 2""")
def tolerant_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "double").when(F.col("l_linenumber") % 3 == 1, "integer").otherwise("string")
    stored = F.col("l_quantity").cast("string")
    wanted = F.when(F.col("l_partkey") % 2 == 0, F.col("l_quantity").cast("int").cast("string")).otherwise(F.col("l_returnflag"))
    same = sync.same_value(kind, stored, stored, wanted)
    return rows.groupBy(F.col("l_returnflag").alias("flag"), (F.col("l_linenumber") % 3).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("same"))


@QUERIES("""
with d as (select event_id, value / 100000 as dx, cast(event_id % 3 as double) / 1000 as dy, case when event_id % 10 = 0 then null else 0.0 end as dz from events)
select event_id, case when dx is null or dz is null then 'N/A' when sqrt(dx * dx + dy * dy + dz * dz) > 0.0026 then 'Moved' else 'No Change' end as status from d""")
def move_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "events")
    dz = F.when(F.col("event_id") % 10 == 0, F.lit(None).cast("double")).otherwise(0.0)
    status = sync.move_status(F.col("value") / 100000, (F.col("event_id") % 3).cast("double") / 1000, dz)
    return e.select("event_id", status.alias("status"))


_PARAM_SQL = """
with m as (select c_custkey, lower(trim(c_name)) as k, c_mktsegment, cast(c_nationkey as varchar) as nat from customer),
e as (select o_custkey, o_orderkey, o_orderpriority, row_number() over (partition by o_custkey order by o_orderkey desc) as rn from orders),
x as (select m.c_custkey, e.o_orderkey as element_id, unnest([{'c': 'c_mktsegment', 'p': 'Segment', 'a': c_mktsegment}, {'c': 'c_nationkey', 'p': 'Nation', 'a': nat}]) as v, e.o_custkey
  from m left join e on m.c_custkey = e.o_custkey and rn = 1)
select c_custkey as row_key, coalesce(element_id, -1) as element_id, v.c as "column", v.p as param,
  case when element_id is null then null when v.p = 'Nation' then cast(o_custkey % 25 as varchar) when element_id % 2 = 0 then lower(v.a) else 'other' end as before, v.a as after
from x where element_id is null or (v.p = 'Nation' and cast(o_custkey % 25 as varchar) <> v.a) or (v.p = 'Segment' and element_id % 2 = 1)"""


@QUERIES(_PARAM_SQL)
def parameter_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = I.table(spark, sf_dir, "customer"), I.table(spark, sf_dir, "orders")
    segment = customers.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    held = F.when(F.col("o_orderkey") % 2 == 0, F.lower("c_mktsegment")).otherwise("other")
    elements = orders.join(segment, "o_custkey").select(
        F.col("o_orderkey").alias("element_id"), F.col("o_custkey").cast("string").alias("equipment_id"), F.lit("Pump").alias("family"),
        F.create_map(F.lit("Segment"), held, F.lit("Nation"), (F.col("o_custkey") % 25).cast("string")).alias("params"), F.col("o_orderkey").alias("seq"),
    )
    mapping = spark.createDataFrame(
        [("c_mktsegment", ["Segment"], ["Pump"]), ("c_nationkey", ["Nation"], [])], "column string, params array<string>, families array<string>"
    )
    found = sync.parameter_changes(customers, "c_custkey", elements, mapping, ["c_mktsegment", "c_nationkey"])
    return found.withColumn("element_id", F.coalesce("element_id", F.lit(-1)).cast("long"))


@QUERIES("""
with c as (select p_partkey, unnest([{'f': 'brand', 'o': p_brand, 'u': upper(p_brand)}, {'f': 'name', 'o': p_name, 'u': replace(p_name, 'a', 'A')}]) as x from part)
select x.f as field, count(*) as total, count(*) filter (x.o <> x.u) as changed from c group by 1""")
def comparison_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = I.table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_brand as `Original: brand`", "upper(p_brand) as `Updated: brand`", "p_name as `Original: name`", "replace(p_name, 'a', 'A') as `Updated: name`"
    )
    pairs = sync.comparison_pairs(part, "p_partkey")
    return pairs.groupBy("field").agg(F.count(F.lit(1)).alias("total"), F.count_if("changed").alias("changed"))


@QUERIES("""
with w as (select n_nationkey as id, case n_nationkey % 4 when 0 then 'CABLE' when 1 then 'cb trip' when 2 then 'FUSE' else 'NOTES' end as name, case when n_nationkey % 5 = 0 then 'None' else n_name end as value from nation)
select id, name, value, case when lower(trim(value)) in ('', 'none') then 'skip' when name = 'CABLE' then 'OK' when name = 'cb trip' then 'OK-fuzzy' else 'FAIL' end as status from w""")
def parameter_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = I.table(spark, sf_dir, "nation")
    name = "case n_nationkey % 4 when 0 then 'CABLE' when 1 then 'cb trip' when 2 then 'FUSE' else 'NOTES' end as name"
    wanted = nation.selectExpr("n_nationkey as id", name, "case when n_nationkey % 5 = 0 then 'None' else n_name end as value")
    have = nation.selectExpr("n_nationkey as id", "explode(array('CABLE', 'CBTRIP', 'FAMILY')) as param")
    return placement.parameter_status(wanted, have)


@QUERIES("""
select s_suppkey from supplier where s_suppkey % 4 > 0 and s_suppkey % 3 > 0""")
def placeable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey", "case s_suppkey % 4 when 0 then ' None ' else s_name end as family", "case s_suppkey % 3 when 0 then 'MCC Bus' else 'FVNR' end as kind"
    )
    return placement.placeable(rows, "family", "kind").select("s_suppkey")


_DOCS = {"pair_id": "o_orderkey", "status": "case o_orderstatus when 'O' then 'changed' when 'F' then 'unchanged' else case when o_orderkey % 2 = 0 then 'added' else 'review_needed' end end", "family": "o_orderpriority"}
_DOC_SQL = I.derived_sql("orders", _DOCS)


@QUERIES(f"""
select case status when 'review_needed' then 'review' else status end as section, row_number() over (partition by status order by pair_id) - 1 as row_index, pair_id, status, family from {_DOC_SQL}""")
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = report.sections(I.derived(I.table(spark, sf_dir, "orders"), _DOCS))
    flat = report.flatten_sections(parts, ["pair_id"])
    return flat.select("section", F.col("row_index").cast("long").alias("row_index"), "pair_id", "status", "family")


@QUERIES(f"""
select count(*) as documents, count(*) filter (status = 'changed') as changed, count(*) filter (status = 'added') as added, count(*) filter (status = 'review_needed') as review_needed from {_DOC_SQL}""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.run_summary(I.derived(I.table(spark, sf_dir, "orders"), _DOCS), ("changed", "added", "review_needed"))


_FEEDBACK = {"id": "cast(conv_id as string) || '-' || cast(turn as string)", "timestamp": "lpad(cast(turn as string), 3, '0')", "source": "case role when 'user' then ' Scan ' when 'assistant' then 'COMPARE' else role end",
             "category": "case turn % 3 when 0 then 'Error' when 1 then 'idea' else 'misc' end", "message": "text"}


@QUERIES(f"""
select id, timestamp, case lower(trim(source)) when 'scan' then 'scanner' when 'compare' then 'comparator' else 'portal' end as source,
  case category when 'Error' then 'bug' when 'idea' then 'feature' else 'general' end as category from {I.derived_sql("conversations", _FEEDBACK)}""")
def feedback_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.derived(I.table(spark, sf_dir, "conversations"), _FEEDBACK)
    return report.latest_feedback(rows).select("id", "timestamp", "source", "category")


@QUERIES("""
select event_id, '{"a":"' || event_type || '","b":"' || cast(user_id as varchar) || '"}' as json from events""")
def sorted_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from drawloom.functions import text as T

    packed = F.create_map(F.lit("b"), F.col("user_id").cast("string"), F.lit("a"), F.col("event_type"))
    return I.table(spark, sf_dir, "events").select("event_id", T.sorted_json(packed).alias("json"))
