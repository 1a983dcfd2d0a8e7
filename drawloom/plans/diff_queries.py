"""Queries of pairing, alignment and revision differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawloom.functions import tags as N
from drawloom.functions import text as T
from drawloom.functions.similarity import sequence_ratio as ratio
from drawloom.operators import assign, diff, layout, pairing, placement
from drawloom.plans import inputs as I
from drawloom.plans import ordered_sql as O
from drawloom.plans.inputs import derived_sql
from drawloom.plans.registry import Registry

QUERIES = Registry()
REVISED = "case when {0} is null then null when regexp_matches(trim({0}), '^[0-9]+$') then cast(trim({0}) as double) when regexp_matches(lower(trim({0})), '^[a-z]$') then cast(ascii(lower(trim({0}))) - 96 as double) end"
_STATUS = f"""case when b_revision <> '' and a_revision <> '' and lower(b_revision) = lower(a_revision) then 'same_revision'
  when {REVISED.format("a_revision")} > {REVISED.format("b_revision")} then 'revised' when {REVISED.format("a_revision")} < {REVISED.format("b_revision")} then 'revision_regressed'
  when {REVISED.format("a_revision")} = {REVISED.format("b_revision")} then 'same_revision'
  when coalesce(b_revision, '') <> '' or coalesce(a_revision, '') <> '' then 'revision_unknown' else 'no_revision' end"""
_BEFORE = f"(select * from {derived_sql('orders', I.SHEETS_BEFORE)} where kept)"
_AFTER = f"(select * from {derived_sql('orders', I.SHEETS_AFTER)} where kept)"


@QUERIES(f"""
with b as (select *, count(*) over (partition by sheet_id) as n, row_number() over (partition by sheet_id order by seq) as nth from {_BEFORE} where not failed and sheet_id is not null),
a as (select *, count(*) over (partition by sheet_id) as n, row_number() over (partition by sheet_id order by seq) as nth from {_AFTER} where not failed and sheet_id is not null),
j as (select coalesce(b.sheet_id, a.sheet_id) as sheet_id, b.path as before_path, a.path as after_path, b.revision as b_revision, a.revision as a_revision,
  b.family as b_family, a.family as a_family, coalesce(max(b.n) over (partition by coalesce(b.sheet_id, a.sheet_id)), 0) as nb,
  coalesce(max(a.n) over (partition by coalesce(b.sheet_id, a.sheet_id)), 0) as na
  from b full join a on b.sheet_id = a.sheet_id and b.nth = a.nth),
s as (select *, {_STATUS} as rev from j)
select case when nb = 1 and na = 1 then case when rev = 'revision_regressed' then 'review_needed' else 'matched' end when nb = 0 and na = 1 then 'added'
  when nb = 1 and na = 0 then 'removed' else 'review_needed' end as status, before_path, after_path, sheet_id, coalesce(a_family, b_family) as family,
  case when nb = 1 and na = 1 then rev when nb = 0 and na = 1 then 'added' when nb = 1 and na = 0 then 'removed' else 'review_needed' end as revision_status from s
union all select 'review_needed', path, null, case when failed then sheet_id end, family, 'review_needed' from {_BEFORE} where failed or sheet_id is null
union all select 'review_needed', null, path, case when failed then sheet_id end, family, 'review_needed' from {_AFTER} where failed or sheet_id is null""")
def sheet_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = I.table(spark, sf_dir, "orders")
    before = I.derived(orders, I.SHEETS_BEFORE).filter("kept")
    after = I.derived(orders, I.SHEETS_AFTER).filter("kept")
    found = pairing.pair_by_sheet(before, after)
    return found.select("status", "before_path", "after_path", "sheet_id", "family", "revision_status")


_REV = {"k": "o_orderkey", "b_revision": I.SHEETS_BEFORE["revision"], "a_revision": I.SHEETS_AFTER["revision"]}


@QUERIES(f"select k, {_STATUS} as status from {derived_sql('orders', _REV)}")
def revision_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.derived(I.table(spark, sf_dir, "orders"), _REV)
    return rows.select("k", N.revision_status(F.col("b_revision"), F.col("a_revision")).alias("status"))


_DIRECTION = {
    "k": "event_id", "br": "case event_id % 3 when 0 then 'A' when 1 then '2' else null end", "ar": "case event_id % 4 when 0 then 'B' when 1 then '1' else null end",
    "bv": "case when event_id % 5 > 1 then cast(event_id % 6 as int) end", "av": "case when event_id % 7 > 1 then cast(event_id % 4 as int) end",
    "bm": "cast(event_id % 9000 as double)", "am": "cast(user_id * 50 % 9000 as double)",
}


@QUERIES(f"""
with r as (select *, {REVISED.format("br")} as x, {REVISED.format("ar")} as y from {derived_sql("events", _DIRECTION)})
select k, case when x <> y then case when x < y then -1 else 1 end when bv <> av then case when bv < av then -1 else 1 end
  when abs(bm - am) > 3600 then case when bm < am then -1 else 1 end else 0 end as earlier,
  case when x <> y then 'revision-order' when bv <> av then 'version-order' when abs(bm - am) > 3600 then 'modified-time' else '' end as method from r""")
def direction_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.derived(I.table(spark, sf_dir, "events"), _DIRECTION)
    none = F.array().cast("array<string>")
    side = lambda s: {"revision": F.col(f"{s}r"), "version": F.col(f"{s}v"), "dates": none, "modified_at": F.col(f"{s}m")}
    found = rows.withColumn("d", N.direction(side("b"), side("a")))
    return found.select("k", F.coalesce("d.order", F.lit(0)).alias("earlier"), F.coalesce("d.method", F.lit("")).alias("method"))


_FAMILY = {
    "k": "o_orderkey", "sheet_id": "case when o_orderkey % 13 = 0 then null else 'DT' || lpad(cast(o_orderkey % 8000 as string), 4, '0') end",
    "title": "case o_orderkey % 9 when 0 then 'Switch Schedules' when 1 then 'MDF Schedule' when 2 then 'IDF detail' when 3 then 'fiber-schedules 2' else o_orderpriority end",
}


@QUERIES(f"""
with s as (select k, upper(title) as t, cast(substr(sheet_id, 3) as int) as n from {derived_sql("orders", _FAMILY)})
select k, case when contains(t, 'SWITCH-SCHEDULES') or contains(t, 'SWITCH SCHEDULES') then 'switch_schedule'
  when contains(t, 'FIBER-SCHEDULES') or contains(t, 'FIBER SCHEDULES') then 'fiber_schedule'
  when (contains(t, 'MDF') or contains(t, 'IDF')) and contains(t, 'SCHEDULE') then 'schedule'
  when (contains(t, 'MDF') or contains(t, 'IDF')) and (contains(t, 'LAYOUT') or contains(t, 'DETAIL')) then 'mdf_idf_layout'
  when n is null then 'unknown' when n < 1000 then 'general_notes' when n < 2000 then 'overall_plan' when n between 4000 and 4999 then 'area_plan'
  when n between 5000 and 5999 then 'detail' when n in (6001, 6002) or n between 6101 and 6109 then 'schedule' when n between 6000 and 6999 then 'mdf_idf_layout'
  else 'unknown' end as family from s""")
def sheet_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.derived(I.table(spark, sf_dir, "orders"), _FAMILY)
    return rows.select("k", N.sheet_family(F.col("sheet_id"), F.col("title")).alias("family"))


_STEM = {
    "k": "o_orderkey",
    "stem": "'DT' || lpad(cast(o_orderkey % 9000 as string), 4, '0') || '-Floor_plan ' || lower(o_orderpriority) || case o_orderkey % 4 when 0 then ' rev B ' when 1 then '_v3_' when 2 then ' 2024-0' || cast(1 + o_orderkey % 9 as string) || '-15 ' else ' 3-5-24 ' end || 'final'",
}


@QUERIES(f"""
select k, case k % 4 when 2 then '2024-0' || (1 + k % 9) || '-15' when 3 then '2024-03-05' else '' end as hints,
  case k % 4 when 0 then 'B' else '' end as revision, case k % 4 when 1 then '3' else '' end as version from {derived_sql("orders", _STEM)}""")
def date_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.derived(I.table(spark, sf_dir, "orders"), _STEM)
    stem = F.col("stem")
    return rows.select(
        "k", F.array_join(T.date_hints(stem), ",").alias("hints"), F.regexp_extract(stem, T.REVISION, 1).alias("revision"), F.regexp_extract(stem, T.VERSION, 1).alias("version")
    )


@QUERIES(f"""
with s as (select k, lower(stem) as s from {derived_sql("orders", _STEM)}),
t as (select k, list_filter(regexp_extract_all(s, '[a-z0-9]+'), lambda x: x not in {I.listed(tuple(T.NOISE_TOKENS))}) as tokens from s)
select k, array_to_string(tokens, ' ') as tokens, upper(substr(tokens[1], 1, 6)) as sheet_id from t""")
def file_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.derived(I.table(spark, sf_dir, "orders"), _STEM)
    return rows.select("k", F.array_join(T.tokenize(F.col("stem")), " ").alias("tokens"), T.sheet_id_in(F.translate("stem", "-_", "  ")).alias("sheet_id"))


@QUERIES("""
with p as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) between 4 and 120) as l from documents),
u as (select doc_id, generate_subscripts(l, 1) as i, unnest(l) as line from p), f as (select doc_id, line, min(i) as i from u group by doc_id, line),
r as (select *, row_number() over (partition by doc_id order by i) as n from f)
select d.doc_id, coalesce(string_agg(line, chr(10) order by n) filter (n <= 6), '') as preview from documents d left join r on d.doc_id = r.doc_id group by d.doc_id""")
def preview_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.preview_lines(F.col("text")), "\n").alias("preview"))


_ORDERS_A = "select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderstatus <> 'P'"
_ORDERS_B = "select o_orderkey, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as o_orderstatus, case when o_orderkey % 11 = 0 then null else o_orderpriority end as o_orderpriority from orders where o_orderpriority <> '1-URGENT'"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = I.table(spark, sf_dir, "orders")
    before = orders.filter("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    after = orders.filter("o_orderpriority <> '1-URGENT'").selectExpr(
        "o_orderkey", "case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as o_orderstatus",
        "case when o_orderkey % 11 = 0 then null else o_orderpriority end as o_orderpriority",
    )
    return before, after


@QUERIES(f"""
with b as ({_ORDERS_A}), a as ({_ORDERS_B}) select coalesce(b.o_orderkey, a.o_orderkey) as o_orderkey,
  case when b.o_orderkey is null then 'added' when a.o_orderkey is null then 'removed' when b.o_orderstatus is not distinct from a.o_orderstatus
  and b.o_orderpriority is not distinct from a.o_orderpriority then 'unchanged' else 'modified' end as change from b full join a on b.o_orderkey = a.o_orderkey""")
def row_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diff.snapshot_diff(*_snapshots(spark, sf_dir), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])
    return found.select("o_orderkey", "change")


@QUERIES(f"""
with b as ({_ORDERS_A}), a as ({_ORDERS_B}), j as (select b.o_orderkey, unnest([{{'f': 'o_orderstatus', 'b': b.o_orderstatus, 'a': a.o_orderstatus}},
  {{'f': 'o_orderpriority', 'b': b.o_orderpriority, 'a': a.o_orderpriority}}]) as x from b join a on b.o_orderkey = a.o_orderkey)
select o_orderkey, x.f as field, x.b as before, x.a as after from j where x.b is distinct from x.a""")
def cell_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.cell_diff(*_snapshots(spark, sf_dir), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@QUERIES("""
with h as (select p_partkey, substr(md5(p_name), 1, 16) as h, substr(md5(p_brand), 1, 16) as g from part)
select p_partkey, 1 - (bit_count(xor(('0x' || substr(h, 1, 8))::bigint, ('0x' || substr(g, 1, 8))::bigint))
  + bit_count(xor(('0x' || substr(h, 9, 8))::bigint, ('0x' || substr(g, 9, 8))::bigint))) / 64.0::double as similarity from h""")
def hash_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = lambda c: F.substring(F.md5(c), 1, 16)
    return I.table(spark, sf_dir, "part").select("p_partkey", T.hamming_similarity(hashed("p_name"), hashed("p_brand")).alias("similarity"))


@QUERIES("""
with t as (select p_partkey, string_split(p_name, ' ') as a, string_split(p_type, ' ') as b, string_split(p_name || ' ' || p_type, ' ') as c from part)
select p_partkey, len(list_intersect(a, c)) / len(list_distinct(list_concat(a, c)))::double as jaccard from t""")
def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, c = F.split("p_name", " "), F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    return I.table(spark, sf_dir, "part").select("p_partkey", T.jaccard(a, c).alias("jaccard"))


@QUERIES("""
select vec_id, list_transform([1, 33], lambda s: list_reduce(list_transform(range(32), lambda i: cast(case when embedding[s + i] >= list_avg(embedding::double[]) then 1 else 0 end as bigint) << (31 - i)), lambda x, y: x + y)) as halves from embeddings""")
def average_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rasters = I.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("grey"))
    found = layout.average_hash(rasters)
    half = lambda at: F.conv(F.substring("fingerprint", at, 8), 16, 10).cast("bigint")
    return found.select(F.col("id").alias("vec_id"), F.array(half(1), half(9)).alias("halves"))


def _records(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """File records of one revision, named after suppliers."""
    rows = I.table(spark, sf_dir, "supplier")
    mark = "' rev A'" if side == "before" else "' rev B'"
    files = rows.selectExpr(f"concat('{side}/', s_name, {mark}, ' area ', cast(s_nationkey as string), '.pdf') as path", "cast(s_suppkey as double) as modified_at", "s_acctbal")
    files = files.filter("s_acctbal > 0" if side == "before" else "s_acctbal < 9000")
    found = pairing.file_records(files)
    return found.select(
        "*", (F.col("seq") % 3 + 1).alias("page_count"), F.lit(800.0).alias("width"), F.lit(600.0).alias("height"), F.lit(False).alias("failed"),
        F.substring(F.md5("normalized_stem"), 1, 16).alias("fingerprint"), F.col("title_hint").alias("preview"),
    )


def _files_sql(side: str, mark: str, kept: str) -> str:
    path = f"'{side}/' || s_name || ' rev {mark} area ' || s_nationkey || '.pdf'"
    return f"""(select row_number() over (order by path) as seq, path, stem, substr(md5(stem), 1, 16) as hash, row_number() over (order by path) % 3 + 1 as pages,
  list_filter(regexp_extract_all(lower(stem), '[a-z0-9]+'), lambda t: t not in {I.listed(tuple(T.NOISE_TOKENS))}) as title_tokens, list_append(list_filter(regexp_extract_all(lower(stem), '[a-z0-9]+'), lambda t: t not in {I.listed(tuple(T.NOISE_TOKENS))}), '{mark.lower()}') as tokens
  from (select {path} as path, s_name || ' area ' || s_nationkey as stem from supplier where {kept}))"""


_JACCARD = "len(list_intersect(b.{0}, a.{0})) / greatest(len(list_distinct(list_concat(b.{0}, a.{0}))), 1)::double".format
_HALF = "bit_count(xor(('0x' || substr(b.hash, {0}, 8))::bigint, ('0x' || substr(a.hash, {0}, 8))::bigint))".format


def _scored_sql(ties: str) -> str:
    """CTEs of the scored candidates ``c``, the ``taken`` ones and their decision ``d``; ``ties`` orders equal scores."""
    return f"""
with recursive b as {_files_sql("before", "A", "s_acctbal > 0")}, a as {_files_sql("after", "B", "s_acctbal < 9000")},
p as (select b.stem as x, a.stem as y from b, a union select lower(b.stem), lower(a.stem) from b, a),{O.ratios("p")},
f as (select b.seq as b_seq, a.seq as a_seq, b.path as before_path, a.path as after_path, r.ratio as stem, t.ratio as title, b.pages = a.pages as paged, abs(b.pages - a.pages) as apart,
  greatest({_JACCARD("tokens")}, {_JACCARD("title_tokens")}) as tokens, {_JACCARD("tokens")} as names, 1 - ({_HALF(1)} + {_HALF(9)}) / 64::double as hashes
  from b join ratios r on r.x = b.stem join a on r.y = a.stem join ratios t on t.x = lower(b.stem) and t.y = lower(a.stem)),
c as (select *, case when stem > 0.98 then 0.40::double else stem * 0.25::double end + tokens * 0.20::double + title * 0.10::double + case when paged then 0.10::double else greatest(0.0::double, 0.1::double - apart * 0.03::double) end
  + 1.0::double * 0.05::double + hashes * 0.10::double + title * 0.05::double + 0.05::double as score from f where names > 0 or stem > 0.45 or hashes > 0.60),{O.greedy("c", "b_seq", "a_seq", "score desc, " + ties)},
nb as (select b_seq, list(score order by score desc)[2] as next_b from c group by b_seq), na as (select a_seq, list(score order by score desc)[2] as next_a from c group by a_seq),
d as (select *, greatest(0.0::double, least(score, 1.0::double)) as confidence, score < 0.56 as low, greatest(coalesce(next_b, 0.0), coalesce(next_a, 0.0)) as second
  from taken join nb using (b_seq) join na using (a_seq)),
e as (select *, second > 0 and score - second < 0.08 as close from d)"""


_DECIDED = "case when low or close then 'review_needed' else 'matched' end as status, confidence, case when low then 'low-confidence' when close then 'ambiguous-match' else '{0}' end as pairing_method, before_path, after_path".format


@QUERIES(f"""{_scored_sql("b_seq, a_seq")}
select {_DECIDED("scored-match")}, list_filter([case when stem > 0.98 then 'normalized stem exact/near-exact' end, case when tokens > 0.5 then 'filename/title token overlap' end, case when paged then 'page count match' end,
  'page size match', case when hashes > 0.75 then 'first-page fingerprint similarity' end, 'revision clues present',
  case when low then 'confidence below auto-pair threshold' when close then 'competing candidate too close' end], lambda x: x is not null) as reasons from e
union all select 'removed', 1.0, 'unmatched-before', path, null, ['file only found in the before folder'] from b where seq not in (select b_seq from e)
union all select 'added', 1.0, 'unmatched-after', null, path, ['file only found in the after folder'] from a where seq not in (select a_seq from e)""")
def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairing.pair_scored(_records(spark, sf_dir, "before"), _records(spark, sf_dir, "after"))
    return found.select("status", "confidence", "pairing_method", "before_path", "after_path", "reasons")


@QUERIES(f"""{_scored_sql("a_seq, b_seq")}
select {_DECIDED("mixed-revision-order")} from e union all select 'review_needed', 0.0, 'mixed-unpaired', path, null from b where seq not in (select b_seq from e)
union all select 'review_needed', 0.0, 'mixed-unpaired', path, null from a where seq not in (select a_seq from e)""")
def mixed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _records(spark, sf_dir, "before").unionByName(_records(spark, sf_dir, "after"))
    both = placement.running_index(both.drop("seq"), ["path"]).withColumnRenamed("index", "seq")
    return pairing.pair_mixed(both).select("status", "confidence", "pairing_method", "before_path", "after_path")


@QUERIES(O.GREEDY_SQL)
def greedy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy one-to-one assignment of suppliers and parts of line items by price."""
    best = I.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_extendedprice").alias("score"))
    order = [F.desc("score"), F.col("l_suppkey"), F.col("l_partkey")]
    return assign.greedy_pairs(best, ["l_suppkey"], ["l_partkey"], order)


@QUERIES(f"with recursive p as (select p_partkey, p_name as x, p_type as y from part),{O.ratios('p')} select p_partkey, ratio from p join ratios using (x, y)")
def sequence_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = I.table(spark, sf_dir, "part")
    return part.select("p_partkey", ratio(part["p_name"], part["p_type"]).alias("ratio"))


def _page_table(spark: SparkSession, sf_dir: str, gone: str) -> DataFrame:
    own = Window.partitionBy("pair_id").orderBy("page_id")
    pages = I.table(spark, sf_dir, "pages").withColumn("pair_id", F.floor(F.col("page_id") / 8))
    pages = pages.filter(~F.contains("url", F.lit(gone))).withColumn("page_index", F.row_number().over(own) - 1)
    return pages.select(
        "pair_id", "page_index", F.substring(F.md5("url"), 1, 16).alias("fingerprint"), F.substring("html", 1, 1500).alias("preview"),
        F.lit(800.0).alias("width"), F.lit(600.0).alias("height"),
    )


@QUERIES()
def page_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.align_pages(_page_table(spark, sf_dir, "?page="), _page_table(spark, sf_dir, "#top"))


def _diff_rows(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Table rows of two revisions: events of a user as rows of one region."""
    events = I.table(spark, sf_dir, "events")
    value = F.col("value") if side == "before" else F.when(F.col("event_id") % 13 == 0, F.col("value") + 1).otherwise(F.col("value"))
    keep = "second(ts) < 55" if side == "before" else "second(ts) >= 5"
    cells = F.array(F.concat(F.lit("EV-"), F.col("event_id").cast("string")), F.col("event_type"), F.round(value, 2).cast("string"))
    rows = events.filter(keep).withColumn("cells", cells).withColumn("text", F.array_join("cells", " "))
    own = Window.partitionBy("user_id").orderBy("event_id" if side == "before" else F.col("event_id") % 50, "event_id")
    return rows.select(
        F.col("user_id").alias("pair_id"), F.lit("r1").alias("region_id"), (F.row_number().over(own) - 1).alias("row_index"), "cells", "text",
        T.normalize_text(F.col("text")).alias("normalized_text"), T.row_key(F.col("cells"), F.col("text")).alias("key"),
    )


def _rows_sql(side: str) -> str:
    value = "value" if side == "before" else "case when event_id % 13 = 0 then value + 1 else value end"
    keep, order = ("< 55", "event_id") if side == "before" else (">= 5", "event_id % 50, event_id")
    return f"""(select pair_id, i, text, lower(text) as plain, substr(sha1(lower(cell || '|' || event_type || '|' || shown)), 1, 12) as key, {_CELL("cell")} as id,
  [{_CELL("cell")}] || case when regexp_matches({_CELL("shown")}, '^[0-9]{{3,}}$') then [{_CELL("shown")}] else [] end as anchors,
  list_filter([{_CELL("cell")}, {_CELL("event_type")}, {_CELL("shown")}], lambda x: x <> '') as cells
  from (select *, cell || ' ' || event_type || ' ' || shown as text from (select user_id as pair_id, 'EV-' || event_id as cell, event_type, cast(round({value}, 2) as varchar) as shown,
    cast(row_number() over (partition by user_id order by {order}) - 1 as int) as i from events where second(ts) {keep})))"""


_CELL = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')".format
_ONCE = "select pair_id, anchor, max(i) as i from (select pair_id, i, unnest(anchors) as anchor from {0}) group by all having count(*) = 1".format


@QUERIES(f"""
with b as {_rows_sql("before")}, a as {_rows_sql("after")}, ub as ({_ONCE("b")}), ua as ({_ONCE("a")}), common as (select pair_id, anchor, ua.i as ai from ub join ua using (pair_id, anchor)),
pairs as (select pair_id, bi, arg_min(ai, pos) as ai from (select pair_id, i as bi, unnest(anchors) as anchor, generate_subscripts(anchors, 1) as pos from b) join common using (pair_id, anchor) group by all),
j as (select p.*, b.text as old, a.text as new, b.key || ':' || a.key as key, b.plain = a.plain or b.cells = a.cells as same, b.plain = a.plain as equal
  from pairs p join b on b.pair_id = p.pair_id and b.i = p.bi join a on a.pair_id = p.pair_id and a.i = p.ai),
lb as (select *, row_number() over (partition by pair_id, plain order by i) as nth from b where not exists (select 1 from pairs p where p.pair_id = b.pair_id and p.bi = b.i)),
la as (select *, row_number() over (partition by pair_id, plain order by i) as nth from a where not exists (select 1 from pairs p where p.pair_id = a.pair_id and p.ai = a.i)),
late as (select lb.pair_id, lb.i as bi, la.i as ai, lb.text as old, la.text as new, lb.key || ':' || la.key as key from lb join la using (pair_id, plain, nth))
select pair_id, 'r1' as region_id, change_type, bi as before_index, ai as after_index, old as before_text, new as after_text, key as row_key, confidence from (
select pair_id, case when same then 'moved' else 'modified' end as change_type, bi, ai, old, new, key, case when same then 0.90::double else 0.82::double end as confidence from j where (same and bi <> ai) or (not same and not equal)
union all select pair_id, 'moved', bi, ai, old, new, key, 0.90 from late
union all select pair_id, 'removed', i, null, text, '', key, 0.88 from lb where not exists (select 1 from late l where l.pair_id = lb.pair_id and l.bi = lb.i)
union all select pair_id, 'added', null, i, '', text, key, 0.88 from la where not exists (select 1 from late l where l.pair_id = la.pair_id and l.ai = la.i))""")
def row_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two revisions matched by anchors: moved, modified, removed, added."""
    return diff.compare_rows(_diff_rows(spark, sf_dir, "before"), _diff_rows(spark, sf_dir, "after"))


def _regions(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    shift = 0 if side == "before" else 7
    spans = I.spans(spark, sf_dir).filter(f"not startswith(text, '{'RM' if side == 'before' else 'RL7'}')")
    return spans.select(
        F.concat_ws("-", "doc_id", "page_num").alias("pair_id"), F.col("span_id").alias("region_id"), F.lit("general").alias("kind"),
        (F.col("x0") + shift).alias("x0"), "y0", (F.col("x1") + shift).alias("x1"), "y1", F.lit(I.WIDTH).alias("width"), F.lit(I.HEIGHT).alias("height"),
        T.normalize_text(F.col("text")).alias("normalized_text"), F.lit("").alias("header"), F.array().cast("array<string>").alias("anchors"), F.lit(0).alias("n_rows"),
    )


def _regions_sql(side: str) -> str:
    shift, gone = (0, "RM") if side == "before" else (7, "RL7")
    return f"""(select doc_id || '-' || page_num as pair_id, span_id as id, (x0 + {shift}) / 1000.0::double as x0, y0 / 800.0::double as y0, (x1 + {shift}) / 1000.0::double as x1, y1 / 800.0::double as y1,
  trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as t from {I.SPANS_SQL} where not starts_with(text, '{gone}'))"""


@QUERIES(f"""
with recursive b as {_regions_sql("before")}, a as {_regions_sql("after")},
n as (select b.pair_id, b.id as b_region_id, a.id as a_region_id, b.t as x, a.t as y, {O.shared_area("b.", "a.")} as shared from b join a on a.pair_id = b.pair_id and {O.shared_area("b.", "a.")} > 0.1),{O.ratios("n")},
s as (select pair_id, b_region_id, a_region_id, shared * 0.45::double + ratio * 0.40::double + 0.0::double * 0.15::double as score, ratio from n join ratios using (x, y)),
o as (select * from s where score >= 0.45),{O.greedy("o", "b_region_id", "a_region_id", "score desc, b_region_id, a_region_id")}
select pair_id, 'general' as kind, b_region_id, a_region_id, score, case when ratio > 0.995 then 'unchanged' else 'modified' end as change from taken
union all select pair_id, 'general', id, null, null, 'removed' from b where id not in (select b_region_id from taken)
union all select pair_id, 'general', null, id, null, 'added' from a where id not in (select a_region_id from taken)""")
def region_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.match_regions(_regions(spark, sf_dir, "before"), _regions(spark, sf_dir, "after"))


@QUERIES(O.WORD_ROWS_SQL)
def word_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = I.spans(spark, sf_dir).selectExpr("doc_id", "page_num", "span_id as seq", "x0", "y0 + span_id % 3 as y0", "x1", "y1 + span_id % 3 as y1", "text as word")
    return layout.words_to_rows(words)


@QUERIES(O.MERGED_ROWS_SQL)
def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to rows, cells, structured rows and merged continuation rows."""
    rows = layout.structured_rows(layout.row_cells(word_rows(spark, sf_dir)))
    return layout.merge_continuations(rows)


@QUERIES(O.MERGED_REGIONS_SQL)
def merged_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = I.spans(spark, sf_dir)
    regions = spans.select("doc_id", "page_num", F.col("span_id").alias("region_id"), F.lit("general").alias("kind"), "x0", "y0", "x1", "y1", "text")
    return layout.top_regions(layout.merge_close_regions(regions))


@QUERIES(O.MASK_SQL)
def mask_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed pixels of 256x256 rasters to boxes."""
    part = I.table(spark, sf_dir, "part")
    pixel = ((F.col("p_partkey") * 7919) % 65536).cast("int")
    masks = part.groupBy((F.col("p_partkey") % 40).alias("id")).agg(F.collect_list(pixel).alias("changed"))
    return layout.mask_components(masks.withColumn("width", F.lit(256)).withColumn("height", F.lit(256)))


_CHANGED = """
with p as (select page_id, string_split(url, '/') as b, string_split(case when page_id % 3 = 0 then upper(url) when page_id % 3 = 1 then replace(url, 'e', 'i') else url || '/x' end, '/') as a from pages)
select page_id, case when len(a) = len(b) then array_to_string(list_filter(range(len(a)), lambda i: regexp_replace(lower(a[i + 1]), '[^a-z0-9]+', '', 'g') <> regexp_replace(lower(b[i + 1]), '[^a-z0-9]+', '', 'g')), ',') end as changed from p"""


@QUERIES(_CHANGED)
def changed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    after = F.when(F.col("page_id") % 3 == 0, F.upper(url)).when(F.col("page_id") % 3 == 1, F.replace(url, F.lit("e"), F.lit("i"))).otherwise(F.concat(url, F.lit("/x")))
    changed = diff.changed_cells(F.split(url, "/"), F.split(after, "/"))
    return I.table(spark, sf_dir, "pages").select("page_id", F.array_join(F.transform(changed, lambda x: x["at"].cast("string")), ",").alias("changed"))


@QUERIES("""
with p as (select l_orderkey % 500 as pair_id, l_quantity / 47 as confidence, l_returnflag, l_linestatus from lineitem),
d as (select pair_id, round_even(avg(confidence), 3) as confidence, count(*) filter (l_returnflag = 'R') as review, count(*) filter (l_linestatus = 'O') as changed from p group by pair_id)
select pair_id, confidence, case when review > 40 then 'review_needed' when changed > 0 then 'changed' else 'unchanged' end as status from d""")
def document_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = I.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 500 as pair_id", "l_quantity / 47 as confidence", "l_returnflag", "l_linestatus")
    counts = pages.groupBy("pair_id").agg(F.count_if(F.col("l_returnflag") == "R").alias("review"), F.count_if(F.col("l_linestatus") == "O").alias("changed"))
    status = diff.document_status(F.col("review") > 40, F.lit(0), F.col("changed"))
    return diff.document_confidence(pages).join(counts, "pair_id").select("pair_id", "confidence", status.alias("status"))


_SIGNAL = ("the ", "error", "ing ")


@QUERIES(f"""select doc_id, {" + ".join(f"cast(contains(lower(text), '{w}') as int)" for w in _SIGNAL)} as hits from documents""")
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "documents").select("doc_id", diff.keyword_hits(F.col("text"), _SIGNAL).alias("hits"))


@QUERIES(f"""
with b as (select * from {I.SPANS_SQL} where contains(text, '-')), r as (select * from {I.SPANS_SQL} where not contains(text, '-'))
select span_id from b where exists (select 1 from r where r.page_num = b.page_num and b.x0 <= r.x1 + 10 and r.x0 <= b.x1 + 10 and b.y0 <= r.y1 + 10 and r.y0 <= b.y1 + 10)""")
def boxes_near_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = I.spans(spark, sf_dir).withColumn("page_id", F.col("page_num"))
    return diff.near_boxes(spans.filter("contains(text, '-')"), spans.filter("not contains(text, '-')"), 10.0).select("span_id")
