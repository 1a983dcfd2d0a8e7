"""Queries of text functions, tag extraction, scoring and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawloom import config
from drawloom.functions import geometry as G
from drawloom.functions import tags as N
from drawloom.functions import text as T
from drawloom.operators import layout, match, scan
from drawloom.plans import inputs as I
from drawloom.plans import ordered_sql as O
from drawloom.plans.inputs import SPANS_SQL, listed, norm_sql
from drawloom.plans.registry import Registry

QUERIES = Registry()
LINES = """(select doc_id, generate_subscripts(parts, 1) - 1 as line_no, unnest(parts) as line
  from (select doc_id, string_split(text, chr(10)) as parts from documents))"""
ISA, EQUIPMENT, DENY = listed(config.ISA_CODES), listed(config.EQUIPMENT_PREFIXES), listed(config.DENY_PREFIXES)
ISA_RE, EQ_RE = "'^([A-Z]{1,4})-?([0-9]{1,4})([A-Z]?)$'", "'^([A-Z]{2,5})([0-9]{2,5})([A-Z]?)$'"
ROOT_RE = "'^R[LM][0-9]*(?:-[A-Z]{2,6})?-[0-9]{3,5}[A-Z]?$'"
COMPACT_RE = "'^(R[LM][0-9]*)-([A-Z]{2,6})([0-9]{3,5}[A-Z]?)$'"
LINE_RE = """'(?:^|[^A-Z0-9/\\-])([0-9]+\\s+[0-9]+/[0-9]+|[0-9]+/[0-9]+|[0-9]+(?:\\.[0-9]+)?)\\s*"?\\s*-\\s*([A-Z][A-Z0-9]{0,9}(?:-[A-Z0-9]{1,10}){1,5})'"""


def sql_isa(x: str) -> str:
    return f"(regexp_extract({x}, {ISA_RE}, 1) in {ISA})"


def sql_equipment(x: str) -> str:
    return f"(regexp_extract({x}, {EQ_RE}, 1) in {EQUIPMENT})"


def sql_asset(x: str) -> str:
    prefix = f"regexp_extract({x}, '^([A-Z]+)', 1)"
    return (
        f"(regexp_matches({x}, '^[A-Z]{{2,8}}[0-9]{{3,7}}[A-Z]?$') and regexp_matches({x}, '^[A-Z]+[0-9]{{4,}}')"
        f" and {prefix} not in {DENY} and not ({prefix} in {ISA} and {prefix} not in {EQUIPMENT}))"
    )


def sql_root(x: str) -> str:
    return f"({sql_asset(x)} or regexp_matches({x}, {ROOT_RE}) or regexp_matches({x}, {COMPACT_RE}))"


def sql_canonical(x: str) -> str:
    return f"regexp_replace({x}, {COMPACT_RE}, '\\1-\\2-\\3')"


def sql_child(x: str) -> str:
    return f"regexp_replace({x}, {ISA_RE}, '\\1\\2\\3')"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@QUERIES(f"select doc_id, line_no, {norm_sql('line')} as norm from {LINES}")
def normalize_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.normalize_token(F.col("line")).alias("norm"))


@QUERIES(f"select doc_id, line_no, length(line) as n_chars from {LINES}")
def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.length("line").cast("long").alias("n_chars"))


@QUERIES(f"""
with w as (select doc_id, line_no, generate_subscripts(p, 1) - 1 as word_no, unnest(p) as word
           from (select doc_id, line_no, string_split(line, ' ') as p from {LINES}))
select doc_id, line_no, word_no, word,
  cast(6 * (coalesce(sum(length(word) + 1) over (partition by doc_id, line_no order by word_no
       rows between unbounded preceding and 1 preceding), 0)) as double) as x0, cast(12 * line_no as double) as y0
from w""")
def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    words = lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.posexplode(F.split("line", " ")).alias("word_no", "word"))
    before = Window.partitionBy("doc_id", "line_no").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    x0 = 6 * F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0))
    return words.select(
        "doc_id", "line_no", F.col("word_no").cast("long").alias("word_no"), "word", x0.cast("double").alias("x0"), (12 * F.col("line_no")).cast("double").alias("y0")
    )


@QUERIES(f"""
with w as {I.derived_sql("orders", I.WORDS)},
g as (select *, x0 - lag(x1) over (partition by page_num order by x0, seq) as gap,
        greatest(18, 1.5 * median(y1 - y0) over (partition by page_num)) as lim from w),
c as (select *, sum(case when coalesce(gap, 0) > lim then 1 else 0 end) over (partition by page_num order by x0, seq rows unbounded preceding) as cell from g)
select page_num, cast(cell as bigint) as cell, string_agg(word, ' ' order by x0, seq) as text, min(x0) as x0, max(x1) as x1
from c group by page_num, cell""")
def cell_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = I.derived(I.table(spark, sf_dir, "orders"), I.WORDS)
    return layout.row_cells(words).select("page_num", "cell", "text", "x0", "x1")


@QUERIES(f"""
with w as {I.derived_sql("orders", I.WORDS)},
g as (select *, x0 - lag(x1) over (partition by page_num order by x0, seq) as gap,
        greatest(18, 1.5 * median(y1 - y0) over (partition by page_num)) as lim from w),
c as (select *, sum(case when coalesce(gap, 0) > lim then 1 else 0 end) over (partition by page_num order by x0, seq rows unbounded preceding) as cell from g),
t as (select page_num, cell, string_agg(word, ' ' order by x0, seq) as text from c group by page_num, cell)
select page_num, count(*) as n_cells, lower(string_agg(text, ' ' order by cell)) as normalized_text,
  substr(sha1(lower(array_to_string(list(text order by cell)[1:3], '|'))), 1, 12) as key
from t group by page_num""")
def structured_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = I.derived(I.table(spark, sf_dir, "orders"), I.WORDS)
    rows = layout.structured_rows(layout.row_cells(words))
    return rows.select("page_num", F.size("cells").cast("long").alias("n_cells"), "normalized_text", "key")


@QUERIES(f"""
with s as (select *, {norm_sql("text")} as norm from {SPANS_SQL})
select span_id, norm, {sql_asset("norm")} as asset,
  (regexp_matches(norm, {ROOT_RE}) or regexp_matches(norm, {COMPACT_RE})) as hyphen_root, {sql_isa("norm")} as isa_child,
  {sql_equipment("norm")} as equipment_child, norm in {ISA} as bare_code,
  {sql_canonical("replace(norm, ' ', '-')")} as canonical, {sql_child("norm")} as child from s""")
def tag_shape_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan.with_norm(I.spans(spark, sf_dir))
    n = F.col("norm")
    return s.select(
        "span_id", "norm", N.looks_asset(n).alias("asset"), N.looks_hyphen_root(n).alias("hyphen_root"), N.looks_isa_child(n).alias("isa_child"),
        N.looks_equipment_child(n).alias("equipment_child"), n.isin(*config.ISA_CODES).alias("bare_code"),
        N.canonical_root(n).alias("canonical"), N.compact_child(n).alias("child"),
    )


def _parse_sql(source: str) -> str:
    """Parsing of a cell named raw in ``source`` (row_num, raw)."""
    def joined(drop: int) -> str:
        return f"array_to_string(parts[1:len(parts) - {drop}], '-')"

    one, two = "parts[len(parts)]", "array_to_string(parts[greatest(len(parts) - 1, 1):], '-')"

    def tail(test: str, part: str, drop: int, kind: str, comp: str) -> str:
        at = sql_canonical(f"replace({norm_sql(joined(drop))}, ' ', '-')")
        return f"when len(parts) >= 2 and {test} then {{'full_tag': {at} || '-' || {comp}, 'root': {at}, 'component': {comp}, 'tag_class': '{kind}'}}"

    whole = f"{{'full_tag': {sql_canonical('n')}, 'root': {sql_canonical('n')}, 'component': '', 'tag_class': 'equipment'}}"
    bare = f"regexp_replace(trim(raw), '^\\s*(?:[0-9]+\\s+[0-9]+/[0-9]+|[0-9]+/[0-9]+|[0-9]+(?:\\.[0-9]+)?)\\s*\"?\\s*-\\s*', '')"
    return f"""(
with a as (select row_num, raw, upper(trim(raw)) as up,
    trim(regexp_replace(replace({norm_sql(f"trim(trim(trim({bare}), chr(34)))")}, ' ', '-'), '-+', '-', 'g'), '-') as n from {source}),
b as (select *, string_split(n, '-') as parts, regexp_extract(up, {LINE_RE}, 1) as size, regexp_extract(up, {LINE_RE}, 2) as body from a),
c as (select *, string_split(body, '-') as bp from b),
d as (select row_num, raw, case
  when raw is null or trim(raw) = '' then null
  when body <> '' then {{'full_tag': regexp_replace(regexp_replace(size, '\\s*/\\s*', '/', 'g'), '\\s+', ' ', 'g') || '"-' || bp[1] || '-' || bp[2], 'root': bp[1], 'component': bp[2], 'tag_class': 'line'}}
  when n = '' or regexp_extract(parts[1], '^([A-Z]+)', 1) in {DENY} then null
  when regexp_matches(n, {ROOT_RE}) or regexp_matches(n, {COMPACT_RE}) then {whole}
  {tail(sql_isa(two), two, 2, "instrument", sql_child(two))}
  {tail(sql_isa(one), one, 1, "instrument", sql_child(one))}
  {tail(sql_equipment(one), one, 1, "equipment", one)}
  {tail(f"regexp_matches({two}, {ISA_RE})", two, 2, "instrument", sql_child(two))}
  {tail(f"regexp_matches({one}, {ISA_RE})", one, 1, "instrument", sql_child(one))}
  when len(parts) = 2 and regexp_matches(parts[1], '^[A-Z]+$') and regexp_matches(parts[2], '[0-9]')
    then {{'full_tag': n, 'root': parts[1], 'component': parts[2], 'tag_class': 'line'}}
  when {sql_asset("n")} then {whole} end as t from c)
select row_num, raw, t.full_tag as full_tag, t.root as root, t.component as component, t.tag_class as tag_class from d)"""


CELLS_SQL = f"(select span_id as row_num, case when span_id % 17 = 0 then '  ' when span_id % 19 = 0 then lower(text) else text end as raw from {SPANS_SQL})"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = "case when span_id % 17 = 0 then '  ' when span_id % 19 = 0 then lower(text) else text end"
    return I.spans(spark, sf_dir).selectExpr("span_id as row_num", f"{raw} as raw")


@QUERIES(f"select * from {_parse_sql(CELLS_SQL)}")
def parse_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).withColumn("t", N.parse_tag(F.col("raw"))).select("row_num", "raw", "t.*")


_H_SQL = f"""(
with s as (select *, {norm_sql("text")} as norm from {SPANS_SQL}),
e as (select *, unnest(regexp_extract_all(norm, '\\b[A-Z]{{1,10}}[0-9]{{0,5}}(?:-[A-Z0-9]{{1,14}}){{2,8}}\\b')) as token from s),
p as (select *, string_split(token, '-') as parts from e),
q as (select *, parts[len(parts)] as one, array_to_string(parts[len(parts) - 1:], '-') as two,
  array_to_string(parts[1:len(parts) - 1], '-') as r1, array_to_string(parts[1:len(parts) - 2], '-') as r2 from p),
t as (select *, case when len(parts) < 3 or regexp_extract(parts[1], '^([A-Z]+)', 1) in {DENY} then null
  when {sql_isa("two")} then case when {sql_root(sql_canonical("r2"))} then {{'r': {sql_canonical("r2")}, 'c': {sql_child("two")}, 'k': 'instrument', 'm': 'fulltag:isa'}} end
  when {sql_isa("one")} then case when {sql_root(sql_canonical("r1"))} then {{'r': {sql_canonical("r1")}, 'c': {sql_child("one")}, 'k': 'instrument', 'm': 'fulltag:isa'}} end
  when {sql_equipment("one")} then {{'r': {sql_canonical("r1")}, 'c': one, 'k': 'equipment', 'm': 'fulltag:equip'}} end as t from q)
select doc_id, page_num, span_id, t.r || '-' || t.c as full_tag, t.r as root, t.c as component, t.k as tag_class, t.m as method,
  text as source_text, x0, y0, x1, y1 from t where t is not null)"""


@QUERIES(f"select span_id, full_tag, root, component, tag_class, method from {_H_SQL}")
def hyphen_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.hyphen_tags(scan.with_norm(I.spans(spark, sf_dir)))
    return found.select(F.col("source_spans")[0].alias("span_id"), "full_tag", "root", "component", "tag_class", "method")


@QUERIES(f"""
with l as (select *, string_split(regexp_extract(upper(text), {LINE_RE}, 2), '-') as p, regexp_extract(upper(text), {LINE_RE}, 1) as pipe from {SPANS_SQL})
select span_id, pipe || '"-' || p[1] || '-' || p[2] as full_tag, p[1] as root, p[2] as component
from l where len(p) >= 2 and p[1] not in {DENY} and regexp_matches(p[1] || p[2], '[0-9]')""")
def line_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.line_tags(scan.with_norm(I.spans(spark, sf_dir)))
    return found.select(F.col("source_spans")[0].alias("span_id"), "full_tag", "root", "component")


_ZONE = "case when (x0 + x1) / 2 > 840 then 'title-block/right' when (y0 + y1) / 2 > 720 then 'title-block/bottom' when (y0 + y1) / 2 < 32 or (x0 + x1) / 2 < 20 or (x0 + x1) / 2 > 980 then 'edge' else 'drawing' end"


@QUERIES(f"select page_num, {_ZONE} as zone, count(*) as n from {SPANS_SQL} group by all")
def zone_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = I.spans(spark, sf_dir)
    zone = G.zone(G.box(), F.lit(I.WIDTH), F.lit(I.HEIGHT))
    return s.groupBy("page_num", zone.alias("zone")).agg(F.count(F.lit(1)).alias("n"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = scan.hyphen_tags(scan.with_norm(scan.dealt(I.spans(spark, sf_dir))))
    legend = F.when(F.col("page_num") % 7 == 0, "legend/reference").otherwise("process/drawing")
    sheet = F.when(F.col("page_num") % 3 == 0, F.concat(F.lit("PAGE_"), F.col("page_num").cast("string"))).otherwise(
        F.concat(F.lit("DG"), F.col("page_num").cast("string"))
    )
    tags = tags.withColumn("page_role", legend).withColumn("sheet_id", sheet).withColumn("seq", F.col("source_spans")[0])
    return scan.score_tags(tags.withColumn("width", F.lit(I.WIDTH)).withColumn("height", F.lit(I.HEIGHT)))


_REVIEW = listed(config.REVIEW_CODES)
_SCORED = f"""(
select *, case when page_num % 3 = 0 then 'PAGE_' || page_num else 'DG' || page_num end as sheet_id, {_ZONE} as zone,
  greatest(0.05, least(0.99, case method when 'fulltag:isa' then 0.86::double else 0.80::double end
  + case {_ZONE} when 'drawing' then 0.06::double when 'edge' then -0.10::double else -0.22::double end
  + case when page_num % 7 = 0 then -0.25::double else 0.02::double end + case when page_num % 3 = 0 then -0.06::double else 0.03::double end
  + case when tag_class = 'instrument' and regexp_extract(component, {ISA_RE}, 1) in {_REVIEW} then -0.14::double else 0.0::double end)) as confidence
from {_H_SQL})"""
_RATE = "case when {0} >= 0.9 then 'High' when {0} >= 0.7 then 'Medium' else 'Low' end"


@QUERIES(f"select span_id, zone, round(confidence, 6) as confidence, {_RATE.format('confidence')} as rating from {_SCORED}")
def score_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(F.col("seq").alias("span_id"), "zone", F.round("confidence", 6).alias("confidence"), "rating")


_BUMPED = f"""(select *, case when n > 1 then least(0.99, confidence + least(0.10, 0.025 * n)) else confidence end as bumped
  from (select *, count(*) over (partition by doc_id, sheet_id, full_tag) as n from {_SCORED}))"""


@QUERIES(f"select span_id, n as repeats, round(bumped, 6) as confidence, {_RATE.format('round(bumped, 9)')} as rating from {_BUMPED}")
def repetition_bump(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = scan.repetition_bump(_scored(spark, sf_dir))
    rating = N.rating(F.round("confidence", 9))
    return tags.select(F.col("seq").alias("span_id"), "repeats", F.round("confidence", 6).alias("confidence"), rating.alias("rating"))


@QUERIES(f"""
select doc_id, sheet_id, page_num, full_tag, span_id from (select *, row_number() over (partition by doc_id, sheet_id, page_num, full_tag
  order by confidence desc, case method when 'fulltag:isa' then 1 else 4 end, span_id) as rn from {_SCORED}) where rn = 1""")
def best_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = scan.dedupe(_scored(spark, sf_dir))
    return best.select("doc_id", "sheet_id", "page_num", "full_tag", F.col("seq").alias("span_id"))


@QUERIES(f"select {_RATE.format('confidence')} as rating, count(*) as n from {_SCORED} group by 1")
def rating_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.rating_counts(_scored(spark, sf_dir))


@QUERIES(f"""
select count(*) as detections, count(distinct full_tag) as unique_tags, count(distinct sheet_id) as unique_sheets,
  count(*) - count(distinct (sheet_id, page_num, full_tag)) as duplicates_collapsed,
  count(*) filter (r = 'High') as high, count(*) filter (r = 'Medium') as medium, count(*) filter (r = 'Low') as low, count(*) filter (r <> 'High') as review
from (select *, {_RATE.format("confidence")} as r from {_SCORED})""")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_summary(_scored(spark, sf_dir))


_LOOKS = f"""looks as (select *, case when {sql_root("norm")} then {sql_canonical("replace(norm, ' ', '-')")} end as root, {sql_isa("norm")} as isa_child,
  {sql_isa("norm")} or {sql_equipment("norm")} as child_, {sql_child("norm")} as compact from (select *, {norm_sql("text")} as norm from {SPANS_SQL}) where trim(text) <> ''),"""
_STACKED = _LOOKS + O.stacked("(select * from looks where root is not null)", "(select * from looks where child_)")
_ROUNDED = "round_even({0}.x0, 0) = round_even({1}.x0, 0) and round_even({0}.y0, 0) = round_even({1}.y0, 0)".format
_TAG = "doc_id, page_num, full_tag, root, component, tag_class, method, spans, source_text, x0, y0, x1, y1"
_W = {k: f"({v})::double" for k, v in config.CONFIDENCE_WEIGHTS.items()}


def _both(kind: str, component: str, method: str) -> str:
    """The tag of a parent a and a child b."""
    return (
        f"select a.doc_id, a.page_num, a.root || '-' || {component} as full_tag, a.root, {component} as component, {kind} as tag_class, {method} as method, [a.span_id, b.span_id] as spans,"
        " a.text || ' / ' || b.text as source_text, least(a.x0, b.x0) as x0, least(a.y0, b.y0) as y0, greatest(a.x1, b.x1) as x1, greatest(a.y1, b.y1) as y1"
    )


def _report_sql(sheets: str) -> str:
    """CTEs up to ``best``, the whole scan with the sheets of a CTE body of (doc_id, page_num, sheet_id)."""
    code = f"coalesce(nullif(regexp_extract(component, {ISA_RE}, 1), ''), regexp_extract(component, '^([A-Z]+)', 1))"
    legend = " + ".join(f"cast(contains(t, '{m}') as int)" for m in config.LEGEND_MARKERS)
    noisy = " or ".join(f"contains(lower(source_text), '{m}')" for m in config.NOISE_CONTEXT)
    rank = " ".join(f"when '{m}' then {r}" for m, r in config.METHOD_RANK.items())
    base = " ".join(f"when '{m}' then {w}" for m, w in _W.items() if ":" in m)
    loud = " or ".join(f"contains(upper(text), '{w}')" for w in config.LINE_NOISE)
    steps = [
        f"case when zone = 'drawing' then ({_W['drawing_zone_bonus']}, 'drawing zone') when starts_with(zone, 'title-block') then ({_W['title_block_penalty']}, 'title-block penalty') else ({_W['edge_zone_penalty']}, 'edge zone') end",
        f"case when page_role = 'legend/reference' then ({_W['legend_page_penalty']}, 'legend page penalty') else ({_W['process_page_bonus']}, 'process page') end",
        f"case when starts_with(sheet_id, 'PAGE_') then ({_W['unmapped_sheet_penalty']}, 'unmapped sheet') else ({_W['mapped_sheet_bonus']}, 'mapped sheet') end",
        f"case when {noisy} then ({_W['noisy_context_penalty']}, 'noisy context') else (0.0::double, null) end",
        f"case when tag_class = 'instrument' and regexp_extract(root, '^([A-Z]+)', 1) = 'VG' then ({_W['valve_group_penalty']}, 'valve group review') else (0.0::double, null) end",
        f"case when tag_class = 'instrument' and {code} in {_REVIEW} then ({_W['custom_code_penalty']}, 'custom code review') else (0.0::double, null) end",
    ]
    total = f"(case method {base} else {_W['unknown']} end)" + "".join(f" + s{i}[1]" for i in range(len(steps)))
    return f"""
with recursive {_STACKED},
stacked as ({_both("case when b.isa_child then 'instrument' else 'equipment' end", "case when b.isa_child then b.compact else b.norm end", "case when b.isa_child then 'stacked:isa' else 'stacked:equip' end")}
  from pairs p join looks a on {O.same_page("a", "p")} and a.span_id = p.parent join looks b on {O.same_page("b", "p")} and b.span_id = p.child),
far as (select a.doc_id, a.page_num, a.span_id as parent, b.span_id as child, abs((b.x0 + b.x1) / 2 - (a.x0 + a.x1) / 2) as dx, abs((b.y0 + b.y1) / 2 - (a.y0 + a.y1) / 2) as dy,
  a.y1 - a.y0 as ah, b.y1 - b.y0 as bh, a.x1 - a.x0 as aw, b.x1 - b.x0 as bw
  from looks a join looks b on {O.same_page("a", "b")} and a.root is not null and b.norm in {listed(config.BARE_CODES)} and a.span_id <> b.span_id),
nearest as (select *, row_number() over (partition by doc_id, page_num, child order by sqrt(dx * dx + dy * dy) + case when dy < greatest(ah, bh) * 4 then -60 else 0 end
  + case when dx < greatest(aw, bw) * 2 then -40 else 0 end + case when aw > 15 * greatest(bw, bh, 1.0) then 150 else 0 end, parent) as rn from far where dx <= 420 and dy <= 420),
coded as (select n.doc_id, n.page_num, n.parent, n.child, lpad(cast(row_number() over (partition by n.doc_id, n.page_num, a.root, b.norm order by b.y0, b.x0, n.child) as varchar), 3, '0') as nth
  from nearest n join looks a on {O.same_page("a", "n")} and a.span_id = n.parent join looks b on {O.same_page("b", "n")} and b.span_id = n.child where rn = 1),
inferred as ({_both("'instrument'", "(b.norm || c.nth)", "'inferred:bare-isa'")}
  from coded c join looks a on {O.same_page("a", "c")} and a.span_id = c.parent join looks b on {O.same_page("b", "c")} and b.span_id = c.child),
free as (select *, row_number() over (partition by doc_id, page_num, compact, round_even(x0, 0), round_even(y0, 0) order by span_id) as rn from looks l
  where isa_child and not exists (select 1 from pairs p where {O.same_page("p", "l")} and p.child = l.span_id)),
alone as (select *, row_number() over (partition by doc_id, page_num, root order by span_id) as rn from looks where root is not null),
placed as (select * from stacked union all select * from inferred
  union all select doc_id, page_num, compact, '', compact, 'instrument', 'standalone:isa', [span_id], text, x0, y0, x1, y1 from free where rn = 1
  union all select doc_id, page_num, root, root, '', 'equipment', 'standalone:asset', [span_id], text, x0, y0, x1, y1 from alone where rn = 1),
joined as (select doc_id, page_num, full_tag, root, component, tag_class, method, [span_id] as spans, source_text, x0, y0, x1, y1 from {_H_SQL} h
  where not exists (select 1 from placed p where {O.same_page("p", "h")} and p.full_tag = h.full_tag and {_ROUNDED("p", "h")})),
piped as (select *, string_split(regexp_extract(upper(text), {LINE_RE}, 2), '-') as p, regexp_extract(upper(text), {LINE_RE}, 1) as pipe from {SPANS_SQL}),
lined as (select doc_id, page_num, pipe || '"-' || p[1] || '-' || p[2] as full_tag, p[1] as root, p[2] as component, 'line' as tag_class, 'line:size-prefix' as method, [span_id] as spans, text as source_text, x0, y0, x1, y1
  from piped where len(p) >= 2 and p[1] not in {DENY} and not ({loud}) and (regexp_matches(p[1] || p[2], '[0-9]') or p[2] in {listed(config.LINE_WORD_COMPONENTS)})),
every as (select {_TAG} from placed union all select {_TAG} from joined union all select {_TAG} from lined),
roles as (select doc_id, page_num, case when {legend} >= 2 then 'legend/reference' else 'process/drawing' end as page_role
  from (select doc_id, page_num, string_agg(lower(text), ' ' order by span_id) as t from looks group by all)),
sheets as ({sheets}),
known as (select e.*, page_role, coalesce(sheet_id, 'PAGE_' || e.page_num) as sheet_id, {_ZONE} as zone
  from every e join roles r on {O.same_page("r", "e")} left join sheets h on {O.same_page("h", "e")}),
steps as (select *, {", ".join(f"{x} as s{i}" for i, x in enumerate(steps))} from known),
weighed as (select *, greatest(0.05::double, least(0.99::double, {total})) as conf, array_to_string(list_filter([{", ".join(f"s{i}[2]" for i in range(len(steps)))}], lambda x: x is not null), '; ') as noted from steps),
counted as (select *, count(*) over (partition by doc_id, sheet_id, full_tag) as n, row_number() over (partition by doc_id, page_num order by y0, x0, full_tag, method, spans) as seq from weighed),
bumped as (select * exclude (conf, noted), case when n > 1 then least(0.99::double, conf + least(0.10::double, 0.025::double * n)) else conf end as confidence,
  case when n > 1 then noted || '; repeated x' || n else noted end as evidence from counted),
best as (select * exclude (rn) from (select *, row_number() over (partition by doc_id, sheet_id, page_num, full_tag order by confidence desc, case method {rank} else 9 end, seq) as rn from bumped) where rn = 1)"""


#: The sheet of a page: file names, labels, tokens in the title corner, else the only token.
_SHEETS_SQL = f"""
select doc_id, page_num, sheet_id from (select *, row_number() over (partition by doc_id, page_num order by score desc, k, i) as rn from (
  select doc_id, page_num, upper(sheet) as sheet_id, 100.0::double as score, 0 as k, i from (select doc_id, page_num, generate_subscripts(f, 1) as i, unnest(f) as sheet
    from (select doc_id, page_num, regexp_extract_all(t, '(?i)(?:^|[\\\\/])(?:[A-Z0-9_ -]*-)?([A-Z]{{1,6}}[0-9]{{3,7}}[A-Z]?)\\s*(?:GMP)?\\.dwg\\b', 1) as f
      from (select doc_id, page_num, string_agg(text, chr(10) order by text) as t from {SPANS_SQL} group by all)))
  union all select doc_id, page_num, upper(label), 60.0, 1, 0 from (select doc_id, page_num, regexp_extract(t, '(?i)(?:drawing|dwg|sheet)\\s*(?:no\\.?|number|#)?\\s*[:#]?\\s*([A-Z]{{1,6}}[0-9]{{3,7}}[A-Z]?)', 1) as label
      from (select doc_id, page_num, string_agg(text, chr(10) order by text) as t from {SPANS_SQL} group by all)) where label <> ''
  union all select doc_id, page_num, norm, 50 + (x0 + x1) / 2 / 1000.0::double + (y0 + y1) / 2 / 800.0::double, 2, span_id from looks
    where regexp_matches(norm, '^[A-Z]{{1,6}}[0-9]{{3,7}}[A-Z]?$') and (x0 > 1000 * 0.65 or y0 > 800 * 0.55)
  union all select doc_id, page_num, case when len(good) = 1 then good[1] else every[1] end, case when len(good) = 1 then 30.0 else 25.0 end, 3, 0 from (
    select doc_id, page_num, list(distinct norm) filter (starts_with(norm, 'DG')) as good, list(distinct norm) as every from looks
    where regexp_matches(norm, '^[A-Z]{{1,6}}[0-9]{{3,7}}[A-Z]?$') group by all) where len(good) = 1 or len(every) = 1)) where rn = 1"""
#: The same scan where no sheet is known.
WORKBOOK_SQL = f"""{_report_sql("select 0::bigint as doc_id, 0 as page_num, '' as sheet_id where false")},
shown as (select sheet_id, page_num, full_tag, root, component, confidence, {_RATE.format("confidence")} as rating, source_text, seq from best)
select *, 'Scan Results' as section, cast(row_number() over (order by page_num, sheet_id, full_tag, seq) - 1 as int) as row_index from shown
union all select *, 'Review Queue', row_number() over (order by page_num, sheet_id, full_tag, seq) - 1 from shown where rating <> 'High'"""


@QUERIES(f"{_report_sql(_SHEETS_SQL)} select doc_id, page_num, sheet_id, full_tag, tag_class, method, zone, confidence, {_RATE.format('confidence')} as rating, evidence from best")
def tag_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan: extraction of every kind, scoring, repetition and the best of each tag."""
    spans, pages = I.spans(spark, sf_dir), I.pages(spark, sf_dir)
    sheets = scan.sheet_map(spans, pages, spans.groupBy("doc_id", "page_num").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text")))
    tags = scan.dedupe(scan.scan(spans, pages, sheets, mode="all"))
    return tags.select("doc_id", "page_num", "sheet_id", "full_tag", "tag_class", "method", "zone", "confidence", "rating", "evidence")


@QUERIES(f"with recursive {_STACKED} select * from pairs")
def stacked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.stacked_pairs(scan.with_norm(I.spans(spark, sf_dir)))


@QUERIES(f"""
with s as (select *, {norm_sql("text")} as norm from {SPANS_SQL}),
r as (select *, {sql_canonical("replace(norm, ' ', '-')")} as root from s where {sql_root("norm")}),
b as (select * from s where norm in {listed(config.BARE_CODES)}),
d as (select b.doc_id, b.page_num, b.span_id as child, r.span_id as parent, r.root, b.norm as code, b.x0, b.y0,
   abs((b.x0 + b.x1) / 2 - (r.x0 + r.x1) / 2) as dx, abs((b.y0 + b.y1) / 2 - (r.y0 + r.y1) / 2) as dy
   from b join r on b.doc_id = r.doc_id and b.page_num = r.page_num),
n as (select *, row_number() over (partition by doc_id, page_num, child order by
   sqrt(dx * dx + dy * dy) + case when dy < 40 then -60 else 0 end + case when dx < 120 then -40 else 0 end, parent) as rn
   from d where dx <= 420 and dy <= 420)
select doc_id, page_num, child, parent, root || '-' || code || lpad(cast(row_number() over (
  partition by doc_id, page_num, root, code order by y0, x0, child) as varchar), 3, '0') as full_tag from n where rn = 1""")
def nearest_root_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare codes with their nearest root and a running number."""
    found = scan.inferred_tags(scan.with_norm(I.spans(spark, sf_dir)))
    spans = F.col("source_spans")
    return found.select("doc_id", "page_num", spans[1].alias("child"), spans[0].alias("parent"), "full_tag")


_ROLE_WORDS = ("the ", "of ", "and ")


@QUERIES(f"""
select doc_id, case when {" + ".join(f"cast(contains(t, '{w}') as int)" for w in _ROLE_WORDS)} >= 2 then 'legend/reference' else 'process/drawing' end as page_role
from (select doc_id, replace(lower(text), chr(10), ' ') as t from documents)""")
def page_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("doc_id", F.lit(1).alias("page_num"), F.col("line_no").alias("span_id"), F.col("line").alias("text"))
    return scan.page_roles(rows, config.rules(page={"legend": _ROLE_WORDS})).select("doc_id", "page_role")


_PAGES = {
    "page_id": "page_id", "word_count": "page_id % 50", "char_count": "page_id % 170", "span_count": "page_id % 60",
    "drawing_count": "page_id * 7 % 900", "image_count": "page_id % 3", "image_coverage": "cast(page_id % 10 as double) / 20",
}


@QUERIES(f"""
with p as {I.derived_sql("pages", _PAGES)},
f as (select *, word_count < 10 or char_count < 40 or span_count < 5 as weak, drawing_count > 600 and word_count < 35 as vector_suspicion,
  image_count > 0 and span_count < 40 and drawing_count > 15 as mixed from p),
g as (select *, image_coverage >= 0.30 or (image_count > 0 and weak) as heavy from f)
select page_id, vector_suspicion, heavy or mixed or vector_suspicion as needs_ocr,
  case when heavy then '{scan.OCR_REASONS["heavy"]}' when mixed then '{scan.OCR_REASONS["mixed"]}'
  when vector_suspicion then '{scan.OCR_REASONS["vector"]}' else '{scan.OCR_REASONS["none"]}' end as ocr_reason from g""")
def ocr_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = scan.ocr_decision(I.derived(I.table(spark, sf_dir, "pages"), _PAGES))
    return pages.select("page_id", "vector_suspicion", "needs_ocr", "ocr_reason")


@QUERIES(f"""
with p as {I.derived_sql("pages", _PAGES)}
select count(*) as pages, count(*) filter (image_count > 1) as ocr_needed, count(*) filter (image_count > 1 and span_count > 9) as ocr_used,
  count(*) filter (span_count = 0) as warnings, round_even(avg(word_count), 1) as avg_words, cast(sum(span_count) as bigint) as native_spans from p""")
def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.derived(I.table(spark, sf_dir, "pages"), _PAGES)
    p = p.withColumn("needs_ocr", F.col("image_count") > 1).withColumn("used_ocr", (F.col("image_count") > 1) & (F.col("span_count") > 9))
    return scan.summarize_profiles(p.withColumn("ocr_warning", F.when(F.col("span_count") == 0, "no text")))


@QUERIES(O.grouped(norm_sql("text"), config.TAG_LIKE))
def grouped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.grouped_spans(I.spans(spark, sf_dir))


_SHEETS = {"doc_id": "0", "page_num": "n_nationkey", "text": "case when n_nationkey % 3 = 0 then 'c:/dwg/AREA-DG' || cast(7000 + n_nationkey as string) || '.dwg ok' when n_nationkey % 3 = 1 then 'Sheet No: DG' || cast(7000 + n_regionkey as string) else n_name end"}


@QUERIES(f"""
select page_num, case when page_num % 3 = 0 then regexp_extract(text, '(DG[0-9]+)', 1) else upper(regexp_extract(text, 'DG[0-9]+')) end as sheet_id
from {I.derived_sql("nation", _SHEETS)} where contains(text, 'DG')""")
def sheet_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = I.derived(I.table(spark, sf_dir, "nation"), _SHEETS)
    pages = text.selectExpr("doc_id", "page_num", "1000d as width", "800d as height")
    none = spark.createDataFrame([], "doc_id int, page_num int, span_id long, text string, x0 double, y0 double, x1 double, y1 double, size double")
    return scan.sheet_map(none, pages, text).select("page_num", "sheet_id")


_LIST = {
    "ws_name": "'list'", "row_num": "s_suppkey",
    "raw_tag": "'RL' || cast(s_suppkey % 9 as string) || '-' || s_name",
    "raw_sheet": "case s_suppkey % 5 when 0 then null when 1 then '' when 2 then 'DG' || cast(100 + s_nationkey as string) when 3 then cast(100 + s_nationkey as string) else 'DG999' end",
}


@QUERIES(f"""
with l as {I.derived_sql("supplier", _LIST)}, n as (select 'DG' || (100 + n_nationkey % 20) as sheet_id, n_nationkey as page_num from nation),
p as (select sheet_id, list(distinct page_num order by page_num) as pages from n group by sheet_id)
select row_num, case when coalesce(raw_sheet, '') = '' then null
  else coalesce((select array_to_string(pages, ',') from p where p.sheet_id = l.raw_sheet),
    case when regexp_matches(raw_sheet, '^[0-9]+$') and (select count(*) from p where ends_with(p.sheet_id, l.raw_sheet)) = 1
      then (select max(array_to_string(pages, ',')) from p where ends_with(p.sheet_id, l.raw_sheet)) end, '') end as allowed from l""")
def allowed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.derived(I.table(spark, sf_dir, "supplier"), _LIST)
    sheets = I.table(spark, sf_dir, "nation").selectExpr("'DG' || cast(100 + n_nationkey % 20 as string) as sheet_id", "n_nationkey as page_num")
    found = match.allowed_pages(rows, sheets)
    return found.select("row_num", F.array_join("allowed_pages", ",").alias("allowed"))


def _tag_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).drop("doc_id")


_ROWS = {
    "ws_name": "'list'", "row_num": "p_partkey", "k": "p_partkey",
    "root": f"'RL' || cast({I.K} % 9 as string) || '-' || {I.EQ} || '-' || cast(100 + {I.K} % 300 as string)",
    "component": f"{I.ISA} || lpad(cast({I.K} % 61 as string), 2, '0')",
}


@QUERIES(f"""
with l as (select *, root || '-' || component as full_tag, case when row_num % 4 = 0 then [row_num % 15 + 1, row_num % 5 + 1] end as allowed from {I.derived_sql("part", _ROWS)}),
t as {_SCORED},
one as (select l.row_num, t.span_id, t.page_num, 1 as tier, t.confidence, allowed from l join t on l.full_tag = t.full_tag),
two as (select l.row_num, t.span_id, t.page_num, 2 as tier, t.confidence, allowed from l join t on l.root = t.root and l.component = t.component
  where l.row_num not in (select row_num from one)),
kept as (select * from (select * from one union all select * from two) where allowed is null or list_contains(allowed, page_num)),
three as (select l.row_num, c.span_id, c.page_num, 3 as tier, 0.72 as confidence, l.allowed from l
  join t c on c.component = l.component and c.tag_class = 'instrument'
  where l.row_num not in (select row_num from kept) and (l.allowed is null or list_contains(l.allowed, c.page_num))
  and exists (select 1 from t r where r.root = l.root and r.page_num = c.page_num))
select row_num, span_id, tier, round(confidence, 6) as confidence from (select * from kept union all select * from three)""")
def tiered_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.derived(I.table(spark, sf_dir, "part"), _ROWS).withColumn("full_tag", F.concat_ws("-", "root", "component"))
    allowed = F.when(F.col("row_num") % 4 == 0, F.array((F.col("row_num") % 15 + 1).cast("int"), (F.col("row_num") % 5 + 1).cast("int")))
    found = match.tiered_matches(rows.withColumn("allowed_pages", allowed), _tag_table(spark, sf_dir))
    return found.select("row_num", F.col("seq").alias("span_id"), "tier", F.round("confidence", 6).alias("confidence"))


_UP = "regexp_replace(upper(replace({}, 'ß', 'SS')), '[^A-Z0-9]+', '', 'g')"


@QUERIES(f"""
with b as (select item_id as row_num, {_UP.format("text")} as key from benchmark),
d as (select doc_id, {_UP.format("text")} as compact from documents),
h as (select row_num, doc_id, count(*) over (partition by row_num) as n from b join d on contains(compact, key) where key <> '')
select row_num, doc_id as block_idx, n as n_hits, round(greatest(0.5::double, least(0.84::double, 0.76::double - case when n > 1 then least(0.12::double, 0.025::double * (n - 1)) else 0 end)), 6) as confidence from h""")
def block_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "benchmark").select(
        F.lit("list").alias("ws_name"), F.col("item_id").alias("row_num"), F.lit(None).cast("array<int>").alias("allowed_pages"), F.lit("line").alias("tag_class"),
        F.col("text").alias("full_tag"), F.lit("").alias("root"), F.lit("").alias("component"),
    )
    blocks = I.table(spark, sf_dir, "documents").select(
        F.lit(1).alias("page_num"), F.col("doc_id").alias("block_idx"), T.compact(F.col("text")).alias("compact"), F.lit("drawing").alias("zone"),
        *[F.lit(0.0).alias(s) for s in G.SIDES],
    )
    found = match.block_fallback(rows, blocks)
    return found.select("row_num", "block_idx", "n_hits", F.round("confidence", 6).alias("confidence"))


@QUERIES(f"""
with t as {_SCORED} select span_id from t where not exists (select 1 from t m where m.confidence >= 0.9 and m.page_num = t.page_num
  and m.full_tag = t.full_tag and round_even(m.x0, 0) = round_even(t.x0, 0) and round_even(m.y0, 0) = round_even(t.y0, 0))""")
def unmatched_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = _tag_table(spark, sf_dir)
    return match.unmatched_tags(tags, tags.filter("confidence >= 0.9")).select(F.col("seq").alias("span_id"))


def _tag_list(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = cells(spark, sf_dir).selectExpr("'list' as ws_name", "row_num", "raw as raw_tag", "case when row_num % 6 = 0 then 'DG' || cast(row_num % 30 as string) end as raw_sheet")
    sheets = _tag_table(spark, sf_dir).select("sheet_id", "page_num").distinct()
    return rows, sheets


_RECONCILED = f"""(
with l as (select *, case when row_num % 6 = 0 then 'DG' || (row_num % 30) end as raw_sheet from {_parse_sql(CELLS_SQL)}),
t as {_SCORED}, sheets as (select sheet_id, list(distinct page_num) as pages from t group by sheet_id),
a as (select l.*, case when raw_sheet is null then null else coalesce(pages, []) end as allowed from l left join sheets s on s.sheet_id = l.raw_sheet),
q as (select * from a where full_tag is not null and (allowed is null or len(allowed) > 0)),
one as (select q.row_num, t.span_id, t.page_num, t.sheet_id, t.method, t.confidence, 1 as tier, allowed from q join t on q.full_tag = t.full_tag),
two as (select q.row_num, t.span_id, t.page_num, t.sheet_id, t.method, t.confidence, 2, allowed from q join t on q.root = t.root and q.component = t.component where q.row_num not in (select row_num from one)),
kept as (select * from (select * from one union all select * from two) where allowed is null or list_contains(allowed, page_num)),
three as (select q.row_num, c.span_id, c.page_num, c.sheet_id, 'samepage:root+comp', 0.72::double, 3, q.allowed from q join t c on c.component = q.component and c.tag_class = 'instrument' and c.component <> ''
  where q.root <> '' and q.row_num not in (select row_num from kept) and (q.allowed is null or list_contains(q.allowed, c.page_num)) and exists (select 1 from t r where r.root = q.root and r.page_num = c.page_num)),
ranked as (select *, count(*) over (partition by row_num) as n, row_number() over (partition by row_num order by confidence desc, case method when 'fulltag:isa' then 1 when 'fulltag:equip' then 4 else 9 end, sheet_id, page_num, span_id) as rn
  from (select * from kept union all select * from three)),
best as (select *, case when len(allowed) > 0 then least(0.99::double, confidence + 0.05::double) else confidence end as agreed from ranked where rn = 1),
priced as (select *, case when n > 1 then greatest(0.05::double, agreed - least(0.15::double, 0.04::double * (n - 1))) else agreed end as conf from best)
select a.row_num, a.raw as raw_tag, a.raw_sheet, a.full_tag, case when a.full_tag is null then 'Unrecognized tag' when len(a.allowed) = 0 then 'No mapped sheet' when tier is not null then 'Matched' else 'Not found' end as status,
  n as n_matches, page_num as best_page, conf as confidence, case when tier is not null then {_RATE.format("conf")} end as rating, tier, list_sort(a.allowed) as allowed from a left join priced p on a.row_num = p.row_num)"""


@QUERIES(f"select * exclude (tier, allowed) from {_RECONCILED}")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag list against detected tags, one row a list row."""
    rows, sheets = _tag_list(spark, sf_dir)
    found = match.reconcile(rows, _tag_table(spark, sf_dir), sheets, mode="all")
    return found.select("row_num", "raw_tag", "raw_sheet", "full_tag", "status", "n_matches", "best_page", "confidence", "rating")


_MATCHED = "count(*) filter (starts_with(status, 'Matched')"


@QUERIES(f"""
select *, coalesce(matched / nullif(reviewed, 0)::double, 0.0::double) as match_rate from (select count(*) as reviewed, {_MATCHED}) as matched, count(*) filter (status = 'Not found') as not_found,
  count(*) filter (status = 'No mapped sheet') as no_page, {_MATCHED} and rating = 'High') as matched_high, {_MATCHED} and rating = 'Medium') as matched_medium, {_MATCHED} and rating = 'Low') as matched_low,
  count(*) filter (status = 'Unrecognized tag') as unrecognized, count(*) filter (status = 'Outside mode') as outside_mode, count(*) filter (n_matches > 1) as ambiguous from {_RECONCILED})""")
def match_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sheets = _tag_list(spark, sf_dir)
    return match.match_statistics(match.reconcile(rows, _tag_table(spark, sf_dir), sheets, mode="all"))


@QUERIES(f"""
select row_num, raw_tag, case status when 'Unrecognized tag' then 'Skipped - unrecognized tag' when 'No mapped sheet' then 'No mapped PDF sheet' when 'Not found' then 'Not found in PDF'
  else case when tier = 3 then 'Matched - same-page inference' when n_matches > 1 then 'Matched - multiple PDF occurrences' else 'Matched' end end as comparison_status,
  confidence as best_confidence, coalesce(rating, 'Low') as rating, coalesce(n_matches, 0) as pdf_occurrences, best_page,
  case when tier is not null then array_to_string(list_filter([case when len(allowed) > 0 then 'excel sheet match' end, case when n_matches > 1 then 'ambiguous x' || n_matches end], lambda x: x is not null), '; ') end as added_evidence,
  case when allowed is null then 'all pages' else array_to_string(allowed, ', ') end as allowed, case when allowed is null then 'No' else 'Yes' end as sheet_filter_used,
  case when full_tag is null then 'unrecognized tag' when allowed is null then 'no sheet column/value supplied' when len(allowed) = 0 then 'sheet value not mapped to PDF' when len(allowed) > 1 then 'duplicate sheet id' else 'mapped sheet id' end as filter_reason
from {_RECONCILED}""")
def annotated_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that an annotated tag list gets; of the evidence what the match adds."""
    rows, sheets = _tag_list(spark, sf_dir)
    found = match.reconcile(rows, _tag_table(spark, sf_dir).drop("evidence"), sheets, mode="all")
    shown = match.status_columns(found, mode="all")
    return shown.select(
        "row_num", "raw_tag", "comparison_status", "best_confidence", "rating", "pdf_occurrences", "best_page", F.col("best_evidence").alias("added_evidence"),
        "allowed", "sheet_filter_used", "filter_reason",
    )


@QUERIES(f"""
with r as (select * from {_RECONCILED}), t as (select *, {_RATE.format("confidence")} as rating from {_SCORED}),
c as (select count(*) as reviewed, count(tier) as matched, count(*) filter (tier is not null and rating = 'High') as h, count(*) filter (tier is not null and rating = 'Medium') as m,
  count(*) filter (tier is not null and rating = 'Low') as l, count(*) filter (n_matches > 1) as amb, count(*) filter (status = 'No mapped sheet') as no_page, count(*) filter (status = 'Not found') as nf,
  count(*) filter (full_tag is null) as skipped, count(*) filter (tier = 3) as same, count(*) filter (full_tag is not null and allowed is null) as every from r)
select i as position, metric, cast(value as double) as value from (select generate_subscripts(names, 1) - 1 as i, unnest(names) as metric, unnest(counts) as value from (select
  ['Rows reviewed', 'Matched rows', 'Match rate', 'High confidence matches', 'Medium confidence matches', 'Low confidence matches', 'Ambiguous matches', 'Rows without mapped page', 'Rows not found', 'Rows skipped',
   'Rows matched by block', 'Rows matched on one page', 'Rows searched across all pages', 'Candidates total', 'High confidence candidates', 'Medium confidence candidates', 'Low confidence candidates'] as names,
  [reviewed, matched, matched / reviewed::double, h, m, l, amb, no_page, nf, skipped, 0, same, every, (select count(*) from t), (select count(*) from t where rating = 'High'),
   (select count(*) from t where rating = 'Medium'), (select count(*) from t where rating = 'Low')]::double[] as counts from c))""")
def comparison_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sheets = _tag_list(spark, sf_dir)
    tags = _tag_table(spark, sf_dir)
    found = match.comparison_summary(match.reconcile(rows, tags, sheets, mode="all"), tags)
    return found.withColumn("position", F.col("position").cast("long"))


@QUERIES(f"""
with t as (select * from {_SCORED}), u as (select * from t where not exists (select 1 from t m where m.confidence >= 0.9 and m.page_num = t.page_num and m.full_tag = t.full_tag
  and round_even(m.x0, 0) = round_even(t.x0, 0) and round_even(m.y0, 0) = round_even(t.y0, 0)))
select row_number() over (order by page_num, sheet_id, zone, tag_class, confidence desc, full_tag, span_id) as position, 'Missing in Excel' as comparison_status, sheet_id, page_num, full_tag, round_even(confidence, 3) as confidence from u""")
def missing_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected tags that the list lacks, with their place in the report."""
    from drawloom.operators.placement import running_index

    tags = _tag_table(spark, sf_dir)
    rest = match.unmatched_tags(tags, tags.filter("confidence >= 0.9")).withColumn("down_", -F.col("confidence"))
    placed = running_index(rest, ["page_num", "sheet_id", "zone", "tag_class", "down_", "full_tag", "seq"])
    shown = placed.select((F.col("index") + 1).alias("position"), F.lit("Missing in Excel").alias("comparison_status"), "sheet_id", "page_num", "full_tag", F.bround("confidence", 3).alias("confidence"))
    return shown


_HEADER_ROWS = {
    "ws_name": "'w' || cast(s_suppkey % 10 as string)",
    "row_num": "cast((s_suppkey - s_suppkey % 10) / 10 as int)",
    "a": "case s_suppkey % 4 when 0 then 'Tag No.' when 1 then s_name when 2 then 'Full Tag' else 'tags' end",
    "b": "case s_suppkey % 3 when 0 then 'Drawing' when 1 then '' else 'Instrument Tag' end",
}


def _rank(x: str, words: tuple[str, ...]) -> str:
    parts = []
    for i, w in enumerate(words):
        n = len(words) - i
        more = "" if w == "tag" else f" when starts_with({x}, '{w}') then {n * 10} when contains({x}, '{w}') then {n}"
        parts.append(f"case when {x} = '{w}' then {n * 100}{more} else 0 end")
    return f"greatest({', '.join(parts)})"


@QUERIES(f"""
with r as (select ws_name, row_num, lower(trim(a)) as a, lower(trim(b)) as b from {I.derived_sql("supplier", _HEADER_ROWS)} where row_num <= 15),
s as (select *, {_rank("a", config.TAG_HEADERS)} as ta, {_rank("b", config.TAG_HEADERS)} as tb, {_rank("a", config.SHEET_HEADERS)} as sa, {_rank("b", config.SHEET_HEADERS)} as sb from r where a <> '' and b <> ''),
c as (select ws_name, row_num, case when ta >= tb then 1 else 2 end as tag_col, case when greatest(sa, sb) = 0 then null when sa >= sb then 1 else 2 end as sheet_col from s where greatest(ta, tb) > 0)
select ws_name, row_num as header_row, tag_col, coalesce(sheet_col, 0) as sheet_col from (select *, row_number() over (partition by ws_name order by sheet_col is null, row_num) as rn from c) where rn = 1""")
def header_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.derived(I.table(spark, sf_dir, "supplier"), _HEADER_ROWS)
    found = match.find_headers(rows.select("ws_name", "row_num", F.array("a", "b").alias("cells")))
    return found.select("ws_name", "header_row", F.col("tag_col").cast("int").alias("tag_col"), F.coalesce("sheet_col", F.lit(0)).cast("int").alias("sheet_col"))


@QUERIES(f"""with recursive {O.kept_boxes(f"(select doc_id, page_num, span_id as seq, span_id % 7 as priority, x0, y0, x1, y1 from {SPANS_SQL})", "doc_id, page_num", "priority desc, seq", 0.2)} select * from kept""")
def nms_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = I.spans(spark, sf_dir).select("doc_id", "page_num", F.col("span_id").alias("seq"), (F.col("span_id") % 7).alias("priority"), *G.SIDES)
    return match.suppress_overlaps(boxes)


@QUERIES(f"""
with n as {_SCORED}, o as (select * from n where zone <> 'edge'),
last as (select *, row_number() over (partition by doc_id, page_num, sheet_id, tag_class, full_tag order by span_id desc) as rn from (select * from n where method = 'fulltag:isa' or zone = 'drawing'))
select span_id, case when rn = 1 and h > 0 then 'matched' else 'native-only' end as source_agreement from (
  select l.*, (select count(*) from o where o.doc_id = l.doc_id and o.page_num = l.page_num and o.sheet_id = l.sheet_id and o.tag_class = l.tag_class and o.full_tag = l.full_tag) as h from last l)
union all select span_id, 'ocr-only' from o where not exists (select 1 from last l where o.doc_id = l.doc_id and o.page_num = l.page_num and o.sheet_id = l.sheet_id and o.tag_class = l.tag_class and o.full_tag = l.full_tag)""")
def fuse_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = _scored(spark, sf_dir)
    native = tags.filter("method = 'fulltag:isa' or zone = 'drawing'").withColumn("text_source", F.lit("native")).withColumn("source_agreement", F.lit("native-only"))
    ocr = tags.filter("zone <> 'edge'").withColumn("text_source", F.lit("ocr")).withColumn("source_agreement", F.lit("ocr-only"))
    return scan.fuse_sources(native, ocr).select(F.col("seq").alias("span_id"), "source_agreement")
