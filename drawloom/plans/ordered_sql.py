"""SQL of queries whose result depends on order: recursive walks that carry the state from row to row."""

from __future__ import annotations

from drawloom.plans.inputs import SPANS_SQL

PAGE = "doc_id, page_num"


def same_page(a: str, b: str) -> str:
    return f"{a}.doc_id = {b}.doc_id and {a}.page_num = {b}.page_num"


def shared_area(a: str, b: str) -> str:
    """Shared area over the smaller area of two boxes with the prefixes ``a`` and ``b``."""
    side = lambda lo, hi: f"greatest(0.0::double, least({a}{hi}, {b}{hi}) - greatest({a}{lo}, {b}{lo}))"
    area = lambda x: f"(greatest({x}x1 - {x}x0, 0.0::double) * greatest({x}y1 - {x}y0, 0.0::double))"
    return f"({side('x0', 'x1')} * {side('y0', 'y1')} / greatest(least({area(a)}, {area(b)}), 1e-9::double))"


def kept_boxes(source: str, keys: str, order: str, most: float) -> str:
    """CTEs of the boxes of ``source`` that keep ``most`` distance from those kept before: table ``kept`` with all columns."""
    same = " and ".join(f"o.{k.strip()} = w.{k.strip()}" for k in keys.split(","))
    return f"""
o as (select *, row_number() over (partition by {keys} order by {order}) as n_ from {source}),
w as (select {keys}, 0::bigint as n_, [] :: struct(x0 double, y0 double, x1 double, y1 double)[] as have, null::bigint as seq from (select distinct {keys} from o)
  union all select {", ".join("o." + k.strip() for k in keys.split(","))}, o.n_, case when len(list_filter(have, lambda b: {shared_area("b.", "o.")} > {most})) = 0
    then list_append(have, {{'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1}}) else have end,
    case when len(list_filter(have, lambda b: {shared_area("b.", "o.")} > {most})) = 0 then o.seq end from w join o on {same} and o.n_ = w.n_ + 1),
kept as (select o.* exclude (n_) from o join w on {same} and o.n_ = w.n_ where w.seq is not null)"""


_WORDS = f"(select doc_id, page_num, span_id as seq, x0, y0 + span_id % 3 as y0, x1, y1 + span_id % 3 as y1, text as word from {SPANS_SQL})"
#: Table ``rows_`` of words with their row_index: words join a row while its running mean centre is near.
WORD_ROWS = f"""
wp as (select *, (y0 + y1) / 2 as c, greatest(3.0::double, 0.75::double * median(y1 - y0) over (partition by {PAGE})) as near,
  row_number() over (partition by {PAGE} order by (y0 + y1) / 2, x0, seq) as n from {_WORDS}),
wr as (select {PAGE}, n, 0 as row_index, c as total, 1 as cnt from wp where n = 1
  union all select p.doc_id, p.page_num, p.n, case when abs(p.c - r.total / r.cnt) > p.near then r.row_index + 1 else r.row_index end,
    case when abs(p.c - r.total / r.cnt) > p.near then p.c else r.total + p.c end, case when abs(p.c - r.total / r.cnt) > p.near then 1 else r.cnt + 1 end
  from wr r join wp p on {same_page("p", "r")} and p.n = r.n + 1),
rows_ as (select p.doc_id, p.page_num, p.seq, p.x0, p.y0, p.x1, p.y1, p.word, r.row_index from wp p join wr r on {same_page("p", "r")} and p.n = r.n)"""
WORD_ROWS_SQL = f"with recursive {WORD_ROWS} select * from rows_"

_HAS_ID = """(len(list_filter(list_transform(regexp_extract_all(lower({0}), '[a-z0-9-]+'), lambda t: regexp_extract(t, '[a-z0-9]+-[a-z0-9].*')),
  lambda t: regexp_matches(t, '[a-z]') and regexp_matches(t, '[0-9]'))) > 0)""".format
_KEY = "substr(sha1(regexp_replace(trim(lower(array_to_string({0}[1:3], '|'))), '\\s+', ' ', 'g')), 1, 12)".format
_PLAIN = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))".format
_FOLDS = f"""(trim(s.text) <> '' and case when starts_with(trim(s.text), '(') then {_HAS_ID("w.text")}
  when regexp_matches(lower(trim(s.text)), '^([0-9]+([^a-z0-9_]|$)|[a-z]{{1,6}}-[0-9])') or {_HAS_ID("s.text")} then false
  else (len(regexp_extract_all(s.text, '\\S+')) <= 6 or length(trim(s.text)) <= 36) and abs(s.x0 - w.x0) <= 36 and s.y0 - w.y1 between 0 and 18 and {_HAS_ID("w.text")} end)"""
MERGED_ROWS_SQL = f"""
with recursive {WORD_ROWS},
g as (select *, x0 - lag(x1) over (partition by {PAGE}, row_index order by x0, seq) as gap,
  greatest(18, 1.5 * median(y1 - y0) over (partition by {PAGE}, row_index)) as lim from rows_),
c as (select *, sum(case when coalesce(gap, 0) > lim then 1 else 0 end) over (partition by {PAGE}, row_index order by x0, seq rows unbounded preceding) as cell from g),
t as (select {PAGE}, row_index, cell, trim(string_agg(word, ' ' order by x0, seq)) as text, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from c group by all),
s as (select *, row_number() over (partition by {PAGE} order by row_index) as n from (
  select {PAGE}, row_index, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, list(text order by cell) as cells, string_agg(text, ' ' order by cell) as text
  from t where text <> '' group by {PAGE}, row_index) where length(text) >= 2),
w as (select {PAGE}, n, row_index, x0, y0, x1, y1, cells, text, {_PLAIN("text")} as normalized_text, {_KEY("cells")} as key from s where n = 1
  union all select s.doc_id, s.page_num, s.n, case when f then w.row_index else s.row_index end, case when f then least(w.x0, s.x0) else s.x0 end,
    case when f then least(w.y0, s.y0) else s.y0 end, case when f then greatest(w.x1, s.x1) else s.x1 end, case when f then greatest(w.y1, s.y1) else s.y1 end,
    case when f then list_concat(w.cells, s.cells) else s.cells end, case when f then w.text || ' ' || s.text else s.text end,
    case when f then {_PLAIN("w.text || ' ' || s.text")} else {_PLAIN("s.text")} end, case when f then {_KEY("list_concat(w.cells, s.cells)")} else {_KEY("s.cells")} end
  from w join s on {same_page("s", "w")} and s.n = w.n + 1, lateral (select {_FOLDS} as f))
select {PAGE}, row_index, x0, y0, x1, y1, cells, text, normalized_text, key from (
  select *, row_number() over (partition by {PAGE}, row_index order by n desc) as last from w) where last = 1"""

#: Regions join the first seed within 80 units; a region near no seed is one.
MERGED_REGIONS_SQL = f"""
with recursive s as (select *, span_id as region_id, row_number() over (partition by {PAGE} order by y0, x0, span_id) as n from {SPANS_SQL}),
w as (select {PAGE}, 0::bigint as n, [] :: struct(id bigint, x0 double, y0 double, x1 double, y1 double)[] as seeds, null::bigint as seed from (select distinct {PAGE} from s)
  union all select doc_id, page_num, n, case when home is null then list_append(seeds, {{'id': region_id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}) else seeds end, coalesce(home, region_id)
  from (select s.*, w.seeds, list_filter(w.seeds, lambda b: greatest(s.x0 - b.x1, b.x0 - s.x1, s.y0 - b.y1, b.y0 - s.y1) <= 80)[1].id as home
    from w join s on {same_page("s", "w")} and s.n = w.n + 1)),
m as (select s.doc_id, s.page_num, w.seed as region_id, 'general' as kind, min(s.x0) as x0, min(s.y0) as y0, max(s.x1) as x1, max(s.y1) as y1, string_agg(s.text, chr(10) order by s.n) as text
  from s join w on {same_page("s", "w")} and s.n = w.n group by s.doc_id, s.page_num, w.seed)
select * exclude (r_) from (select *, row_number() over (partition by {PAGE} order by length(text) desc, region_id) as r_ from m) where r_ <= 8"""

MASK_SQL = """
with recursive t as (select distinct p_partkey % 40 as id, cast(floor((p_partkey * 7919) % 65536 / 256 / 16) as int) as ty, cast(floor((p_partkey * 7919) % 65536 % 256 / 16) as int) as tx from part),
r as (select id, ty, tx, ty as sy, tx as sx from t
  union select t.id, t.ty, t.tx, r.sy, r.sx from r join t on t.id = r.id and abs(t.ty - r.ty) <= 1 and abs(t.tx - r.tx) <= 1),
c as (select id, ty, tx, min(sy * 16 + sx) as root from r group by all),
b as (select id, cast(min(tx) * 16 as double) as x0, cast(min(ty) * 16 as double) as y0, cast(max(tx) * 16 + 16 as double) as x1, cast(max(ty) * 16 + 16 as double) as y1 from c group by id, root)
select * exclude (n) from (select *, row_number() over (partition by id order by (x1 - x0) * (y1 - y0) desc, x0, y0, x1, y1) as n from b) where n <= 72"""



def greedy(source: str, left: str, right: str, order: str, name: str = "taken") -> str:
    """CTEs of table ``name``: a candidate that is the first of both its ends is taken, and what it blocks leaves."""
    w = f"{name}_w"
    return f"""
{w} as (select *, false as got from {source}
  union all select * exclude (best, used_l, used_r) from (
    select * exclude (got), max(best) over (partition by {left}) as used_l, max(best) over (partition by {right}) as used_r, best = 1 as got from (
      select *, case when row_number() over (partition by {left} order by {order}) = 1 and row_number() over (partition by {right} order by {order}) = 1 then 1 else 0 end as best from {w} where not got))
  where got or (used_l = 0 and used_r = 0)),
{name} as (select * exclude (got) from {w} where got)"""


GREEDY_SQL = f"""with recursive s as (select l_suppkey, l_partkey, max(l_extendedprice) as score from lineitem group by all),
{greedy("s", "l_suppkey", "l_partkey", "score desc, l_suppkey, l_partkey")} select * from taken"""


def ratios(source: str, name: str = "ratios") -> str:
    """CTEs of table ``name`` (x, y, ratio) over the pairs (x, y) of ``source``: the longest common block, the first one, then left and right of it."""
    q = f"{name}_q"
    return f"""
{q} as (select x, y, x as a, y as b, 0::bigint as m from (select distinct x, y from {source})
  union all select x, y, p.a, p.b, p.m from (select x, y, unnest([
      {{'a': substr(a, 1, i - 1), 'b': substr(b, 1, strpos(b, part) - 1), 'm': k}}, {{'a': substr(a, i + k), 'b': substr(b, strpos(b, part) + k), 'm': 0}}]) as p
    from (select *, best.k as k, -best.i as i, substr(a, -best.i, best.k) as part from (select *, list_max(flatten(list_transform(range(1, length(a) + 1),
      lambda i: list_transform(range(1, length(a) - i + 2), lambda k: case when contains(b, substr(a, i, k)) then {{'k': k, 'i': -i}} end)))) as best from {q} where a <> '' and b <> '') where best is not null))),
{name} as (select x, y, case when x = y then 1.0::double else 2.0::double * sum(m) / (length(x) + length(y)) end as ratio from {q} group by x, y)"""


def stacked(roots: str, children: str) -> str:
    """CTEs of table ``pairs`` (parent, child): roots in reading order take their best free child of the tables given."""
    wide = "(a.x1 - a.x0 >= a.y1 - a.y0)"
    overlap = lambda lo, hi: f"case when least(a.{hi} - a.{lo}, b.{hi} - b.{lo}) > 0 then greatest(0.0::double, least(a.{hi}, b.{hi}) - greatest(a.{lo}, b.{lo})) / least(a.{hi} - a.{lo}, b.{hi} - b.{lo}) else 0.0::double end"
    return f"""
near as (select a.doc_id, a.page_num, a.span_id as parent, a.y0, a.x0, b.span_id as child, case when {wide} then a.y1 - a.y0 else a.x1 - a.x0 end as line,
  case when {wide} then b.y0 - a.y1 else b.x0 - a.x1 end as gap, case when {wide} then {overlap("x0", "x1")} else {overlap("y0", "y1")} end as shared,
  abs(a.size - b.size) / greatest(a.size, 1.0::double) as sized
  from {roots} a join {children} b on {same_page("a", "b")} and a.span_id <> b.span_id and {wide} = (b.x1 - b.x0 >= b.y1 - b.y0)),
stack as (select {PAGE}, parent, list(child order by gap * (1.0::double - 0.5::double * shared) + 5.0::double * sized, child) as options,
  row_number() over (partition by {PAGE} order by y0, x0, parent) as n from near
  where gap >= -0.3 * line and gap <= 2.0 * line and shared >= 0.5 group by {PAGE}, parent, y0, x0),
walk as (select {PAGE}, 0::bigint as n, [] :: bigint[] as used, null::bigint as parent, null::bigint as child from (select distinct {PAGE} from stack)
  union all select doc_id, page_num, n, case when got is null then used else list_append(used, got) end, parent, got
  from (select s.*, w.used, list_filter(s.options, lambda x: not list_contains(w.used, x))[1] as got from walk w join stack s on {same_page("s", "w")} and s.n = w.n + 1)),
pairs as (select {PAGE}, parent, child from walk where child is not null)"""


def grouped(norm: str, tag_like: str) -> str:
    """Lines of neighbouring spans, each joining the first line whose last span it shares a line with, and their windows."""
    wide = lambda a: f"({a}.x1 - {a}.x0 >= {a}.y1 - {a}.y0)"

    def beside(lo: str, hi: str) -> str:
        shared = f"greatest(0.0::double, least(l.{hi}, s.{hi}) - greatest(l.{lo}, s.{lo})) / greatest(1.0::double, least(l.{hi} - l.{lo}, s.{hi} - s.{lo}))"
        return f"({shared} >= 0.45 or abs((l.{lo} + l.{hi}) / 2 - (s.{lo} + s.{hi}) / 2) <= greatest(l.{hi} - l.{lo}, s.{hi} - s.{lo}))"

    last = "struct(no bigint, x0 double, y0 double, x1 double, y1 double)"
    fits = f"{wide('l')} = {wide('s')} and case when {wide('s')} then {beside('y0', 'y1')} else {beside('x0', 'x1')} end"
    now = lambda no: f"{{'no': {no}, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}"
    return f"""
with recursive s as (select *, row_number() over (partition by {PAGE} order by case when x1 - x0 >= y1 - y0 then y0 else x0 end, case when x1 - x0 >= y1 - y0 then x0 else y0 end, span_id) as n
  from {SPANS_SQL} where trim(text) <> ''),
w as (select {PAGE}, 0::bigint as n, [] :: {last}[] as lines, null::bigint as line from (select distinct {PAGE} from s)
  union all select doc_id, page_num, n, case when home is null then list_append(lines, {now("cast(len(lines) as bigint)")})
    else list_transform(lines, lambda l: case when l.no = home then {now("home")} else l end) end, coalesce(home, cast(len(lines) as bigint))
  from (select s.*, w.lines, list_filter(w.lines, lambda l: {fits})[1].no as home from w join s on {same_page("s", "w")} and s.n = w.n + 1)),
p as (select s.* exclude (n), w.line, row_number() over (partition by s.doc_id, s.page_num, w.line order by case when {wide("s")} then s.x0 else s.y0 end, case when {wide("s")} then s.y0 else s.x0 end, s.span_id) as i
  from s join w on {same_page("s", "w")} and s.n = w.n),
g as (select *, case when {wide("p")} then lead(x0) over nxt - x1 else lead(y0) over nxt - y1 end as gap, greatest(y1 - y0, lead(y1 - y0) over nxt, 1.0::double) as h from p
  window nxt as (partition by {PAGE}, line order by i)),
j as (select *, coalesce(gap >= -0.5 * h and gap <= greatest(22.0::double, 3.0::double * h), false) as joined from g),
e as (select a.doc_id, a.page_num, a.line, a.i, b.i as last from j a join j b on {same_page("a", "b")} and a.line = b.line and b.i between a.i + 1 and a.i + 5),
v as (select e.doc_id, e.page_num, e.line, e.i, e.last, string_agg(j.text, ' ' order by j.i) as raw, min(j.x0) as x0, min(j.y0) as y0, max(j.x1) as x1, max(j.y1) as y1, max(j.size) as size,
  list(j.span_id order by j.i) as grouped_from, bool_and(j.joined or j.i = e.last) as whole
  from e join j on {same_page("j", "e")} and j.line = e.line and j.i between e.i and e.last group by e.doc_id, e.page_num, e.line, e.i, e.last),
t as (select *, trim(regexp_replace(regexp_replace(regexp_replace(raw, '\\s*-\\s*', '-', 'g'), '\\s*"\\s*', '"', 'g'), '\\s+', ' ', 'g')) as text from v where whole)
select {PAGE}, text, x0, y0, x1, y1, size, grouped_from from (select *, {norm} as norm from t)
where length(norm) >= 4 and regexp_matches(norm, '[0-9]') and regexp_matches(norm, '{tag_like}')"""
