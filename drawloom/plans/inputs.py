"""Inputs of the queries, derived from the driver tables by expressions that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: str, values: list[str]) -> str:
    whens = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values))
    return f"(case {key} % {len(values)} {whens} end)"


K = "p_partkey"
ISA = _pick(K, ["HV", "PI", "FCV", "LIT", "TT", "PSV", "XV", "FIC", "TE", "PG", "BV", "PMP"])
EQ = _pick(K, ["TNK", "PMP", "CHR", "VBU", "BIN"])
S = "cast({} as string)".format
_TEXT = f"""(case {K} % 8
 when 0 then {EQ} || {S(f"20000 + {K} % 700")}
 when 1 then 'RL' || {S(f"{K} % 9")} || '-' || {EQ} || '-' || {S(f"100 + {K} % 300")} || '-' || {ISA} || '-' || lpad({S(f"{K} % 60")}, 2, '0')
 when 2 then {ISA} || '-' || lpad({S(f"{K} % 90")}, 3, '0')
 when 3 then '3/4"-CA-' || {S(f"{K} % 40")} || 'A-EL-1'
 when 4 then p_name || ' filename: ' || {EQ} || {S(f"30000 + {K} % 9")}
 when 5 then 'RL7-PMP' || {S(f"100 + {K} % 300")}
 when 6 then {_pick(K + " % 5", ["HV", "PI", "XV", "TR", "BV"])}
 else 'RM' || {S(f"{K} % 5")} || '-' || {S(f"1000 + {K} % 40")} || '-CHR' || lpad({S(f"{K} % 99")}, 3, '0') end)"""
#: Positioned text on pages of 5 documents, 133 spans each at most.
SPANS = {
    "doc_id": f"{K} % 5",
    "page_num": f"cast({K} % 15 + 1 + ({K} - {K} % 2000) / 2000 * 15 as int)",
    "span_id": K,
    "text": _TEXT,
    "x0": f"cast({K} % 2 * 100 + {K} % 15 * 60 as double)",
    "y0": f"cast({K} * 7 % 31 * 24 as double)",
    "x1": f"cast({K} % 2 * 100 + {K} % 15 * 60 + 75 as double)",
    "y1": f"cast({K} * 7 % 31 * 24 + 10 as double)",
    "size": f"cast(8 + {K} % 3 as double)",
}
WIDTH, HEIGHT = 1000.0, 800.0
#: Words in one row a customer.
WORDS = {
    "doc_id": "0",
    "page_num": "o_custkey",
    "row_index": "0",
    "seq": "o_orderkey",
    "x0": "cast((o_orderkey * 13) % 3000 as double)",
    "y0": "0.0d",
    "x1": "cast((o_orderkey * 13) % 3000 + 20 + o_orderkey % 7 * 10 as double)",
    "y1": "cast(8 + o_orderkey % 5 as double)",
    "word": "o_orderpriority || cast(o_orderkey % 10 as string)",
}
#: Two revisions of a set of sheets: some sheets only in one, some twice, some without id.
SHEETS_BEFORE = {
    "seq": "o_orderkey",
    "path": "'before/' || cast(o_orderkey as string)",
    "sheet_id": "case when o_orderkey % 11 = 0 then null else 'DT' || lpad(cast((o_orderkey - o_orderkey % 4) % 9000 as string), 4, '0') end",
    "revision": "case o_orderkey % 5 when 0 then 'A' when 1 then 'B' when 2 then '3' when 3 then null else 'c' end",
    "family": "'detail'",
    "failed": "o_orderkey % 97 = 0",
    "kept": "o_orderstatus <> 'P'",
}
SHEETS_AFTER = SHEETS_BEFORE | {
    "path": "'after/' || cast(o_orderkey as string)",
    "revision": "case o_orderkey % 7 when 0 then 'B' when 1 then 'A' when 2 then '4' when 3 then 'rev9' else null end",
    "family": "'area_plan'",
    "kept": "o_orderpriority <> '5-LOW'",
}


def derived(source: DataFrame, columns: dict[str, str]) -> DataFrame:
    return source.selectExpr(*[f"{e} as {n}" for n, e in columns.items()])


def derived_sql(source: str, columns: dict[str, str]) -> str:
    shown = ", ".join(f"{e} as {n}" for n, e in columns.items()).replace("0.0d", "0.0::double")
    return f"(select {shown} from {source})"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(table(spark, sf_dir, "part"), SPANS)


SPANS_SQL = derived_sql("part", SPANS)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(spark, sf_dir).select("doc_id", "page_num").distinct()
    return found.selectExpr("*", f"{WIDTH}d as width", f"{HEIGHT}d as height")


def listed(values: tuple[str, ...]) -> str:
    """An SQL list of strings."""
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


#: Token normalisation in the other engine; its upper() keeps the sharp s.
def norm_sql(x: str) -> str:
    up = f"upper(replace(coalesce({x}, ''), 'ß', 'SS'))"
    plain = f"regexp_replace({up}, '[\\x{{2010}}-\\x{{2014}}]', '-', 'g')"
    plain = f"translate({plain}, chr(160) || chr(9), '  ')"
    return f"trim(trim(regexp_replace({plain}, '\\s+', ' ', 'g')), '.,;:()[]{{}}<>\"''')"
