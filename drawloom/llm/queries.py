"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawloom.llm import bpe, chat, exact_dedup, mixing, pii, quality, sharding, simhash, token_scan, url_filter


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file, as installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    return found.withColumn("clean_sha256", F.sha2("clean_text", 256)).drop("clean_text")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(table(spark, sf_dir, "documents"))
    shards = F.transform("copies", lambda c: F.concat_ws(":", c["pass"], c["block"], c["shard"], c["words"], c["place"]))
    return mix.select("doc_id", "size", "source_size", "target", "taken", F.array_join(shards, ",").alias("shards"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = url_filter.filter_urls(captures_of(pages), dated_list(pages))
    return found.withColumn("fetched", F.col("fetched").cast("string"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.read_back(chat.format_records(chat.turn_rows(rows.union(extra))))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = token_scan.count_tokens(docs, tokenizer_path("byte_bpe_50k.tiktoken"), eod=50256)
    return counts.select("doc_id", "n_tokens")


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a day of fetching, by a rule: the tables hold none."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts, domains and path prefixes of the pages, by a rule of their hashes."""
    url = F.col("url")
    hosts = pages.select(url_filter.host_of(url).alias("host"), url_filter.path_head(url).alias("head"))
    hosts = hosts.select("host", F.split("head", "/")[0].alias("seg")).distinct().filter("host is not null")
    parent = F.regexp_replace("host", r"^[^.]+\.", "")
    rules = (
        ("host", F.col("host"), 3),
        ("domain", parent, 5),
        ("allow", F.col("host"), 7),
        ("prefix", F.concat_ws("/", "host", F.coalesce("seg", F.lit(""))), 4),
    )
    offered = F.array(
        *[F.struct(F.lit(k).alias("kind"), p.alias("pattern"), F.lit(n).alias("every")) for k, p, n in rules]
    )
    rows = hosts.select(F.explode(offered).alias("o")).select("o.*").distinct()
    code = F.conv(F.substring(F.md5(F.concat_ws(":", "kind", "pattern")), 1, 4), 16, 10).cast("int")
    rows = rows.withColumn("code", code).filter("code % every = 0")
    start = F.lit("2024-01-01").cast("date")
    events = F.array(
        F.struct(F.lit("add").alias("action"), F.date_add(start, F.col("code") % 180).alias("since")),
        F.struct(
            F.lit("remove").alias("action"),
            F.date_add(start, F.col("code") % 180 + F.col("code") % 90 + 1).alias("since"),
        ),
        F.struct(F.lit("add").alias("action"), F.date_add(start, F.col("code") % 180 + 200).alias("since")),
    )
    several = F.slice(events, F.lit(1), F.col("code") % 3 + 1)
    category = F.element_at(F.array(*map(F.lit, ("spam", "adult", "malware"))), F.col("code") % 3 + 1)
    return rows.select("kind", "pattern", category.alias("category"), F.explode(several).alias("e")).select(
        "kind", "pattern", "category", "e.action", "e.since"
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_exact_dedup,
        op3_mixing,
        op4_sharding,
        op5_url_filters,
        op6_quality_rules,
        op7_bpe,
        op8_chat_formatting,
        op9_simhash_near_dedup,
        op10_token_counts,
    )
}
SQL: dict[str, str] = {}
SQL["op2_exact_dedup"] = r"""
with n as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = min(doc_id) over w as kept, sha256(norm) as text_sha256
from n window w as (partition by norm)
"""
SQL["op5_url_filters"] = r"""
with c as (
  select page_id, cast(date '2024-01-01' + cast(page_id * 37 % 366 as int) as date) as fetched,
         nullif(regexp_replace(rtrim(lower(regexp_extract(url,
           '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '^www\.', ''), '') as host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'),
           lambda s: s <> '')[1:2] as segs
  from pages),
offered as (
  select 'host' as kind, host as pattern, 3 as every from c where host is not null
  union select 'domain', regexp_replace(host, '^[^.]+\.', ''), 5 from c where host is not null
  union select 'allow', host, 7 from c where host is not null
  union select 'prefix', host || '/' || coalesce(segs[1], ''), 4 from c where host is not null),
coded as (
  select *, cast('0x' || substr(md5(kind || ':' || pattern), 1, 4) as int) as code from offered),
entries as (
  select kind, pattern, ['spam', 'adult', 'malware'][code % 3 + 1] as category, e.action,
         cast(date '2024-01-01' + e.days as date) as since
  from (select *, unnest([{'action': 'add', 'days': code % 180},
                          {'action': 'remove', 'days': code % 180 + code % 90 + 1},
                          {'action': 'add', 'days': code % 180 + 200}][1:code % 3 + 1]) as e
        from coded where code % every = 0)),
spans as (
  select *, lead(since) over (partition by kind, pattern order by since) as until from entries),
listed as (select * from spans where action = 'add'),
keys as (
  select distinct page_id, fetched, k.kind as kind, k.pattern as pattern from (
    select page_id, fetched, unnest(list_concat(
      [{'kind': 'host', 'pattern': host}, {'kind': 'allow', 'pattern': host}],
      list_transform(range(1, len(string_split(host, '.')) + 1),
        lambda i: {'kind': 'domain', 'pattern': array_to_string(string_split(host, '.')[i:], '.')}),
      list_transform(range(1, len(segs) + 1),
        lambda i: {'kind': 'prefix', 'pattern': host || '/' || array_to_string(segs[1:i], '/')}))) as k
    from c where host is not null)),
verdict as (
  select page_id, fetched, count(*) filter (k.kind <> 'allow') as n_active,
         array_to_string(list_sort(list_distinct(list(category) filter (k.kind <> 'allow'))), ',') as categories,
         count(*) filter (k.kind = 'allow') as n_allow
  from keys k join listed l on k.kind = l.kind and k.pattern = l.pattern
  where since <= fetched and (until is null or fetched < until) group by page_id, fetched)
select c.page_id, c.host, cast(c.fetched as varchar) as fetched, coalesce(n_active, 0) as n_active, coalesce(categories, '') as categories,
       coalesce(n_active > 0 and n_allow = 0, false) as blocked
from c left join verdict v on c.page_id = v.page_id
"""
SQL["op8_chat_formatting"] = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -7, i, ['user', 'assistant'][i + 1], '\### Assistant: </turn> ok' from range(2) r(i))
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(role) + length(text) + 16
         + length(regexp_replace(role || text, '[^\\<]', '', 'g'))) as bigint) as formatted_chars,
       cast(0 as bigint) as n_problems
from t group by conv_id
"""
