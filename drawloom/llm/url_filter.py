"""URL filters as a temporal list join.

A dated list holds entries (pattern, kind, category, action, since): from
``since`` on the pattern is listed (``add``) or no longer listed (``remove``).
Entries of one pattern and category become validity intervals [since, until),
and every capture is judged against the entries that were active when it was
fetched; a removal without a category ends the pattern in all of them.

Kinds: ``host`` matches the host itself, ``domain`` it and all hosts below it,
``prefix`` a host and path prefix that ends at a path border, ``allow`` a host
that no entry blocks.  A capture asks for its few candidate keys (its host, the
domains above it, its path prefixes), so the join is an equality join on the
key with the interval as a further condition.  Captures are grouped by host,
path head and day first, so a host with a third of all captures asks once a day
and not once a capture; questions and patterns that very many rows share are
joined by broadcast.

Nulls: a null or unparsable URL has no host and is never blocked; a null fetch
time sees no entry; entries without pattern or date are ignored.  Of entries of
one pattern, kind, category and date the removal counts.  Repeated captures get a row
each; an empty list blocks nothing, and no captures give no rows.  URLs of any
length are read whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawloom.llm.common import cut, lookup

#: Kind of the host itself that a domain entry with a leading www lists besides the hosts below it.
WWW = "www"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def plain_host(host: Column) -> Column:
    """A host in lower case, without a leading www or a closing dot."""
    return F.regexp_replace(F.rtrim(F.lower(host), F.lit(".")), r"^www\.", "")


def host_of(url: Column) -> Column:
    """The plain host of a URL; null where there is none."""
    host = plain_host(F.regexp_extract(url, HOST, 1))
    return F.when(host != "", host)


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def path_head(url: Column, depth: int | None = None) -> Column:
    """The first ``depth`` segments of the path, or all; paths keep their case."""
    segments = _segments(F.regexp_extract(url, PATH, 1))
    return F.array_join(segments if depth is None else F.slice(segments, 1, depth), "/")


def candidate_keys(host: Column, head: Column) -> Column:
    """Structs (kind, pattern) that may list a capture."""
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")),
    )
    parts = _segments(head)
    prefixes = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(parts)), lambda i: i > 0),
        lambda i: F.struct(
            F.lit("prefix").alias("kind"),
            F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("pattern"),
        ),
    )
    exact = F.array(*[F.struct(F.lit(k).alias("kind"), host.alias("pattern")) for k in ("host", "allow", WWW)])
    return F.when(host.isNotNull(), F.concat(exact, domains, prefixes))


def plain_entries(entries: DataFrame) -> DataFrame:
    """Entries with hosts and paths written as ``host_of`` and ``path_head`` write those of captures."""
    dated = entries.filter("pattern is not null and since is not null")
    pattern = F.col("pattern")
    host = F.substring_index(pattern, "/", 1)
    path = F.array_join(_segments(F.substring(pattern, F.length(host) + 2, F.length(pattern))), "/")
    bare = F.rtrim(F.lower(pattern), F.lit("."))
    both = F.array(
        F.struct(F.col("kind").alias("kind"), bare.alias("pattern")),
        F.struct(F.lit(WWW).alias("kind"), plain_host(pattern).alias("pattern")),
    )
    one = F.when(F.col("kind") == "prefix", F.concat(plain_host(host), F.lit("/"), path)).otherwise(plain_host(pattern))
    own = F.array(F.struct(F.col("kind").alias("kind"), one.alias("pattern")))
    split = (F.col("kind") == "domain") & bare.startswith("www.")
    named = dated.withColumn("k__", F.explode(F.when(split, both).otherwise(own)))
    return named.select("k__.kind", "k__.pattern", "category", "action", "since")


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, pattern, category, since, until) during which a pattern is listed."""
    plain = plain_entries(entries)
    general = (F.col("action") == "remove") & F.col("category").isNull()  # ends the pattern in every category
    listed = plain.filter("action = 'add'").select("kind", "pattern", "category").distinct()
    ended = plain.filter(general).drop("category").join(listed, ["kind", "pattern"])
    plain = plain.filter(~general).unionByName(ended)
    last = F.max_by("action", (F.col("action") == "remove").cast("int"))
    dated = plain.groupBy("kind", "pattern", "category", "since").agg(last.alias("action"))
    own = Window.partitionBy("kind", "pattern", "category").orderBy("since")
    spans = dated.select("kind", "pattern", "category", "action", "since", F.lead("since").over(own).alias("until"))
    return spans.filter("action = 'add'").drop("action")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per capture (page_id, url, fetched): page_id, host, fetched, n_active, categories, blocked."""
    listed = cut(intervals(entries))
    segments = F.size(_segments(F.col("pattern"))) - 1
    depth = listed.filter("kind = 'prefix'").agg(F.max(segments)).first()[0] or 0  # the deepest prefix listed
    rows = captures.select(
        "page_id", "fetched", host_of(F.col("url")).alias("host"), F.coalesce(path_head(F.col("url"), depth), F.lit("")).alias("head")
    )
    seen = F.col("host").isNotNull() & F.col("fetched").isNotNull()
    rows = rows.withColumn("ask", F.when(seen, F.struct("host", "head", "fetched")))
    asked = rows.filter(seen).groupBy("ask").agg(F.count(F.lit(1)).alias("captures")).select("ask.*", "ask", "captures")
    keys = asked.select("ask", "fetched", F.explode(candidate_keys(F.col("host"), F.col("head"))).alias("key"))
    spans = F.collect_list(F.struct("category", "since", "until")).alias("spans")  # a pattern's own history
    by_key = cut(listed.groupBy(F.struct("kind", "pattern").alias("key")).agg(spans))
    met = lookup(keys, by_key, "key", None, by_key.count())
    now = F.filter(
        "spans", lambda s: (s["since"] <= F.col("fetched")) & (s["until"].isNull() | (F.col("fetched") < s["until"]))
    )
    active = met.filter("spans is not null").select("ask", F.col("key.kind").alias("kind"), F.explode(now).alias("s"))
    blocking = F.col("kind") != "allow"
    verdict = active.groupBy("ask").agg(
        F.count_if(blocking).alias("n_active"),
        F.array_join(F.array_sort(F.collect_set(F.when(blocking, F.col("s.category")))), ",").alias("categories"),
        (F.count_if(blocking) > 0).alias("hit"),
        (F.count_if(~blocking) > 0).alias("allowed"),
    )
    verdict = cut(verdict.join(asked.select("ask", "captures"), "ask"))
    n, total = verdict.agg(F.count(F.lit(1)), F.sum("captures")).first()
    found = lookup(rows, verdict, "ask", "captures", n, total or 0)
    return found.select(
        "page_id",
        "host",
        "fetched",
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("categories", F.lit("")).alias("categories"),
        F.coalesce(F.col("hit") & ~F.col("allowed"), F.lit(False)).alias("blocked"),
    )


def keep_allowed(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The captures that are not blocked, all columns kept."""
    blocked = filter_urls(captures, entries).filter("blocked").select("page_id", "fetched").distinct()
    same = captures["page_id"].eqNullSafe(blocked["page_id"]) & captures["fetched"].eqNullSafe(blocked["fetched"])
    return captures.join(blocked, same, "left_anti")
