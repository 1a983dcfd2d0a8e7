"""Exact deduplication by skew-safe combining.

1. Every row gets the digest of its normalised text; counts of digests show
   which can have copies at all and which are hot.
2. Rows with such digests are deduplicated inside each input partition (the
   map side of the aggregate), merged within (digest, salt, text), and the
   winners of the salts are combined per (digest, text).  The key of each
   stage holds the full text, so equal digests of unequal texts never merge.
3. Every row looks its group up again.

Only texts whose digest occurs twice are shuffled.  Hot digests are salted and
looked up through a broadcast that has under 1000 rows by construction.

Nulls: a null text is empty; a null doc_id is never the smallest unless all of
the group are null.  Rows repeated with one doc_id and one text: one of them is
kept.  Texts of white space only equal one space, an empty text only itself.
Of rows that tie in doc_id and text any one is kept, as they are equal in both.
Texts of any length are compared whole; an empty table gives no rows, and the
columns of a table keep their names, whatever they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawloom.llm.common import SPACE, cut, fresh, lookup, sized_broadcast, text_of


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    salts: int = 16,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    norm = docs.select(docs[id_col].alias("doc_id"), normalised(text_of(docs, text_col)).alias("norm"))
    exact = digest is sha256
    rows = norm.select("doc_id", "norm", digest(F.col("norm")).alias("key"))
    ids = cut(
        rows.select(
            F.monotonically_increasing_id().alias("uid"),
            "doc_id",
            "key",
            *([] if exact else [sha256(F.col("norm")).alias("sha")]),
        )
    )
    counts = cut(ids.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    n_keys, total = counts.count(), ids.count()
    hot = F.col("n") >= max(1024, total // 1000)
    copies = sized_broadcast(counts.select("key", hot.alias("hot")), n_keys)
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(F.lit(0))
    merged = (
        rows.join(copies, "key")
        .groupBy("key", salt.alias("salt"), "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    groups = merged.groupBy("key", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    groups = cut(groups.withColumn("variants", F.count(F.lit(1)).over(Window.partitionBy("key"))))
    plain = groups.filter("variants = 1").select("key", "keep_id", F.col("n").alias("group_size"), "n")
    found = lookup(ids, plain, "key", "n", n_keys, total)
    if groups.filter("variants > 1").limit(1).count():
        found = _apart(found, rows, groups)
    mine = Window.partitionBy("key", "doc_id").orderBy("uid")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.withColumn("nth", F.row_number().over(mine)).select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex(F.col("key" if exact else "sha"))).alias("text_sha256"),
    )


def _apart(found: DataFrame, rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Look up by full text the rows whose digest stands for several texts."""
    mixed = groups.filter("variants > 1").select(
        "key", "norm", F.col("keep_id").alias("keep_2"), F.col("n").alias("size_2")
    )
    by_doc = (
        rows.join(mixed, ["key", "norm"])
        .select(
            "key",
            "doc_id",
            sha256(F.col("norm")).alias("sha"),
            "keep_2",
            "size_2",
        )
        .distinct()
    )
    same = (
        (found["key"] == by_doc["key"])
        & (found["sha"] == by_doc["sha"])
        & found["doc_id"].eqNullSafe(by_doc["doc_id"])
    )
    return found.join(by_doc, same, "left").select(
        found["uid"],
        found["doc_id"],
        found["key"],
        found["sha"],
        F.coalesce(found["keep_id"], "keep_2").alias("keep_id"),
        F.coalesce(found["group_size"], "size_2").alias("group_size"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    flags = exact_dedup(docs)
    sha, nth, one, marked_id, key = fresh(docs, "sha", "nth", "one_kept", "id", "key")
    marks = cut(
        flags.groupBy("doc_id", "text_sha256")
        .agg(F.min("kept").alias("all_kept"), F.max("kept").alias(one))
        .filter(~F.col("all_kept"))
        .select(F.col("doc_id").alias(marked_id), F.col("text_sha256").alias(key), one)
    )
    rows = docs.withColumn(sha, F.sha2(normalised(text_of(docs)), 256))
    same = rows["doc_id"].eqNullSafe(marks[marked_id]) & (rows[sha] == marks[key])
    marked = rows.join(sized_broadcast(marks, marks.count()), same, "left")
    once = Window.partitionBy("doc_id", sha).orderBy(F.lit(0))
    repeated = marked.filter(one).withColumn(nth, F.row_number().over(once)).filter(f"{nth} = 1")
    return marked.filter(f"{one} is null").select(docs.columns).unionByName(repeated.select(docs.columns))
