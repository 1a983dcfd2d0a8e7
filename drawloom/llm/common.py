"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space of every contract: blank and the five ASCII controls 9-13.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Most rows of a table that may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 100_000


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder that all executors share and cut its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    end = "__"
    while any(n + end in taken for n in names):
        end += "_"
    return [n + end for n in names]


def without(rows: DataFrame, marks: DataFrame, hashed: Column) -> DataFrame:
    """``rows`` whose doc_id and ``hashed`` value are not among ``marks`` (doc_id, key); null ids are equal."""
    key, marked_id, marked = fresh(rows, "key", "id", "marked")
    named = cut(marks.select(marks["doc_id"].alias(marked_id), marks["key"].alias(marked)).distinct())
    keyed = rows.withColumn(key, hashed)
    same = (keyed[key] == named[marked]) & keyed["doc_id"].eqNullSafe(named[marked_id])
    return keyed.join(sized_broadcast(named, named.count()), same, "left_anti").drop(key)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def text_of(df: DataFrame, name: str = "text") -> Column:
    return F.coalesce(df[name].cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The maximal runs of anything but white space."""
    bare = F.trim(text, F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))


def n_words(text: Column) -> Column:
    bare = F.trim(text, F.lit(SPACE_CHARS))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACE + "+"))).cast("long")


def running_ends(lengths: Column, block: int = 256) -> Column:
    """Running sums of an ``array<bigint>``, in two levels, so that long arrays stay cheap."""

    def folded(xs: Column, start: Column) -> Column:
        return F.slice(
            F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))),
            F.lit(2),
            F.size(xs),
        )

    zero = F.lit(0).cast("long")
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int")),
        lambda b: F.slice(lengths, b * block + 1, F.lit(block)),
    )

    def summed(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, x: a + x))
        starts = F.aggregate(totals, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return let(starts, lambda at: F.flatten(F.transform(parts, lambda p, i: folded(p, at[i]))))

    return F.when(F.size(lengths) == 0, F.array().cast("array<bigint>")).otherwise(let(blocks, summed))


def sized_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only where the counted ``rows`` stay under ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str | None, rows: int, total: int | None = None) -> DataFrame:
    """Left join on the unique ``key`` of ``right``; ``weight`` is how many left rows a key has.

    Keys with over a thousandth of ``total`` rows (under 1000 such keys can
    exist) are joined by broadcast, so no task gets a hot key's rows.  Without
    ``weight`` the left rows of each key are counted where that is needed.
    """
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right.drop(weight) if weight else right), key, "left")
    if weight is None:
        weight = fresh(right, "weight")[0]
        counted = left.groupBy(key).agg(F.count(F.lit(1)).alias(weight))
        right = cut(right.join(counted, key))
        total = right.agg(F.sum(weight)).first()[0] or 0
    heavy = max(1024, total // 1000)
    hot = F.broadcast(right.filter(F.col(weight) >= heavy).drop(weight))
    cold = right.filter(F.col(weight) < heavy).drop(weight)
    return left.join(hot, key, "inner").unionByName(left.join(hot, key, "left_anti").join(cold, key, "left"))
