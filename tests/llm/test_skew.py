"""Hot groups and the paths beyond the broadcast bound give the same results."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from drawloom.llm import common, exact_dedup, quality, simhash


@pytest.fixture
def small_bounds(monkeypatch):
    """Nothing is small enough to be broadcast but the keys that are hot by count."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    never = lambda df, rows, limit=0: df
    for module in (common, exact_dedup, simhash, quality):
        monkeypatch.setattr(module, "sized_broadcast", never, raising=False)


def hot_docs(spark):
    """A text that holds two thirds of all rows, some pairs, and single texts."""
    hot = spark.range(1500).select((F.col("id") * 2 + 1).alias("doc_id"), F.lit("the same hot text again and again over there").alias("text"))
    rest = spark.range(700).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("text number "), F.floor(F.col("id") / 2), F.lit(" of the cold ones here")).alias("text"))
    return hot.unionByName(rest).repartition(6)


def test_lookup_joins_hot_keys_by_broadcast(spark, small_bounds):
    left = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 2000, 7).otherwise(F.col("id") % 50).cast("long").alias("key"))
    right = left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("key < 40").withColumn("name", F.concat(F.lit("k"), "key"))
    got = common.lookup(left, right, "key", "n", right.count(), 3000)
    plan = got._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Union" in plan
    want = Counter((r.id, f"k{r.key}" if r.key < 40 else None) for r in left.collect())
    assert Counter((r.id, r.name) for r in got.collect()) == want


def test_exact_dedup_of_a_hot_text(spark, small_bounds):
    rows = exact_dedup.exact_dedup(hot_docs(spark)).collect()
    assert len(rows) == 2200
    hot = [r for r in rows if r.group_size == 1500]
    assert len(hot) == 1500 and {r.keep_id for r in hot} == {1} and sum(r.kept for r in hot) == 1
    cold = [r for r in rows if r.group_size != 1500]
    assert {r.group_size for r in cold} == {2} and all(r.keep_id == r.doc_id - r.doc_id % 4 for r in cold)
    assert exact_dedup.keep_first(hot_docs(spark)).count() == 351


def test_simhash_of_a_hot_text(spark, small_bounds):
    rows = simhash.near_duplicates(hot_docs(spark)).collect()
    hot = [r for r in rows if r.doc_id % 2]
    assert len(rows) == 2200 and len(hot) == 1500 and len({r.component_id for r in hot}) == 1
    by_print: dict = {}
    for r in rows:
        by_print.setdefault(r.fingerprint, set()).add(r.component_id)
    assert all(len(c) == 1 for c in by_print.values())


def test_quality_counts_a_hot_text_once(spark, small_bounds):
    labels = spark.range(0, 700).select((F.col("id") * 2).alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    scores = {r.doc_id: r.score for r in quality.judge(hot_docs(spark), labels).collect()}
    assert len(scores) == 2200
    once = hot_docs(spark).filter("doc_id % 2 = 0 or doc_id = 1")
    alone = {r.doc_id: r.score for r in quality.judge(once, labels).collect()}
    assert all(abs(scores[d] - s) < 1e-6 for d, s in alone.items())
