"""Greedy one-to-one assignment in a total order, in rounds of mutual bests.

Sequential greedy takes candidates in order and skips those whose left or right
is used.  A candidate that is the first of both its ends is taken by it in any
case; taking all such at once, dropping what they block and repeating gives the
same set, in a number of joins that grows with the longest chain and not with
the number of candidates.  Nothing is collected into one task.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the folder that executors share."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def greedy_pairs(candidates: DataFrame, left: list[str], right: list[str], order: list[Column]) -> DataFrame:
    """The candidates that greedy assignment takes; ``order`` must be total."""
    rest, taken = cut(candidates), None
    while True:
        first_l = F.row_number().over(Window.partitionBy(*left).orderBy(*order))
        first_r = F.row_number().over(Window.partitionBy(*right).orderBy(*order))
        best = cut(rest.withColumn("l_", first_l).filter("l_ = 1").select(*candidates.columns).join(
            rest.withColumn("r_", first_r).filter("r_ = 1").select(*left, *right), [*left, *[c for c in right if c not in left]]
        ).select(*candidates.columns))
        if best.isEmpty():
            return taken if taken is not None else rest
        taken = best if taken is None else taken.unionByName(best)
        rest = rest.join(best.select(*left).distinct(), left, "left_anti").join(best.select(*right).distinct(), right, "left_anti")
        rest = cut(rest)


def greedy_one_set(candidates: DataFrame, a: list[str], b: list[str], order: list[Column]) -> DataFrame:
    """Greedy assignment where both ends are of one set: an item is used at most once on either side."""
    rest, taken = cut(candidates.withColumn("id_", F.monotonically_increasing_id())), None
    while True:
        ends = rest.select("*", F.struct(*a).alias("end_")).unionByName(rest.select("*", F.struct(*[F.col(y).alias(x) for x, y in zip(a, b, strict=True)]).alias("end_")))
        first = Window.partitionBy("end_").orderBy(*order)
        best = ends.withColumn("n_", F.row_number().over(first)).filter("n_ = 1").groupBy("id_").agg(F.count(F.lit(1)).alias("firsts_"))
        best = cut(rest.join(best.filter("firsts_ = 2").select("id_"), "id_", "left_semi"))
        if best.isEmpty():
            return (taken if taken is not None else rest).drop("id_")
        taken = best if taken is None else taken.unionByName(best)
        used = best.select(F.struct(*a).alias("end_")).unionByName(best.select(F.struct(*[F.col(y).alias(x) for x, y in zip(a, b, strict=True)]).alias("end_")))
        rest = rest.withColumn("ea_", F.struct(*a)).withColumn("eb_", F.struct(*[F.col(y).alias(x) for x, y in zip(a, b, strict=True)]))
        rest = rest.join(used.select(F.col("end_").alias("ea_")), "ea_", "left_anti").join(used.select(F.col("end_").alias("eb_")), "eb_", "left_anti")
        rest = cut(rest.drop("ea_", "eb_"))
