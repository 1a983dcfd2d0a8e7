"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is one permuted stream of words: its documents ordered by a seeded
hash, found without sorting a source in one task (4096 hash buckets a source,
running sums over the buckets, then a sort inside each bucket).  The mix takes
the first ``round(target)`` words of the stream repeated end to end, so full
passes take every document and only one document a source is taken in part.

The taken stream is cut into blocks of ``block_words``.  A binary tree over the
output shards splits the exact number of blocks of every source: each node
draws the left half's counts from the multivariate hypergeometric distribution,
one conditional hypergeometric draw a source.  Row and column sums are exact.
Shards then take disjoint ranges of each source's permuted block numbers, and
rows are shuffled inside a shard by a hash.

A draw costs the same at any number of blocks, and block numbers are permuted by
a keyed bijection, so no task ever holds the blocks of a source.

Long texts are cut at block ends; rows that tie in hash and size follow in the
order in which they were read.
Nulls: a null text has no words; the null source is a source and comes last; a
null doc_id is allowed.  Repeated rows are rows of their own.  Empty texts get
``taken`` 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawloom.llm.common import SPACE, cut, fresh, let, n_words, text_of

BUCKET_BITS = 12
#: Weights of the sources in code point order, repeated.
WEIGHTS = (1, 2, 3)
MOST_PASSES = 3
SHARDS = 16
#: Tries of a draw; fewer than one in 10 ** 60 draws needs more.
TRIES = 128
#: Rounds of the permutation, and steps by which a number that falls outside walks back.
ROUNDS = 6
WALK = 64
COUNTS = "array<bigint>"


def source_targets(sizes: DataFrame) -> DataFrame:
    """Add weight and target to (key, source_size): shares by weight, at most 3 times the size.

    One row a source; windows over it are windows over the number of sources.
    """
    every = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(every.orderBy("key")))
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    ranked = ranked.withColumn("weight", F.element_at(weights, F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1))
    cap = (MOST_PASSES * F.col("source_size")).cast("double")
    by_ratio = every.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum(F.col("source_size").cast("double")).over(every)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = ranked.withColumn("cap", cap).withColumn("level", left / F.sum("weight").over(after))
    fits = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))
    level = level.withColumn("level", F.max(fits).over(every))  # the first that fits: later levels only fall
    target = F.least("cap", F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return level.select("key", "source_size", "rank", "weight", target.alias("target"))


def _uniform(*parts: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) * F.lit(2.0**-53)


def log_factorial(x: Column) -> Column:
    """ln(x!) of whole numbers: a product up to 20, from there Stirling's series (off by less than 1e-15)."""
    z = x + 1.0
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * z * z)) / (z * z)) / (z * z)) / z
    stirling = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series
    return F.when(x <= 20, F.ln(F.factorial(F.least(x, F.lit(20.0)).cast("int")).cast("double"))).otherwise(stirling)


def hypergeometric(population: Column, marked: Column, drawn: Column, uniform: Callable[[Column], Column]) -> Column:
    """A draw from the hypergeometric distribution, by the ratio of uniforms with rejection, at any size.

    ``uniform`` gives the uniform number of an index; try i uses 2i and 2i + 1.
    Marked and unmarked, drawn and left are exchanged so that the smaller counts
    are drawn.  A try is taken with a probability of .7 or more; after TRIES of
    them (never seen) the mode is taken.
    """
    n, k, d = population.cast("double"), marked.cast("double"), drawn.cast("double")
    setup = F.struct(n.alias("n"), k.alias("k"), d.alias("d"), F.least(k, n - k).alias("few"), F.least(d, n - d).alias("take"))

    def shaped(p: Column) -> Column:
        share = p["few"] / p["n"]
        sd = F.sqrt((p["n"] - p["take"]) * p["take"] * share * (1 - share) / F.greatest(p["n"] - 1, F.lit(1.0)) + 0.5)
        mode = F.floor((p["take"] + 1) * (p["few"] + 1) / (p["n"] + 2)).cast("double")
        centre = p["take"] * share + 0.5
        width = 2 * math.sqrt(2 / math.e) * sd + (3 - 2 * math.sqrt(3 / math.e))  # fixed values of the method
        return F.struct(
            p["n"].alias("n"), p["k"].alias("k"), p["d"].alias("d"), p["few"].alias("few"), p["take"].alias("take"),
            centre.alias("centre"), width.alias("width"), mode.alias("mode"),
            F.least(F.least(p["take"], p["few"]) + 1, F.floor(centre + 16 * sd).cast("double")).alias("end"),
        )

    def log_ways(p: Column, x: Column) -> Column:
        rest = p["n"] - p["few"] - p["take"] + x
        parts = F.array(x, p["few"] - x, p["take"] - x, rest)
        return -F.aggregate(parts, F.lit(0.0), lambda total, part: total + log_factorial(part))

    def walked(p: Column, top: Column) -> Column:
        def judged(i: Column) -> Column:
            def one(u: Column) -> Column:
                at = p["centre"] + p["width"] * (u["v"] - 0.5) / u["u"]
                inside = (at >= 0) & (at < p["end"])
                good = 2 * F.ln(u["u"]) <= log_ways(p, F.floor(at).cast("double")) - top
                return F.when(inside & good, F.floor(at).cast("double"))

            return let(F.struct(uniform(2 * i).alias("u"), uniform(2 * i + 1).alias("v")), one)

        found = F.aggregate(
            F.sequence(F.lit(0), F.lit(TRIES - 1)),
            F.lit(None).cast("double"),
            lambda acc, i: F.when(acc.isNotNull(), acc).otherwise(judged(i)),
        )
        found = F.coalesce(found, p["mode"])
        kept = F.when(p["k"] * 2 > p["n"], p["take"] - found).otherwise(found)
        return F.when(p["d"] * 2 > p["n"], p["k"] - kept).otherwise(kept).cast("bigint")

    def drawn_from(p: Column) -> Column:
        least, most = F.greatest(F.lit(0.0), p["d"] - (p["n"] - p["k"])), F.least(p["d"], p["k"])
        wide = let(shaped(p), lambda q: let(log_ways(q, q["mode"]), lambda top: walked(q, top)))
        return F.when(least >= most, least.cast("bigint")).otherwise(wide)

    return let(setup, drawn_from)


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Split (rank, blocks) among ``shards``, a power of two: (shard, rank, quota)."""
    whole = quotas.agg(F.array_sort(F.collect_list(F.struct("rank", "blocks"))).alias("q"))
    nodes = whole.select(F.lit(1).alias("node"), F.transform("q", lambda x: x["blocks"]).cast(COUNTS).alias("counts"))

    def left_half(counts: Column, node: Column) -> Column:
        total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
        start = F.struct(
            total.alias("left"), F.ceil(total / 2).cast("bigint").alias("draws"), F.array().cast(COUNTS).alias("out")
        )

        def each(acc: Column, x: Column) -> Column:
            got = hypergeometric(
                acc["left"], x, acc["draws"], lambda i: _uniform(F.lit(seed), i, node, F.size(acc["out"]))
            )
            return let(
                got,
                lambda g: F.struct(
                    (acc["left"] - x).alias("left"),
                    (acc["draws"] - g).alias("draws"),
                    F.concat(acc["out"], F.array(g)).alias("out"),
                ),
            )

        return F.aggregate(counts, start, each)["out"]

    for _ in range(shards.bit_length() - 1):
        halves = nodes.withColumn("left", left_half(F.col("counts"), F.col("node")))
        right = F.zip_with("counts", "left", lambda a, b: a - b)
        both = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("counts")),
            F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("counts")),
        )
        nodes = cut(halves.select(F.explode(both).alias("n")).select("n.node", "n.counts"))  # one level's plan at a time
    return nodes.select((F.col("node") - shards).alias("shard"), F.posexplode("counts").alias("at", "quota"))


def mix(
    docs: DataFrame, *, block_words: int = 4096, shards: int = SHARDS, seed: int = 42, source_col: str = "source"
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, copies.

    ``copies`` has one entry for each time the document enters the mix and each
    block that it fills there: pass, ``from`` (words before the piece), words,
    block, shard and ``place``, the hash that orders rows inside a shard.  So
    each shard holds exactly the words of the blocks in its quotas.
    """
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    text = text_of(docs)
    source = docs[source_col].cast("string")
    key = F.coalesce(F.concat(F.lit("a"), source), F.lit("b"))
    hashed = F.xxhash64(F.lit(seed), docs["doc_id"], source, text)
    rows = cut(
        docs.select(
            docs["doc_id"].alias("doc_id"), source.alias("source"), key.alias("key"), n_words(text).alias("size"),
            hashed.alias("hash"), F.shiftrightunsigned(hashed, 64 - BUCKET_BITS).cast("int").alias("bucket"),
            F.monotonically_increasing_id().alias("uid"),
        )
    )
    buckets = cut(rows.groupBy("key", "bucket").agg(F.sum("size").alias("words")))
    sizes = buckets.groupBy("key").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes).withColumn("wanted", F.round("target").cast("bigint"))
    targets = cut(targets.withColumn("blocks", F.ceil(F.col("wanted") / block_words).cast("bigint")))
    quota = split_quotas(targets.select("rank", "blocks"), shards, seed)
    cuts = quota.groupBy((F.col("at") + 1).alias("rank")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("shard", "quota"))), lambda x: x["quota"]).alias("quotas")
    )
    ends = F.aggregate(
        "quotas",
        F.array(F.lit(0).cast("bigint")),
        lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)),
    )
    ends = F.slice(ends, 2, shards)
    plan = targets.join(cuts.select("rank", ends.alias("ends")), "rank")
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("start", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")
    starts = starts.join(plan.drop("rank", "weight", "blocks"), "key")
    inside = Window.partitionBy("key", "bucket").orderBy("hash", "size", "uid")
    placed = rows.join(starts, ["key", "bucket"]).withColumn(
        "at", F.col("start") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    )
    def pieces(i: Column) -> Column:
        """The words of pass ``i`` that are taken, cut where a block ends."""
        begin = i.cast("bigint") * F.col("source_size") + F.col("at")
        end = F.least(begin + F.col("size"), F.col("wanted"))

        def piece(block: Column) -> Column:
            first, last = F.greatest(begin, block * block_words), F.least(end, (block + 1) * block_words)
            at = permuted(block, F.greatest(F.element_at("ends", -1), F.lit(1)), F.xxhash64(F.lit(seed), F.col("key")))
            return F.struct(
                i.alias("pass"), (first - begin).alias("from"), (last - first).alias("words"), block.alias("block"),
                let(at, lambda x: F.size(F.filter("ends", lambda e: e <= x))).alias("shard"),
                F.xxhash64(F.lit(seed), i, F.col("hash"), block).alias("place"),
            )

        blocks = F.sequence(F.floor(begin / block_words).cast("bigint"), F.floor((end - 1) / block_words).cast("bigint"))
        return F.when(end > begin, F.transform(blocks, piece))

    copies = F.transform(F.sequence(F.lit(0), F.lit(MOST_PASSES - 1)), pieces)
    shard = F.flatten(F.filter(copies, lambda c: c.isNotNull()))
    return placed.select("doc_id", "source", "size", "source_size", "target", shard.alias("copies"), "hash").select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.aggregate("copies", F.lit(0).cast("bigint"), lambda a, c: a + c["words"]).alias("taken"),
        "copies",
        "hash",
    )


def permuted(number: Column, count: Column, key: Column) -> Column:
    """A keyed bijection of 0..count-1.

    A Feistel network over pairs of digits (high, low) of a rectangle that just
    holds the numbers; the fewer than ``sqrt(count)`` pairs outside go through
    it again until they fall inside.
    """
    side = F.ceil(F.sqrt(count.cast("double"))).cast("bigint")
    other = F.ceil(count.cast("double") / side).cast("bigint")
    size = F.struct(count.cast("bigint").alias("n"), side.alias("a"), other.alias("b"), key.alias("key"))

    def network(x: Column, p: Column) -> Column:
        high, low = F.floor(x / p["b"]).cast("bigint"), F.pmod(x, p["b"])
        pair = F.struct(high.alias("h"), low.alias("l"))
        for i in range(ROUNDS):
            pair = let(pair, _round(p, i))
        return let(pair, lambda q: q["h"] * p["b"] + q["l"])

    def walked(p: Column) -> Column:
        step = lambda acc, _: F.when(acc < p["n"], acc).otherwise(network(acc, p))
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), network(number.cast("bigint"), p), step)

    return let(size, walked)


def _round(p: Column, i: int) -> Callable[[Column], Column]:
    """One round: either half is shifted by a hash of the other."""

    def shifted(value: Column, by: Column, size: Column) -> Column:
        return F.pmod(value + F.pmod(F.xxhash64(p["key"], F.lit(i), by), size), size)

    def turned(pair: Column) -> Column:
        high, low = pair["h"], pair["l"]
        if i % 2:
            return F.struct(high.alias("h"), shifted(low, high, p["b"]).alias("l"))
        return F.struct(shifted(high, low, p["a"]).alias("h"), low.alias("l"))

    return turned


def first_words(text: Column, count: Column) -> Column:
    """``text`` up to the end of its word number ``count``, white space kept."""
    pieces = F.split(text, rf"(?<={SPACE})(?!{SPACE})|(?<!^)(?<!{SPACE})(?={SPACE})")
    blank = F.when(text.rlike("^" + SPACE), 1).otherwise(0)
    return F.array_join(F.slice(pieces, F.lit(1), blank + 2 * count.cast("int") - 1), "")


def some_words(text: Column, begin: Column, count: Column) -> Column:
    """``count`` words of ``text`` after its first ``begin``, with the white space before them, to the end if no word is left."""
    pieces = F.split(text, rf"(?<={SPACE})(?!{SPACE})|(?<!^)(?<!{SPACE})(?={SPACE})")
    blank = F.when(text.rlike("^" + SPACE), 1).otherwise(0)
    first = F.when(begin == 0, 1).otherwise(blank + 2 * begin.cast("int"))
    last = blank + 2 * (begin + count).cast("int") - 1
    last = F.when(begin + count >= n_words(text), F.size(pieces)).otherwise(last)
    return F.array_join(F.slice(pieces, first, last - first + 1), "")


def mixed_documents(docs: DataFrame, *, shard_columns: bool = False, **options: object) -> DataFrame:
    """The mix as rows: the columns of ``docs``, once for each piece of a copy, in order of shard and place.

    Pieces of one pass of a document make up its text, or its beginning where
    it is taken in part (one document a source).  ``shard_columns`` adds shard
    and place.  A shard goes to as many tasks as give the session's number of
    shuffle partitions, by its places, which are uniform hashes: the rows of a
    shard follow each other, and nothing is sampled to find ranges.
    """
    seed, shards = options.get("seed", 42), options.get("shards", SHARDS)
    marked, same, copies, piece, hashed, shard, place, begin, size, task = fresh(
        docs, "id", "same", "copies", "piece", "hash", "shard", "place", "from", "size", "task"
    )
    plan = mix(docs, **options).filter(F.size("copies") > 0)
    plan = plan.groupBy(F.col("doc_id").alias(marked), F.col("hash").alias("mix_key")).agg(
        F.flatten(F.collect_list("copies")).alias(copies), F.count(F.lit(1)).alias(same), F.max("size").alias(size)
    )
    plan = cut(plan)
    text = text_of(docs)
    rows = docs.withColumn(hashed, F.xxhash64(F.lit(seed), docs["doc_id"], docs["source"].cast("string"), text))
    joined = rows.join(plan, (rows[hashed] == plan["mix_key"]) & rows["doc_id"].eqNullSafe(plan[marked])).drop(plan["mix_key"])
    repeated = joined.filter(f"{same} > 1").dropDuplicates(["doc_id", hashed])
    entered = joined.filter(f"{same} = 1").unionByName(repeated).withColumn(piece, F.explode(copies))
    p = F.col(piece)
    whole = p["words"] == F.col(size)
    cut_text = F.when(whole | F.col("text").isNull(), F.col("text")).otherwise(some_words(F.col("text"), p["from"], p["words"]))
    order = (p["shard"].alias(shard), p["place"].alias(place), p["from"].alias(begin))
    rows = entered.withColumn("text", cut_text).select(*docs.columns, *order)
    tasks = -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    high = F.shiftright(F.col(place), 32) + F.lit(1 << 31)  # the upper half of the place, from 0 on
    dealt = rows.withColumn(task, (F.col(shard) * tasks + F.shiftright(high * tasks, 32)).cast("int"))
    dealt = dealt.repartitionById(shards * tasks, task).sortWithinPartitions(shard, place, "doc_id", begin)
    named = [F.col(shard).alias("shard"), F.col(place).alias("place")] if shard_columns else []
    return dealt.select(*docs.columns, *named)
