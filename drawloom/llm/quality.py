"""Quality rules with a hashed n-gram likelihood ratio.

Words and word pairs of a text are hashed into ``buckets`` bins.  Two smoothed
multinomials over the bins are estimated, one from trusted texts (a bounded,
documented sample of the labelled rows) and one from every n-gram of the whole
corpus, each text counted once however often it is copied.  A document's score
is the sum of its n-grams' log ratios divided by their number, and it is kept
when the score reaches ``threshold``, less a fixed slack for short texts, and
the base rules pass.  Both are constants, so the verdict is deterministic.

The log ratios are ``buckets`` numbers, whatever the corpus: they travel as one
constant array.  Nothing else is gathered.

Nulls: a null text has no words and fails the base rules; a null label is not
trusted.  Without trusted texts all scores are 0 and only the base rules judge.
Repeated rows are judged each; empty tables give empty results.  Texts of any
length are read whole.  A score that ties with the threshold is kept; trusted
documents that tie in their hash are picked by doc_id.  Columns of the input keep
their names, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawloom.llm.common import BROADCAST_ROWS, cut, let, lookup, text_of, without, words

SYMBOLS = r"[#*$%&|<>]"
#: Most trusted documents that the target distribution is fitted on.
TRUSTED = 20_000
#: Most hashes of copied texts (16 bytes each) that are broadcast; beyond it they are looked up by shuffle, hot ones apart.
COPIES = 1_000_000
BUCKETS = 8192
#: Score in nats an n-gram under which a document looks unlike the trusted ones.
THRESHOLD = -0.12
#: The threshold falls by this over the root of the number of n-grams, since short texts scatter.
SLACK = 0.6


def repeated_words(ws: Column, window: int = 5) -> Column:
    """How many words stand in a window of ``window`` words that occurs twice or more."""
    n = F.size(ws)
    hashes = F.transform(
        F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(window)])
    )

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(p: Column) -> Column:
            same = F.transform(
                p,
                lambda x, i: F.when(
                    (F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"]),
                    x["i"],
                ),
            )
            return F.array_sort(F.filter(same, lambda x: x.isNotNull()))

        def total(at: Column) -> Column:
            return F.aggregate(
                F.transform(at, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - x, F.lit(window)))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            )

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(let(pairs, positions), total)
        )

    return F.when(n <= window, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def with_base(rows: DataFrame) -> DataFrame:
    """Add the base figures to (doc_id, text, words)."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    n_words = F.size("words").cast("long")
    symbols = F.length("text") - F.length(F.regexp_replace("text", SYMBOLS + "+", ""))
    out = rows.select(
        "*",
        n_words.alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _bin(ws: Column, i: Column, buckets: int, pair: int) -> Column:
    if pair:
        return F.pmod(F.xxhash64(F.get(ws, i), F.get(ws, i + 1)), F.lit(buckets)).cast("int")
    return F.pmod(F.xxhash64(F.get(ws, i)), F.lit(buckets)).cast("int")


def bin_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """(bin, n) over all words and word pairs of (words); partial sums leave each task."""
    ws = F.col("words")
    singles = rows.select("words", F.explode(F.sequence(F.lit(0), F.size(ws) - 1)).alias("i"))
    bins = F.array(_bin(ws, F.col("i"), buckets, 0), F.when(F.col("i") + 1 < F.size(ws), _bin(ws, F.col("i"), buckets, 1)))
    return singles.select(F.explode(bins).alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def trusted_ids(labels: DataFrame, limit: int = TRUSTED) -> DataFrame:
    """At most ``limit`` doc_ids with quality 1 and no toxicity, picked by hash."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull()
    ids = labels.filter(good).select("doc_id").distinct()
    return ids.orderBy(F.xxhash64(F.lit(42), "doc_id"), "doc_id").limit(limit)


def one_of_copies(rows: DataFrame) -> DataFrame:
    """The rows of (doc_id, text_hash, ...) without further copies of a text: the smallest doc_id stays."""
    groups = rows.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))
    copied = cut(groups.filter("n > 1"))
    n, total = copied.agg(F.count(F.lit(1)), F.sum("n")).first()
    if BROADCAST_ROWS < n <= COPIES:
        marked = rows.join(F.broadcast(copied.drop("n")), "text_hash", "left")
    else:
        marked = lookup(rows, copied, "text_hash", "n", n, total)
    return marked.filter("first_id is null or doc_id = first_id").drop("first_id")


def log_ratios(rows: DataFrame, trusted: DataFrame, buckets: int) -> list[float]:
    """``buckets`` log ratios from (doc_id, text_hash, words) and the trusted doc_ids.

    Copies of a text count once on either side, or a text copied often enough
    would make its own words look untrusted.
    """
    once = one_of_copies(rows)
    picked = rows.join(F.broadcast(trusted), "doc_id", "left_semi").dropDuplicates(["text_hash"])
    raw = bin_counts(once, buckets).withColumnRenamed("n", "raw")
    target = bin_counts(picked, buckets).withColumnRenamed("n", "target")
    both = raw.join(target, "bin", "left")
    sums = both.agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    smooth = F.lit(1.0)
    rate = lambda n, total: (F.coalesce(n, F.lit(0)) + smooth) / (F.coalesce(total, F.lit(0)) + smooth * buckets)
    score = F.ln(rate(F.col("target"), F.col("all_target"))) - F.ln(rate(F.col("raw"), F.col("all_raw")))
    score = F.when(F.col("all_target").isNull(), F.lit(0.0)).otherwise(score)
    known = {r["bin"]: r["score"] for r in both.join(F.broadcast(sums)).select("bin", score.alias("score")).collect()}
    return [known.get(b, 0.0) for b in range(buckets)]


def judge(
    docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, threshold: float = THRESHOLD, trusted: int = TRUSTED
) -> DataFrame:
    """One row per input row: doc_id, the base figures, base_failed, score, kept, text_hash."""
    text = text_of(docs)
    rows = docs.select(docs["doc_id"].alias("doc_id"), text.alias("text"), words(text).alias("words"))
    hashed = rows.select("doc_id", F.xxhash64("words").alias("text_hash"), "words")
    model = log_ratios(hashed, trusted_ids(labels, trusted), buckets)
    table = F.from_json(F.lit("[" + ",".join(map(repr, model)) + "]"), "array<double>")
    last = F.size("words") - 1

    def value(i: Column, pair: int) -> Column:
        return F.get(table, _bin(F.col("words"), i, buckets, pair))

    summed = F.aggregate(
        F.sequence(F.lit(0), last),
        F.lit(0.0),
        lambda acc, i: acc + value(i, 0) + F.when(i < last, value(i, 1)).otherwise(F.lit(0.0)),
    )
    grams = F.greatest(2 * F.size("words") - 1, F.lit(1))
    score = F.when(last < 0, F.lit(0.0)).otherwise(F.round(summed / grams, 9))
    based = with_base(rows).withColumn("score", score)
    kept = ~F.col("base_failed") & (F.col("score") >= threshold - SLACK / F.sqrt(grams))
    return based.withColumn("kept", kept).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept",
        F.xxhash64("text").alias("text_hash"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    The verdicts are cut before they are filtered: a filter that moved below
    them would split each text again for each of its words.  Rows with one
    doc_id but several verdicts are told apart by their text.
    """
    verdicts = cut(judge(docs, labels, **options))
    bad = verdicts.filter(~F.col("kept")).select("doc_id", F.col("text_hash").alias("key"))
    return without(docs, bad, F.xxhash64(text_of(docs)))
