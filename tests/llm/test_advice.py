"""Cases in which an operator once did less than the whole job."""

from collections import Counter

from pyspark.sql import functions as F

from drawloom.llm import mixing, pii, simhash, url_filter


def test_keep_one_tells_null_and_repeated_ids_apart(spark):
    rows = [(None, "a b"), (3, "a b"), (None, "zzz"), (4, "one two"), (5, "one  two"), (5, "quite other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in simhash.keep_one(df).collect()} == {(3, "a b"), (None, "zzz"), (4, "one two"), (5, "quite other")}


def fillers(spark, n):
    return spark.range(n).select(F.concat(F.lit("filler text number "), "id").alias("text"))


def test_pii_contexts_hold_whole_words_only(spark):
    rows = [f"we met ann at {i} o'clock, write to secret@one.example now" for i in ("six", "ten", "two")]
    middle = "was seen in the garden beside the house on the hill and say"
    rows += [f"Hermann {middle} other{i}@two.example bye" for i in range(40)]
    assert len(f"ann {middle} ") == 64  # the window begins inside of Hermann
    df = spark.createDataFrame([(t,) for t in rows], "text string").unionByName(fillers(spark, 3000))
    assert {r.term: r.disclosure for r in pii.disclosing_terms(df).collect()}.get("ann") == 1.0


def test_pii_counts_copies_once_and_terms_of_the_whole_text(spark):
    rows = [f"signed {w} by Zorblax via secret@one.example today" for w in ("six", "ten", "two")]
    far = " and so on" * 12
    rows += [rows[0]] * 2000 + [f"Zorblax starts{i}{far} then secret@one.example ends" for i in range(4)]
    df = spark.createDataFrame([(t,) for t in rows], "text string").unionByName(fillers(spark, 3000))
    got = {r.term: (r.action, r.disclosure) for r in pii.disclosing_terms(df).collect()}
    assert got.get("zorblax") == ("remove", 1.0) and "filler" not in got


def judged(spark, entries, urls):
    kinds = "kind string, pattern string, category string, action string, since string"
    listed = spark.createDataFrame(entries, kinds).withColumn("since", F.col("since").cast("date"))
    rows = spark.createDataFrame([(i, u, d) for i, (u, d) in enumerate(urls)], "page_id long, url string, fetched string")
    found = url_filter.filter_urls(rows.withColumn("fetched", F.col("fetched").cast("date")), listed)
    return [(r.n_active, r.categories, r.blocked) for r in found.orderBy("page_id").collect()]


def test_url_entries_deep_mixed_case_and_www(spark):
    entries = [
        ("prefix", "deep.example/a/b/c/d", "spam", "add", "2024-01-01"), ("prefix", "WWW.Case.example/Blog/", "spam", "add", "2024-01-01"),
        ("host", "www.Host.example.", "spam", "add", "2024-01-01"), ("domain", "www.dom.example", "spam", "add", "2024-01-01"),
    ]
    urls = {
        "http://deep.example/a/b/c/d/e": 1, "http://deep.example/a/b/c/x": 0, "http://case.example/Blog/1": 1, "http://case.example/blog/1": 0,
        "http://www.host.example/": 1, "http://host.example/x": 1, "http://www.dom.example/": 1, "http://a.www.dom.example/": 1, "http://b.dom.example/": 0,
    }
    got = judged(spark, entries, [(u, "2024-05-01") for u in urls])
    assert [n for n, _, _ in got] == list(urls.values())


def test_url_categories_have_intervals_of_their_own(spark):
    entries = [
        ("host", "x.example", "spam", "add", "2024-01-01"), ("host", "x.example", "malware", "add", "2024-01-10"),
        ("host", "x.example", "malware", "remove", "2024-01-20"), ("host", "x.example", "adult", "add", "2024-01-10"),
        ("host", "x.example", None, "remove", "2024-02-01"),
    ]
    got = judged(spark, entries, [("http://x.example/", d) for d in ("2024-01-05", "2024-01-15", "2024-01-25", "2024-02-01")])
    assert [c for _, c, _ in got] == ["spam", "adult,malware,spam", "adult,spam", ""] and not got[3][2]


def test_mixed_shards_hold_their_quotas_in_order(spark):
    sizes = [7, 300, 40, 1, 0, 64, 129, 15, 90, 33]
    rows = [(i, " " * (i % 2) + " ".join(f"d{i}w{j}" for j in range(n)) + "\n" * (i % 3), "s" + str(i % 3)) for i, n in enumerate(sizes * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix(df, block_words=32, shards=8).collect()
    words, shard_of = Counter(), {}
    for r in plan:
        for c in r.copies:
            words[r.source, c.block] += c.words
            assert shard_of.setdefault((r.source, c.block), c.shard) == c.shard
    wanted = {r.source: round(r.target) for r in plan}
    assert all(n == min(32, wanted[s] - 32 * b) for (s, b), n in words.items())
    blocks = [(i, -(-wanted[s] // 32)) for i, s in enumerate(sorted(wanted), 1)]
    quotas = mixing.split_quotas(spark.createDataFrame(blocks, "rank int, blocks bigint"), 8, 42).collect()
    got = Counter((shard, s) for (s, _), shard in shard_of.items())
    assert got == Counter({(q.shard, f"s{q['at']}"): q.quota for q in quotas if q.quota})
    mixed = mixing.mixed_documents(df, block_words=32, shards=8, shard_columns=True).collect()
    order = [(r.shard, r.place) for r in mixed]
    assert order == sorted(order)
    text = {(r.shard, r.place): r.text for r in mixed}
    for r in plan:
        for p in range(3):
            if sum(c.words for c in r.copies if c["pass"] == p) == r.size > 0:
                assert "".join(text[c.shard, c.place] for c in r.copies if c["pass"] == p) == rows[r.doc_id][1]
