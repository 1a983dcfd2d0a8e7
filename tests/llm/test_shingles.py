"""Near-copies by shingles against brute force."""

import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from drawloom.llm import shingles, simhash


def edited(rnd, ws, n):
    ws = list(ws)
    for _ in range(n):
        ws[rnd.randrange(len(ws))] = f"new{rnd.randrange(10**6)}"
    return ws


def brute(texts):
    sets = [set(zip(*(t.lower().split()[i:] for i in range(5)), strict=False)) for t in texts]
    low = list(range(len(texts)))

    def root(i):
        return i if low[i] == i else root(low[i])

    close = [(i, j) for i, j in combinations(range(len(texts)), 2) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    for i, j in close:
        a, b = sorted((root(i), root(j)))
        low[b] = a
    return [root(i) for i in range(len(texts))], close


def test_copies_at_similarity_of_four_fifths(spark):
    rnd = random.Random(5)
    texts = []
    for _ in range(40):
        ws = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(60, 200))]
        texts.append(" ".join(ws))
        texts += [" ".join(edited(rnd, ws, rnd.randint(1, 6))) for _ in range(2)]
    hot = [f"w{rnd.randrange(3000)}" for _ in range(150)]
    texts += [" ".join(edited(rnd, hot, rnd.randint(1, 3))) for _ in range(60)]
    want, close = brute(texts)
    assert len(close) > 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingles.copies(df).collect()}
    assert got == dict(enumerate(want))
    assert {r.doc_id for r in shingles.keep_one(df).collect()} == set(want)


def test_likely_pairs_of_a_large_group_are_few():
    rnd = np.random.default_rng(1)
    marks = np.tile(rnd.integers(0, 1 << 32, 100, dtype=np.uint32), (3000, 1))
    marks[np.arange(3000), rnd.integers(0, 100, 3000)] += 1
    assert len(shingles.likely_pairs(marks, 0.67)) < 3 * 3000


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b"), (3, "A  b"), (None, "zzz"), (4, "one two"), (5, "one  two"), (5, "other"), (6, ""), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in shingles.keep_one(df).collect()}
    assert got == {(3, "A  b"), (None, "zzz"), (4, "one two"), (5, "other"), (6, "")}
    assert shingles.keep_one(df.limit(0)).count() == 0


def test_pipeline_stage_takes_near_copies_that_simhash_leaves(spark):
    rnd = random.Random(7)
    ws = [f"w{rnd.randrange(3000)}" for _ in range(200)]
    texts = [" ".join(ws), " ".join(w if i not in (40, 100, 160) else "changed" for i, w in enumerate(ws)), " ".join(ws[100:]) + " other" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, two = (simhash.fingerprint(t) for t in texts[:2])
    assert (one ^ two).bit_count() > simhash.DISTANCE
    stage = dict(corpus_pipeline.STAGES)["near dedup"]
    assert {r.doc_id for r in stage(spark, df, "").collect()} == {0, 2}


def test_a_large_group_loses_no_link(spark):
    """Few of these near-copies are close to each other; a forest of best partners left out two of their links."""
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(3000)}" for _ in range(150)]
    texts = [" ".join(edited(rnd, base, rnd.randint(2, 6))) for _ in range(80)]
    want, close = brute(texts)
    assert len(close) == 35 and len(set(want)) == 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in shingles.copies(df).collect()} == dict(enumerate(want))


def test_fingerprints_are_simhash_and_meet_by_their_blocks():
    rnd = np.random.default_rng(3)
    times, plus = shingles.seeds(shingles.fingerprints_for(0.8, 5))
    met, apart = 0, []
    for n in (1, 4, 300):
        own = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
        hashes = [[int(shingles._mixed(own[i : i + 1] * t + p)[0]) for i in range(n)] for t, p in zip(times, plus, strict=True)]
        want = [sum((2 * sum(h >> bit & 1 for h in hs) > n) << bit for bit in range(64)) for hs in hashes]
        assert shingles.fingerprints(own, times, plus).tolist() == want
    for _ in range(300):
        own = rnd.integers(0, 1 << 63, 180, dtype=np.uint64)
        other = np.concatenate([own[:160], rnd.integers(0, 1 << 63, 20, dtype=np.uint64)])  # similarity 160 / 200
        one, two = (shingles.fingerprints(s, times, plus) for s in (own, other))
        met += bool((shingles.block_keys(one, 5) == shingles.block_keys(two, 5)).any())
        apart.append(int(np.bitwise_count(one[: shingles.CHECKED] ^ two[: shingles.CHECKED]).sum()))
    assert met >= 299 and max(apart) <= shingles.radius_for(0.8)
    for _ in range(300):  # four bits of one fingerprint leave one of its blocks whole
        near = one[:1] ^ np.uint64(sum(1 << int(b) for b in rnd.choice(64, 4, replace=False)))
        assert (shingles.block_keys(one[:1], 5) == shingles.block_keys(near, 5)).any()


def test_pipeline_stage_links_inside_its_simhash_radius_only(spark, monkeypatch):
    rnd = random.Random(7)
    ws = [f"w{rnd.randrange(3000)}" for _ in range(200)]
    df = spark.createDataFrame([(0, " ".join(ws)), (1, " ".join(ws[:-2]))], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near dedup"]
    assert {r.doc_id for r in stage(spark, df, "").collect()} == {0}
    monkeypatch.setattr(shingles, "radius_for", lambda similarity: -1)
    assert {r.doc_id for r in stage(spark, df, "").collect()} == {0, 1}


def test_members_of_keys_of_any_size_meet(monkeypatch):
    rnd = np.random.default_rng(4)
    key = np.sort(np.concatenate([np.repeat(np.arange(40), rnd.integers(1, 12, 40)), np.full(90, 40)]))
    marks = np.tile(rnd.integers(0, 1 << 63, 4, dtype=np.uint64), (len(key), 1)) ^ rnd.integers(0, 1 << 3, (len(key), 4), dtype=np.uint64)
    want = {
        (i, j)
        for i, j in combinations(range(len(key)), 2)
        if key[i] == key[j] and int(np.bitwise_count(marks[i] ^ marks[j]).sum()) <= 5
    }
    for small in (64, 4):
        monkeypatch.setattr(shingles, "SMALL", small)
        assert set(zip(*(c.tolist() for c in shingles._near(key, marks, 5)), strict=True)) == want
