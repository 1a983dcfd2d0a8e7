"""The operators built from DataFrame functions only, against brute force and at the edges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from drawloom.llm import common, exact_dedup, mixing, pii, quality, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)


def odd_rows():
    long = "word " * 30_000
    return [
        (1, "Plain text one two three four five six seven eight nine ten.", "en", "s1"),
        (2, None, None, None),
        (3, "", "en", "s1"),
        (4, "Plain  text one\ttwo three four five six seven eight nine ten.", "en", None),
        (4, "Plain  text one\ttwo three four five six seven eight nine ten.", "en", None),
        (None, "Plain text one two three four five six seven eight nine ten.", "de", "s2"),
        (6, long, "en", "s3"),
        (7, " \n\t ", "fr", "s1"),
        (8, "é ß 日本 a b c d e f g h i j k", "fr", "s2"),
    ]


def test_words_split_at_the_six_blanks_only(spark):
    texts = ["", "  a b ", "a b c", "\x1c a\x0bb\x0cc", "x" * 50, "\n\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(common.words(F.col("t"))).collect()]
    assert got == [WORD.findall(t) for t in texts]
    assert [r[0] for r in df.select(common.n_words(F.col("t"))).collect()] == [len(WORD.findall(t)) for t in texts]


def test_running_ends_over_many_items(spark):
    n = 1000
    df = spark.createDataFrame([(list(range(n)),), ([],)], "a array<bigint>")
    got = [r[0] for r in df.select(common.running_ends(F.col("a"))).collect()]
    assert got == [[i * (i + 1) // 2 for i in range(n)], []]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    rows = odd_rows() + [(100 + i, f"copy {i % 5}", "en", "hot") for i in range(60)]
    digest = {"digest": lambda c: F.lit("same")} if weak else {}
    got = exact_dedup.exact_dedup(docs(spark, rows), **digest).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups: dict = {}
    for d, t, *_ in rows:
        groups.setdefault(norm(t), []).append(d)
    want = Counter()
    for d, t, *_ in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        want[d, min(ids) if ids else None, len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_keep_first_keeps_columns_and_one_of_repeated_rows(spark):
    df = docs(spark, odd_rows()).withColumn("group_size", F.lit(1)).withColumn("key", F.lit("x"))
    kept = exact_dedup.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [1, 2, 6, 7, 8]


def test_mixing_reaches_targets(spark):
    rows = odd_rows() + [(1000 + i, "w " * (i % 40), "en", ["a", "b", "c", "hot"][min(3, i % 9)]) for i in range(400)]
    got = mixing.mix(docs(spark, rows), block_words=64, shards=8).collect()
    assert len(got) == len(rows)
    sizes: Counter = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: 1.0 + i % 3 for i, s in enumerate(names)}
    capped: set = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = left / sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and share * weight[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    taken: Counter = Counter()
    for r in got:
        assert r.source_size == sizes[r.source]
        want = 3 * sizes[r.source] if r.source in capped else share * weight[r.source]
        assert math.isclose(r.target, want, rel_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(c.words for c in r.copies)
        taken[r.source] += r.taken
    for r in got:
        assert abs(taken[r.source] - r.target) <= 0.5
    again = mixing.mix(docs(spark, rows).repartition(3), block_words=64, shards=8).collect()
    key = lambda r: (r.doc_id or -1, r.size, r.taken, str(r.copies))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_splitting_tree_is_exact(spark):
    counts = [0, 1, 7, 1000, 333, 50_000]
    df = spark.createDataFrame(list(enumerate(counts, 1)), "rank int, blocks bigint")
    rows = mixing.split_quotas(df, 8, 42).collect()
    by_source, by_shard = Counter(), Counter()
    for r in rows:
        assert r.quota >= 0
        by_source[r["at"]] += r.quota
        by_shard[r["shard"]] += r.quota
    assert [by_source[i] for i in range(len(counts))] == counts
    assert max(by_shard.values()) - min(by_shard.values()) <= 3
    big = [r.quota for r in rows if r["at"] == 5]
    assert max(big) - min(big) < 600 and len(set(big)) > 1


def draws(spark, n, k, d, rows=4000):
    u = lambda i: mixing._uniform(F.col("id"), i)
    return Counter(r.x for r in spark.range(rows).select(mixing.hypergeometric(F.lit(n), F.lit(k), F.lit(d), u).alias("x")).collect())


@pytest.mark.parametrize("n, k, d", [(30, 12, 10), (30, 25, 10), (30, 12, 25), (9, 8, 8), (5, 0, 3), (5, 5, 2), (400, 30, 390)])
def test_hypergeometric_distribution(spark, n, k, d):
    got = draws(spark, n, k, d)
    for x in range(0, d + 1):
        p = math.comb(k, x) * math.comb(n - k, d - x) / math.comb(n, d)
        assert abs(got[x] / 4000 - p) < 0.03


def test_hypergeometric_of_very_many(spark):
    n, k, d = 4_000_000_000, 1_300_000_000, 2_000_000_000
    got = list(draws(spark, n, k, d).elements())
    mean, sd = d * k / n, math.sqrt(d * (k / n) * (1 - k / n) * (n - d) / (n - 1))
    z = [(x - mean) / sd for x in got]
    assert abs(sum(z) / 4000) < 0.08 and abs(sum(v * v for v in z) / 4000 - 1) < 0.1
    assert abs(sum(abs(v) < 1 for v in z) / 4000 - 0.6827) < 0.03 and len(set(got)) > 3500


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1024, 1000, 4099])
def test_permutation_is_one_and_mixes(spark, n):
    df = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n), F.lit(7)).alias("p"))
    got = [r.p for r in df.orderBy("id").collect()]
    assert sorted(got) == list(range(n))
    if n >= 1000:
        assert sum(abs(a - b) == 1 for a, b in zip(got, got[1:], strict=False)) < n / 50


def test_seed_and_shards_change_the_shards_and_never_the_sums(spark):
    rows = [(i, " ".join(["w"] * (i % 50)), "en", "s" + str(i % 3)) for i in range(300)]
    df = docs(spark, rows)
    plans = {}
    for seed, shards in ((42, 4), (43, 4), (42, 8)):
        got = mixing.mix(df, block_words=32, shards=shards, seed=seed).collect()
        plans[seed, shards] = {r.doc_id: [(c.block, c.shard) for c in r.copies] for r in got}
        for s in ("s0", "s1", "s2"):
            assert sum(r.taken for r in got if r.source == s) == round(next(r.target for r in got if r.source == s))
        at = {(r.source, c.block): c.shard for r in got for c in r.copies}
        per_shard = Counter(at.values())
        assert len(per_shard) == shards and max(per_shard.values()) - min(per_shard.values()) <= shards.bit_length()
    assert plans[42, 4] != plans[43, 4] and plans[42, 4] != plans[42, 8]


CLASHING = [c + e for c in ("copies", "copy", "piece", "hash", "key", "id", "same", "shard", "place", "from", "nth", "one_kept", "sha", "mix_key") for e in ("", "__")]


def test_columns_with_clashing_names_stay(spark):
    text = "a b c d e f g h i j k"
    rows = [(1, text, "en", "s", 1, *CLASHING), (2, text, "en", "s", 1, *CLASHING), (None, None, None, None, None, *CLASHING)]
    df = spark.createDataFrame(rows, f"{DOCS}, " + ", ".join(f"`{c}` string" for c in CLASHING))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    plain = df.select("doc_id", "text", "lang", "source", "n_chars")
    for run in (pii.find_personal_data, sharding.assign_shards, mixing.mix, exact_dedup.exact_dedup):
        clash = plain.select("*", *[F.lit("x").alias(c) for c in run(plain).columns if c not in plain.columns])
        assert sorted(map(str, run(clash).collect())) == sorted(map(str, run(plain).collect()))
    for made in (mixing.mixed_documents(df), exact_dedup.keep_first(df), quality.keep_good(df, labels)):
        got = made.collect()
        assert made.columns == df.columns and got
        assert all([r[c] for c in CLASHING] == CLASHING for r in got)


def test_mixed_documents_hold_the_words_taken(spark):
    rows = [(i, f"a{i} b{i}  c{i}\nd{i} ", "en", "s" + str(i % 3)) for i in range(30)] + [(5, "dup x y", "en", "s1")] * 2
    df = docs(spark, rows)
    plan = mixing.mix(df)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    words = sum(len(WORD.findall(r.text)) for r in mixed.collect())
    assert words == plan.agg(F.sum("taken")).first()[0]


def test_first_words(spark):
    texts = ["a bb  ccc\td", "  a b c", "one"]
    for t in texts:
        n = len(WORD.findall(t))
        for k in range(1, n + 1):
            got = spark.createDataFrame([(t, k)], "t string, k int").select(mixing.first_words(F.col("t"), F.col("k"))).first()[0]
            end = [m.end() for m in WORD.finditer(t)][k - 1]
            assert got == t[:end]


def test_sharding_rows_law(spark):
    rows = odd_rows() + [(i, "x" * (i % 90), ["en", "de"][i % 2], f"src{i % 7}") for i in range(200, 500)]
    got = sharding.assign_shards(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(8))
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    order = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2)])
def test_hilbert_curve_visits_neighbours(spark, dims, bits):
    n = 1 << bits
    cells = spark.range(n**dims)
    codes = F.array(*[F.pmod(F.floor(F.col("id") / n**i), F.lit(n)).cast("bigint") for i in range(dims)])
    rows = cells.select(codes.alias("c"), sharding.hilbert_index(codes, dims, bits).alias("h")).collect()
    at = {r.h: list(r.c) for r in rows}
    assert sorted(at) == list(range(n**dims))
    assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1], strict=True)) == 1 for i in range(len(at) - 1))


def test_fewer_rows_than_shards_and_empty_tables(spark):
    three = docs(spark, odd_rows()[:3])
    assert sorted(r.slot for r in sharding.assign_shards(three).collect()) == [0, 0, 0]
    none = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        sharding.assign_shards(none), mixing.mix(none), exact_dedup.exact_dedup(none), quality.judge(none, labels), pii.find_personal_data(none),
        exact_dedup.keep_first(none), mixing.mixed_documents(none), quality.keep_good(none, labels),
    ):
        assert out.count() == 0


def brute_quality(t):
    w = WORD.findall(t or "")
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover), failed


def test_quality_base_figures(spark):
    rows = odd_rows() + [
        (20, "a b c d e a b c d e", "en", "s"), (21, "x\nx\n x\nx\n\n\n", "en", "s"), (22, "a a a a a a a", "en", "s"), (23, "# $ % & | < > * **", "en", "s"),
        (24, "p q r s t u p q r s t v w p q r s t", "en", "s"),
    ]
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (8, None, None), (6, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs(spark, rows), labels).collect()
    figures = lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
    assert Counter((r.doc_id, *figures(r)) for r in got) == Counter((d, *brute_quality(t)) for d, t, *_ in rows)
    assert all(not r.kept for r in got if r.base_failed)


def test_quality_score_matches_brute_force(spark):
    good = [(i, " ".join(f"good{(i * j) % 13}" for j in range(1, 20)), "en", "s") for i in range(1, 30)]
    bad = [(100 + i, " ".join(f"bad{(i * j) % 11}" for j in range(1, 20)), "en", "s") for i in range(1, 20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 21)], "doc_id long, quality int, toxic int")
    df = docs(spark, good + bad)
    got = {r.doc_id: r for r in quality.judge(df, labels, buckets=64).collect()}
    bins = {}
    grams = lambda t: [(w,) for w in t.split()] + list(zip(t.split(), t.split()[1:], strict=False))
    for g in {g for _, t, *_ in good + bad for g in grams(t)}:
        bins[g] = None
    hashed = spark.createDataFrame([(list(g),) for g in bins], "g array<string>").select(
        "g", F.pmod(F.when(F.size("g") == 1, F.xxhash64(F.col("g")[0])).otherwise(F.xxhash64(F.col("g")[0], F.get("g", F.lit(1)))), F.lit(64)).alias("b")
    )
    bins = {tuple(r.g): r.b for r in hashed.collect()}
    raw, target = Counter(), Counter()
    for t in {t for _, t, *_ in good + bad}:
        raw.update(bins[g] for g in grams(t))
    for t in {t for d, t, *_ in good if d <= 20}:
        target.update(bins[g] for g in grams(t))
    ratio = {b: math.log((target[b] + 1) / (target.total() + 64)) - math.log((raw[b] + 1) / (raw.total() + 64)) for b in raw}
    for d, t, *_ in good + bad:
        want = sum(ratio[bins[g]] for g in grams(t)) / len(grams(t))
        assert math.isclose(got[d].score, want, abs_tol=1e-8)
    assert min(got[d].score for d, *_ in good) > max(got[d].score for d, *_ in bad)
    kept = quality.keep_good(df.withColumn("kept", F.lit(0)), labels, buckets=64)
    assert kept.columns == [*df.columns, "kept"]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(t):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, t or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(digits))))
            good = {
                "email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out[kind].append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_spans(spark):
    texts = [
        "a@b.c_d@e.f é x@y.zz", "1.2.3.4.5.6.7.8 and 256.1.1.1 001.002.003.255", "4111 1111 1111 1111 5500-0000-0000-0004 4111111111111112",
        "+1 (555) 123-4567+44 20 7946 0958 +12", "日本 a.b+c@d-e.f.g, 10.0.0.1", "@x.y a@b a@b. a@.b " * 3, "9" * 500, "a.b." * 2000 + "@x", "x@" + "y." * 3000 + "z",
        "🙂🙂 mail me@example.org now", "+" + "1 " * 300, None, "", "4111-1111 1111-1111  1",
    ]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(0, texts[0], "en", "s")]
    got = pii.find_personal_data(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in PATTERNS]
        listed = ",".join(x for k in PATTERNS for x in want[k])
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.spans == listed


def test_pii_terms_that_give_a_value_away(spark):
    rows = [(i, f"note {i} by Zorblax lives here ann{i % 2}@corp.example the end {i}", "en", "s") for i in range(8)]
    rows += [(100 + i, f"common filler the end number {i} here by note lives", "en", "s") for i in range(200)]
    rows += [(500, "Ask ZORBLAX, not Zorblaxes.", "en", "s"), (None, "zorblax", "en", "s")]
    rows += [(600 + i, "seen once with copies Quux bob@copy.example", "en", "s") for i in range(9)]
    got = {r.doc_id: r for r in pii.find_personal_data(docs(spark, rows), generalise=0.6, remove=0.8).collect()}
    assert got[500].spans == "term:4:11" and got[None].n_term == 1
    assert got[500].clean_text in ("Ask , not Zorblaxes.", "Ask [NAME], not Zorblaxes.")
    assert all(got[i].n_term == 0 for i in range(100, 300)), "clean documents stay as they are"
    assert all(got[i].n_term == 0 for i in range(600, 609)), "one context, however often copied, proves nothing"
    assert "[EMAIL]" in got[3].clean_text and "corp" not in got[3].clean_text
    assert got[3].n_email == 1 and got[3].n_term == 1


SECRET = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}")


def brute_terms(texts, reach=64, support=3, generalise=0.9, remove=0.97):
    """Disclosing terms by plain loops over distinct texts."""
    texts = sorted(set(texts))
    term_of = lambda t: {w for w in re.split(r"[\W_]+", t.lower()) if re.search(r"[^\W\d_]", w)}
    contexts, holders = {}, {}
    for n, t in enumerate(texts):
        found = {k: [tuple(map(int, s.split(":")[1:])) for s in v] for k, v in brute_spans(t).items()}
        found["secret"] = [m.span() for m in SECRET.finditer(t) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and len(set(m[0])) >= 8]
        for kind, spans in found.items():
            every = [m.span() for m in (SECRET if kind == "secret" else re.compile(PATTERNS[kind])).finditer(t)]
            for a, b in spans:
                i = every.index((a, b))
                low = max(a - reach, every[i - 1][1] if i else 0)
                high = min(b + reach, every[i + 1][0] if i + 1 < len(every) else len(t))
                words = [m for m in re.finditer(r"[^\W_]+", t) if m.end() > low and m.start() < high]
                inside = frozenset(m[0].lower() for m in words if m.start() >= low and m.end() <= high and (m.end() <= a or m.start() >= b))
                value = t[a:b].lower() if kind == "email" else t[a:b] if kind in ("ip", "secret") else re.sub("[^0-9]", "", t[a:b])
                for entity in (kind, f"{kind}:{value}"):
                    holders.setdefault(entity, set()).add(n)
                    contexts.setdefault(entity, set()).add((t[low:a], t[b:high], inside))
    with_term = {}
    for n, t in enumerate(texts):
        for w in term_of(t):
            with_term.setdefault(w, set()).add(n)
    best = {}
    for entity, found in contexts.items():
        if len(holders[entity]) < support or len(holders[entity]) == len(texts):
            continue
        information = -math.log2(len(holders[entity]) / len(texts))
        for w in set().union(*(c[2] for c in found)):
            if sum(w in c[2] for c in found) >= support and w in with_term:
                joint = len(holders[entity] & with_term[w])
                if joint:
                    best[w] = max(best.get(w, -9), 1 + math.log2(joint / len(with_term[w])) / information)
    return {w: ("remove" if d >= remove else "generalise", round(d, 9)) for w, d in best.items() if d >= generalise}


def pii_corpus():
    rng = random.Random(5)
    plain = [f"w{i}" for i in range(300)]
    names = ["Zorblax", "Quimby", "Ferrant", "Odo"]
    texts = []
    for i in range(900):
        ws = rng.choices(plain, k=rng.randint(5, 60))
        if i % 9 == 0:
            n = i // 9 % 4
            ws.insert(rng.randrange(len(ws)), f"{names[n]} writes from {names[n].lower()}.{n}@corp.example and")
            if n == 3 and i % 5 == 0:
                ws += ["Odo"] * 2 + ["end"]
        if i % 14 == 0:
            ws.insert(rng.randrange(len(ws)), f'apikey = "{rng.getrandbits(160):040x}" now')
        if i % 31 == 0:
            ws += [rng.choice(names)]
        texts.append(" ".join(ws))
    return texts + texts[:1] * 500


def test_disclosing_terms_match_brute_force_with_production_thresholds(spark):
    texts = pii_corpus()
    want = brute_terms(texts)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = {r.term: (r.action, round(r.disclosure, 9)) for r in pii.disclosing_terms(docs(spark, rows)).collect()}
    assert got == want and want["apikey"] == ("remove", 1.0) and len(want) >= 3
    found = {r.doc_id: r for r in pii.find_personal_data(docs(spark, rows)).collect()}
    assert all(r.n_term >= 1 and r.n_secret == 1 for i, r in found.items() if i < 900 and i % 14 == 0)
    assert all("apikey" not in r.clean_text and "[SECRET]" in r.clean_text for i, r in found.items() if i < 900 and i % 14 == 0)
    clean = [r for i, r in found.items() if i < 900 and i % 9 and i % 14 and i % 31]
    assert clean and all(r.n_spans == 0 and r.clean_text == texts[r.doc_id] for r in clean)


@pytest.mark.parametrize("bound", [common.BROADCAST_ROWS, 0])
def test_disclosing_terms_beyond_the_broadcast_bound(spark, monkeypatch, bound):
    texts = pii_corpus()[::3]
    monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = {r.term: r.action for r in pii.disclosing_terms(docs(spark, rows)).collect()}
    assert got == {w: a for w, (a, _) in brute_terms(texts).items()} and got
