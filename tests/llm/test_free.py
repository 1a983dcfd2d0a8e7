"""The operators with Python workers, against libraries and brute force."""

import hashlib
import json
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
import xxhash
from pyspark.sql import functions as F

from drawloom.llm import bpe, chat, common, simhash, token_scan, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("x"))


def odd_texts():
    rnd = random.Random(1)
    letters = "aàéÉß'’1²٣Ω日本🙂éİI  \x1c\x85​\tthinge's.,!?Σς"
    latin = "".join(map(chr, range(256)))
    made = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    made += ["".join(rnd.choice(latin) for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    words = [" ".join("".join(rnd.choice("thineraostly") for _ in range(rnd.randint(1, 20))) for _ in range(40)) for _ in range(50)]
    fixed = ["", None, " ", "<|endoftext|>", "a<|startoftext|>b<|endoftext|>", "it's we're I'LL 'd", "x" * 3000, "ab" * 2000, "!" * 500, "̀a", "İstanbul ΣΑΣ ﬁ", latin]
    return fixed + made + words


def test_bpe_equals_the_library(spark):
    texts = odd_texts()
    library = tokenizers.Tokenizer.from_file(WORD_BPE)
    got = {r.doc_id: r for r in bpe.encode_digests(docs(spark, texts), WORD_BPE).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want, repr(t)


def test_bpe_ids_and_their_decoding(spark):
    texts = ["Hello there, world", None, "naïve café 42"]
    library = tokenizers.Tokenizer.from_file(WORD_BPE)
    ids = bpe.encode_ids(docs(spark, texts), WORD_BPE)
    back = {r.doc_id: r.text for r in bpe.decode_ids(ids, WORD_BPE).collect()}
    for r in ids.collect():
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == want and back[r.doc_id] == library.decode(want, skip_special_tokens=False)


def test_bpe_with_null_and_repeated_rows_and_none(spark):
    df = spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two"), (2, None)], "doc_id long, text string").withColumn("ids_sha256", F.lit("clash"))
    got = Counter((r.doc_id, r.n_tokens) for r in bpe.encode_digests(df, WORD_BPE).collect())
    n = len(tokenizers.Tokenizer.from_file(WORD_BPE).encode("one two", add_special_tokens=False).ids)
    assert got == Counter({(None, n): 1, (1, n): 2, (2, 0): 1})
    assert bpe.encode_digests(df.limit(0), WORD_BPE).count() == 0


def test_bpe_memory_stays_bounded():
    memory = bpe._Memory(bpe.encoder(WORD_BPE))
    for i in range(300):
        memory[f"w{i}"]
    assert memory["hello"] == memory["hello"]
    assert len(memory) + len(memory.older) <= bpe.REMEMBERED


def brute_print(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = WORD.findall(low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, ids):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(prints)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= 4:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    low = {}
    for i in range(len(prints)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low[find(i)] for i in range(len(prints))]


def test_simhash_components(spark):
    rnd = random.Random(2)
    base = [" ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rnd.randint(0, 99)) for _ in range(120)) for _ in range(20)]
    texts = []
    for t in base:
        w = t.split()
        texts += [t, t.upper(), " ".join(w[:-1]), " ".join([*w[:50], "changed", *w[51:]])]
    texts += ["", None, " \n", "one two", "ONE  two", "É é", "word " * 5000]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    prints = [brute_print(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(texts))] == brute_components(prints, list(range(len(texts))))
    kept = {r.doc_id for r in simhash.keep_one(docs(spark, texts)).collect()}
    assert kept == {r.component_id for r in got.values()}


def test_close_sets_of_large_groups_are_exact(monkeypatch):
    rnd = random.Random(3)
    centres = [rnd.getrandbits(64) for _ in range(40)]
    prints = list({c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for c in centres for _ in range(12)})
    array = np.array(sorted(prints), dtype=np.uint64)
    whole = simhash.close_sets(array)
    monkeypatch.setattr(simhash, "LEAF", 16)
    divided = simhash.close_sets(array)
    same = lambda parent: [sorted(np.flatnonzero(parent == p)) for p in np.unique(parent)]
    assert same(whole) == same(divided)
    ints = [int(x) for x in array]
    assert len(np.unique(whole)) == len(set(brute_components(ints, list(range(len(ints))))))


@pytest.mark.parametrize("most", [4, 40, 1 << 16])
def test_links_of_keys_that_are_dealt_again(spark, most):
    rnd = random.Random(8)
    centres = [rnd.getrandbits(64) for _ in range(30)]
    prints = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 6))) for c in centres for _ in range(25)}
    prints |= {centres[0] ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(24)}
    ints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in ints], "fp long").repartition(3)
    edges = simhash.links(df, len(ints), most)
    root = {r.node % (1 << 64): r.root for r in simhash.components(edges).collect()}
    want = dict(zip(ints, brute_components(ints, list(range(len(ints)))), strict=True))
    groups = lambda of: sorted(sorted(g) for g in ([p for p in ints if of(p) == k] for k in {of(p) for p in ints}))
    assert groups(lambda p: root.get(p, ("alone", p))) == groups(want.get)


@pytest.mark.parametrize("n", [10, 10**8, 10**11])
def test_every_close_pair_shares_a_key(n):
    masks = simhash.masks_for(simhash.blocks_for(n))
    rnd = random.Random(4)
    for _ in range(200):
        a = rnd.getrandbits(64)
        b = a ^ sum(1 << i for i in rnd.sample(range(64), 4))
        assert any(a & m == b & m for m in masks)


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(-5, -9)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {-5: -9, -9: -9}


def test_simhash_with_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (None, "zzz")], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == Counter({(None, 3): 1, (3, 3): 2, (None, None): 1})
    assert simhash.near_duplicates(df.limit(0)).count() == 0


CONVERSATIONS = [
    (1, 0, "system", "Be \\brief </turn>\n<turn:user>"), (1, 1, "user", "hi"), (1, 2, "assistant", "a\\<b"), (1, 3, "assistant", ""), (2, 0, "user", None),
    (2, 1, "assistant", "é🙂" * 5000), (3, 0, None, "x"), (3, 0, None, "x"), (None, 1, "assistant", "n"),
]


def test_chat_reads_back(spark):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string")
    formatted = chat.format_records(chat.turn_rows(df))
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    whole = Counter()
    for r in formatted.collect():
        whole[r.conv_id] += len(r.formatted)
    for conv in {c for c, *_ in CONVERSATIONS}:
        turns = [(r or "", t or "") for c, _, r, t in CONVERSATIONS if c == conv]
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[conv].formatted_chars == whole[conv]
    assert chat.read_back(chat.format_records(chat.turn_rows(df.limit(0)))).count() == 0


def test_chat_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 7},
        {"prompt": "q", "response": "a"}, {"instruction": "q", "input": "", "output": "a"}, {"question": "q", "answer": "a", "meta": {"x": [1]}},
        {"instruction": None, "output": None, "history": [["q", "a"]]}, {"role": "user", "text": "q"},
    ]
    df = spark.createDataFrame([(i, 0, json.dumps(r)) for i, r in enumerate(records)], "conv_id long, turn long, record string")
    rows = chat.format_records(df).orderBy("conv_id", "seq").collect()
    for i in range(len(records) - 1):
        turns = [chat.read_turn(r.formatted) for r in rows if r.conv_id == i]
        assert turns == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.Mapper().turns({"odd": 1})
    assert chat.fingerprint({"a": {"b": "x"}}) == chat.fingerprint({"a": {"b": "other"}}) != chat.fingerprint({"a": {"c": "x"}})
    assert chat.fingerprint({"a": 1}) != chat.fingerprint({"a": "1"})


def test_chat_reports_records_that_it_cannot_map(spark):
    bad = [
        None, "no json", "[1]", "{}", '{"messages": ["a"]}', '{"odd": "x"}', '{"messages": [{"role": "user", "content": [{"text": "part"}]}]}',
        '{"prompt": "q", "response": "a", "messages": []}', '{"instruction": "q", "output": "a", "history": [["only"]]}', '{"role": "user", "text": "q", "thought": "lost"}',
        "[" * 100_000, '{"messages": null}',
    ]
    rows = [(1, i, r) for i, r in enumerate(bad)] + [(1, 99, '{"role": "user", "text": "q"}'), (2, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, record string").withColumn("problem", F.lit("clash"))
    formatted = chat.format_records(df).collect()
    assert all(r.problem and r.formatted is None for r in formatted if r.turn != 99) and len(formatted) == len(rows)
    back = {r.conv_id: (r.n_turns, r.n_problems) for r in chat.read_back(chat.format_records(df)).collect()}
    assert back == {1: (1, len(bad)), 2: (0, 1)}


def test_chat_turns_come_in_all_layouts(spark):
    roles = ["user", "assistant", "system", "tool", "human", None]
    rows = [(i, i % 3, roles[i % 6], f"text {i}" if i % 5 else "") for i in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = [json.loads(r.record) for r in chat.turn_rows(df).collect()]
    assert {chat.layout_of(r) for r in records} == set(chat.LAYOUTS)
    turns = [chat.read_turn(r.formatted) for r in chat.format_records(chat.turn_rows(df)).orderBy("conv_id").collect()]
    assert turns == [(r or "", t) for _, _, r, t in rows]


def test_token_scan_stitches_documents(spark):
    texts = odd_texts()[:60] + ["long text " * 3000, "", "end"]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoding: tiktoken.Encoding = token_scan.encoding(path)
    want = Counter((i, len(encoding.encode_ordinary(t or ""))) for i, t in enumerate(texts))
    for block in (64, 4096, 1 << 22):
        got = token_scan.count_tokens(docs(spark, texts).repartition(3), path, eod=50256, block_bytes=block)
        assert Counter((r.doc_id, r.n_tokens) for r in got.collect()) == want
    assert token_scan.count_tokens(docs(spark, texts).limit(0), path, eod=50256).count() == 0


def test_token_scan_with_nulls_repeats_and_narrow_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("file", F.lit("x")).withColumn("doc", F.lit("y"))
    got = Counter((r.doc_id, r.n_tokens) for r in token_scan.count_tokens(df, path, eod=50256).collect())
    assert got == Counter({(None, 2): 1, (1, 2): 2, (2, 0): 1})
    with pytest.raises(ValueError, match="do not fit"):
        token_scan.count_tokens(df, path, eod=70_000)


@pytest.mark.parametrize("run", [1, 3, 4096])
def test_token_scan_in_runs_of_blocks(spark, tmp_path, monkeypatch, run):
    monkeypatch.setattr(token_scan, "RUN", run)
    test_token_scan_of_foreign_files(spark, tmp_path)


def test_token_scan_of_foreign_files(spark, tmp_path):
    rnd = random.Random(5)
    ids = [rnd.choice([9, 9, 1, 2, 3]) for _ in range(1001)]
    (tmp_path / "a.tokens").write_bytes(np.array(ids, dtype="<u4").tobytes())
    (tmp_path / "empty.tokens").write_bytes(b"")
    at = tmp_path.as_uri()
    got = token_scan.scan_flat(token_scan.blocks_of(spark, at, block_bytes=40), at, eod=9, width=4).orderBy("doc").collect()
    runs = " ".join(map(str, ids)).split("9")
    want = [len(r.split()) for r in runs]
    tail = want.pop()
    assert [r.n_tokens for r in got if r.closed] == want
    assert [r.n_tokens for r in got if not r.closed] == ([tail] if tail else [])


def test_url_filter(spark):
    entries = spark.createDataFrame(
        [
            ("domain", "bad.example", "spam", "add", "2024-01-10"), ("domain", "bad.example", "spam", "remove", "2024-02-01"),
            ("domain", "bad.example", "spam", "add", "2024-03-01"), ("host", "one.example", "adult", "add", "2024-01-01"), ("prefix", "ok.example/x", "malware", "add", "2024-01-05"),
            ("allow", "good.bad.example", "none", "add", "2024-03-05"), (None, None, "spam", "add", "2024-01-01"), ("host", "tie.example", "a", "add", "2024-01-01"),
            ("host", "tie.example", "a", "remove", "2024-01-01"),
        ], "kind string, pattern string, category string, action string, since string",
    ).withColumn("since", F.col("since").cast("date"))
    captures = [
        (1, "http://a.bad.example/p", "2024-01-09", False), (2, "http://a.bad.example/p", "2024-01-10", True), (3, "https://www.BAD.example./", "2024-02-01", False),
        (4, "http://u:p@bad.example:80/x?y", "2024-03-01", True), (5, "http://good.bad.example/", "2024-03-04", True), (6, "http://good.bad.example/", "2024-03-06", False),
        (7, "http://one.example/x", "2024-05-01", True), (8, "http://sub.one.example/x", "2024-05-01", False), (9, "http://ok.example/x/y", "2024-05-01", True),
        (10, "http://ok.example/xy", "2024-05-01", False), (11, None, "2024-05-01", False), (12, "nonsense", "2024-05-01", False), (13, "http://one.example/", None, False),
        (14, "http://notbad.example/", "2024-03-01", False), (15, "http://tie.example/", "2024-03-01", False), (7, "http://one.example/x", "2024-05-01", True),
    ]
    df = spark.createDataFrame([c[:3] for c in captures], "page_id long, url string, f string").select("page_id", "url", F.col("f").cast("date").alias("fetched"), F.lit(1).alias("kind"))
    got = Counter((r.page_id, r.blocked) for r in url_filter.filter_urls(df, entries).collect())
    assert got == Counter((c[0], c[3]) for c in captures)
    assert url_filter.keep_allowed(df, entries).count() == sum(not c[3] for c in captures)
    assert url_filter.filter_urls(df, entries.limit(0)).filter("blocked").count() == 0
    assert url_filter.filter_urls(df.limit(0), entries).count() == 0


def test_url_filter_of_hot_hosts_beyond_the_broadcast_bound(spark, monkeypatch):
    entries = spark.createDataFrame(
        [("host", "hot.example", "spam", "add", "2024-01-10"), *[("host", f"h{i}.example", "spam", "add", "2024-01-01") for i in range(50)]],
        "kind string, pattern string, category string, action string, since string",
    ).withColumn("since", F.col("since").cast("date"))
    rows = [(i, "http://hot.example/a/b" if i % 3 else f"http://h{i % 99}.example/", f"2024-01-{i % 20 + 1:02d}") for i in range(4000)]
    df = spark.createDataFrame(rows, "page_id long, url string, f string").select("page_id", "url", F.col("f").cast("date").alias("fetched"))
    want = {r.page_id: tuple(r) for r in url_filter.filter_urls(df, entries).collect()}
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert {r.page_id: tuple(r) for r in url_filter.filter_urls(df, entries).collect()} == want
    assert all(want[i][5] == ((i % 20 + 1 >= 10) if i % 3 else i % 99 < 50) for i in range(4000))
