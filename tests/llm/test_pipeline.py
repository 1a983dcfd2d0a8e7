"""The stages of the pipeline over small tables."""

import hashlib

import public_tokenizers
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from drawloom.llm import exact_dedup, mixing, quality

from test_shingles import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder):
    words = [f"word{i}" for i in range(400)]
    texts = [" ".join(words[(7 * i + j * (i % 5 + 1)) % 400] for j in range(40 + i)) for i in range(40)]
    texts += [texts[3], texts[3].replace(" ", "  "), texts[20] + " tail", "short one", "", None, "a b c d e " * 30]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in (*range(40), 42)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_in_turn(spark, tmp_path):
    rows = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "encoding"]
    columns = docs.columns
    good = stages["quality rules"](spark, docs, str(tmp_path))
    verdict = {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == {d for d, k in verdict.items() if k}
    assert set(range(40)) <= {r.doc_id for r in good.collect()}, "clean documents stay"
    once = stages["exact dedup"](spark, good, str(tmp_path))
    kept = {r.doc_id for r in exact_dedup.exact_dedup(good).collect() if r.kept}
    assert once.columns == columns and {r.doc_id for r in once.collect()} == kept and not kept & {40, 41}
    one = stages["near dedup"](spark, once, str(tmp_path))
    left = sorted((r.doc_id, r.text) for r in once.collect())
    heads = {left[i][0] for i in brute([t for _, t in left])[0]}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == heads
    mixed = stages["mixing"](spark, one, str(tmp_path))
    plan = mixing.mix(one).agg(F.sum("taken"), F.sum(F.size("copies"))).first()
    n_words = sum(len(r.text.split()) for r in mixed.collect())
    assert mixed.columns == columns and (n_words, mixed.count()) == tuple(plan)
    out = stages["encoding"](spark, mixed, str(tmp_path)).collect()
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(
        (r.doc_id, hashlib.sha256(" ".join(map(str, library.encode(r.text, add_special_tokens=False).ids)).encode()).hexdigest())
        for r in mixed.collect()
    )
    assert sorted((r.doc_id, r.ids_sha256) for r in out) == want
    assert len(rows) == docs.count()
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in whole) == want
