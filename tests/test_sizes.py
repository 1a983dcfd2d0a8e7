"""Operators whose cost must not grow faster than their input, against plain restatements."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from drawloom.functions import similarity
from drawloom.operators import diff, layout, match, pairing, report, scan


def copies(spark, side, names, rnd):
    """Records of several copies of files, which differ in time of change and pages only."""
    rows = [(f"{side}/{n}.pdf", float(rnd.randrange(9000))) for n in names]
    files = spark.createDataFrame(rows, "path string, modified_at double")
    found = pairing.file_records(files)
    return found.withColumns({
        "page_count": (F.col("seq") % 2 + 1).cast("int"), "width": F.lit(10.0), "height": F.lit(10.0), "fingerprint": F.substring(F.md5("normalized_stem"), 1, 16),
        "preview": F.col("title_hint"), "failed": F.lit(False),
    })


def scored(spark, b, a):
    """Scores of all pairs by rows, gates aside."""
    b, a = (df.select(*[F.col(c).alias(f"{s}_{c}") for c in df.columns]) for s, df in (("b", b), ("a", a)))
    return {(r.b_seq, r.a_seq): (r.score, r) for r in pairing._scored(b.crossJoin(a)).collect()}


def greedy(pairs, one_set):
    used, out = set(), set()
    for _, x, y in sorted((-s, min(p) if one_set else p[0], max(p) if one_set else p[1]) for p, s in pairs.items()):
        ends = {x, y} if one_set else {("b", x), ("a", y)}
        if not ends & used:
            used |= ends
            out.add((x, y))
    return out


NAMES = ["Pump plan area 1", "Pump plan area 2", "Valve list area 1", "Tank area 7"]


@pytest.mark.parametrize("chunk", [1, 500_000])
def test_copies_of_files_are_scored_once_and_paired_as_by_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(pairing, "CHUNK", chunk)
    rnd = random.Random(chunk)
    before = copies(spark, "b", [f"{rnd.choice(NAMES)} rev A" for _ in range(17)], rnd).localCheckpoint()
    after = copies(spark, "a", [f"{rnd.choice(NAMES)} rev B" for _ in range(14)], rnd).localCheckpoint()
    texts, looks = pairing._looks(before)
    assert texts.count() <= len(NAMES) and looks.count() <= 2 * len(NAMES)
    seen = {}
    monkeypatch.setattr(pairing, "decide", lambda tops, taken, method, real=pairing.decide: seen.update(taken=taken) or real(tops, taken, method))
    found = pairing.pair_scored(before, after)
    pairs = {p: s for p, (s, _) in scored(spark, before, after).items()}
    assert {(r.b_seq, r.a_seq) for r in seen["taken"].collect()} == greedy(pairs, False)
    assert found.count() == 17  # every after file is paired, three before files are left
    path = lambda df: {r.seq: r.path for r in df.collect()}
    b, a = path(before), path(after)
    for x, y in greedy(pairs, False):
        second = max([sorted((s for p, s in pairs.items() if p[0] == x), reverse=True)[1], sorted((s for p, s in pairs.items() if p[1] == y), reverse=True)[1]])
        low, close = pairs[x, y] < pairing.ACCEPT, pairs[x, y] - second < pairing.MARGIN
        want = "low-confidence" if low else "ambiguous-match" if close else "scored-match"
        assert any(r.before_path == b[x] and r.after_path == a[y] and r.pairing_method == want for r in found.collect())


@pytest.mark.parametrize("chunk", [1, 500_000])
def test_copies_in_one_folder_are_paired_as_by_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(pairing, "CHUNK", chunk)
    rnd = random.Random(chunk + 1)
    both = copies(spark, "m", [f"{rnd.choice(NAMES)}{rnd.choice([' rev A', ' rev B', ''])}" for _ in range(24)], rnd).localCheckpoint()
    seen = {}
    monkeypatch.setattr(pairing, "decide", lambda tops, taken, method, real=pairing.decide: seen.update(tops=tops, taken=taken) or real(tops, taken, method))
    pairing.pair_mixed(both)
    every = {}
    for (x, y), (s, r) in scored(spark, both, both).items():
        told = r.b_revision is not None and r.a_revision is not None and r.b_revision != r.a_revision
        earlier = r.b_revision < r.a_revision if told else r.a_modified_at - r.b_modified_at > 3600
        if x != y and earlier:
            every[x, y] = s
    taken = {(r.b_seq, r.a_seq) for r in seen["taken"].collect()}
    assert {(min(p), max(p)) for p in taken} == greedy(every, True) and taken <= every.keys()
    for side, at in (("b", 0), ("a", 1)):
        got = {r[f"{side}_seq"]: r[f"next_{side}"] for r in seen["tops"][side].collect()}
        want = {p[at]: (sorted((s for q, s in every.items() if q[at] == p[at]), reverse=True) + [None, None])[1] for p in taken}
        assert {k: v and round(v, 12) for k, v in got.items()} == {k: v and round(v, 12) for k, v in want.items()}


def test_matches_are_counted_before_rows_meet_them(spark):
    rnd = random.Random(5)
    roots, parts = ["R1", "R2", "R3", ""], ["A1", "B2", ""]
    full = lambda r, c: "-".join(x for x in (r, c) if x)
    have = []
    for i in range(60):
        r, c = rnd.choice(roots), rnd.choice(parts)
        have.append((i, full(r, c) if rnd.random() < 0.6 else f"other{i}", r, c, "instrument" if rnd.random() < 0.8 else "equipment", rnd.choice(["stacked:isa", "standalone:isa", "fulltag:isa"]), rnd.randrange(6), f"S{rnd.randrange(3)}", "drawing", rnd.choice([0.5, 0.7, 0.9]), f"text {i}"))
    tags = spark.createDataFrame(have, "seq int, full_tag string, root string, component string, tag_class string, method string, page_num int, sheet_id string, zone string, confidence double, source_text string").withColumn("rating", F.lit("Low"))
    rows = [("w", i, full(r, c), r, c, None if rnd.random() < 0.4 else rnd.choices(range(6), k=rnd.randrange(4))) for i, (r, c) in enumerate((rnd.choice(roots + ["R9"]), rnd.choice(parts)) for _ in range(80))]
    parsed = spark.createDataFrame(rows, "ws_name string, row_num int, full_tag string, root string, component string, allowed_pages array<int>")
    own = Window.partitionBy("row_num")
    every = match.tiered_matches(parsed, tags).withColumn("n_matches", F.count(F.lit(1)).over(own)).withColumn("nth", F.row_number().over(own.orderBy(*scan.tag_order())))
    columns = ["row_num", "n_matches", "tier", "confidence", "method", "sheet_id", "page_num", "zone"]
    want = {tuple(r) for r in every.filter("nth = 1").select(columns).collect()}
    assert {tuple(r) for r in match.best_matches(parsed, tags).select(columns).collect()} == want
    assert {r[2] for r in want} == {1, 2, 3}


def test_sheet_ids_that_recur_meet_each_other_where_asked(spark):
    files = lambda side, names: spark.createDataFrame([(f"{side}/{n}.pdf", 0.0) for n in names], "path string, modified_at double")
    b, a = (pairing.file_records(files(s, n)).withColumn("failed", F.lit(False)) for s, n in (("b", ["DT0001 rev A", "DT0001 x rev B", "DT0002"]), ("a", ["DT0001 rev B", "DT0001 x rev A", "DT0003"])))
    _, found = pairing.scan_and_pair([b, a], conflicts="every")
    got = sorted((r.before_path or "", r.after_path or "", r.status, r.revision_status) for r in found.collect())
    assert got == [
        ("", "a/DT0003.pdf", "added", "added"), ("b/DT0001 rev A.pdf", "a/DT0001 rev B.pdf", "matched", "revised"), ("b/DT0001 rev A.pdf", "a/DT0001 x rev A.pdf", "matched", "same_revision"),
        ("b/DT0001 x rev B.pdf", "a/DT0001 rev B.pdf", "matched", "same_revision"), ("b/DT0001 x rev B.pdf", "a/DT0001 x rev A.pdf", "review_needed", "revision_regressed"), ("b/DT0002.pdf", "", "removed", "removed"),
    ]
    assert pairing.pair_by_sheet(b, a).filter("sheet_id = 'DT0001'").count() == 2
    with pytest.raises(ValueError, match="zipped or every"):
        pairing.pair_by_sheet(b, a, conflicts="some")


def test_short_texts_are_compared_once_a_worker():
    similarity._kept.cache_clear()
    import pandas as pd

    for _ in range(3):  # batches
        similarity._ratios(pd.Series(["pump plan"] * 5), pd.Series(["pump plant"] * 5), {})
    assert similarity._kept.cache_info().misses == 1


def test_pages_are_compared_while_their_bound_leads(monkeypatch):
    import pandas as pd

    calls = []
    monkeypatch.setattr(diff, "ratio", lambda a, b: calls.append(1) or similarity.ratio(a, b))
    columns = ["page_index", "fingerprint", "preview", "width", "height"]
    rows = [(i, f"{i:x}" * 16, f"text of page {i} " * 9, 8.0, 6.0) for i in range(8)]
    got = diff._aligned((1,), pd.DataFrame(rows, columns=columns), pd.DataFrame(rows[:7] + [(7, "7" * 16, "quite another page", 8.0, 6.0)], columns=columns))
    assert sorted((r.before_index, r.after_index) for r in got.head(7).itertuples()) == [(i, i) for i in range(7)]
    assert len(calls) <= 1  # of 64 pairs


def test_words_are_walked_without_a_group_a_page(spark):
    words = spark.createDataFrame([(d, 1, i, float(i), 10.0 * (i // 3), 1.0 + i, 10.0 * (i // 3) + 8, "w") for d in range(40) for i in range(9)], "doc_id int, page_num int, seq int, x0 double, y0 double, x1 double, y1 double, word string")
    rows = layout.words_to_rows(words)
    assert "InPandas" not in rows._jdf.queryExecution().toString()
    assert {(r.doc_id, r.seq, r.row_index) for r in rows.collect()} == {(d, i, i // 3) for d in range(40) for i in range(9)}


def test_sections_are_numbered_in_ranges(spark):
    docs = spark.range(2000).selectExpr("id", "id % 2 = 0 as even").repartition(8)
    flat = report.flatten_sections({"all": docs, "even": docs.filter("even")}, ["id"])
    assert "windowspecdefinition(section" not in flat._jdf.queryExecution().toString()
    got = {(r.section, r.id, r.row_index) for r in flat.collect()}
    assert got == {("all", i, i) for i in range(2000)} | {("even", i, i // 2) for i in range(0, 2000, 2)}


def test_spans_are_dealt_before_they_are_classified(spark):
    rows = [(i % 3, 1, i, ["TNK20001", "XV"][i % 2], 100.0 + i, 100.0, 140.0 + i, 110.0, 10.0) for i in range(12)]
    spans = spark.createDataFrame(rows, "doc_id int, page_num int, span_id long, text string, x0 double, y0 double, x1 double, y1 double, size double").coalesce(1)
    plan = scan.classified(spans)._jdf.queryExecution().toString()
    assert "RepartitionByExpression [doc_id" in plan
    assert scan.inferred_tags(scan.with_norm(spans)).count() == 6
