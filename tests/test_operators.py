"""Operators on small fixtures, against restatements in plain Python and by properties."""

import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from drawloom import config
from drawloom.functions import similarity
from drawloom.operators import analyze, assign, diff, layout, match, pairing, placement, report, scan, sync

SPANS = "doc_id int, page_num int, span_id long, text string, x0 double, y0 double, x1 double, y1 double, size double"


def spans(spark, rows):
    return spark.createDataFrame([(1, 1, i, t, x, y, x + w, y + h, 10.0) for i, (t, x, y, w, h) in enumerate(rows)], SPANS)


def page(spark):
    return spans(spark, [
        ("VBU20000", 100.0, 100.0, 60.0, 10.0), ("HV-01", 105.0, 112.0, 40.0, 10.0), ("TCV02", 105.0, 125.0, 40.0, 10.0), ("TNK41101", 500.0, 300.0, 10.0, 60.0),
        ("PI001", 512.0, 305.0, 10.0, 50.0), ("XV", 150.0, 200.0, 20.0, 10.0), ('3/4"-CA-12A-EL-1', 300.0, 400.0, 90.0, 10.0), ("RL7-CKR-101-TCV-01", 300.0, 430.0, 90.0, 10.0),
        ("DG7002", 900.0, 750.0, 40.0, 10.0), ("NOTES", 10.0, 10.0, 40.0, 10.0), ("BA2", 20.0, 500.0, 20.0, 10.0),
    ])


def pages(spark):
    return spark.createDataFrame([(1, 1, 1000.0, 800.0)], "doc_id int, page_num int, width double, height double")


def test_extraction_of_every_kind(spark):
    got = {(r.full_tag, r.method) for r in scan.extract_tags(page(spark)).collect()}
    want = {
        ("VBU20000-HV01", "stacked:isa"), ("TNK41101-PI001", "stacked:isa"), ("TCV02", "standalone:isa"), ("VBU20000", "standalone:asset"), ("TNK41101", "standalone:asset"),
        ("VBU20000-XV001", "inferred:bare-isa"), ('3/4"-CA-12A', "line:size-prefix"), ("RL7-CKR-101-TCV01", "fulltag:isa"),
    }
    assert got == want


def test_scan_scores_and_sheet(spark):
    text = page(spark).groupBy("doc_id", "page_num").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    sheets = scan.sheet_map(page(spark), pages(spark), text)
    assert [r.sheet_id for r in sheets.collect()] == ["DG7002"]
    tags = {r.full_tag: r for r in scan.scan(page(spark), pages(spark), sheets, mode="all").collect()}
    assert tags["VBU20000-HV01"].confidence == pytest.approx(0.88 + 0.06 + 0.02 + 0.03)
    assert tags["VBU20000-HV01"].rating == "High" and tags["VBU20000-HV01"].evidence == "drawing zone; process page; mapped sheet"
    only = scan.scan(page(spark), pages(spark), sheets, mode="line").collect()
    assert [r.full_tag for r in only] == ['3/4"-CA-12A']


def test_repetition_is_counted_before_dedupe(spark):
    rows = [("RL7-CKR-101-TCV-01", 300.0, 100.0 * i, 90.0, 10.0) for i in range(1, 4)]
    sheets = spark.createDataFrame([(1, 1, "DG1")], "doc_id int, page_num int, sheet_id string")
    tags = scan.scan(spans(spark, rows), pages(spark), sheets)
    assert {r.repeats for r in tags.collect()} == {3} and tags.count() == 3
    best = scan.dedupe(tags).collect()
    assert len(best) == 1 and best[0].confidence == 0.99 and best[0].evidence.endswith("repeated x3")
    assert scan.dedupe(tags, by_location=True).count() == 3


def test_groups_of_neighbouring_spans(spark):
    rows = [("RL7", 0.0, 0.0, 20.0, 10.0), ("-", 22.0, 0.0, 12.0, 10.0), ("TNK", 36.0, 1.0, 20.0, 10.0), ("far", 300.0, 0.0, 20.0, 10.0), ("102", 58.0, 0.0, 20.0, 10.0)]
    got = {r.text for r in scan.grouped_spans(spans(spark, rows)).collect()}
    assert "RL7-TNK 102" in got and "TNK 102" in got and not any("far" in t for t in got)


def test_stacking_is_exclusive_and_keeps_orientation(spark):
    rows = [("RL7-TNK-102", 0.0, 0.0, 60.0, 10.0), ("RL7-TNK-103", 0.0, 11.0, 60.0, 10.0), ("HV01", 0.0, 22.0, 60.0, 10.0), ("HV02", 0.0, 12.0, 10.0, 40.0)]
    got = {(r.parent, r.child) for r in scan.stacked_pairs(scan.with_norm(spans(spark, rows))).collect()}
    assert got == {(0, 2)}


def test_ocr_modes(spark):
    df = spark.createDataFrame([(5, 100, 50, 0, 1, 0.0), (34, 100, 50, 600, 0, 0.0), (34, 100, 50, 601, 0, 0.0)], "word_count int, char_count int, span_count int, drawing_count int, image_count int, image_coverage double")
    assert [r.needs_ocr for r in scan.ocr_decision(df).collect()] == [True, False, True]
    assert not any(r.needs_ocr for r in scan.ocr_decision(df, "off").collect()) and all(r.needs_ocr for r in scan.ocr_decision(df, "always").collect())
    with pytest.raises(ValueError, match="mode"):
        scan.ocr_decision(df, "maybe")


def tags(spark, rows):
    return spark.createDataFrame(rows, "seq int, full_tag string, root string, component string, tag_class string, method string, page_num int, sheet_id string, zone string, confidence double, rating string, source_text string, x0 double, y0 double")


def tag(seq, full, root, comp, page_num, method="stacked:isa", confidence=0.9):
    return (seq, full, root, comp, "instrument" if comp else "equipment", method, page_num, f"DG{page_num}", "drawing", confidence, "High", full, float(seq), 0.0)


def test_reconcile_tiers_and_statuses(spark):
    have = tags(spark, [
        tag(1, "VBU20000-HV001", "VBU20000", "HV001", 1), tag(2, "VBU20000-HV001", "VBU20000", "HV001", 2, confidence=0.8), tag(3, "TNK41101", "TNK41101", "", 3, "standalone:asset"),
        tag(4, "PI001", "", "PI001", 3, "standalone:isa", 0.4),
    ])
    sheets = spark.createDataFrame([("DG7001", 1), ("DG7002", 2), ("DG7003", 3)], "sheet_id string, page_num int")
    rows = [(1, "VBU20000-HV001", None), (2, "VBU20000-HV001", "DG7002"), (3, "TNK41101-PI001", "7003"), (4, "CHR20001-HV001", None), (5, "words", None), (6, "VBU20000-HV001", "DG9999"), (7, "TNK41101", None), (8, "BIN20001-LIT01", None)]
    listed = spark.createDataFrame([("w", n, t, s) for n, t, s in rows], "ws_name string, row_num int, raw_tag string, raw_sheet string")
    blocks = spark.createDataFrame([(3, 0, "XBIN20001LIT01", "drawing", "DG7003", 0.0, 0.0, 1.0, 1.0)], "page_num int, block_idx int, compact string, zone string, sheet_id string, x0 double, y0 double, x1 double, y1 double")
    got = {r.row_num: r for r in match.reconcile(listed, have, sheets, blocks).collect()}
    assert [got[i].status for i in range(1, 9)] == ["Matched", "Matched", "Matched", "Not found", "Unrecognized tag", "No mapped sheet", "Outside mode", "Matched by block"]
    assert got[1].n_matches == 2 and got[1].best_page == 1 and got[1].confidence == pytest.approx(0.86)
    assert got[2].n_matches == 1 and got[2].best_page == 2 and got[2].confidence == pytest.approx(0.85)
    assert got[3].tier == 3 and got[3].best_page == 3 and got[3].confidence == pytest.approx(0.71)
    assert got[8].tier == 4 and got[8].confidence == pytest.approx(0.76)
    stats = match.match_statistics(match.reconcile(listed, have, sheets, blocks)).first()
    assert (stats.reviewed, stats.matched, stats.not_found, stats.no_page, stats.ambiguous) == (8, 4, 1, 1, 1)


def test_block_fallback_across_blocks(spark):
    parsed = spark.createDataFrame([("w", 1, None, "instrument", "VBU20000-HV001", "VBU20000", "HV001")], "ws_name string, row_num int, allowed_pages array<int>, tag_class string, full_tag string, root string, component string")
    blocks = [(1, 0, "VBU20000", "edge", 0.0, 0.0), (1, 1, "HV001", "drawing", 900.0, 0.0), (2, 0, "VBU20000", "edge", 0.0, 0.0), (2, 1, "HV001", "drawing", 300.0, 300.0)]
    df = spark.createDataFrame([(*b, b[4] + 1, b[5] + 1) for b in blocks], "page_num int, block_idx int, compact string, zone string, x0 double, y0 double, x1 double, y1 double")
    got = match.block_fallback(parsed, df).collect()
    assert [(r.page_num, r.block_idx, r.cross_block) for r in got] == [(2, 0, True)] and got[0].confidence == pytest.approx(0.64)


def brute_greedy(candidates):
    used_a, used_b, out = set(), set(), set()
    for score, a, b in sorted(candidates, key=lambda c: (-c[0], c[1], c[2])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.add((a, b))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_rounds_equal_sequential_greedy(spark, seed):
    rnd = random.Random(seed)
    pairs = {(a, b): rnd.randint(0, 5) / 5 for a in range(12) for b in range(12) if rnd.random() < 0.5}
    rows = [(s, a, b) for (a, b), s in pairs.items()]
    df = spark.createDataFrame(rows, "score double, a int, b int")
    got = assign.greedy_pairs(df, ["a"], ["b"], [F.desc("score"), F.col("a"), F.col("b")])
    assert {(r.a, r.b) for r in got.collect()} == brute_greedy(rows)
    half = [(s, a, b) for s, a, b in rows if a < b]
    used, want = set(), set()
    for _, a, b in sorted(half, key=lambda c: (-c[0], c[1], c[2])):
        if not {a, b} & used:
            used |= {a, b}
            want.add((a, b))
    one = assign.greedy_one_set(spark.createDataFrame(half, "score double, a int, b int"), ["a"], ["b"], [F.desc("score"), F.col("a"), F.col("b")])
    assert {(r.a, r.b) for r in one.collect()} == want


def records(spark, names, **changes):
    files = spark.createDataFrame([(n, 0.0) for n in names], "path string, modified_at double")
    found = pairing.file_records(files)
    extra = {"page_count": F.lit(1), "width": F.lit(10.0), "height": F.lit(10.0), "fingerprint": F.lit("0" * 16), "preview": F.lit(""), "failed": F.lit(False)} | changes
    return found.withColumns(extra)


def test_sheet_pairing(spark):
    before = records(spark, ["b/DT0100 rev A.pdf", "b/DT0200 rev B.pdf", "b/DT0300.PDF", "b/DT0400 x.pdf", "b/DT0400 y.pdf", "b/none.pdf", "b/skip.txt"])
    after = records(spark, ["a/DT0100 rev B.pdf", "a/DT0200 rev A.pdf", "a/DT0400 x.pdf", "a/DT0500.pdf"])
    got = {(r.sheet_id, r.status, r.pairing_method) for r in pairing.pair_by_sheet(before, after).collect()}
    assert got == {
        ("DT0100", "matched", "sheet-id"), ("DT0200", "review_needed", "sheet-id-revision-regressed"), ("DT0300", "removed", "sheet-id-removed"),
        ("DT0400", "review_needed", "sheet-id-conflict"), ("DT0500", "added", "sheet-id-added"), (None, "review_needed", "sheet-id-parse-failed"),
    }
    assert pairing.pair_by_sheet(before, after).filter("sheet_id = 'DT0400'").count() == 2


def test_scored_and_mixed_pairing(spark):
    before, after = records(spark, ["b/Pump plan rev A.pdf", "b/Old valve list.pdf"]), records(spark, ["a/Pump plan rev B.pdf", "a/Quite other.pdf"])
    got = pairing.pair_scored(before, after).collect()
    first = next(r for r in got if r.before_path == "b/Pump plan rev A.pdf")
    assert first.status in ("matched", "review_needed") and first.after_path == "a/Pump plan rev B.pdf"
    assert all(sum(p in (r.before_path, r.after_path) for r in got) == 1 for p in ("b/Old valve list.pdf", "a/Quite other.pdf"))
    both = records(spark, ["m/Pump plan rev A.pdf", "m/Pump plan rev B.pdf", "m/alone.pdf"])
    mixed = pairing.pair_mixed(both).collect()
    pair = next(r for r in mixed if r.pairing_method.startswith("mixed-rev"))
    assert (pair.before_path, pair.after_path) == ("m/Pump plan rev A.pdf", "m/Pump plan rev B.pdf")
    assert any(r.pairing_method == "mixed-unpaired" and r.after_path == "m/alone.pdf" for r in mixed)


def rows_of(spark, texts, pair="p"):
    cells = [[c.strip() for c in t.split("|")] for t in texts]
    data = [(pair, "r", i, c, " ".join(c), " ".join(c).lower(), f"k{' '.join(c)}") for i, c in enumerate(cells)]
    return spark.createDataFrame(data, "pair_id string, region_id string, row_index int, cells array<string>, text string, normalized_text string, key string")


def changes(spark, before, after):
    got = diff.compare_rows(rows_of(spark, before), rows_of(spark, after)).collect()
    return sorted((r.change_type, r.before_text, r.after_text) for r in got)


def test_row_changes_by_anchor(spark):
    before = ["Tag ID | Size", "AA-100 | 5", "BB-200 | 6", "CC-300 | 7"]
    assert changes(spark, before, before) == []
    assert changes(spark, before, ["Tag ID | Size", "BB-200 | 6", "AA-100 | 9", "DD-400 | 1"]) == [
        ("added", "", "DD-400 1"), ("modified", "AA-100 5", "AA-100 9"), ("moved", "BB-200 6", "BB-200 6"), ("removed", "CC-300 7", ""),
    ]


def test_row_changes_by_sequence(spark):
    before, after = ["one", "two", "three", "four", "five"], ["zero", "nil", "none", "void", "blank"]
    got = changes(spark, before, after)
    assert [c for c, *_ in got] == ["modified"] * 5
    assert changes(spark, ["a b", "c d", "e f", "g h"], []) == sorted(("removed", t, "") for t in ("a b", "c d", "e f", "g h"))


def test_same_snapshots_have_no_changes(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 3)], "k int, x string, y int")
    assert {r.change for r in diff.snapshot_diff(df, df, ["k"], ["x", "y"]).collect()} == {"unchanged"}
    assert diff.cell_diff(df, df, ["k"], ["x", "y"]).count() == 0


def test_pages_align_one_to_one(spark):
    schema = "pair_id int, page_index int, fingerprint string, preview string, width double, height double"
    before = spark.createDataFrame([(1, i, h * 16, p, 10.0, 5.0) for i, (h, p) in enumerate([("0", "alpha"), ("f", "beta"), ("a", "gamma")])], schema)
    after = spark.createDataFrame([(1, i, h * 16, p, 5.0, 10.0) for i, (h, p) in enumerate([("f", "beta"), ("0", "alpha")])], schema)
    got = {(r.before_index, r.after_index) for r in diff.align_pages(before, after).collect()}
    assert got == {(0, 1), (1, 0), (2, None)}


def test_regions_match_by_kind(spark):
    schema = "pair_id int, region_id string, kind string, x0 double, y0 double, x1 double, y1 double, width double, height double, normalized_text string, header string, anchors array<string>, n_rows int"
    one = lambda i, kind, x, t: (1, i, kind, x, 0.0, x + 10, 10.0, 100.0, 100.0, t, t, [t], 1)
    before = spark.createDataFrame([one("b1", "general", 0.0, "same text"), one("b2", "bom-like", 50.0, "bom one"), one("b3", "general", 80.0, "gone")], schema)
    after = spark.createDataFrame([one("a1", "general", 1.0, "same text"), one("a2", "bom-like", 50.0, "bom one"), one("a3", "table-like", 80.0, "gone")], schema)
    got = {(r.b_region_id, r.a_region_id, r.change) for r in diff.match_regions(before, after).collect()}
    assert got == {("b1", "a1", "unchanged"), ("b2", "a2", "unchanged"), ("b3", None, "removed"), (None, "a3", "added")}


def test_sequence_ratio_keeps_its_sides(spark):
    from drawloom.functions.similarity import sequence_ratio

    pairs = [("abcd", "bcde"), ("", ""), ("x" * 300 + "ab", "ab" * 100), (None, "a")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(sequence_ratio("a", "b")).collect()]
    assert got == [SequenceMatcher(None, a or "", b or "").ratio() for a, b in pairs]


def test_words_to_merged_rows(spark):
    words = [(0.0, 0.0, "AB-1"), (30.0, 1.0, "pump"), (100.0, 0.5, "5"), (0.0, 20.0, "long"), (30.0, 20.0, "name"), (0.0, 60.0, "CD-2")]
    df = spark.createDataFrame([(1, 1, i, x, y, x + 20, y + 10, w) for i, (x, y, w) in enumerate(words)], "doc_id int, page_num int, seq int, x0 double, y0 double, x1 double, y1 double, word string")
    rows = layout.structured_rows(layout.row_cells(layout.words_to_rows(df)))
    assert [r.cells for r in rows.orderBy("row_index").collect()] == [["AB-1 pump", "5"], ["long name"], ["CD-2"]]
    merged = layout.merge_continuations(rows).orderBy("row_index").collect()
    assert [r.cells for r in merged] == [["AB-1 pump", "5", "long name"], ["CD-2"]]


def test_mask_components(spark):
    def pixels(x0, y0, x1, y1):
        return [y * 100 + x for y in range(y0, y1) for x in range(x0, x1)]

    df = spark.createDataFrame([(1, 100, 100, pixels(0, 0, 3, 3) + pixels(16, 16, 20, 20) + pixels(90, 90, 91, 91))], "id int, width int, height int, changed array<int>")
    got = sorted((r.x0, r.y0, r.x1, r.y1) for r in layout.mask_components(df, least=1).collect())
    assert got == [(0.0, 0.0, 32.0, 32.0), (80.0, 80.0, 96.0, 96.0)]


def test_matrix_filters(spark):
    df = spark.createDataFrame([("PANEL-1", "X"), ("ca-2", ""), ("zzz", None), (None, "")], "conn string, Obsolete string")
    groups = {r.conn: r.group for r in sync.group_rows(df, "conn", filters=[("obsolete", [""])]).collect()}
    assert groups == {"PANEL-1": "EL", "ca-2": "CA", "zzz": "Other", None: "Other"}
    strict = {r.conn: r.group for r in sync.group_rows(df, "conn", filters=[("obsolete", [""])], strict=True).collect()}
    assert strict == {"PANEL-1": "Other", "ca-2": "CA", "zzz": "Other", None: "Other"}
    log = [(r.group, r.n) for r in sync.group_log(sync.group_rows(df, "conn")).orderBy("output_index").collect()]
    assert log == [("CA", 1), ("EL", 1), ("Other", 2)]
    assert sync.group_rows(df, "conn", filters=[("missing", ["x"])]).filter("group <> 'Other'").count() == 0


def test_upsert_and_idempotent_changes(spark):
    required = spark.createDataFrame([(" e1", "EL-1", 1), ("E1", "-", 2), ("E1", "CA-9", 3)], "equipment_id string, connection_id string, seq int")
    model = spark.createDataFrame([(10, "E1", "el-1", 1), (11, "e1 ", "EL-1", 2), (12, "E1", "none", 3)], "element_id int, equipment_id string, connection_id string, seq int")
    got = {(r.connection, r.element_id, r.action) for r in sync.upsert_plan(required, model).collect()}
    assert got == {("EL-1", 11, "match"), ("CA-9", None, "insert"), (None, 10, "rogue"), (None, 12, "rogue")}
    matrix = spark.createDataFrame([("k1", "New", "None"), ("k2", "x", "y")], "id string, a string, b string")
    elements = lambda have: spark.createDataFrame([(1, "K1 ", "Fam One", have, 1)], "element_id int, equipment_id string, family string, params map<string,string>, seq int")
    mapping = spark.createDataFrame([("a", ["P", "Q"], ["one"]), ("b", ["R"], [])], "column string, params array<string>, families array<string>")
    first = sync.parameter_changes(matrix, "id", elements({"P": "old", "Q": "new"}), mapping, ["a", "b"]).collect()
    assert {(r.row_key, r.element_id, r.param) for r in first} == {("k1", 1, "P"), ("k2", None, "P"), ("k2", None, "Q"), ("k2", None, "R")}
    again = sync.parameter_changes(matrix, "id", elements({"P": "NEW", "Q": "New"}), mapping, ["a", "b"])
    assert again.filter("element_id is not null").count() == 0


def test_spacing_and_grids(spark):
    items = spark.createDataFrame([(1, i, 1.0, 0.5) for i in range(3)], "g int, i int, l double, w double")
    got = [r.step_offset for r in sync.even_spacing(items, ["g"], ["i"], "l", "w").orderBy("i").collect()]
    assert got == pytest.approx([-0.333, 0.0, 0.333])
    grid = placement.grid_layout(spark.range(30).select("id"), ["id"]).orderBy("id").collect()
    assert [(r.grid_row, r.grid_col) for r in grid[11:15]] == [(0, 11), (0, 12), (1, 0), (1, 1)]
    assert [r["index"] for r in grid] == list(range(30))
    slots = spark.range(70).select("id", placement.bus_slot(F.col("id")).alias("p"), placement.bus_slot(F.col("id"), wrap=False).alias("q")).collect()
    at = {r.id: tuple(r.p) for r in slots}
    assert at[14] == (0, 14) and at[15] == (1, 0) and at[65] == (3, 16) and at[66] == (3, 0)
    assert slots[65].q is not None and slots[66].q is None


def test_reports(spark, tmp_path):
    docs = spark.createDataFrame([("p1", "changed"), ("p2", "added"), ("p3", "review_needed")], "pair_id string, status string")
    flat = report.flatten_sections(report.sections(docs), ["pair_id"])
    assert {(r.section, r.row_index, r.pair_id) for r in flat.collect()} == {("changed", 0, "p1"), ("added", 0, "p2"), ("review", 0, "p3")}
    report.write_bundle(report.sections(docs), ["pair_id"], str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/manifest_json")).count() == 3
    with pytest.raises(ValueError, match="leads out"):
        report.safe_path(str(tmp_path), "../etc/passwd")


def test_fixed_values_are_whole():
    assert len(config.ISA_CODES) == len(set(config.ISA_CODES)) and len(config.EQUIPMENT_PREFIXES) == len(set(config.EQUIPMENT_PREFIXES))
    assert config.rules(bare={"reach": 9.0})["bare"] == {"codes": config.BARE_CODES, "reach": 9.0} and config.RULES["bare"]["reach"] == 420.0
    with pytest.raises(KeyError, match="bare.other"):
        config.rules(bare={"other": 1})


def test_blocks_by_anchors_equal_blocks_by_trial(spark, monkeypatch):
    blocks = spark.createDataFrame([(1, i, f"XX{i:05d}TNK20{i}PUMP{i % 7}") for i in range(60)] + [(1, 99, "AB"), (1, 98, "")], "page_num int, block_idx int, compact string")
    keys = spark.createDataFrame([(k,) for k in ("TNK20", "TNK2011PUMP4", "AB", "0001", "PUMP3", "XX00001TNK201PUMP1", "NOWHERE", "NOWHERETOBEFOUND")], "key string")
    want = {tuple(r) for r in match._blocks_with(blocks, keys).collect()}
    monkeypatch.setattr(match, "FEW_KEYS", 0)
    got = match._blocks_with(blocks, keys)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    assert {tuple(r) for r in got.collect()} == want and len(want) > 60


def test_sections_go_by_several_names(spark):
    docs = spark.createDataFrame([("p1", "changed")], "pair_id string, status string")
    sheets = report.report_sheets({"rows": docs}, {"Sheet Map": ("documents", "rows"), "Nothing": ("none",)}, {"Sheet Map": ["status", "title"]})
    assert list(sheets) == ["Sheet Map"] and [tuple(r) for r in sheets["Sheet Map"].collect()] == [("changed", None)]


def test_feedback_is_appended_and_rewritten(spark, tmp_path):
    entry = lambda i: spark.createDataFrame([(i, "scan", "error", f"t{i}")], "id long, source string, category string, timestamp string")
    at = str(tmp_path / "feedback")
    report.add_feedback(entry(1), at)
    report.add_feedback(entry(2), at)
    assert {(r.id, r.source, r.category) for r in spark.read.parquet(at).collect()} == {(1, "scanner", "bug"), (2, "scanner", "bug")}
    report.rewrite_feedback(entry(3), at)
    assert [r.id for r in spark.read.parquet(at).collect()] == [3]


def test_one_or_two_folders_are_paired(spark):
    with pytest.raises(ValueError, match="one mixed folder or two"):
        pairing.scan_and_pair([])


def test_changed_boxes_of_rows_of_unequal_length(spark):
    box = lambda x: (float(x), 0.0, x + 1.0, 1.0)
    kind = "struct<x0:double,y0:double,x1:double,y1:double>"
    rows = [(["a", "b", "c"], ["a", "x", "b", "c"], "a b c", "a x b c"), (["a", "b"], ["a", "B "], "a b", "a b"), ([], [], "", ""), (["p", "q"], ["r"], "p q", "r")]
    data = [(i, b, a, [box(j) for j in range(len(b))], [box(j) for j in range(len(a))], box(-1), box(-2), tb, ta) for i, (b, a, tb, ta) in enumerate(rows)]
    df = spark.createDataFrame(
        data, f"id int, b_cells array<string>, a_cells array<string>, b_cell_boxes array<{kind}>, a_cell_boxes array<{kind}>, b_box {kind}, a_box {kind}, b_normalized_text string, a_normalized_text string"
    )
    got = {r.id: ([x.x0 for x in r.before_boxes], [x.x0 for x in r.after_boxes]) for r in diff.changed_boxes(df).collect()}
    assert got == {0: ([-1.0], [1.0]), 1: ([], []), 2: ([-1.0], [-2.0]), 3: ([0.0, 1.0], [0.0])}


@given(st.text("abc d", max_size=30), st.text("abc d", max_size=30))
def test_ratio_is_that_of_the_standard_matcher(a, b):
    assert similarity.ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_tables_below_a_header_start_where_no_other_table_is(spark):
    lines = ["item qty model", "dev-1 2 ab12x", "item qty model type", "dev-2 3 cd34y", "far away text"]
    words = [(0, 1, 10 * i + j, 10.0 + 60 * j, 100.0 + 14 * i if i < 4 else 400.0, 50.0 + 60 * j, 110.0 + 14 * i if i < 4 else 410.0, w) for i, t in enumerate(lines) for j, w in enumerate(t.split())]
    df = spark.createDataFrame(words, "doc_id int, page_num int, seq int, x0 double, y0 double, x1 double, y1 double, word string")
    got = analyze.header_tables(layout.row_cells(layout.words_to_rows(df))).collect()
    assert [(r.table_index, r.header_row, r.row_indexes) for r in got] == [(0, 0, [0, 1, 2, 3])]
