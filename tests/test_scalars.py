"""Scalar functions on hand-worked values."""

import pytest
from pyspark.sql import functions as F

from drawloom.functions import tags as N
from drawloom.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("function", "given", "want"),
    [
        (T.normalize_token, " rl7–tnk 102.; ", "RL7-TNK 102"), (T.normalize_token, None, ""), (T.normalize_token, "\t(a b)\n", "A B"),
        (T.strip_pipe_size, '3/4"-CA-12A', "CA-12A"), (T.strip_pipe_size, '1 3/8" - FRE-18A', "FRE-18A"), (T.normalize_pipe_size, ' 1  3 / 8" ', "1 3/8"),
        (N.canonical_root, "RL7-PMP103", "RL7-PMP-103"), (N.canonical_root, "rl7 tnk 102", "RL7-TNK-102"), (N.compact_child, "LIT-01", "LIT01"), (N.compact_child, "LIT 01", "LIT 01"),
        (N.looks_asset, "VBU20000", True), (N.looks_asset, "TNK41101", True), (N.looks_asset, "BA2", False), (N.looks_asset, "HV20000", False), (N.looks_asset, "DG7002", False),
        (N.looks_hyphen_root, "RL7-5000", True), (N.looks_hyphen_root, "RX7-5000", False), (N.looks_isa_child, "TCV-01", True), (N.looks_isa_child, "QQ01", False),
        (N.instrument_code, "LIT01", "LIT"), (T.sheet_id_in, "x dt0100 y", "DT0100"), (T.sheet_id_in, "DT01000", None),
        (T.strip_version_tokens, "Plan_A rev B v3 2024-03-05", "Plan A"), (T.revision_value, "c", 3.0), (T.revision_value, "12", 12.0), (T.revision_value, "b2", None),
        (T.date_hints, "issued 2024-03-05", ["2024-03-05"]), (T.date_hints, "3-5-24", ["2024-03-05"]), (T.date_hints, "none", []),
        (T.normalize_sheet_id, "c:/x/AREA-DG7002.dwg", "DG7002"), (T.normalize_sheet_id, "see dg7002a now", "DG7002A"), (T.normalize_sheet_id, "12", "12"),
        (T.preview_lines, "abc\nabcd\n abcd \nlonger line", ["abcd", "longer line"]), (T.safe_slug, "..a b/c!", "a_b_c"),
    ],
)
def test_scalar(spark, function, given, want):
    assert value(spark, function(F.lit(given).cast("string"))) == want


@pytest.mark.parametrize(
    ("cell", "want"),
    [
        ("VBU20000-XV001", ("VBU20000-XV001", "VBU20000", "XV001", "instrument")), ("VBU20000 XV001", ("VBU20000-XV001", "VBU20000", "XV001", "instrument")),
        ("RL7-TNK-102-LIT-01", ("RL7-TNK-102-LIT01", "RL7-TNK-102", "LIT01", "instrument")), ('3/4"-CA-12A', ('3/4"-CA-12A', "CA", "12A", "line")),
        ('1 3/8"-FRE-18A-2"', ('1 3/8"-FRE-18A', "FRE", "18A", "line")), ("RL7-PMP103", ("RL7-PMP-103", "RL7-PMP-103", "", "equipment")),
        ("VBU20000-CHR001", ("VBU20000-CHR001", "VBU20000", "CHR001", "equipment")), ("CA-12A", ("-CA12A", "", "CA12A", "instrument")), ("TNK41101", ("TNK41101", "TNK41101", "", "equipment")),
        ("DWG-12", None), ("", None), (None, None), ("plain words", None), ("VBU20000-QQ01", ("VBU20000-QQ01", "VBU20000", "QQ01", "instrument")),
    ],
)
def test_parse_tag(spark, cell, want):
    got = value(spark, N.parse_tag(F.lit(cell).cast("string")))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("x", "want"), [(0.90, "High"), (0.70, "Medium"), (0.699, "Low")])
def test_rating(spark, x, want):
    assert value(spark, N.rating(F.lit(x))) == want


@pytest.mark.parametrize(
    ("sheet", "title", "want"),
    [
        ("DT0100", "", "general_notes"), ("DT1500", "", "overall_plan"), ("DT4100", "", "area_plan"), ("DT5100", "", "detail"), ("DT6001", "", "schedule"),
        ("DT6500", "", "mdf_idf_layout"), ("DT7000", "", "unknown"), (None, "IDF layout", "mdf_idf_layout"), (None, "x", "unknown"),
    ],
)
def test_sheet_family(spark, sheet, title, want):
    assert value(spark, N.sheet_family(F.lit(sheet).cast("string"), F.lit(title))) == want


@pytest.mark.parametrize(
    ("before", "after", "want"),
    [("A", "B", "revised"), ("B", "A", "revision_regressed"), ("1", "1", "same_revision"), ("A", None, "revision_unknown"), (None, None, "no_revision"), ("a", " A", "same_revision")],
)
def test_revision_status(spark, before, after, want):
    assert value(spark, N.revision_status(F.lit(before).cast("string"), F.lit(after).cast("string"))) == want


def test_similarities(spark):
    lists = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert value(spark, T.jaccard(lists("a", "b"), lists("b", "c"))) == pytest.approx(1 / 3)
    assert value(spark, T.jaccard(lists(), lists("b"))) == 0.0
    assert value(spark, T.hamming_similarity(F.lit("f" * 16), F.lit("0" * 16))) == 0.0
    assert value(spark, T.hamming_similarity(F.lit("8" + "0" * 15), F.lit("0" * 16))) == 1 - 1 / 64
    assert value(spark, T.hamming_similarity(F.lit(""), F.lit("0" * 16))) == 0.0
