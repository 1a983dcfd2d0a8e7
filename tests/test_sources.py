"""Sources, sinks and streams."""

import zipfile
from datetime import datetime

import pytest

from drawloom.operators import match
from drawloom.sources import files, xlsx
from drawloom.streaming import ingest


def test_workbook_round_trip(spark, tmp_path):
    rows = [("a<b>&", 1, 2.5, True, None), ("é\x01x", -3, 0.0, False, "last")]
    df = spark.createDataFrame(rows, "t string, i int, d double, b boolean, n string")
    at = str(tmp_path / "book.xlsx")
    xlsx.write_workbook(at, {"One": df, "one": df.limit(0), "Bad/Name[" + "x" * 40: df.select("t")})
    got = xlsx.read_workbooks(spark, str(tmp_path)).collect()
    names = {r.sheet for r in got}
    assert len(names) == 3 and all(len(n) <= 31 for n in names) and "One" in names and "one_2" in names
    one = {r.row_num: list(r.cells) for r in got if r.sheet == "One"}
    assert one[1] == ["t", "i", "d", "b", "n"]
    assert one[2] == ["a<b>&", "1", "2.5", "TRUE"] and one[3] == ["éx", "-3", "0.0", "FALSE", "last"]
    assert xlsx.sheet_named(["Main", "UM Mapping"], "ummapping") == "UM Mapping"
    assert xlsx.column_number("AB7") == 28 and xlsx.column_letters(28) == "AB"


def test_tag_list_of_a_workbook(spark, tmp_path):
    rows = [("Notes", "of the job"), ("Tag No.", "Drawing"), ("VBU20000-XV001", "DG7002"), (" ", "x")]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    xlsx.write_workbook(str(tmp_path / "list.xlsx"), {"List": df})
    cells = xlsx.read_workbooks(spark, str(tmp_path / "list.xlsx")).selectExpr("sheet as ws_name", "row_num", "cells")
    got = [(r.row_num, r.raw_tag, r.raw_sheet) for r in match.read_tag_list(cells).collect()]
    assert got == [(4, "VBU20000-XV001", "DG7002")]


def test_folder_scan_and_uploads(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/DT0001.PDF").write_bytes(b"%PDF-1.4\n%%EOF")
    (tmp_path / "in/broken.pdf").write_bytes(b"nothing")
    (tmp_path / "in/other.txt").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: r.failed for r in files.scan_folder(spark, str(tmp_path / "in"), "before").collect()}
    assert got == {"DT0001.PDF": False, "broken.pdf": True}
    with zipfile.ZipFile(tmp_path / "up.zip", "w") as z:
        z.writestr("old/DT0001.pdf", "x")
        z.writestr("readme.txt", "x")
    assert [p.rsplit("/", 1)[1] for p in files.unpack(str(tmp_path / "up.zip"), str(tmp_path / "out"))] == ["DT0001.pdf"]
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../../evil.pdf", "x")
    with pytest.raises(ValueError, match="leads out"):
        files.unpack(str(tmp_path / "bad.zip"), str(tmp_path / "out"))
    with pytest.raises(ValueError, match="unsupported"):
        files.checked_file(str(tmp_path / "up.zip"), (".pdf",))


def test_sheet_fallbacks():
    assert files.sheet_fallbacks(None) == {"DG7002": 6}
    assert files.sheet_fallbacks("DG7002:6, DG7003:7, bad, DGX:2, DG7004:no") == {"DG7002": 6, "DG7003": 7}


def test_feedback_is_seeded_once(spark, tmp_path):
    (tmp_path / "seed.json").write_text('[{"id": "1", "timestamp": "t", "source": "s", "category": "c", "message": "m"}]')
    at = str(tmp_path / "feedback")
    assert files.feedback_table(spark, at, str(tmp_path / "seed.json")).count() == 1
    files.feedback_table(spark, at).limit(1).write.mode("append").parquet(at)
    assert files.feedback_table(spark, at, str(tmp_path / "seed.json")).count() == 2


def test_stream_of_line_tags(spark, tmp_path):
    rows = [("d", 1, i, t, 0.0, 0.0, 1.0, 1.0, 1.0, datetime(2024, 1, 1, 0, i)) for i, t in enumerate(['3/4"-CA-12A', '3/4"-CA-12A', "note", "VBU20000"])]
    spark.createDataFrame(rows, ingest.SPANS).write.parquet(str(tmp_path / "in"))
    stream = ingest.line_tag_stream(spark, str(tmp_path / "in"))
    for _ in range(2):
        query = ingest.append_new(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination(120)
    assert [r.full_tag for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ['3/4"-CA-12A']
    counts = ingest.append_new(ingest.tag_counts_stream(spark, str(tmp_path / "in"), late="0 seconds"), str(tmp_path / "c"), str(tmp_path / "s2"))
    counts.awaitTermination(120)
    assert counts.exception() is None


def test_tables_of_sheets_and_packages(spark):
    from drawloom.sources import tables

    rows = [("p", "Main", 1, ["note"]), ("p", "Main", 2, [" Tag ", None, "SIZE", "size"]), ("p", "Main", 3, ["a", "b", "1", "2"]), ("p", "Main", 4, ["c"]), ("p", "Other", 3, ["x"])]
    df = spark.createDataFrame(rows, xlsx.SCHEMA)
    got = tables.sheet_table(df, "Main", 2).orderBy("row_num").collect()
    assert [r.asDict() for r in got] == [{"row_num": 3, "tag": "a", "size": "2"}, {"row_num": 4, "tag": "c", "size": None}]
    same = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    for package in (
        same, [[same[0]], [same[1]]], {"a": [1, 2], "b": ["x"]}, [["a", "b"], [1, "x"], [2]], [["a", "b"], [[1, "x"], [2, None]]], [["a", "b"], {"a": [1, 2], "b": ["x"]}],
        {"FlatData": same, "Mapping": {"q": 1}, "Log": []}, {"GroupedData": {"g": [same[0]], "h": [same[1]]}},
    ):
        assert [r.asDict() for r in tables.package_table(spark, package).collect()] == [{"a": "1", "b": "x"}, {"a": "2", "b": None}]
    assert tables.package_table(spark, []).count() == 0
    boxes = spark.createDataFrame([(1, 0.0, 5.0, 2.0, 6.0), (1, 1.0, 3.0, 9.0, 4.0)], "k int, x0 double, y0 double, x1 double, y1 double")
    assert tuple(tables.union_box(boxes, ["k"]).first()) == (1, 0.0, 3.0, 9.0, 6.0)
