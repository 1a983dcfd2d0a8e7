"""Spreadsheets without other libraries: a reader and a writer of XLSX packages.

``spark.read.format("drawloom_xlsx").load(path)`` gives one row a sheet row
(path, sheet, row_num, cells).  Each workbook is one partition; sheets are
parsed as a stream, so a long sheet never stands in memory.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SCHEMA = StructType(
    [
        StructField("path", StringType()),
        StructField("sheet", StringType()),
        StructField("row_num", IntegerType()),
        StructField("cells", ArrayType(StringType())),
    ]
)
#: Characters that a sheet name may not have, and its longest length.
BAD_NAME = re.compile(r"[\[\]:*?/\\]")
NAME_LENGTH = 31
CELL_LENGTH = 32767
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def column_number(reference: str) -> int:
    """B7 to 2."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as file:
        return ["".join(t.text or "" for t in e.iter(f"{MAIN}t")) for _, e in ElementTree.iterparse(file) if e.tag == f"{MAIN}si"]


def sheet_files(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, member) of the sheets in their order."""
    rels = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    targets = {r.get("Id"): r.get("Target", "") for r in rels}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    found = []
    for s in sheets:
        target = targets[s.get(f"{REL}id")]
        found.append((s.get("name", ""), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return found


def _value(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    v = cell.find(f"{MAIN}v")
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "TRUE" if v.text == "1" else "FALSE"
    return v.text


def read_rows(data: io.IOBase | bytes | str) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells) of a workbook; gaps between cells are nulls."""
    source = io.BytesIO(data) if isinstance(data, bytes) else data
    with zipfile.ZipFile(source) as book:
        shared = _shared(book)
        for name, member in sheet_files(book):
            with book.open(member) as file:
                at = 0
                for _, row in ElementTree.iterparse(file):
                    if row.tag != f"{MAIN}row":
                        continue
                    at = int(row.get("r") or at + 1)
                    cells: list[str | None] = []
                    for cell in row.iter(f"{MAIN}c"):
                        n = column_number(cell.get("r") or "") or len(cells) + 1
                        cells += [None] * (n - 1 - len(cells))
                        cells.append(_value(cell, shared))
                    yield name, at, cells
                    row.clear()


def sheet_named(names: list[str], wanted: str) -> str | None:
    """The sheet of a name: equal, else equal but for case and blanks, else the first that contains it."""
    loose = lambda s: re.sub(r"\s+", "", s).lower()
    tests = (lambda n: n == wanted, lambda n: loose(n) == loose(wanted), lambda n: loose(wanted) in loose(n))
    return next((n for test in tests for n in names if test(n)), None)


class _Book(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_Book(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import pyarrow.fs as pafs

        fs, at = pafs.FileSystem.from_uri(partition.path)
        with fs.open_input_file(at) as file:
            for sheet, row, cells in read_rows(file):
                yield partition.path, sheet, row, cells


class XlsxSource(DataSource):
    """Workbooks below a path or a file."""

    @classmethod
    def name(cls) -> str:
        return "drawloom_xlsx"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        import pyarrow.fs as pafs

        uri = self.options["path"]
        uri = uri if "://" in uri else f"file://{uri}"
        fs, at = pafs.FileSystem.from_uri(uri)
        root = uri[: len(uri) - len(at)]
        info = fs.get_file_info(at)
        files = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(at, recursive=True))
        return _Reader(sorted(root + f.path for f in files if f.is_file and f.path.lower().endswith(".xlsx")))


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(XlsxSource)
    return spark.read.format("drawloom_xlsx").load(path)


def sheet_names(names: list[str]) -> list[str]:
    """Legal, distinct sheet names of at most 31 characters."""
    out: list[str] = []
    for name in names:
        base = BAD_NAME.sub("_", name).strip().strip("'")[:NAME_LENGTH] or "Sheet"
        tried, n = base, 1
        while tried.lower() in (x.lower() for x in out):
            n += 1
            tried = f"{base[: NAME_LENGTH - len(str(n)) - 1]}_{n}"
        out.append(tried)
    return out


def _cell(reference: str, value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{reference}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{reference}"><v>{value}</v></c>'
    text = escape(CONTROL.sub("", str(value))[:CELL_LENGTH])
    return f'<c r="{reference}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def write_workbook(path: str, sections: dict[str, DataFrame]) -> None:
    """One sheet for each section, header first; rows stream through the driver one at a time."""
    names = sheet_names(list(sections))
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    package = "http://schemas.openxmlformats.org/package/2006"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for i, df in enumerate(sections.values(), 1):
            with book.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                out.write(f'{head}<worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
                for r, row in enumerate(_with_header(df), 1):
                    cells = "".join(_cell(f"{column_letters(c)}{r}", v) for c, v in enumerate(row, 1))
                    out.write(f'<row r="{r}">{cells}</row>'.encode())
                out.write(b"</sheetData></worksheet>")
        sheets = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{office}"><sheets>{sheets}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{rels}</Relationships>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(names) + 1))
        book.writestr(
            "[Content_Types].xml",
            f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>',
        )


def _with_header(df: DataFrame) -> Iterator[tuple]:
    yield tuple(df.columns)
    for row in df.toLocalIterator():
        yield tuple(row)
