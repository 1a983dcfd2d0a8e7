"""Folders of drawings, uploads and tables."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawloom.operators.report import safe_path

MAGIC = b"%PDF-"


def scan_folder(spark: SparkSession, path: str, group: str) -> DataFrame:
    """(path, length, modified_at, source_group, failed) of the PDF files below a folder, names in either case.

    Only the first bytes decide whether a file can be read; a file that can't
    is a row with ``failed`` set, and never ends the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    bad = F.substring("content", 1, 5) != F.lit(MAGIC)
    return files.select("path", "length", F.unix_timestamp("modificationTime").cast("double").alias("modified_at"), F.lit(group).alias("source_group"), bad.alias("failed"))


def unpack(archive: str, to: str) -> list[str]:
    """The PDF members of a ZIP file below ``to``; members that lead out of it are refused, others skipped."""
    out = []
    with zipfile.ZipFile(archive) as packed:
        for member in packed.infolist():
            if member.is_dir() or not member.filename.lower().endswith(".pdf"):
                continue
            at = safe_path(to, member.filename)
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_bytes(packed.read(member))
            out.append(str(at))
    return sorted(out)


def checked_file(path: str, kinds: tuple[str, ...]) -> str:
    """An existing file of one of the extensions."""
    at = Path(path)
    if not path or not at.is_file():
        raise FileNotFoundError(path or "no path")
    if kinds and at.suffix.lower() not in kinds:
        raise ValueError(f"unsupported file type: {at.suffix}")
    return str(at.resolve())


def sheet_fallbacks(text: str | None, default: dict[str, int] | None = None) -> dict[str, int]:
    """Sheet to page from "A:1, B:2"; parts that don't read so are skipped."""
    if text is None:
        return dict(default or {"DG7002": 6})
    out: dict[str, int] = {}
    for part in text.split(","):
        sheet, colon, page = part.partition(":")
        if colon and sheet.strip() and page.strip().isdigit() and any(c.isdigit() for c in sheet):
            out[sheet.strip()] = int(page)
    return out


def pdf_spans(spark: SparkSession, path: str) -> DataFrame:
    """Text spans of PDF files, one partition a file; needs an optional library and says so where it is missing."""
    try:
        import fitz
    except ImportError as error:
        raise ImportError("reading PDF files needs the optional PyMuPDF library; pass a spans table instead") from error

    schema = "doc_id string, page_num int, span_id int, text string, x0 double, y0 double, x1 double, y1 double, size double"

    def read(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for at, content in zip(pdf["path"], pdf["content"], strict=True):
                with fitz.open(stream=content, filetype="pdf") as doc:
                    for number, page in enumerate(doc, 1):
                        n = 0
                        for block in page.get_text("dict")["blocks"]:
                            for span in (s for line in block.get("lines", ()) for s in line["spans"] if s["text"].strip()):
                                box = (fitz.Rect(span["bbox"]) * page.rotation_matrix).normalize()
                                rows.append((at, number, n, span["text"], box.x0, box.y0, box.x1, box.y1, span["size"]))
                                n += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return files.select("path", "content").mapInPandas(read, schema)


def feedback_table(spark: SparkSession, path: str, seed_json: str | None = None) -> DataFrame:
    """The feedback table at ``path``; where there is none it is seeded from a JSON list once."""
    schema = "id string, timestamp string, source string, category string, message string"
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:  # the path does not exist yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    seed = spark.read.schema(schema).option("multiLine", True).json(seed_json) if seed_json else spark.createDataFrame([], schema)
    seed.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
