"""Report sections."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawloom.operators.placement import running_index

#: The sections of a revision report and the statuses they hold.
SECTIONS = {
    "changed": ("changed",),
    "added": ("added",),
    "removed": ("removed",),
    "unchanged": ("unchanged",),
    "review": ("review_needed",),
}
#: What feedback sources and categories are called.
FEEDBACK_SOURCES = {"scan": "scanner", "scanner": "scanner", "compare": "comparator", "comparator": "comparator", "user": "portal", "portal": "portal"}
FEEDBACK_CATEGORIES = {"bug": "bug", "error": "bug", "issue": "bug", "idea": "feature", "feature": "feature", "request": "feature"}
#: Fill colours by rating and by change.
RATING_FILLS = {"High": "C6EFCE", "Medium": "FFEB9C", "Low": "FFC7CE"}
CHANGE_FILLS = {"added": "00B050", "removed": "FF0000", "modified": "FFC000", "moved": "0070C0"}


def sections(documents: DataFrame) -> dict[str, DataFrame]:
    """One DataFrame for each section of documents with a status."""
    return {name: documents.filter(F.col("status").isin(*have)) for name, have in SECTIONS.items()}


def flatten_sections(parts: dict[str, DataFrame], order: list[str]) -> DataFrame:
    """All sections by name with section and row_index, 0 on, in ``order``; a section is numbered in ranges, not in one task."""
    def one(name: str, df: DataFrame) -> DataFrame:
        placed = running_index(df, [c for c in order if c in df.columns])
        return placed.withColumn("section", F.lit(name)).withColumn("row_index", F.col("index").cast("int")).drop("index")

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(n, d) for n, d in parts.items()])


def run_summary(documents: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Documents, and documents of each status, in one row."""
    return documents.agg(F.count(F.lit(1)).alias("documents"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def lookup(c: Column, names: dict[str, str], default: str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(F.coalesce(c, F.lit(""))))), F.lit(default))


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """Feedback with its source and category normalised, newest first by text time."""
    return feedback.withColumn("source", lookup(F.col("source"), FEEDBACK_SOURCES, "portal")).withColumn(
        "category", lookup(F.col("category"), FEEDBACK_CATEGORIES, "general")
    ).orderBy(F.desc("timestamp"), "id")


def write_bundle(parts: dict[str, DataFrame], order: list[str], folder: str) -> None:
    """Each section as Parquet, all of them as CSV and as JSON lines."""
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{folder}/sections/{name}")
    flat = flatten_sections(parts, order)
    flat.write.mode("overwrite").option("header", True).csv(f"{folder}/manifest_csv")
    flat.write.mode("overwrite").json(f"{folder}/manifest_json")


def safe_path(root: str, name: str) -> Path:
    """``name`` below ``root``; anything that leads out of it is refused."""
    base = Path(root).resolve()
    at = (base / name).resolve()
    if base != at and base not in at.parents:
        raise ValueError("the path leads out of its folder")
    return at


def first_section(parts: dict[str, DataFrame], aliases: tuple[str, ...]) -> DataFrame | None:
    """The first section that goes by one of its names."""
    return next((parts[a] for a in aliases if a in parts), None)


def report_sheets(parts: dict[str, DataFrame], aliases: dict[str, tuple[str, ...]], columns: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The sheets of a report in the order of ``aliases``: known columns first where they are named, missing ones null, else all."""
    out = {}
    for name, names in aliases.items():
        found = first_section(parts, names)
        wanted = columns.get(name, [])
        if found is not None and wanted:
            found = found.select(*[F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in wanted])
        if found is not None:
            out[name] = found
    return out


def add_feedback(entries: DataFrame, folder: str) -> None:
    """Append entries to a feedback table."""
    latest_feedback(entries).write.mode("append").parquet(folder)


def rewrite_feedback(entries: DataFrame, folder: str) -> None:
    """Replace a feedback table; ``entries`` must not read it."""
    latest_feedback(entries).write.mode("overwrite").parquet(folder)


def listing_counts(files: DataFrame) -> DataFrame:
    """(folder, files, pdfs, bytes) of a listing (path, length)."""
    folder = F.regexp_replace("path", r"[/\\][^/\\]*$", "")
    pdf = F.lower("path").endswith(".pdf")
    return files.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.count_if(pdf).alias("pdfs"), F.sum("length").alias("bytes"))


def run_states(events: DataFrame) -> DataFrame:
    """(run_id, state, message, events) of run logs (run_id, at, seq, state, message): the last entry says where a run stands."""
    last = F.max_by(F.struct("state", "message"), F.struct("at", "seq"))
    return events.groupBy("run_id").agg(last.alias("l_"), F.count(F.lit(1)).alias("events")).select("run_id", "l_.*", "events")
