"""Tables out of spreadsheet rows and loose data packages."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawloom.functions import geometry as G


def sheet_table(rows: DataFrame, sheet: str, header_row: int = 1) -> DataFrame:
    """The rows below a sheet's header as columns named by it, lower case and trimmed, all text, with row_num.

    Empty headers are skipped and the last of equal headers counts.  Only the
    header row comes to the driver.
    """
    at = max(1, header_row)
    own = rows.filter(F.col("sheet") == sheet)
    head = own.filter(F.col("row_num") == at).first()
    names = {}
    for i, name in enumerate(head["cells"] if head else []):
        if name is not None and name.strip():
            names[name.strip().lower()] = i
    below = own.filter(F.col("row_num") > at)
    return below.select("row_num", *[F.get("cells", F.lit(i)).alias(name) for name, i in names.items()])


def records(package: object) -> Iterator[dict]:
    """Records of a data package: a list of records or of nested packages, a record of columns,
    [headers, rows], or a record itself; mappings and logs beside the data are dropped."""
    if isinstance(package, dict):
        if "FlatData" in package or "GroupedData" in package:
            inner = package.get("FlatData", package.get("GroupedData"))
            yield from records(list(inner.values()) if isinstance(inner, dict) else inner)
        elif package and all(isinstance(v, (list, tuple)) for v in package.values()):
            n = max(map(len, package.values()))
            yield from ({k: v[i] if i < len(v) else None for k, v in package.items()} for i in range(n))
        elif package:
            yield package
    elif isinstance(package, (list, tuple)) and package:
        head, *rest = package
        if isinstance(head, (list, tuple)) and head and all(isinstance(h, str) for h in head):
            inner = rest[0] if len(rest) == 1 and isinstance(rest[0], list) and rest[0] and isinstance(rest[0][0], (list, tuple)) else rest
            if len(rest) == 1 and isinstance(rest[0], dict):
                yield from records({h: rest[0].get(h, []) for h in head})
            else:
                yield from ({h: row[i] if i < len(row) else None for i, h in enumerate(head)} for row in inner)
        else:
            for item in package:
                yield from records(item)


def package_table(spark: SparkSession, package: object) -> DataFrame:
    """A data package as a table of text columns, in the order in which keys first appear."""
    found = list(records(package))
    names = list(dict.fromkeys(k for r in found for k in r))
    rows = [tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in found]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)) if names else spark.createDataFrame([], "empty string")


def union_box(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The smallest box around the boxes of each key."""
    sides = [(F.min if s.endswith("0") else F.max)(s).alias(s) for s in G.SIDES]
    return boxes.groupBy(*keys).agg(*sides)
