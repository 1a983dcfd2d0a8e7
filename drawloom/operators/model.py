"""Reading a model snapshot: elements, symbols, parameters, and the first values of new elements.

``elements`` are rows of a snapshot (element_id, seq, category, family, ...);
``parameters`` (element_id, name, kind, value, display, read_only, seq).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawloom.operators.sync import family_applies

#: Cells that never write.
BLANK_CELLS = ("", "-", "None", "null")
#: Most families of a model that are broadcast.
FEW = 100_000


def scan_elements(elements: DataFrame, categories: list[str], family_part: str) -> DataFrame:
    """Elements of some categories whose family name holds ``family_part``."""
    return elements.filter(F.col("category").isin(*categories) & F.coalesce("family", F.lit("")).contains(family_part))


def symbol_cache(existing: DataFrame, symbols: DataFrame, terms: list[str]) -> DataFrame:
    """(family, symbol_id, place, seq): the first symbol of each family, those of existing elements before all others.

    Both sides are (family, symbol_id, seq); of ``symbols`` only families that hold one of ``terms``.
    """
    name = F.lower("family")
    wanted = reduce(lambda a, b: a | b, [name.contains(t.strip().lower()) for t in terms], F.lit(False))
    every = existing.select("family", "symbol_id", F.lit(0).alias("place"), "seq").unionByName(
        symbols.filter(wanted).select("family", "symbol_id", F.lit(1).alias("place"), "seq")
    )
    first = Window.partitionBy("family").orderBy("place", "seq")
    return every.filter(F.coalesce("family", F.lit("")) != "").withColumn("n_", F.row_number().over(first)).filter("n_ = 1").drop("n_")


def find_symbols(names: DataFrame, cache: DataFrame) -> DataFrame:
    """(name, symbol_id) of distinct names: the family of that name in any case, else the first that contains it.

    The cache has a row a family of the model; a family list beyond FEW is joined without a hint.
    """
    wanted = names.select("name").distinct().withColumn("key_", F.lower(F.trim("name")))
    known = cache.select(F.lower("family").alias("family_"), "symbol_id", "place", "seq")
    if known.count() <= FEW:
        known = F.broadcast(known)
    order = F.struct(F.col("family_") != F.col("key_"), "place", "seq")
    met = wanted.join(known, F.contains(F.col("family_"), F.col("key_")))
    best = met.groupBy("name").agg(F.min_by("symbol_id", order).alias("symbol_id"))
    return wanted.join(best, "name", "left").select("name", "symbol_id")


def place_symbols(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """(row, type_name, symbol_id, error) of rows with a type name: an exact look-up, misses with their message.

    ``symbols`` are (type_name, symbol_id), one row a type.
    """
    name = F.trim("type_name")
    wanted = rows.select("row", name.alias("type_name")).filter((F.col("type_name") != "") & (F.col("type_name") != "None"))
    found = wanted.join(symbols.select("type_name", "symbol_id"), "type_name", "left")
    error = F.concat(F.lit("Row "), F.col("row").cast("string"), F.lit(": '"), F.col("type_name"), F.lit("' not in project"))
    return found.select("row", "type_name", "symbol_id", F.when(F.col("symbol_id").isNull(), error).alias("error"))


def display_value(kind: Column, value: Column, display: Column) -> Column:
    """What a parameter shows: text itself, doubles as displayed or to four digits, integers and ids as digits."""
    number = F.bround(value.try_cast("double"), 4).cast("string")
    shown = F.when(F.coalesce(display, F.lit("")) != "", display).otherwise(F.coalesce(number, F.lit("")))
    return F.when(kind == "double", shown).otherwise(F.coalesce(value, F.lit("")))


def parameter_maps(parameters: DataFrame) -> DataFrame:
    """(element_id, params): a map of lower-case name to (kind, value, display, read_only); the last of equal names counts."""
    name = F.lower(F.trim("name"))
    entry = F.struct("kind", "value", display_value(F.col("kind"), F.col("value"), F.col("display")).alias("display"), F.coalesce("read_only", F.lit(False)).alias("read_only"))
    last = parameters.groupBy("element_id", name.alias("name")).agg(F.max_by(entry, "seq").alias("entry"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("name").alias("key"), F.col("entry").alias("value"))))
    return last.groupBy("element_id").agg(F.map_from_entries(listed).alias("params"))


def shown_value(own: Column, of_type: Column, names: Column, preferred: Column) -> Column:
    """The first display that is not blank of ``preferred`` and ``names`` in the maps of the element, then of its type."""
    ordered = F.array_distinct(F.transform(F.concat(F.array_compact(F.array(preferred)), names), lambda n: F.lower(F.trim(n))))
    displays = F.transform(ordered, lambda n: F.coalesce(F.try_element_at(own, n), F.try_element_at(of_type, n))["display"])
    filled = F.filter(displays, lambda d: F.trim(F.coalesce(d, F.lit(""))) != "")
    return F.when(F.size(filled) > 0, F.get(filled, F.lit(0))).otherwise(F.lit(""))


def initial_writes(inserted: DataFrame, cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """(element_id, column, param, kind, value): first values of inserted elements.

    ``inserted`` are (element_id, row_key, family, params, type_params) with
    maps of ``parameter_maps``, ``cells`` (row_key, column, value), ``mapping``
    (column, params, families).  Blank cells never write.  A family that is not
    listed writes all the same where one of the parameters is there.  Text is
    written in upper case, integers through a float, and nothing that is read-only.
    """
    value = F.trim("value")
    filled = cells.filter(~F.coalesce(value, F.lit("")).isin(*BLANK_CELLS)).select("row_key", F.lower(F.trim("column")).alias("column"), value.alias("value"))
    plan = mapping.select(F.lower(F.trim("column")).alias("column"), F.col("params").alias("wanted"), "families")
    rows = inserted.join(filled, "row_key").join(plan, "column")
    name = lambda n: F.lower(F.trim(n))
    there = F.exists("wanted", lambda n: F.map_contains_key("params", name(n)) | F.map_contains_key("type_params", name(n)))
    rows = rows.filter(family_applies(F.col("family"), F.col("families")) | there)
    each = rows.withColumn("param", F.explode("wanted")).withColumn("p", F.try_element_at("params", name(F.col("param"))))
    each = each.filter(F.col("p").isNotNull() & ~F.col("p.read_only"))
    whole = F.col("value").try_cast("double").cast("bigint").cast("string")
    written = F.when(F.col("p.kind") == "string", F.upper("value")).when(F.col("p.kind") == "integer", whole).when(F.col("p.kind") == "double", F.col("value"))
    return each.select("element_id", "column", "param", F.col("p.kind").alias("kind"), written.alias("value")).filter("value is not null")


def family_counts(elements: DataFrame) -> DataFrame:
    """(family, instances) of the model."""
    return elements.groupBy("family").agg(F.count(F.lit(1)).alias("instances"))


def move_counts(moves: DataFrame) -> DataFrame:
    """(status, n) of elements by their move status."""
    return moves.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
