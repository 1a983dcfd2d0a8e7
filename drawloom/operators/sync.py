"""Planning the synchronisation of a spreadsheet matrix with model elements.

Nothing is written to a model: every operator returns the rows of changes that
a consumer would apply.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Service prefixes in the order in which they are tried, and the connector family of each.
SERVICES = ("CA", "DRN", "EL", "EX", "HH", "INT", "PCW", "PHW", "TD")
FAMILIES = {
    "CA": "pipe", "DRN": "pipe", "HH": "pipe", "PCW": "pipe", "PHW": "pipe", "EL": "electrical", "EX": "duct",
    "INT": "duct", "TD": "data",
}
SHEET_BLANKS = ("-", "None", "", "null")
MODEL_BLANKS = ("-", "NONE", "", "NULL")
MOVE_TOLERANCE = 0.0026
#: Most columns of a mapping sheet that are broadcast.
FEW_COLUMNS = 100_000


def keep_mapped_rows(rows: DataFrame, mapped: list[str]) -> DataFrame:
    """Rows in which a mapped column is not null; headers match in any case."""
    have = {c.strip().lower(): c for c in rows.columns}
    used = [have[m.strip().lower()] for m in mapped if m.strip().lower() in have]
    return rows.filter(F.coalesce(*[F.col(c).cast("string") for c in used]).isNotNull()) if used else rows.limit(0)


def _holds(cell: Column, value: str) -> Column:
    return F.lower(F.trim(F.coalesce(cell.cast("string"), F.lit("")))).contains(value.strip().lower())


def primary_group(cell: Column, values: tuple[str, ...] = SERVICES) -> Column:
    """The first value that the cell contains, else Other.  Containment, so PANEL-1 is in EL."""
    return F.coalesce(*[F.when(_holds(cell, v), v) for v in values], F.lit("Other"))


def supplementary(rows: DataFrame, filters: list[tuple[str, list[str]]], logic: str = "AND", *, strict: bool = False) -> Column:
    """Whether a row passes column filters; a missing column fails.

    An empty value is contained in every cell; with ``strict`` it matches
    empty cells only, as such filters are meant.
    """
    have = {c.strip().lower(): c for c in rows.columns}
    tests = []
    for name, values in filters:
        at = have.get(name.strip().lower())
        if at is None:
            tests.append(F.lit(False))
            continue
        blank = F.trim(F.coalesce(F.col(at).cast("string"), F.lit(""))) == ""
        each = [blank if strict and not v.strip() else _holds(F.col(at), v) for v in values]
        tests.append(reduce(lambda a, b: a | b, each, F.lit(False)))
    if not tests:
        return F.lit(True)
    return reduce(lambda a, b: (a & b) if logic.upper() == "AND" else (a | b), tests)


def group_rows(rows: DataFrame, column: str, values: tuple[str, ...] = SERVICES, filters: list | None = None, logic: str = "AND", *, strict: bool = False) -> DataFrame:
    """Add ``group``; rows that fail the supplementary filters go to Other, none is dropped."""
    group = primary_group(F.col(column), values)
    return rows.withColumn("group", F.when(supplementary(rows, filters or [], logic, strict=strict), group).otherwise("Other"))


def group_log(grouped: DataFrame) -> DataFrame:
    """(group, n, output_index): groups with rows in order of name, Other last."""
    counts = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("group") == "Other", "group")  # one row a group
    return counts.withColumn("output_index", F.row_number().over(order) - 1)


def unpivot_mapping(rows: DataFrame, key: str, params: str, families: list[str]) -> DataFrame:
    """(column, params, families) of a mapping sheet: columns marked yes become families, rows without any go."""
    long = rows.unpivot([key, params], families, "family", "mark").filter(F.lower(F.trim("mark")) == "yes")
    split = F.filter(F.transform(F.split(params, ","), lambda p: F.trim(p)), lambda p: p != "")
    return long.groupBy(F.trim(key).alias("column")).agg(
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(params).alias("p"), split.alias("s")))), lambda x: x["s"]))).alias("params"),
        F.array_sort(F.collect_set("family")).alias("families"),
    )


def family_applies(family: Column, families: Column) -> Column:
    """Whether a family name contains or is contained in one of ``families``; an empty list applies to all."""
    f = F.lower(F.trim(family))
    near = F.exists(families, lambda x: F.contains(f, F.lower(F.trim(x))) | F.contains(F.lower(F.trim(x)), f))
    return (F.size(families) == 0) | near


def upsert_plan(required: DataFrame, elements: DataFrame) -> DataFrame:
    """match (0), insert (1) or rogue (2) for each equipment and connection.

    ``required`` is (equipment_id, connection_id, seq), ``elements`` is
    (element_id, equipment_id, connection_id, seq).  The last of several
    elements with one connection is the match; the others are rogue.
    """
    key = F.upper(F.trim(F.coalesce("equipment_id", F.lit(""))))
    conn = F.trim(F.coalesce("connection_id", F.lit("")))
    wanted = required.filter(~conn.isin(*SHEET_BLANKS)).select(
        key.alias("equipment"), F.upper(conn).alias("connection"), conn.alias("connection_text"), F.col("seq").alias("row_seq")
    )
    model = elements.filter(key != "").select(
        key.alias("equipment"), F.upper(conn).alias("connection"), "element_id", F.col("seq").alias("element_seq")
    )
    named = ~F.col("connection").isin(*MODEL_BLANKS)
    last = Window.partitionBy("equipment", "connection", named).orderBy(F.desc("element_seq"))
    model = model.withColumn("match_key", F.when(named & (F.row_number().over(last) == 1), F.col("connection")))
    joined = wanted.join(
        model.drop("connection").withColumnRenamed("match_key", "connection"), ["equipment", "connection"], "full"
    )
    action = F.when(F.col("row_seq").isNull(), "rogue").when(F.col("element_id").isNull(), "insert").otherwise("match")
    service = primary_group(F.col("connection_text"))
    families = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    return joined.select("equipment", "connection", "row_seq", "element_id", action.alias("action"), F.try_element_at(families, service).alias("family"))


def even_spacing(items: DataFrame, group: list[str], order: list[str], length: str, width: str) -> DataFrame:
    """Add spacing and step_offset along the longer axis; every item takes a slot."""
    own = Window.partitionBy(*group)
    n = F.count(F.lit(1)).over(own)
    i = F.row_number().over(own.orderBy(*order)) - 1
    axis = F.when(F.col(length) >= F.col(width), F.col(length)).otherwise(F.col(width))
    spaced = items.withColumn("n_", n).withColumn("i_", i).withColumn("spacing", F.greatest(F.lit(0.333), axis / (n + 1)))
    offset = -((F.col("n_") - 1) * F.col("spacing")) / 2.0 + F.col("i_") * F.col("spacing")
    return spaced.withColumn("step_offset", offset).drop("n_", "i_")


def move_status(dx: Column, dy: Column, dz: Column) -> Column:
    far = F.sqrt(dx * dx + dy * dy + dz * dz)
    return F.when(far.isNull(), "N/A").when(far > MOVE_TOLERANCE, "Moved").otherwise("No Change")


def same_value(kind: Column, stored: Column, shown: Column, wanted: Column) -> Column:
    """Whether a parameter already has a value: text without case, doubles within 1e-4 or as shown, integers through float."""
    text = F.lower(F.trim(F.coalesce(stored, F.lit("")))) == F.lower(F.trim(wanted))
    bare = lambda c: F.translate(F.trim(F.coalesce(c, F.lit(""))), "\"'", "")
    number = F.abs(stored.try_cast("double") - wanted.try_cast("double")) <= 1e-4
    double = F.coalesce(number, F.lit(False)) | (bare(shown) == bare(wanted))
    integer = F.coalesce(stored.try_cast("double").try_cast("bigint") == wanted.try_cast("double").try_cast("bigint"), F.lit(False))
    return F.when(kind == "double", double).when(kind == "integer", integer).otherwise(text)


def parameter_changes(matrix: DataFrame, key: str, elements: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """Cell changes (key, element_id, column, param, before, after) and rows without element (element_id null).

    ``elements`` are (element_id, equipment_id, family, params map, seq); the
    last element of a key counts.  A column may set several parameters; blanks
    and sentinels never write, and writing what is there is no change.
    """
    clean = lambda c: F.lower(F.trim(c.cast("string")))
    last = Window.partitionBy(clean(F.col("equipment_id"))).orderBy(F.desc("seq"))
    model = elements.withColumn("n_", F.row_number().over(last)).filter("n_ = 1").drop("n_").withColumn("key_", clean(F.col("equipment_id")))
    cells = matrix.select(F.col(key).alias("row_key"), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(["row_key"], columns, "column", "after")
    cells = cells.filter(~F.coalesce(F.trim("after"), F.lit("")).isin(*SHEET_BLANKS)).withColumn("key_", clean(F.col("row_key")))
    plan = F.broadcast(mapping) if mapping.count() <= FEW_COLUMNS else mapping
    wanted = cells.join(plan, "column").join(model.select("key_", "element_id", "family", F.col("params").alias("have")), "key_", "left")
    wanted = wanted.filter(F.col("element_id").isNull() | family_applies(F.col("family"), F.col("families")))
    each = wanted.withColumn("param", F.explode("params")).withColumn("before", F.try_element_at("have", "param"))
    changed = each.filter(F.col("element_id").isNull() | (~same_value(F.lit("string"), F.col("before"), F.col("before"), F.col("after"))))
    return changed.select("row_key", "element_id", "column", "param", "before", F.trim("after").alias("after"))


def comparison_pairs(rows: DataFrame, key: str) -> DataFrame:
    """(key, field, original, updated, changed) from columns headed Original: and Updated:."""
    names = [c.split(":", 1)[1].strip() for c in rows.columns if c.startswith("Original:")]
    pairs = [
        F.struct(
            F.lit(n).alias("field"), F.col(f"`Original: {n}`").cast("string").alias("original"), F.col(f"`Updated: {n}`").cast("string").alias("updated")
        )
        for n in names
        if f"Updated: {n}" in rows.columns
    ]
    long = rows.select(key, F.explode(F.array(*pairs)).alias("p")).select(key, "p.*")
    return long.withColumn("changed", ~F.col("original").eqNullSafe(F.col("updated")))
