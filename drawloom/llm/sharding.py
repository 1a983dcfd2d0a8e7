"""Sharding along a Hilbert curve over several metadata dimensions.

Source, language and size are quantised to ``bits`` bits each (strings by the
bytes after their common prefix, sizes by their logarithm, so equal ranges of
codes are ranges of values), the codes become one index on a Hilbert curve, and
the rows in the order of the index are cut into runs of equal row counts (law
``rows``).  A shard then covers a compact box of the metadata, which is what
min/max statistics of its files prune by.

No task sorts more than one small group: cells of the curve (at most 2 ** (3 *
bits)) are counted, cells are divided by a hash into 256 parts or more, running sums
give each part its first rank, and rows are numbered inside their part.

Nulls: a null text has size 1 (no bytes plus one) and checksum 0; null source
or language get the lowest code; a null doc_id is allowed.  Repeated rows get
slots of their own.  With fewer rows than shards some shards stay empty, and
an empty table gives no rows.  Rows of one cell tie and are numbered by a hash,
equal hashes by their reading order.  Sizes are those of whole texts.  Columns
other than doc_id, text, source and lang are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawloom.llm.common import cut, let, text_of

PARTS = 256
#: Rows of a part where a cell holds all of them; larger tables get more parts.
PART_ROWS = 1 << 18


def hilbert_index(codes: Column, dims: int, bits: int) -> Column:
    """Index on the Hilbert curve of an array of ``dims`` codes of ``bits`` bits.

    The inverse rotations of the curve run from the highest bit down, each an
    exchange or inversion of low bits, then a Gray code is undone.
    """
    axes = F.transform(codes, lambda c: c.cast("bigint"))

    def bit_of(x: Column, shift: Column) -> Column:
        return F.call_function("shiftright", x, shift.cast("int")).bitwiseAND(F.lit(1))

    def turn(x: Column, level: Column) -> Column:
        low = F.call_function("shiftleft", F.lit(1).cast("bigint"), level.cast("int")) - 1

        def one(acc: Column, i: Column) -> Column:
            head, other = acc[0], acc[i]
            mixed = head.bitwiseXOR(other).bitwiseAND(low)
            inverted = bit_of(other, level) == 1
            new_head = F.when(inverted, head.bitwiseXOR(low)).otherwise(head.bitwiseXOR(mixed))
            new_other = F.when(inverted, other).otherwise(other.bitwiseXOR(mixed))
            return F.transform(acc, lambda v, j: F.when(j == 0, new_head).when(j == i, new_other).otherwise(v))

        return F.aggregate(F.sequence(F.lit(0), F.lit(dims - 1)), x, one)

    turned = F.aggregate(F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1)), axes, turn) if bits > 1 else axes
    gray = let(
        turned,
        lambda t: F.aggregate(
            F.sequence(F.lit(1), F.lit(dims - 1)),
            F.slice(t, 1, 1),
            lambda acc, i: F.concat(acc, F.array(t[i].bitwiseXOR(F.element_at(acc, -1)))),
        ),
    )
    return _interleaved(gray, dims, bits)


def _interleaved(gray: Column, dims: int, bits: int) -> Column:
    def joined(g: Column) -> Column:
        last = g[dims - 1]
        parity = F.lit(0).cast("bigint")
        for q in range(bits - 1, 0, -1):
            on = F.shiftright(last, q).bitwiseAND(F.lit(1)) == 1
            parity = parity.bitwiseXOR(F.when(on, F.lit((1 << q) - 1)).otherwise(F.lit(0)))

        def packed(t: Column) -> Column:
            index = F.lit(0).cast("bigint")
            for q in range(bits - 1, -1, -1):
                for i in range(dims):
                    bit = F.shiftright(g[i].bitwiseXOR(t), q).bitwiseAND(F.lit(1))
                    index = index * 2 + bit
            return index

        return let(parity, packed)

    return let(gray, joined)


def _prefix_number(value: Column, skip: Column) -> Column:
    """Seven bytes of a string after ``skip`` bytes as a number in the order of the bytes."""
    piece = F.substring(F.encode(value, "UTF-8"), skip + 1, F.lit(7))
    return F.conv(F.rpad(F.hex(piece), 14, "0"), 16, 10).cast("double")


def _common_bytes(a: Column, b: Column) -> Column:
    same = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))),
        F.lit(0),
        lambda acc, i: F.when((acc == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(acc),
    )
    return F.coalesce(F.octet_length(F.substring(a, F.lit(1), same)), F.lit(0))


def assign_shards(docs: DataFrame, *, shards: int = 8, bits: int = 5, dims: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve."""
    text = text_of(docs)
    null = F.lit(None).cast("string")
    labels = [docs[d].cast("string") if d in docs.columns else null for d in dims]
    rows = cut(
        docs.select(
            docs["doc_id"].alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            *[label.alias(f"d{i}") for i, label in enumerate(labels)],
        ).withColumn("uid", F.monotonically_increasing_id())
    )
    names = [f"d{i}" for i in range(len(dims))]
    bounds = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(F.ln("size")).alias("low_s"),
        F.max(F.ln("size")).alias("high_s"),
        *[f(n).alias(f"{kind}_{n}") for n in names for kind, f in (("low", F.min), ("high", F.max))],
    )
    bounds = bounds.select("*", *[_common_bytes(F.col(f"low_{n}"), F.col(f"high_{n}")).alias(f"skip_{n}") for n in names])
    edge = bounds.first()  # one row of bounds
    most = F.lit((1 << bits) - 1)

    def code(x: Column, low: Column, high: Column) -> Column:
        scaled = F.floor((x - low) / F.when(high > low, high - low) * (1 << bits))
        return F.coalesce(F.greatest(F.lit(0), F.least(most, scaled)), F.lit(0)).cast("bigint")

    codes = []
    for n in names:
        skip = F.lit(edge[f"skip_{n}"])
        low, high = (_prefix_number(F.lit(edge[f"{k}_{n}"]).cast("string"), skip) for k in ("low", "high"))
        codes.append(code(_prefix_number(F.col(n), skip), low, high))
    codes.append(code(F.ln("size"), F.lit(edge["low_s"]), F.lit(edge["high_s"])))
    part = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(max(PARTS, edge["rows"] // PART_ROWS))).cast("int")
    curved = rows.withColumn("curve", hilbert_index(F.array(*codes), len(codes), bits)).withColumn("part", part)
    parts = cut(curved.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n")))
    earlier = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    in_cell = parts.withColumn("in_cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    cells = parts.groupBy("curve").agg(F.sum("n").alias("cell"))
    along = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 ** (dims * bits) cells
    cells = cells.select("curve", F.coalesce(F.sum("cell").over(along), F.lit(0)).alias("before"))
    starts = in_cell.join(F.broadcast(cells), "curve").select("curve", "part", (F.col("before") + F.col("in_cell")).alias("start"))
    inside = Window.partitionBy("curve", "part").orderBy("doc_id", "text_crc32", "size", "uid")
    ranked = curved.join(starts, ["curve", "part"]).withColumn("rank", F.col("start") + F.row_number().over(inside) - 1)
    total = max(1, edge["rows"])
    shard = F.expr(f"(rank * {shards}) div {total}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("rank") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )
