"""Near-duplicates by SimHash fingerprints and pigeonhole blocks.

Fingerprints (64 bits, 4-word shingles) are made in Arrow batches.  Distinct
fingerprints only go on.  A fingerprint is cut into ``m`` blocks; two that
differ in at most ``distance`` bits agree on at least ``m - distance`` blocks,
so every choice of that many blocks is a join key and close pairs meet under
some key.  Each key's members arrive sorted, are verified by Hamming distance in
vectorised blocks, and leave as the edges of a spanning forest: a group of k
close fingerprints yields k - 1 links, never all its pairs, with the same
components.  A key with very many members is dealt out again by blocks of its
remaining bits, which is exact by the same argument.

Components are found over the links by alternating large-star and small-star
steps, each a pair of joins cut by a checkpoint, and are looked up by all
documents, hot fingerprints through a small broadcast.

Nulls: a null text is empty; texts without words have fingerprint zero and
link like others; a null doc_id gets a row but is never a component's id unless
all of the component are null.  Repeated rows each get a row.  Ties do not
arise: ids are minima, and equal fingerprints are one.  Texts of any length are
read whole, their shingles in slices.  An empty table gives no rows; columns
other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawloom.llm.common import cut, lookup, text_of, without

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Members of a key up to which all of them are compared in blocks.
LEAF = 2048
#: Members of a key from which it is dealt out again.
OPEN = 1 << 16
#: Least edges of a node that are joined by broadcast of the node.
HEAVY = 4096
#: Expected members of a key; more blocks are used when there would be more.
PER_KEY = 8


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text, all its shingles counted."""
    ws = (text or "").encode().lower().split()  # bytes: lowers A-Z only, splits at ASCII white space only
    if not ws:
        return 0
    if len(ws) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(ws), SEED)
    total = np.zeros(64, dtype=np.int64)
    n = len(ws) - SHINGLE + 1
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, 65536):
        part = ws[start : start + 65536 + SHINGLE - 1]
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(part[i:] for i in range(SHINGLE)), strict=False)]
        raw = np.array(hashes, dtype="<u8").view(np.uint8)
        total += np.unpackbits(raw, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = 2 * total > n
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
        prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        columns = [batch.column(0), pa.array(prints.view(np.int64)), *batch.columns[2:]]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "text_hash"][: len(columns)])


def with_fingerprints(docs: DataFrame, text_col: str = "text", hashed: bool = False) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit number, and text_hash where ``hashed``."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    if not hashed:
        return rows.mapInArrow(_fingerprints, "doc_id long, fp long")
    rows = rows.select("doc_id", "text", F.xxhash64(text_of(rows)).alias("text_hash"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long, text_hash long")


def blocks_for(n: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(shift, width) of the blocks: as few as keep keys near PER_KEY members."""
    for m in range(distance + 2, 13):
        widths = [64 // m + (i < 64 % m) for i in range(m)]
        if n / 2.0 ** sum(sorted(widths)[: m - distance]) <= PER_KEY:
            break
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def masks_for(blocks: list[tuple[int, int]], distance: int = DISTANCE) -> list[int]:
    """The bits of each choice of blocks that a close pair may agree on."""
    part = [((1 << w) - 1) << s for s, w in blocks]
    return [sum(c) for c in combinations(part, len(part) - distance)]


def _roots(parent: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return parent


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of each pair; parents point to lower indices."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        parent = _roots(parent)
    return parent


def close_sets(prints: np.ndarray, distance: int = DISTANCE, free: int = (1 << 64) - 1) -> np.ndarray:
    """For each print the lowest index that it reaches by steps of at most ``distance`` bits.

    ``free`` are the bits in which the prints may differ; large sets are
    divided by blocks of them.
    """
    parent = np.arange(len(prints))
    if len(prints) <= LEAF or bin(free).count("1") <= 2 * distance + 2:
        for start in range(0, len(prints), 1024):
            part = prints[start : start + 1024]
            i, j = np.nonzero(np.bitwise_count(part[:, None] ^ prints[None, :]) <= distance)
            i += start
            up = i < j
            parent = _merge(parent, i[up], j[up])
        return parent
    places = [p for p in range(64) if free >> p & 1]
    m = distance + 2
    parts = [sum(1 << p for p in places[k * len(places) // m : (k + 1) * len(places) // m]) for k in range(m)]
    for chosen in combinations(parts, m - distance):
        fixed = sum(chosen)
        keys = prints & np.uint64(fixed)
        order = np.argsort(keys, kind="stable")
        edges = np.flatnonzero(np.diff(keys[order])) + 1
        for group in np.split(order, edges):
            if len(group) > 1:
                low = close_sets(prints[group], distance, free & ~fixed)
                parent = _merge(parent, group, group[low])
    return parent


def free_bits(mask: int) -> int:
    return ~mask & (1 << 64) - 1


def finer_masks(mask: int, distance: int = DISTANCE) -> list[int]:
    """The masks that divide the prints that agree on ``mask``: by choices of blocks of the other bits."""
    places = [p for p in range(64) if free_bits(mask) >> p & 1]
    m = distance + 2
    parts = [sum(1 << p for p in places[k * len(places) // m : (k + 1) * len(places) // m]) for k in range(m)]
    return [mask | sum(chosen) for chosen in combinations(parts, m - distance)]


def _solved(which: np.ndarray, key: np.ndarray, fp: np.ndarray, masks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges inside each (choice, key) of sorted rows."""
    edge = np.flatnonzero((np.diff(which) != 0) | (np.diff(key) != 0)) + 1
    starts = np.concatenate([[0], edge])
    sizes = np.diff(np.concatenate([starts, [len(fp)]]))
    a, b = [], []
    prints = fp.view(np.uint64)
    for size in np.unique(sizes[(sizes > 1) & (sizes <= 16)]):  # many small keys at once
        rows = starts[sizes == size][:, None] + np.arange(size)
        group = prints[rows]
        i, j = np.triu_indices(size, 1)
        near = np.bitwise_count(group[:, i] ^ group[:, j]) <= DISTANCE
        at, pair = np.nonzero(near)
        a.append(group[at, i[pair]])
        b.append(group[at, j[pair]])
    for start, size in zip(starts[sizes > 16], sizes[sizes > 16], strict=True):
        group = prints[start : start + size]
        low = close_sets(group, DISTANCE, free_bits(masks[which[start]]))
        up = low != np.arange(size)
        a.append(group[up])
        b.append(group[low[up]])
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)


def _linker(masks: list[int], most: int):
    """Rows (a, b, which) of sorted (which, key, fp): links (a > b, which -1), or, of keys with over ``most`` members, their
    prints (a) and choice, which are to be divided again.  At most ``most`` members and a batch are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, b: np.ndarray, which: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(which.astype(np.int32))], ["a", "b", "which"])

        def linked(rows: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _solved(*rows, masks)
            return out(np.maximum(a, b), np.minimum(a, b), np.full(len(a), -1))

        held: list[np.ndarray] = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)]
        opened: tuple[int, int] | None = None
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(3)]
            if opened is not None:
                other = np.flatnonzero((rows[0] != opened[0]) | (rows[1] != opened[1]))
                stop = other[0] if len(other) else len(rows[0])
                yield out(rows[2][:stop], rows[1][:stop], rows[0][:stop])
                rows = [c[stop:] for c in rows]
                if not len(rows[0]):
                    continue
                opened = None
            held = [np.concatenate(c) for c in zip(held, rows, strict=True)]
            last = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0))
            if len(last):
                stop = last[-1] + 1
                yield linked([c[:stop] for c in held])
                held = [c[stop:] for c in held]
            if len(held[0]) > most and free_bits(masks[held[0][0]]).bit_count() > 2 * DISTANCE + 2:
                yield out(held[2], held[1], held[0])
                opened = (held[0][0], held[1][0])
                held = [c[:0] for c in held]
        if len(held[0]):
            yield linked(held)

    return run


def links(prints: DataFrame, n: int, most: int = OPEN) -> DataFrame:
    """(a, b), b lower: links with the components of all pairs of close fingerprints of (fp).

    Keys with over ``most`` members are dealt out again by blocks of their
    remaining bits, so no task holds or solves a larger group.
    """
    masks = masks_for(blocks_for(n))
    rows = prints.select(F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("which"), "fp")
    found = None
    while True:
        signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])
        keyed = rows.select("which", F.col("fp").bitwiseAND(F.get(signed, F.col("which"))).alias("key"), "fp")
        dealt = keyed.repartition("which", "key").sortWithinPartitions("which", "key", "fp")
        out = cut(dealt.mapInArrow(_linker(masks, most), "a long, b long, which int"))
        edges = out.filter("which < 0").select("a", "b")
        found = edges if found is None else found.unionByName(edges)
        left = out.filter("which >= 0")
        if left.isEmpty():
            return found.distinct()
        finer = [finer_masks(m) for m in masks]
        steps = F.explode(F.sequence(F.lit(0), F.lit(len(finer[0]) - 1))).alias("step")
        rows = left.select("which", F.col("a").alias("fp"), steps).select((F.col("which") * len(finer[0]) + F.col("step")).alias("which"), "fp")
        masks = [m for own in finer for m in own]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): the lowest node it reaches.

    Large-star hangs a node's higher neighbours under its lowest neighbour,
    small-star its lower ones; both keep the components, and at the end every
    edge leads to a root.
    """
    edges = cut(edges.filter("a <> b"))
    seen, total = None, edges.count()

    def centred(rows: DataFrame, lowest: DataFrame) -> DataFrame:
        """Each (a, b) of ``rows`` as (b, m), m the lowest of a; nodes with very many edges by broadcast."""
        heavy = F.col("degree") >= max(HEAVY, total // 1000)
        if lowest.filter(heavy).limit(1).count():
            lowest = cut(lowest)
            hot = F.broadcast(lowest.filter(heavy).drop("degree"))
            rest = rows.join(hot.select("a"), "a", "left_anti").join(lowest.filter(~heavy).drop("degree"), "a")
            met = rows.join(hot, "a").unionByName(rest)
        else:
            met = rows.join(lowest.drop("degree"), "a")
        return met.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")

    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("degree"))
        large = centred(both.filter("b > a"), least).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree"))
        small = centred(large, low)
        edges = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        sums = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen, total = tuple(sums), sums[0]


def component_ids(distinct: DataFrame, key: str, roots: DataFrame) -> DataFrame:
    """(key, component_id, n) of (key, first, n) where a row may differ from its own doc_id: by components and copies."""
    linked = cut(distinct.join(roots.withColumnRenamed("node", key), key))
    lowest = cut(linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("nodes")))
    n, nodes = lowest.agg(F.count(F.lit(1)), F.sum("nodes")).first()
    named = lookup(linked, lowest, "root", "nodes", n, nodes or 0).select(key, "component_id", "first", "n")
    alone = distinct.join(roots.select(F.col("node").alias(key)), key, "left_anti")
    every = named.unionByName(alone.select(key, F.col("first").alias("component_id"), "first", "n"))
    return cut(every.filter("n > 1 or component_id <> first or first is null").select(key, "component_id", "n"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id."""
    return _flags(with_fingerprints(docs))


def _flags(prints: DataFrame) -> DataFrame:
    """The rows of (doc_id, fp, ...) with fingerprint and component_id in place of fp."""
    rows = cut(prints)
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    total, n = rows.count(), distinct.count()
    roots = cut(components(links(distinct.select("fp"), n)))
    several = component_ids(distinct, "fp", roots)
    found = lookup(rows, several, "fp", "n", several.count(), total)
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        *[c for c in rows.columns if c not in ("doc_id", "fp")],
    )


def not_first(docs: DataFrame, flags: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``flags`` (doc_id, text_hash, component_id) leaves to another doc_id.

    Rows are told apart by doc_id and text, as null and repeated doc_ids may belong to several texts.
    """
    gone = flags.filter("not (doc_id <=> component_id)").select("doc_id", F.col("text_hash").alias("key"))
    return without(docs, gone, F.xxhash64(text_of(docs)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component, all columns kept.

    Null doc_ids beside others in a component go; a component of nulls only stays whole.
    """
    return not_first(docs, _flags(with_fingerprints(docs, hashed=True)))
