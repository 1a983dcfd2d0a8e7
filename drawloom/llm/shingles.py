"""Near-copies by wide SimHash fingerprints, then exact Jaccard similarity of word shingles.

Two texts are near-copies when the sets of their 5-word shingles have a Jaccard
similarity of 0.8 or more.  The method is that of ``simhash``, made wide enough
for this: at 0.8 two texts differ in 15 % of their SimHash bits, so a text gets
several 64-bit fingerprints of its shingles, each with its own seed and cut into
blocks, and every block is a join key.  Texts within four bits in any one
fingerprint agree on a block of it (pigeonhole); a pair at 0.8 shares a key with
probability 0.9996, and closer pairs more surely.  Similarity sets the number of
fingerprints (12 at 0.8) and the Hamming radius.

Distinct texts only go on.  Members of a key whose fingerprints lie within the
radius (61 of 256 bits at 0.8, four deviations wide) are linked and verified by
the exact Jaccard similarity of their shingle sets.  A small cluster of such
members gives all its pairs; a larger one a spanning forest, best links first,
and the next best link of each member.  Once these are verified, all its pairs
that still lie in different components are verified as well, so the forest loses
no link and a group of close copies stays linear.  Components of verified pairs
are found as in ``simhash``.

The members of one key are linked in one task, which holds 48 bytes a distinct
text.  Tables of over ``WIDE`` rows get wider blocks and more fingerprints.

Nulls: a null text is empty; texts without words are copies of each other; a
null doc_id is never kept beside others.  Repeated rows share a verdict.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawloom.llm.common import cut, lookup, sized_broadcast, text_of
from drawloom.llm.simhash import _merge, component_ids, components, not_first

SHINGLE = 5
SIMILARITY = 0.8
#: Most probability that a pair at the least similarity shares no key.
MISS = 5e-4
#: Rows up to which a fingerprint has five blocks; beyond them it has four.
WIDE = 1 << 24
#: Fingerprints whose bits are compared, and how many deviations the radius is wide.
CHECKED = 4
DEVIATIONS = 4
#: Share of equal bits from which a member simply hangs under a leader of its cluster.
LEAD = 0.9
#: Clusters of at most so many members give all their pairs.
FEW = 8
#: Keys of at most so many members are compared many at a time; up to LEAF, by all their pairs.
SMALL = 64
LEAF = 4096
#: Pairs of one text from which its shingles are broadcast to them.
HOT = 1024


def block_widths(blocks: int) -> list[int]:
    return [64 // blocks + (i < 64 % blocks) for i in range(blocks)]


def apart_at(similarity: float) -> float:
    """Most probability that one SimHash bit of two sets of that Jaccard similarity differs."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def fingerprints_for(similarity: float, blocks: int) -> int:
    """Fingerprints until a pair of that similarity shares no block with probability MISS at most."""
    missed = math.prod(1 - (1 - apart_at(similarity)) ** w for w in block_widths(blocks))
    return max(CHECKED, math.ceil(math.log(MISS) / math.log(missed))) if missed > 0 else CHECKED


def radius_for(similarity: float) -> int:
    """Bits in which the compared fingerprints of a pair of that similarity may differ."""
    bits, apart = 64 * CHECKED, apart_at(similarity)
    return math.floor(bits * apart + DEVIATIONS * math.sqrt(bits * apart * (1 - apart)))


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, times in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
    return h ^ (h >> np.uint64(33))


def shingle_set(ws: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles; a shorter text is one shingle."""
    if len(ws) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(ws))], dtype=np.uint64)
    words = np.fromiter(map(xxhash.xxh64_intdigest, ws), dtype=np.uint64, count=len(ws))
    n = len(ws) - shingle + 1
    h = np.zeros(n, dtype=np.uint64)
    for i in range(shingle):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return np.unique(h)


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # as in simhash: ASCII case and white space only


def seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(42).integers(0, 1 << 63, (count, 2), dtype=np.uint64)
    return drawn[:, 0] * np.uint64(2) + np.uint64(1), drawn[:, 1]


def fingerprints(shingles: np.ndarray, times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """One SimHash fingerprint a seed; a bit is 1 if set in over half the shingles' hashes."""
    total = np.zeros(64 * len(times), dtype=np.int64)
    for at in range(0, len(shingles), 255):  # so many bits add up in a byte
        h = _mixed(shingles[at : at + 255, None] * times + plus)
        bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little")
        total += bits.view(np.uint64).sum(axis=0).view(np.uint8)
    return np.packbits(2 * total > len(shingles), bitorder="little").view(np.uint64)


def block_keys(prints: np.ndarray, blocks: int) -> np.ndarray:
    """The key of each block of each fingerprint: its place among all blocks and its bits."""
    widths = block_widths(blocks)
    shifts = np.cumsum([0, *widths[:-1]]).astype(np.uint64)
    masks = np.array([(1 << w) - 1 for w in widths], dtype=np.uint64)
    bits = (prints[:, None] >> shifts & masks).ravel()
    return (np.arange(len(bits)) << max(widths) | bits.astype(np.int64)).astype(np.int32)


def _signed(hashes: list[int]) -> pa.Array:
    return pa.array(np.array(hashes, dtype=np.uint64).view(np.int64))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256))


def _signer(shingle: int, count: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, plus = seeds(count)
        for batch in _slices(batches):
            nodes, prints, keys = [], [], []
            for text in batch.column(2).to_pylist():
                ws = split_words(text)
                own = fingerprints(shingle_set(ws, shingle), times, plus)
                nodes.append(xxhash.xxh64_intdigest(b" ".join(ws)))
                prints.append(own[:CHECKED].view(np.int64))
                keys.append(block_keys(own, blocks))
            columns = [batch.column(0), batch.column(1), _signed(nodes), pa.array(prints, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", "prints", "keys"])

    return run


def _setter(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [split_words(t) for t in batch.column(0).to_pylist()]
            sets = pa.array([shingle_set(ws, shingle).view(np.int64) for ws in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([_signed([xxhash.xxh64_intdigest(b" ".join(ws)) for ws in found]), sets], ["node", "held"])

    return run


def _alike(marks: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Share of equal bits of ``rows`` and all members."""
    apart = np.zeros((len(rows), len(marks)), dtype=np.uint16)
    for p in range(marks.shape[1]):
        apart += np.bitwise_count(marks[rows, p][:, None] ^ marks[:, p][None, :])
    return 1 - apart / np.float32(8 * marks.itemsize * marks.shape[1])


def likely_pairs(marks: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of members to verify first: a spanning forest by equal bits, best first, and spare partners.

    The largest cluster is never compared inside, so one group of close copies costs linear time.
    """
    k = len(marks)
    if k <= FEW:
        i, j = np.nonzero(np.triu(_alike(marks, np.arange(k)) >= least, 1))
        return list(zip(i.tolist(), j.tolist(), strict=True))
    label = np.arange(k)
    pairs: set[tuple[int, int]] = set()
    left = np.arange(k)
    while len(left):
        near = _alike(marks[left], np.zeros(1, np.int64))[0] >= LEAD
        pairs.update((int(left[0]), int(m)) for m in left[near][1:])
        label[left[near]] = left[0]
        left = left[~near]
    while True:
        largest = np.bincount(label).argmax()
        rows = np.flatnonzero(label != largest)
        best, partner = np.zeros(k, np.float32), np.zeros(k, np.int64)
        step = max(1, 4_000_000 // k)
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            e = _alike(marks, part)
            e[label[part][:, None] == label[None, :]] = 0
            for turn in range(2):
                j = e.argmax(axis=1)
                top = e[np.arange(len(part)), j]
                good = top >= least
                pairs.update((min(a, b), max(a, b)) for a, b in zip(part[good].tolist(), j[good].tolist(), strict=True))
                if not turn:
                    best[part], partner[part] = top, j
                    down = e.max(axis=0)
                    up = (down > best) & (label == largest)
                    best[up], partner[up] = down[up], part[e.argmax(axis=0)][up]
                e[np.arange(len(part)), j] = 0
        good = np.flatnonzero(best >= least)
        if not len(good):
            return sorted(pairs)
        pairs.update((min(a, b), max(a, b)) for a, b in zip(good.tolist(), partner[good].tolist(), strict=True))
        low = np.arange(k)
        for a, b in zip(label[good].tolist(), label[partner[good]].tolist(), strict=True):
            while low[a] != a:
                a = low[a]
            while low[b] != b:
                b = low[b]
            low[max(a, b)] = min(a, b)
        while not np.array_equal(low[low], low):
            low = low[low]
        label = low[label]


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted rows (key, ...), cut where a key ends."""
    held: list[np.ndarray] = []
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = [np.concatenate(c) for c in zip(held, rows, strict=True)] if held else rows
        last = np.flatnonzero(np.diff(held[0]))
        if len(last):
            yield [c[: last[-1] + 1] for c in held]
            held = [c[last[-1] + 1 :] for c in held]
    if held and len(held[0]):
        yield held


def _key_sizes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
    return starts, np.diff(np.concatenate([starts, [len(key)]]))


def _within(marks: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of members within ``most`` bits, some rows at a time."""
    step = max(1, 4_000_000 // len(marks))
    least = 1 - (most + 0.5) / (8 * marks.itemsize * marks.shape[1])
    for at in range(0, len(marks), step):
        i, j = np.nonzero(_alike(marks, np.arange(at, min(at + step, len(marks)))) >= least)
        up = i + at < j
        yield i[up] + at, j[up]


def _near(key: np.ndarray, marks: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows that share one of the keys of LEAF members at most and lie within ``most`` bits."""
    starts, sizes = _key_sizes(key)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):  # many small keys at once
        i, j = np.triu_indices(size, 1)
        every = starts[sizes == size]
        for part in np.array_split(every, 1 + len(every) * len(i) // 1_000_000):
            rows = part[:, None] + np.arange(size)
            apart = np.zeros((len(part), len(i)), dtype=np.uint16)
            for p in range(marks.shape[1]):
                group = marks[rows, p]
                apart += np.bitwise_count(group[:, i] ^ group[:, j])
            at, pair = np.nonzero(apart <= most)
            a.append(rows[at, i[pair]])
            b.append(rows[at, j[pair]])
    middle = (sizes > SMALL) & (sizes <= LEAF)
    for start, size in zip(starts[middle], sizes[middle], strict=True):
        for i, j in _within(marks[start : start + size], most):
            a.append(i + start)
            b.append(j + start)
    return np.concatenate(a), np.concatenate(b)


def _linker(most: int):
    """Rows (a, b, key) of sorted (key, node, marks): pairs to verify, a > b; of clusters that gave not all pairs, with their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, *columns in _by_key(batches):
            marks = np.stack(columns, axis=1).view(np.uint64)
            least = 1 - (most + 0.5) / (64 * marks.shape[1])
            i, j = _near(key, marks, most)
            low = _merge(np.arange(len(key)), i, j)
            members = np.bincount(low, minlength=len(key))
            few = members[low[i]] <= FEW
            a, b, named = [i[few]], [j[few]], [np.full(few.sum(), -1)]
            clusters = [np.flatnonzero(low == c) for c in np.flatnonzero(members > FEW)]
            starts, sizes = _key_sizes(key)
            clusters += [np.arange(s, s + n) for s, n in zip(starts[sizes > LEAF], sizes[sizes > LEAF], strict=True)]
            for rows in clusters:
                pairs = np.array(likely_pairs(marks[rows], least), dtype=np.int64).reshape(-1, 2)
                a.append(rows[pairs[:, 0]])
                b.append(rows[pairs[:, 1]])
                named.append(np.full(len(pairs), key[rows[0]]))
            x, y = node[np.concatenate(a)], node[np.concatenate(b)]
            found = [pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y)), pa.array(np.concatenate(named).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(found, ["a", "b", "key"])

    return run


def _common(held: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """How many shingles each of ``rows`` has in common with each member."""
    found, place, n = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(len(held)), [len(h) for h in held])
    shared = n > 1
    column = (np.cumsum(shared) - 1)[place][shared[place]]
    member, total = member[shared[place]], np.zeros((len(rows), len(held)), np.float32)
    order = np.argsort(column, kind="stable")
    column, member = column[order], member[order]
    step = max(64, 4_000_000 // len(held))
    for at in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(column, (at, at + step))
        has = np.zeros((len(held), step), np.float32)
        has[member[lo:hi], column[lo:hi] - at] = 1
        total += has[rows] @ has.T
    return total


def _crosser(most: int, similarity: float):
    """Verified links (a, b), a > b, of sorted (key, node, root, held, marks) between members whose roots differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, root, held, *columns in _by_key(batches):
            marks = np.stack(columns, axis=1).view(np.uint64)
            for start, size in zip(*_key_sizes(key), strict=True):
                part = slice(start, start + size)
                own, under, sets = node[part], root[part], list(held[part])
                if (under == under[0]).all():
                    continue
                lengths = np.array([len(h) for h in sets])
                for i, j in _within(marks[part], most):
                    cross = under[i] != under[j]
                    i, j = i[cross], j[cross]
                    if not len(i):
                        continue
                    rows, at = np.unique(i, return_inverse=True)
                    common = _common(sets, rows)[at, j]
                    alike = common >= (similarity - 1e-12) * (lengths[i] + lengths[j] - common)
                    x, y = own[i[alike]], own[j[alike]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])

    return run


def _with_sets(pairs: DataFrame, sets: DataFrame, end: str, hot: DataFrame) -> DataFrame:
    """Add the shingles of one end; texts in very many pairs are broadcast."""
    named = sets.select(F.col("node").alias(end), F.col("held").alias(f"held_{end}"))
    few = F.broadcast(hot.select(F.col("node").alias(end)))
    shown = F.broadcast(named.join(few, end, "left_semi"))
    return pairs.join(shown, end).unionByName(pairs.join(few, end, "left_anti").join(named, end))


def _verified(pairs: DataFrame, sets: DataFrame, ends: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar; ``ends`` are their (node, pairs)."""
    hot = ends.filter(F.col("pairs") >= HOT).select("node")
    both = _with_sets(_with_sets(pairs, sets, "a", hot), sets, "b", hot)
    common = F.size(F.array_intersect("held_a", "held_b"))
    either = F.size("held_a") + F.size("held_b") - common
    return cut(both.filter(common >= F.lit(similarity - 1e-12) * either).select("a", "b"))


def _ends(pairs: DataFrame) -> DataFrame:
    return cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("pairs")))


def copies(docs: DataFrame, *, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, text_hash, component_id."""
    text = text_of(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    blocks = 5 if docs.count() <= WIDE else 4
    signer, most = _signer(shingle, fingerprints_for(similarity, blocks), blocks), radius_for(similarity)
    signed = cut(rows.mapInArrow(signer, "doc_id long, text_hash long, node long, prints array<long>, keys array<int>"))
    distinct = cut(
        signed.groupBy("node").agg(
            F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), F.min("text_hash").alias("text_hash"),
            F.min("prints").alias("prints"), F.min("keys").alias("keys"),
        )
    )
    marks = [F.col("prints")[i].alias(f"print_{i}") for i in range(CHECKED)]
    members = distinct.select(F.explode("keys").alias("key"), "node", *marks)
    met = members.repartition("key").sortWithinPartitions("key")
    linked = cut(met.mapInArrow(_linker(most), "a long, b long, key int").distinct())
    pairs = cut(linked.select("a", "b").distinct())
    ends = _ends(pairs)
    wanted = cut(distinct.join(ends, "node", "left_semi").select("text_hash"))
    held = rows.join(sized_broadcast(wanted, wanted.count()), "text_hash", "left_semi")
    held = held.groupBy("text_hash").agg(F.min("text").alias("text")).select("text")
    sets = cut(held.mapInArrow(_setter(shingle), "node long, held array<long>"))
    roots = cut(components(_verified(pairs, sets, ends, similarity)))
    left = linked.filter("key >= 0")
    if not left.isEmpty():
        left = left.select("key", F.explode(F.array("a", "b")).alias("node")).distinct()
        left = left.join(roots, "node", "left").join(distinct.select("node", *marks), "node")
        left = left.join(sets, "node")
        left = left.select("key", "node", F.coalesce("root", "node").alias("root"), "held", *[f"print_{i}" for i in range(CHECKED)])
        left = left.repartition("key").sortWithinPartitions("key")
        edges = cut(left.mapInArrow(_crosser(most, similarity), "a long, b long").distinct())
        if not edges.isEmpty():
            roots = cut(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(edges)))
    several = component_ids(distinct.select("node", "first", "n"), "node", roots)
    found = signed.select("doc_id", "text_hash", "node")
    found = lookup(found, several, "node", "n", several.count(), distinct.agg(F.sum("n")).first()[0] or 0)
    return found.select("doc_id", "text_hash", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, **options: float) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component, all columns kept."""
    return not_first(docs, copies(docs, **options))
