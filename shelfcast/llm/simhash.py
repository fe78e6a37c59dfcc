"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints that differ in at most k bits agree on at least ``blocks - k`` of ``blocks`` bit
blocks, so every link lies inside a bucket of fingerprints that share such a choice of blocks.
A bucket is sorted by Gray rank, where neighbours share long bit patterns. Runs of neighbours are
leaves, runs of leaves upper nodes; a node holds the bits that all its fingerprints share. Two nodes
are compared on the bits both share, differences add up on the way down, and a pair of whole groups
is dropped as soon as the sum is over k. Every bucket reports a spanning forest of its links, so
its output is linear in its rows; the forests are joined into components in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import fresh, quoted
from shelfcast.llm.components import components
from shelfcast.llm.words import as_binary, lower_ascii, slices, word_bounds
from shelfcast.plans.durable import durable

SHINGLE = 4
MAX_BITS = 4
SEED = 42
# Fewest blocks, and the random fingerprints that a bucket may hold before more blocks are taken.
BLOCKS = 6
ROWS_PER_BUCKET = 32
ROWS_PER_CELL = 200_000
RUN = 8
PAIRS_AT_ONCE = 1 << 19
ALL_BITS = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(words: bytes, starts: list[int], ends: list[int], size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words; of the whole if there are fewer. ``words`` has single spaces."""
    digest = xxhash.xxh64_intdigest
    if len(starts) < size:
        return np.array([digest(words, SEED)], np.uint64)
    runs = zip(starts, ends[size - 1 :])
    return np.array([digest(words[a:b], SEED) for a, b in runs], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bit i is 1 where more than half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        raw = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes))
    return int.from_bytes(bits.tobytes(), "big")


def fingerprint_texts(texts: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """Fingerprint of each text as a signed 64-bit number; 0 for texts without words."""
    data, offsets = as_binary(lower_ascii(texts))
    starts, ends = word_bounds(data, offsets)
    lengths = ends - starts
    # One space after each word: word k sits at its own bytes plus k spaces.
    places = np.cumsum(lengths) - lengths + np.arange(len(lengths))
    packed = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
    inside = np.ones(len(packed), bool)
    inside[places + lengths] = False
    spans = np.zeros(len(data) + 1, np.int8)
    spans[starts] += 1
    spans[ends] -= 1
    packed[inside] = data[np.cumsum(spans[:-1], dtype=np.int8).view(bool)] if len(starts) else packed[inside]
    first = np.searchsorted(starts, offsets, side="left")
    out = np.zeros(len(offsets) - 1, np.uint64)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if a == b:
            continue
        low, high = int(places[a]), int(places[b - 1] + lengths[b - 1])
        heads = (places[a:b] - low).tolist()
        tails = (places[a:b] - low + lengths[a:b]).tolist()
        out[i] = majority(shingle_hashes(packed[low:high].tobytes(), heads, tails, size))
    return out.view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, text_hash, fp), one per row of ``docs``; text_hash is Spark's xxhash64 of the text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = pa.array(fingerprint_texts(part.column("text"), size))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), found], ["doc_id", "text_hash", "fp"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    number, text = F.col(quoted(id_col)), F.col(quoted(text_col))
    source = docs.select(number.alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return source.mapInArrow(work, f"doc_id {kind}, text_hash long, fp long")


def gray_rank(fp: Column) -> Column:
    """Place of a bit pattern in the Gray code, ordered as unsigned numbers."""
    rank = fp
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def block_edges(blocks: int) -> list[int]:
    """First bit of each block, and 64."""
    return [round(64 * k / blocks) for k in range(blocks + 1)]


def blocks_for(fingerprints: int, max_bits: int = MAX_BITS, per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Fewest blocks whose buckets hold at most ``per_bucket`` of that many random fingerprints.

    A bucket key has the bits of ``blocks - max_bits`` blocks, so more blocks mean longer keys, and
    more choices of blocks for each fingerprint. Links between similar fingerprints are the same with
    any number.
    """
    for blocks in range(max(BLOCKS, max_bits + 1), 64):
        edges = block_edges(blocks)
        key_bits = sum(sorted(b - a for a, b in zip(edges, edges[1:]))[: blocks - max_bits])
        if fingerprints <= per_bucket << key_bits:
            return blocks
    return 64


def block_keys(fp: Column, blocks: int, max_bits: int) -> Column:
    """Array of the bucket keys of a fingerprint: its bits on each choice of agreeing blocks."""
    edges = block_edges(blocks)
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    signed = lambda n: n - (1 << 64) if n >= 1 << 63 else n
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - max_bits)):
        mask = sum(masks[c] for c in chosen)
        keys.append(F.struct(F.lit(number).cast("short").alias("choice"), fp.bitwiseAND(F.lit(signed(mask))).alias("bits")))
    return F.array(*keys)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class Level:
    """Nodes of one height: shared bits, their values, and the range of children below."""

    def __init__(self, mask, value, first, group):
        self.mask, self.value, self.first, self.group = mask, value, first, group


def build(fp: np.ndarray, group: np.ndarray) -> list[Level]:
    """Levels from the fingerprints up to one root per group. Rows of a group lie together in Gray order."""
    levels = [Level(np.full(len(fp), ALL_BITS), fp, None, group)]
    ones, some = fp, fp
    while True:
        below = levels[-1]
        heads = np.flatnonzero(np.concatenate([[True], below.group[1:] != below.group[:-1]]))
        sizes = np.diff(np.append(heads, len(below.group)))
        if sizes.max(initial=1) == 1:
            return levels
        inside = np.arange(len(below.group)) - np.repeat(heads, sizes)
        first = np.flatnonzero(inside % RUN == 0)
        ones, some = np.bitwise_and.reduceat(ones, first), np.bitwise_or.reduceat(some, first)
        levels.append(Level(ones | ~some, ones, np.append(first, len(below.group)), below.group[first]))


def close_pairs(fp: np.ndarray, group: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group that differ in at most ``max_bits`` bits, found from the roots down."""
    levels = build(fp, group)
    roots = np.arange(len(levels[-1].group))
    todo = [(len(levels) - 1, roots, roots, np.zeros(len(roots), np.int64))]
    while todo:
        height, a, b, sums = todo.pop()
        if height == 0:
            apart = a != b
            if apart.any():
                yield a[apart], b[apart]
            continue
        if len(a) > PAIRS_AT_ONCE // (RUN * RUN):
            half = len(a) // 2
            todo += [(height, a[half:], b[half:], sums[half:]), (height, a[:half], b[:half], sums[:half])]
            continue
        upper, lower = levels[height], levels[height - 1]
        na, nb = upper.first[a + 1] - upper.first[a], upper.first[b + 1] - upper.first[b]
        both = na * nb
        parent = np.repeat(np.arange(len(a)), both)
        inside = np.arange(len(parent)) - np.repeat(np.cumsum(both) - both, both)
        ca = upper.first[a][parent] + inside // nb[parent]
        cb = upper.first[b][parent] + inside % nb[parent]
        keep = ca <= cb
        parent, ca, cb = parent[keep], ca[keep], cb[keep]
        counted = (upper.mask[a] & upper.mask[b])[parent]
        shared = lower.mask[ca] & lower.mask[cb]
        sums = sums[parent] + popcount((lower.value[ca] ^ lower.value[cb]) & shared & ~counted)
        near = sums <= max_bits
        todo.append((height - 1, ca[near], cb[near], sums[near]))


def forest(fp: np.ndarray, group: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and root of every row that a link joins to an earlier row."""
    root = np.arange(len(fp))
    for a, b in close_pairs(fp, group, max_bits):
        while True:
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                break
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return moved, root[moved]


def _search(max_bits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def table(parts):
            t = pa.Table.from_batches(parts)
            keys = [t.column(c).to_numpy() for c in ("choice", "bits", "low", "high")]
            return t.column("fp").to_numpy().view(np.uint64), keys

        def cut(keys) -> np.ndarray:
            change = np.zeros(len(keys[0]), bool)
            for k in keys:
                change[1:] |= k[1:] != k[:-1]
            return np.cumsum(change)

        def solve(fp, group):
            # The bits of a root are those its whole bucket shares, so nothing is counted above it.
            rows, roots = forest(fp, group, max_bits)
            return pa.RecordBatch.from_arrays(
                [pa.array(fp[rows].view(np.int64)), pa.array(fp[roots].view(np.int64))], ["src", "dst"]
            )

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < ROWS_PER_CELL:
                continue
            fp, keys = table(held)
            group = cut(keys)
            last = int(np.searchsorted(group, group[-1]))
            if last:
                yield solve(fp[:last], group[:last])
                held = pa.Table.from_batches(held).slice(last).combine_chunks().to_batches()
                rows = sum(b.num_rows for b in held)
        if rows:
            fp, keys = table(held)
            yield solve(fp, cut(keys))

    return work


def links(distinct_fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Edges (src, dst) between fingerprints, enough to connect all that link directly or in steps.

    ``distinct_fps`` has one row per fingerprint. A bucket of more than ``per_cell`` rows is cut into
    blocks, and each pair of blocks is a cell of its own, so no task holds a whole hot bucket and no
    link is lost.
    """
    keyed = distinct_fps.select("fp", F.explode(block_keys(F.col("fp"), blocks, max_bits)).alias("key"))
    keyed = keyed.select("fp", "key.choice", "key.bits")
    # A bucket can be hot only if the table is that large.
    hot = durable(
        keyed.groupBy("choice", "bits").count().where(F.col("count") > per_cell)
        .select("choice", "bits", F.ceil(F.col("count") / per_cell).cast("int").alias("cells"))
    )
    own = F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    dealt = (
        keyed.join(hot, ["choice", "bits"], "left")
        .withColumn("cells", F.coalesce("cells", F.lit(1)))
        .withColumn("own", own)
        .withColumn("other", other)
        .select("fp", "choice", "bits", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    )
    ordered = dealt.repartition("choice", "bits", "low", "high").sortWithinPartitions(
        "choice", "bits", "low", "high", gray_rank(F.col("fp"))
    )
    return ordered.mapInArrow(_search(max_bits), "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                    max_bits: int = MAX_BITS, blocks: int | None = None, per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Rows (doc_id, text_hash, fp, component_id), one per row of ``docs``.

    Without ``blocks``, :func:`blocks_for` takes them from the number of different fingerprints.

    component_id is the smallest id that links reach; null ids are passed over and give null only
    where a component has no other. Texts without words have fingerprint 0 and link like any
    other; null counts as empty; an empty table gives no rows.
    """
    rows = durable(fingerprints(docs, id_col, text_col, size))
    least = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    blocks = blocks or blocks_for(least.count(), max_bits)
    joined = components(links(least.select("fp"), max_bits, blocks, per_cell))
    # Roots stand for themselves as well.
    members = durable(joined.union(joined.select("root", "root").distinct()))
    linked = members.join(least, members["node"] == least["fp"])
    by_root = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = durable(members.join(by_root, "root").select(F.col("node").alias("fp"), "component_id", F.lit(True).alias("linked")))
    named = least.join(found, "fp", "left").select(
        "fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least_id")).alias("component_id")
    )
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that carry the smallest id of their component, with the same columns.

    Rows that repeat both id and text are one document and all stay. Rows without an id stay only if
    no row of their component has one.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_hash").distinct()
    digest, other = fresh("text_hash", docs.columns), fresh("kept_id", docs.columns)
    kept = kept.select(F.col("doc_id").alias(other), F.col("text_hash").alias(digest + "_kept"))
    hashed = docs.withColumn(digest, F.xxhash64(F.col(quoted(text_col))))
    same = (hashed[digest] == kept[digest + "_kept"]) & hashed[quoted(id_col)].eqNullSafe(kept[other])
    return hashed.join(kept, same, "left_semi").select(*map(quoted, docs.columns))
