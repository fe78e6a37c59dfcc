"""Tokenised documents packed into sequences by hierarchical best fit.

Each partition tokenises its documents, cuts only those longer than a sequence, and packs the
pieces by best fit, longest first. Bins that are nearly full are final. The others become items of
the next round: fewer, larger groups of bins are packed by best fit again, until one group is left
or a round no longer merges anything. Only (bin, fill) pairs move in the rounds, at most
``bins_per_task`` to a task.
"""

from __future__ import annotations

import json
import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.words import as_binary, slices, split_words, take_runs
from shelfcast.plans.durable import durable

SEQUENCE = 4096
END_ID = 1
NEARLY_FULL = 4
BINS_PER_TASK = 50_000
FAN_IN = 8
PIECES_AT_ONCE = 200_000

PIECES = (
    "doc_id {id}, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"
)


class WordIds:
    """Ids of words, from the tokenizer file at ``path``.

    No token of this kind of tokenizer spans white space, so the ids of a text are those of its words in
    a row. Words of plain ASCII and Latin-1 letters skip the general normaliser: they are lower-cased and
    cut here into runs of letters, single digits and runs of other signs, as its pre-tokens are, and the
    distinct ones go through the library's merges in one call, one text with spaces between them. Every
    other word, and every one with an apostrophe or the start of a special token, goes through the whole
    tokenizer. Nothing is remembered from one slice of texts to the next.
    """

    LETTER, DIGIT, SIGN = 1, 2, 3
    #: Signs that may end a plain word's pre-token elsewhere, or start a special token together with the next one.
    APOSTROPHE, SPECIAL = ord("'"), b"<|"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_str(json.dumps(spec))
        if not all(t["content"].encode().startswith(self.SPECIAL) for t in spec["added_tokens"]):
            raise ValueError(f"special tokens of {path} do not start with {self.SPECIAL!r}")
        pieces = [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}]
        plain = {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": pieces}}
        self.parts = Tokenizer.from_str(json.dumps(spec | plain))
        vocabulary, mark = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.is_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.is_end[[n for token, n in vocabulary.items() if token.endswith(mark)]] = True
        self.kinds = np.zeros(256, np.uint8)
        self.kinds[33:127] = self.SIGN
        self.kinds[48:58] = self.DIGIT
        self.kinds[[*range(65, 91), *range(97, 123)]] = self.LETTER

    def _cut(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the words with plain ones in lower case, first byte of each part, and is it an odd word's?

        An odd word is one part.
        """
        kind = self.kinds[data]
        low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        # Latin-1 letters are C3 and a second byte; 97 and B7 are the signs of multiplication and division.
        at = np.flatnonzero(data == 0xC3)
        second = data[at + 1]
        at, second = at[(second != 0x97) & (second != 0xB7)], second[(second != 0x97) & (second != 0xB7)]
        kind[at] = kind[at + 1] = self.LETTER
        low[at + 1] = np.where(second <= 0x9E, second + 32, second)
        odd = (kind == 0) | (data == self.APOSTROPHE)
        odd[:-1] |= (data[:-1] == self.SPECIAL[0]) & (data[1:] == self.SPECIAL[1])
        odd = np.repeat(np.logical_or.reduceat(odd, first), np.diff(first, append=len(data)))
        head = np.empty(len(data), bool)
        head[0] = True
        head[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == self.DIGIT)
        head &= ~odd
        head[first] = True
        return np.where(odd, data, low), np.flatnonzero(head), odd[head]

    def _plain(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts in a row, and the number of ids of each."""
        data, offsets = as_binary(parts)
        spaced = np.full(len(data) + len(parts), ord(" "), np.uint8)
        spaced[np.arange(len(data)) + np.repeat(np.arange(len(parts)), np.diff(offsets))] = data
        found = self.parts.encode_batch_fast([spaced.tobytes().decode()], add_special_tokens=False)[0].ids
        ids = np.array(found, dtype="<u4")
        return ids, np.diff(np.flatnonzero(self.is_end[ids]), prepend=-1)

    def _odd(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode() for w in words.to_pylist()]
        found = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], dtype="<u4"), np.array([len(ids) for ids in found], np.int64)

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each word."""
        if len(words) == 0:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        data, offsets = as_binary(words)
        data, heads, odd = self._cut(data, offsets[:-1])
        bounds = np.append(heads, len(data)).astype(np.int64)
        parts = pa.Array.from_buffers(pa.large_binary(), len(heads), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = parts.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        odd_entry = np.zeros(len(coded.dictionary), bool)
        odd_entry[codes[odd]] = True
        counts = np.zeros(len(odd_entry), np.int64)
        flat = []
        for chosen, find in ((~odd_entry, self._plain), (odd_entry, self._odd)):
            if chosen.any():
                ids, counts[chosen] = find(coded.dictionary.filter(pa.array(chosen)))
                flat.append(ids)
        # Plain entries come first in the row of ids, then odd ones, each in their own order.
        order = np.argsort(odd_entry, kind="stable")
        starts = np.empty(len(counts), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        all_ids = np.concatenate(flat)[take_runs(starts[codes], counts[codes])]
        return all_ids, np.add.reduceat(counts[codes], np.searchsorted(heads, offsets[:-1]))


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per Python worker."""
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def token_ids(path: str, texts: pa.Array) -> list[np.ndarray]:
    """Ids of each text followed by the end id; null and empty texts have the end id alone."""
    words = split_words(texts)
    ids, counts = word_ids(path).ids(words.words)
    ends = np.concatenate([[0], np.cumsum(counts)])[words.first]
    tail = np.array([END_ID], dtype="<u4")
    return [np.concatenate([ids[a:b], tail]) for a, b in zip(ends[:-1], ends[1:])]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit decreasing. Returns bin and offset of each item, and the fill of each bin.

    Ties are broken by position, so equal input gives equal bins.
    """
    place = np.zeros(len(sizes), np.int64)
    offset = np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    open_by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            stack = open_by_room[room]
            b = stack.pop()
            if not stack:
                del open_by_room[room]
                rooms.pop(at)
        else:
            b, room = len(fills), capacity
            fills.append(0)
        place[i], offset[i] = b, fills[b]
        fills[b] += size
        room -= size
        if room:
            if room not in open_by_room:
                open_by_room[room] = []
                insort(rooms, room)
            open_by_room[room].append(b)
    return place, offset, np.array(fills, np.int64)


def pieces_of(path: str, capacity: int):
    """Task function: tokenise, cut and pack the documents of one partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, bins = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        schema = None

        def flush() -> pa.RecordBatch:
            nonlocal bins
            ids, piece, start, length, crc = (list(c) for c in zip(*held))
            held.clear()
            length = np.array(length, np.int64)
            place, offset, fill = best_fit(length, capacity)
            numbers = (task << 40) + bins + place
            bins += len(fill)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, schema), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length), pa.array(crc, pa.int64()), pa.array(numbers), pa.array(offset),
                    pa.array(fill[place]),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"],
            )

        for batch in batches:
            schema = batch.schema.field(0).type
            for part in slices(batch, "text"):
                for doc, ids in zip(part.column(0).to_pylist(), token_ids(path, part.column("text"))):
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        cut = ids[start : start + capacity]
                        held.append((doc, k, start, len(cut), zlib.crc32(cut.tobytes())))
                if len(held) >= PIECES_AT_ONCE:
                    yield flush()
        if held:
            yield flush()

    return pack


def _merge_group(capacity: int):
    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin", kind="stable")
        place, shift, fill = best_fit(group["fill"].to_numpy(), capacity)
        # The new bin takes the number of the first old bin in it.
        names = group["bin"].to_numpy()
        head = np.full(len(fill), -1, np.int64)
        head[place[shift == 0]] = names[shift == 0]
        return pd.DataFrame({"bin": names, "target": head[place], "shift": shift, "fill": fill[place]})

    return merge


def merge_bins(open_bins: DataFrame, capacity: int, per_task: int = BINS_PER_TASK, fan_in: int = FAN_IN) -> DataFrame | None:
    """Map of underfull bins (bin, fill) to their last bin: bin, target, shift. None if there are none."""
    items = durable(open_bins)
    left = items.count()
    if not left:
        return None
    whole, groups = None, max(1, math.ceil(left / per_task) * fan_in)
    while True:
        groups = max(math.ceil(groups / fan_in), math.ceil(left / per_task))
        dealt = items.withColumn("group", F.pmod(F.xxhash64("bin", F.lit(groups)), F.lit(groups)))
        step = durable(
            dealt.groupBy("group").applyInPandas(
                _merge_group(capacity), "bin long, target long, shift long, fill long"
            )
        )
        if whole is None:
            whole = step.select("bin", "target", "shift")
        else:
            nxt = step.select(F.col("bin").alias("target"), F.col("target").alias("next"), F.col("shift").alias("more"))
            whole = durable(
                whole.join(nxt, "target", "left").select(
                    "bin",
                    F.coalesce("next", "target").alias("target"),
                    (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"),
                )
            )
        merged = step.where((F.col("shift") == 0) & (F.col("fill") < capacity - NEARLY_FULL))
        items = merged.select("target", "fill").withColumnRenamed("target", "bin")
        now = items.count()
        if groups == 1 or now == 0 or now > 0.99 * left:
            return whole
        left = now


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE,
         per_task: int = BINS_PER_TASK) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``path`` is a tokenizer file that every executor has. Null and empty texts hold the end id
    only. Rows that repeat an id are packed each on its own. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pieces = durable(source.mapInArrow(pieces_of(path, capacity), PIECES.format(id=kind)))
    heads = pieces.where((F.col("offset") == 0) & (F.col("fill") < capacity - NEARLY_FULL)).select("bin", "fill")
    moved = merge_bins(heads, capacity, per_task)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if moved is None:
        return pieces.select(*columns, F.col("bin").alias("sequence_id"), "offset")
    return pieces.join(moved, "bin", "left").select(
        *columns,
        F.coalesce("target", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
