"""Whole texts as arrays of words: the vectorised front end of the text operators.

A word is a longest run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. Everything here works on the rows of one Arrow batch inside a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True

SLICE_BYTES = 4 << 20


def bytes_outside(inside: Iterable[int]) -> np.ndarray:
    """Table of the bytes between words, where words hold the bytes ``inside`` and every byte beyond ASCII."""
    table = np.ones(256, dtype=bool)
    table[[*inside, *range(128, 256)]] = False
    return table


@dataclass
class Words:
    """Words of several texts, in order. Text i has the words first[i] to first[i + 1]."""

    first: np.ndarray
    words: pa.Array

    def owners(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def as_binary(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if large else np.int32) if offsets else np.zeros(1, np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``most`` bytes of text, one row at least."""
    if batch.num_rows == 0:
        return
    _, offsets = as_binary(batch.column(text))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def word_bounds(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one byte of every word; a word never spans two texts. ``outside`` marks bytes between words."""
    inside = ~outside[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    before[heads] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    after[tails] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def split_words(texts: pa.Array, outside: np.ndarray = _IS_SPACE) -> Words:
    """Words of each text as one Arrow array without copies of single words."""
    data, offsets = as_binary(texts)
    starts, ends = word_bounds(data, offsets, outside)
    bounds = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    packed = data[~outside[data]]
    words = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(packed))]
    )
    return Words(np.searchsorted(starts, offsets, side="left"), words)


def lower_ascii(texts: pa.Array) -> pa.Array:
    """A to Z in lower case, all other bytes as they are."""
    data, offsets = as_binary(texts)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def distinct(words: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Number of each word's entry, and the entries."""
    if len(words) == 0:
        return np.zeros(0, np.int64), []
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def take_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the runs (start, length), one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(total)
