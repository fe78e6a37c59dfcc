"""Benchmark passages in documents, found by one Aho-Corasick automaton.

Both sides are normalised alike: A to Z in lower case, words are runs of letters, digits and
characters beyond ASCII. The patterns are all windows of ten consecutive words of an item; an item of
fewer words is one window. The automaton reads words, not bytes: each word of the windows is one
letter of its alphabet, every other word of a document the same foreign letter. So one pass over a
text, one step a word, finds every occurrence of every window, and the place of a letter is the number
of a word, whose bytes in the original text are known.

Only windows reach the driver and the tasks, at most ``windows_at_once`` at a time (and
``bytes_at_once`` bytes); a larger benchmark is dealt into that many passes, each with an automaton
of its own, and every pass adds to the marks of those before it.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.llm.common import fresh, quoted
from shelfcast.llm.words import SLICE_BYTES, as_binary, bytes_outside, lower_ascii, slices, split_words, word_bounds
from shelfcast.plans.durable import durable

WINDOW = 10
#: An automaton has at most ten nodes a window, and a letter for every word of the windows.
WINDOWS_AT_ONCE = 100_000
BYTES_AT_ONCE = 32 << 20

BETWEEN = bytes_outside([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)])
FOREIGN = 1

SPAN = pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField(f.name, T.LongType()) for f in SPAN]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _windows_of(length: int):
    """Task function: rows (item, text) to rows (item, window)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                split = split_words(lower_ascii(part.column("text")), BETWEEN)
                words = split.words.cast(pa.large_string()).to_pylist()
                items, windows = [], []
                for item, first, stop in zip(part.column("item").to_pylist(), split.first[:-1], split.first[1:]):
                    for start in range(first, max(stop - length, first) + 1 if stop > first else first):
                        items.append(item)
                        windows.append(" ".join(words[start : min(start + length, stop)]))
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(windows, pa.string())], ["item", "window"])

    return cut


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", length: int = WINDOW) -> DataFrame:
    """Distinct (item, window) rows; the window's words are joined by spaces, a null id is the empty string."""
    rows = benchmark.select(
        F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")).alias("item"), F.col(quoted(text_col)).alias("text")
    )
    return rows.mapInArrow(_windows_of(length), "item string, window string").distinct()


class Automaton:
    """Windows as words over an alphabet of words."""

    def __init__(self, rows: list[tuple[str, str]]):
        owners: dict[str, list[str]] = {}
        for item, window in rows:
            owners.setdefault(window, []).append(item)
        split = [w.split(" ") for w in owners]
        entries = sorted({w for words in split for w in words})
        letters = self.letter(np.arange(len(entries)))
        self.vocabulary = pa.array([e.encode() for e in entries], pa.large_binary())
        by_word = dict(zip(entries, self.text(letters)))
        self.lengths = np.array([len(words) for words in split], np.int64)
        self.items = list(owners.values())
        self.machine = ahocorasick.Automaton()
        for number, words in enumerate(split):
            self.machine.add_word("".join([by_word[w] for w in words]), number)
        self.machine.make_automaton()

    @staticmethod
    def letter(number: np.ndarray) -> np.ndarray:
        """Code points after the foreign letter, without the surrogates."""
        code = number.astype(np.int64) + FOREIGN + 1
        return np.where(code >= 0xD800, code + 0x800, code)

    @staticmethod
    def text(codes: np.ndarray) -> str:
        return codes.astype("<u4").tobytes().decode("utf-32-le")

    def find(self, words: pa.Array, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last word and window number of every occurrence. A foreign letter keeps texts apart."""
        found = pc.index_in(words, value_set=self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
        codes = np.full(len(words) + (int(owners[-1]) + 1 if len(owners) else 0), FOREIGN, np.int64)
        places = np.arange(len(words)) + owners
        codes[places] = np.where(found < 0, FOREIGN, self.letter(found))
        hits = list(self.machine.iter(self.text(codes))) if self.items else []
        ends = np.fromiter((h[0] for h in hits), np.int64, len(hits))
        return np.searchsorted(places, ends), np.fromiter((h[1] for h in hits), np.int64, len(hits))


_BUILT: dict[str, Automaton] = {}


def _automaton(name: str, shared) -> Automaton:
    """The automaton of a broadcast, built once in a Python worker."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Automaton(shared.value)
    return _BUILT[name]


def _runs(hit: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one place of every run of hits that no break cuts."""
    before = np.concatenate([[False], hit[:-1]])
    before[breaks[breaks < len(hit)]] = False
    after = np.concatenate([hit[1:], [False]])
    after[breaks[breaks > 0] - 1] = False
    return np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1


def _marks(automaton: Automaton, texts: pa.Array, spans: pa.Array | None, items: pa.Array | None) -> list[pa.Array]:
    """The columns of RESULT for some texts, added to those of earlier passes."""
    data, offsets = as_binary(texts)
    starts, ends = word_bounds(data, offsets, BETWEEN)
    split = split_words(lower_ascii(texts), BETWEEN)
    owners, rows = split.owners(), len(texts)
    last, window = automaton.find(split.words, owners)
    steps = np.zeros(len(starts) + 1, np.int64)
    np.add.at(steps, last - automaton.lengths[window] + 1, 1)
    np.add.at(steps, last + 1, -1)
    names: list[set[str]] = [set() for _ in range(rows)]
    pairs = np.unique(owners[last] * len(automaton.items) + window) if len(last) else []
    for pair in pairs:
        names[pair // len(automaton.items)].update(automaton.items[pair % len(automaton.items)])
    if spans is not None:
        for row, (old, had) in enumerate(zip(spans.to_pylist(), items.to_pylist())):
            names[row].update(had)
            for span in old:
                at = split.first[row] + span["first_word"]
                steps[at] += 1
                steps[at + span["words"]] -= 1
    hit = np.cumsum(steps)[:-1] > 0
    first, stop = _runs(hit, split.first)
    row = owners[first]
    # Characters of the original text before a byte: its bytes that continue no character.
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if len(first) else np.zeros(1, np.int64)
    base = heads[offsets[row]]
    span_rows = pa.StructArray.from_arrays(
        [
            pa.array(first - split.first[row]), pa.array(stop - first),
            pa.array(heads[starts[first]] - base), pa.array(heads[ends[stop - 1]] - base),
        ],
        fields=list(SPAN),
    )
    bounds = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    counts = np.bincount(owners, weights=hit, minlength=rows).astype(np.int64)
    return [
        pa.array(np.diff(split.first).astype(np.int64)), pa.array(counts),
        pa.ListArray.from_arrays(pa.array(bounds), span_rows), pa.array([sorted(n) for n in names], pa.list_(pa.string())),
    ]


def _scanner(shared, kept: int, again: bool):
    """Task function: (text, kept columns, spans, items) to (text, kept columns, columns of RESULT)."""
    name = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.names[0], SLICE_BYTES):
                old = (part.column(kept + 1), part.column(kept + 2)) if again else (None, None)
                marks = _marks(_automaton(name, shared), part.column(0), *old)
                columns = [part.column(k) for k in range(kept + 1)]
                yield pa.RecordBatch.from_arrays(columns + marks, [f"c{k}" for k in range(len(columns) + len(marks))])

    return scan


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
         keep: list[str] | None = None, length: int = WINDOW, windows_at_once: int = WINDOWS_AT_ONCE,
         bytes_at_once: int = BYTES_AT_ONCE) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default), n_words, n_hit, spans and items of each row.

    n_hit counts the words inside any occurrence of a window; spans are the runs of such words, with
    their first word, number of words and half-open range of characters in the original text; items
    are the distinct ids, as sorted strings, of the items with windows there. A null text has no words;
    a null or wordless item has no windows, an item with a null id has the id ''; items that repeat an
    id are one item. Rows that repeat are marked each on its own. An empty benchmark marks nothing, an
    empty table gives no rows. Where ``keep`` has one of the four names, underscores are appended to the new one.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    windows = durable(item_windows(benchmark, item_col, item_text, length))
    count, size = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("window") + F.octet_length("item")), F.lit(0))).first()
    passes = max(1, math.ceil(count / windows_at_once), math.ceil(size / bytes_at_once))
    text = F.col(quoted(text_col)).cast("string").alias("c0")
    rows = docs.select(text, *[F.col(quoted(c)).alias(f"c{k + 1}") for k, c in enumerate(keep)])
    fields = list(rows.schema.fields)
    for number in range(passes):
        block = windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(passes)) == number)
        shared = spark.sparkContext.broadcast([(r["item"], r["window"]) for r in block.collect()])
        new = [T.StructField(f"c{len(fields) + k}", f.dataType) for k, f in enumerate(RESULT.fields)]
        if number:
            rows = durable(rows).drop(f"c{len(fields)}", f"c{len(fields) + 1}")
        rows = rows.mapInArrow(_scanner(shared, len(keep), number > 0), T.StructType(fields + new))
    names = list(keep)
    for f in RESULT.fields:
        names.append(fresh(f.name, names))
    return rows.select(*[F.col(f"c{k + 1}").alias(name) for k, name in enumerate(names)])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", most_share: float = 0.0, **options) -> DataFrame:
    """The rows of ``docs`` of whose words at most ``most_share`` lie in windows; none at all by default."""
    marked = scan(docs, benchmark, text_col, **options)
    words, hit = marked.columns[len(docs.columns) :][:2]
    return marked.where(F.col(quoted(hit)) <= F.col(quoted(words)) * most_share).select(*[F.col(quoted(c)) for c in docs.columns])


def cut_passages(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the marked runs of words cut from the text; what lies between them stays as it is."""
    marked = scan(docs, benchmark, text_col, **options)
    spans, text = F.col(quoted(marked.columns[-2])), F.col(quoted(text_col))

    def between(at):
        start = F.when(at == 0, F.lit(0)).otherwise(F.get(spans, at - 1)["stop"]).cast("int")
        stop = F.coalesce(F.get(spans, at)["start"], F.length(text).cast("long")).cast("int")
        return text.substr(start + 1, stop - start)

    left = F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans)), between), "")
    cut = F.when((F.size(spans) > 0) & text.isNotNull(), left).otherwise(text)
    return marked.select(*[cut.alias(c) if c == text_col else F.col(quoted(c)) for c in docs.columns])
