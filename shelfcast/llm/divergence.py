"""Divergence of the word use of sources, from exact products of one-hot level matrices.

A source's count of a term becomes an integer probability p, the same for all terms of that count: a
level. With a one-hot column for each (source, level) over the terms, the product of the transposed
matrix with itself holds, for each two sources, the joint table of their levels: how many terms have
level i here and level j there. Each cell is priced once by the integer divergence of its two levels,
and a pair's divergence is the sum of its priced table. Terms are dealt into blocks of similar counts,
where levels are few, and sources into blocks of columns; products of 0/1 matrices of fewer than 2^24
rows are exact in single precision, and so are the sums of prices, kept under 2^53 a block, in double.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import quoted
from shelfcast.llm.words import bytes_outside, lower_ascii, slices, split_words
from shelfcast.plans.durable import durable

LEAST_DOCS = 10
TOP_TERMS = 10
UNIT = 1_000_000_000
TERMS_PER_BLOCK = 2048
SOURCES_PER_BLOCK = 256
#: A block of terms is halved until it has at most so many one-hot columns, or so few terms.
MOST_COLUMNS = 512
FEWEST_TERMS = 16
COLUMNS_AT_ONCE = 2048
COUNT_SLICE = 16 << 20

BETWEEN = bytes_outside([*range(0x41, 0x5B), *range(0x61, 0x7B)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) to counts (lang, source, term, times, docs); a null term counts the documents."""
    names = ["lang", "source", "term", "times", "docs"]
    for batch in batches:
        for part in slices(batch, "text", COUNT_SLICE):
            keys = part.select(["lang", "source"]).to_pylist()
            numbers: dict[tuple, int] = {}
            group = np.array([numbers.setdefault((k["lang"], k["source"]), len(numbers)) for k in keys], np.int64)
            split = split_words(lower_ascii(part.column("text")), BETWEEN)
            coded = split.words.dictionary_encode()
            width = max(len(coded.dictionary), 1)
            # First each (document, term) with its count, then each (group, term).
            cells, times = np.unique(split.owners() * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            pairs, place = np.unique(group[cells // width] * width + cells % width, return_inverse=True)
            totals = np.bincount(place, weights=times, minlength=len(pairs)).astype(np.int64)
            docs = np.bincount(place, minlength=len(pairs)).astype(np.int64)
            of_pair = np.concatenate([pairs // width, np.arange(len(numbers))])
            langs, sources = (pa.array([n[k] for n in numbers], pa.string()) for k in (0, 1))
            terms = coded.dictionary.cast(pa.large_string()).cast(pa.string()).take(pa.array(pairs % width))
            yield pa.RecordBatch.from_arrays(
                [
                    langs.take(pa.array(of_pair)), sources.take(pa.array(of_pair)),
                    pa.concat_arrays([terms, pa.nulls(len(numbers), pa.string())]),
                    pa.array(np.concatenate([totals, np.zeros(len(numbers), np.int64)])),
                    pa.array(np.concatenate([docs, np.bincount(group, minlength=len(numbers))])),
                ],
                names,
            )


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
                least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row per (lang, term) kept: lang, term, total, parts (source and times); one with a null term lists a lang's sources.

    Every task counts its own texts first, so a frequent term of a large source is one row a task.
    """
    text = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counts = rows.mapInArrow(_count, "lang string, source string, term string, times long, docs long")
    by_source = counts.groupBy("lang", "source", "term").agg(F.sum("times").alias("times"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("times").alias("total"), F.collect_list(F.struct("source", "times")).alias("parts")
    )
    return by_term.where(F.col("term").isNull() | (F.col("docs") >= least_docs)).select("lang", "term", "total", "parts")


# Spark has integer division as an operator of SQL only.
def _div(top: str, bottom: str) -> Column:
    return F.expr(f"({top}) div ({bottom})")


def _with_level(rows: DataFrame, name: str, times: str, mass: str, terms: str) -> DataFrame:
    top = f"cast({UNIT} as decimal(10,0)) * cast({times} + 2 as decimal(20,0))"
    bottom = f"cast(greatest({mass} + 2 * {terms}, 1) as decimal(20,0))"
    return rows.withColumn(name, _div(top, bottom) + 1)


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of integer levels up to about 2 * UNIT, which 64 bits hold."""
    return (p - q) ** 2 // (p + q)


def priced_tables(levels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Divergence of each pair (row of ``left``, row of ``right``) of sources over some terms.

    ``levels`` has a row for every term and a column for every source. Only pairs whose left number is
    the smaller one are worked out; the others stay 0.
    """
    sources = levels.shape[1]
    out = np.zeros(sources * sources, np.int64)
    known = [np.unique(levels[:, s], return_inverse=True) for s in range(sources)]
    shift = np.cumsum([0] + [len(values) for values, _ in known])
    columns = np.stack([place + shift[s] for s, (_, place) in enumerate(known)], axis=1) if sources else levels
    value = np.concatenate([values for values, _ in known]) if sources else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(sources), np.diff(shift))
    is_left, is_right = np.isin(np.arange(sources), left), np.isin(np.arange(sources), right)
    order = np.argsort(levels.sum(axis=1), kind="stable")

    def product(terms: np.ndarray) -> None:
        used, place = np.unique(columns[terms], return_inverse=True)
        if len(used) > max(MOST_COLUMNS, sources) and len(terms) > FEWEST_TERMS:
            product(terms[: len(terms) // 2])
            product(terms[len(terms) // 2 :])
            return
        hot = np.zeros((len(terms), len(used)), np.float32)
        hot[np.arange(len(terms))[:, None], place.reshape(len(terms), sources)] = 1
        lefts, rights = np.flatnonzero(is_left[owner[used]]), np.flatnonzero(is_right[owner[used]])
        for a in range(0, len(lefts), COLUMNS_AT_ONCE):
            for b in range(0, len(rights), COLUMNS_AT_ONCE):
                here, there = lefts[a : a + COLUMNS_AT_ONCE], rights[b : b + COLUMNS_AT_ONCE]
                joint = hot[:, here].T @ hot[:, there]
                i, j = np.nonzero(joint)
                x, y = used[here[i]], used[there[j]]
                wanted = owner[x] < owner[y]
                x, y, n = x[wanted], y[wanted], joint[i[wanted], j[wanted]].astype(np.int64)
                cost = n * price(value[x], value[y])
                pair = owner[x] * sources + owner[y]
                out[:] += np.bincount(pair, weights=cost, minlength=len(out)).astype(np.int64)

    if len(order):
        product(order)
    return out.reshape(sources, sources)


def _block(table: pa.Table) -> pa.Table:
    """One block of terms and two of sources: rows (lang, a, b, term, number, p); rows without a term give p at no occurrence."""
    lang, a, b = (table.column(c)[0].as_py() for c in ("lang", "a", "b"))
    terms = table.column("term").combine_chunks()
    number, p = table.column("number").to_numpy(), table.column("p").to_numpy()
    base = terms.is_null().to_numpy(zero_copy_only=False)
    numbers, first = np.unique(number[base], return_index=True)
    coded = terms.filter(pa.array(~base)).dictionary_encode()
    levels = np.tile(p[base][first], (len(coded.dictionary), 1))
    at = np.searchsorted(numbers, number[~base])
    levels[coded.indices.to_numpy(zero_copy_only=False), at] = p[~base]
    left, right = (np.flatnonzero(numbers // SOURCES_PER_BLOCK == k) for k in (a, b))
    values = priced_tables(levels, left, right)
    i, j = (m.ravel() for m in np.meshgrid(left, right, indexing="ij"))
    i, j = i[i < j], j[i < j]
    return pa.table(
        {
            "lang": pa.array([lang] * len(i), pa.string()), "one": pa.array(numbers[i].astype(np.int64)),
            "two": pa.array(numbers[j].astype(np.int64)), "value": pa.array(values[i, j]),
        }
    )


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
          least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """Rows lang, source, part, item, value, rank: each source against the others of its lang, and its marked terms.

    Part ``pair``: the divergence from every other source of the lang, over the terms that at least
    ``least_docs`` of the lang's rows have. Part ``term``: the ``top`` terms that the source has oftener
    than the whole lang. Null lang, source and text count as ''; rows that repeat count each; ties are
    broken by the item. A lang without such terms has pairs of value 0, a lang of one source no pairs; an
    empty table gives no rows. Columns other than the three named are not read.
    """
    counted = durable(term_counts(docs, lang_col, source_col, text_col, least_docs))
    kept = counted.where("term is not null")
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_mass"))
    spread = kept.select("lang", "term", "total", F.explode("parts").alias("c")).select("lang", "term", "total", "c.source", "c.times")
    listed = counted.where("term is null").select(
        "lang", F.size("parts").alias("sources"), F.posexplode(F.array_sort(F.transform("parts", lambda c: c["source"]))).alias("number", "source")
    )
    groups = (
        listed.join(spread.groupBy("lang", "source").agg(F.sum("times").alias("mass")), ["lang", "source"], "left")
        .join(of_lang, "lang", "left")
        .fillna(0, ["mass", "terms", "lang_mass"])
    )
    groups = durable(_with_level(groups.withColumn("none", F.lit(0)), "p", "none", "mass", "terms").drop("none"))

    # Terms of one lang and of counts between two powers of two, dealt into blocks.
    size_class = F.length(F.bin("total"))
    classes = kept.groupBy("lang", size_class.alias("size_class")).agg(F.ceil(F.count(F.lit(1)) / TERMS_PER_BLOCK).alias("blocks"))
    classes = durable(classes)
    cells = spread.withColumn("size_class", size_class).join(classes, ["lang", "size_class"])
    cells = cells.withColumn("block", F.pmod(F.xxhash64("term"), "blocks")).drop("blocks")
    cells = cells.join(groups.drop("p"), ["lang", "source"])
    cells = _with_level(_with_level(cells, "p", "times", "mass", "terms"), "q", "total", "lang_mass", "terms")

    blocks = classes.select("lang", "size_class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    alone = groups.select("lang", F.lit(0).alias("size_class"), F.lit(0).cast("long").alias("block")).distinct()
    bases = groups.join(blocks.union(alone), "lang").withColumn("term", F.lit(None).cast("string"))
    columns = ["lang", "size_class", "block", "sources", "term", "number", "p"]
    own = F.floor(F.col("number") / SOURCES_PER_BLOCK)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / SOURCES_PER_BLOCK)))
    dealt = cells.select(*columns).union(bases.select(*columns)).withColumn("other", other)
    dealt = dealt.select(
        "lang", "size_class", "block", F.least(own, "other").alias("a"), F.greatest(own, "other").alias("b"), "term", "number", "p"
    )
    products = dealt.groupBy("lang", "size_class", "block", "a", "b").applyInArrow(_block, "lang string, one long, two long, value long")
    sums = products.groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("one").alias("number"), F.col("two").alias("other")),
                                                          F.struct(F.col("two").alias("number"), F.col("one").alias("other")))).alias("w"))
    names = groups.select("lang", F.col("number").cast("long").alias("number"), "source")
    pairs = (
        both.select("lang", "value", "w.number", "w.other").join(names, ["lang", "number"])
        .join(names.select("lang", F.col("number").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))
    marked = cells.where("p > q").withColumn("value", _div("(p - q) * (p - q)", "p + q"))
    marked = marked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    marked = marked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.select(*out).unionByName(marked.select(*out))
