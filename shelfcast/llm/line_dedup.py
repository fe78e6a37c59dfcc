"""Passages of lines that occur again, found as content-defined chunks of two lines.

A rolling hash runs over the hashes of neighbouring lines; where it is a multiple of ``mean``, a chunk
of these two lines begins. A chunk depends on its own lines alone, so inserted lines shift nothing
beyond themselves, and chunks overlap, so a repeated passage is the union of its repeated chunks. At
``mean`` 1 every line begins a chunk and nothing of a passage is lost; larger values sample. A line of
at least ``least_words`` words is a chunk of its own as well.

Hashes are computed once, and counted without texts. Lines are fetched only for chunks whose hash
occurs twice, and grouped by hash and bytes, so chunks that only share a hash stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import quoted
from shelfcast.plans.durable import durable

MEAN_LINES = 1
LEAST_WORDS = 10
BLANK = " \t\n\x0b\x0c\r"


def split_lines(text: Column) -> Column:
    """Lines of a text; null counts as empty, an empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def chunk_keys(text: Column, mean: int = MEAN_LINES, least_words: int = LEAST_WORDS) -> Column:
    """Array of (start, lines, hash): start counts lines from 0; chunks of white space alone are left out."""
    long = rf"^\s*+(?:\S++\s++){{{least_words - 1}}}\S"
    marks = F.transform(
        split_lines(text),
        lambda line: F.struct(F.xxhash64(line).alias("h"), line.rlike(long).alias("long"), (F.btrim(line, F.lit(BLANK)) != "").alias("ink")),
    )

    def keys(marks: Column) -> Column:
        def at(mark: Column, i: Column) -> Column:
            after = F.get(marks, i + 1)
            rolled = F.xxhash64(mark["h"], after["h"])
            pair = after.isNotNull() & (mark["ink"] | after["ink"])
            if mean > 1:
                pair = pair & (F.pmod(rolled, F.lit(mean)) == 0)
            one = F.struct(i.alias("start"), F.lit(1).alias("lines"), mark["h"].alias("hash"))
            return F.array(F.when(mark["long"], one), F.when(pair, F.struct(i.alias("start"), F.lit(2).alias("lines"), rolled.alias("hash"))))

        return F.filter(F.flatten(F.transform(marks, at)), lambda k: k.isNotNull())

    # The marks are computed once per row: they become the element of a one-row array.
    return F.flatten(F.transform(F.array(marks), keys))


def _base(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column, Column]:
    """``docs`` with columns c0, c1, ... and the MD5 of the text; its id and text. No name can clash afterwards."""
    base = docs.select(*[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(docs.columns)])
    row_id, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    # Never null, also to the planner: a filter for nulls in one of the plans would keep it from reusing the other's shuffle.
    digest = F.coalesce(F.unhex(F.md5(F.coalesce(text, F.lit("")))), F.lit(b""))
    return base.withColumn("digest", digest), row_id, text


def _of_row(base: DataFrame, found: DataFrame, row_id: Column) -> DataFrame:
    """``base`` with what was found for its rows; the same join everywhere, so that texts are shuffled once."""
    return base.join(found, row_id.eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of_doc")), "left")


def _repeated(base: DataFrame, row_id: Column, text: Column, mean: int, least_words: int) -> DataFrame:
    place = F.struct("id", "doc", "start")
    keys = durable(base.select(row_id.alias("id"), F.col("digest").alias("doc"), chunk_keys(text, mean, least_words).alias("keys")))
    often = keys.select(F.explode("keys").alias("k")).groupBy("k.lines", "k.hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    each = keys.select("id", "doc", F.explode("keys").alias("k")).select("id", "doc", "k.start", "k.lines", "k.hash")
    again = each.join(often, ["lines", "hash"], "left_semi")
    spots = again.groupBy(F.col("id").alias("of_id"), F.col("doc").alias("of_doc")).agg(
        F.collect_set(F.struct("start", "lines", "hash")).alias("spots")
    )
    bodies = F.flatten(F.transform(
        F.array(split_lines(text)),
        lambda ls: F.transform(F.coalesce(F.col("spots"), F.array()), lambda s: F.struct(
            s["start"].alias("start"), s["lines"].alias("lines"), s["hash"].alias("hash"),
            F.array_join(F.slice(ls, s["start"] + 1, s["lines"]), "\n").alias("body"),
        )),
    ))
    chunks = _of_row(base, spots, row_id).select(row_id.alias("id"), F.col("digest").alias("doc"), F.explode_outer(bodies).alias("c"))
    chunks = chunks.where("c is not null").select("id", "doc", "c.start", "c.lines", "c.hash", "c.body")
    sha = F.unhex(F.sha2("body", 256)).alias("sha")
    equal = chunks.groupBy("hash", "body").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    found = chunks.select("id", "doc", "start", "lines", "hash", sha).join(equal.select("hash", sha, "first"), ["hash", "sha"])
    return found.select("id", "doc", "start", "lines", (place == F.col("first")).alias("is_first"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean: int = MEAN_LINES,
             least_words: int = LEAST_WORDS) -> DataFrame:
    """Places of every chunk that occurs twice: id, doc (MD5 of the text), start, lines, is_first.

    First means the smallest (id, doc, start), null ids first. Rows that repeat id and text are one
    document here.
    """
    return _repeated(*_base(docs.select(F.col(quoted(id_col)), F.col(quoted(text_col))), id_col, text_col), mean, least_words)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed: str = "removed_lines", total: str | None = None,
                mean: int = MEAN_LINES, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the lines of repeated chunks, the number of lines cut, and that of all lines as ``total``.

    A line goes if it lies in a chunk that occurred before. It stays if it belongs to the first place
    of a repeated chunk, so each is left once in full. Every row stays, with an empty text if all its
    lines go; null texts stay null. An empty table gives no rows. The new columns replace those of
    ``docs`` with the same names, in whatever case.
    """
    counts = [removed, *([total] if total else [])]
    names = [c for c in docs.columns if c.lower() not in {n.lower() for n in counts}]
    base, row_id, text = _base(docs.select(*[F.col(quoted(c)) for c in names]), id_col, text_col)
    lines = F.sequence("start", F.col("start") + F.col("lines") - 1)
    cut = (
        _repeated(base, row_id, text, mean, least_words)
        .groupBy(F.col("id").alias("of_id"), F.col("doc").alias("of_doc"))
        .agg(*[
            F.array_distinct(F.flatten(F.collect_set(F.when(F.col("is_first") == first, lines)))).alias(name)
            for name, first in (("later_lines", False), ("first_lines", True))
        ])
        .select("of_id", "of_doc", F.array_except("later_lines", "first_lines").alias("cut"))
        .where(F.size("cut") > 0)
    )
    left = F.array_join(F.flatten(F.transform(
        F.array(split_lines(text)),
        lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("cut")), lambda i: F.get(ls, i)),
    )), "\n")
    gone = F.col("cut").isNotNull() & text.isNotNull()
    figures = [F.when(gone, F.size("cut")).otherwise(0).cast("long").alias(removed)]
    if total:
        figures.append(F.size(split_lines(text)).cast("long").alias(total))
    return _of_row(base, cut, row_id).select(
        *[(F.when(gone, left).otherwise(text) if c == text_col else F.col(f"c{k}")).alias(c) for k, c in enumerate(names)], *figures
    )
