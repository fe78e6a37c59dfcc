"""Exact duplicates by a 128-bit content hash whose groups are compared byte by byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import fresh, quoted


def content(text: str = "text") -> Column:
    """The compared text: null counts as empty, nothing else changes."""
    return F.coalesce(F.col(text), F.lit(""))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per distinct text: content_hash, text_sha256, keep_id, group_size.

    Rows are grouped by (hash, text): the hash leads and deals out the rows, the text behind it is
    compared byte by byte by the aggregate, so texts that only share the hash are different
    classes. Copies are counted before the shuffle, so a group of any size costs one row per task.
    keep_id ignores null ids and is null only where all ids of the class are.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    keyed = docs.select(F.col(id_col).alias("id"), content(text_col).alias("text"))
    grouped = keyed.groupBy(F.md5("text").alias("content_hash"), "text").agg(
        best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return grouped.select("content_hash", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")


def membership(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    The classes carry digests only, so no text moves in this join; the text's own SHA-256 stands
    beside the hash and tells apart texts whose hashes collide. Rows that repeat the id that stays
    are one row to this function and are all marked kept; an empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias(id_col),
        F.md5(content(text_col)).alias("content_hash"),
        F.sha2(content(text_col), 256).alias("text_sha256"),
    )
    joined = rows.join(classes(docs, id_col, text_col, keep), ["content_hash", "text_sha256"])
    return joined.select(
        id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One whole row of each distinct text, with the columns of ``docs``.

    The row with the smallest (largest) id stays; null ids come last, ties are broken by the other
    columns in order, and rows that are equal throughout count as one. A single shuffle: every
    task first keeps its best row of each text. Columns must have an order (no maps).
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    missing = F.col(id_col).isNull() if keep == "smallest" else F.col(id_col).isNotNull()
    first, names = fresh("null_rank", docs.columns), docs.columns
    order = [missing.alias(first), F.col(id_col), *[F.col(quoted(c)) for c in names if c not in (id_col, text_col)]]
    texts, digest, row = (fresh(n, names) for n in ("dedup_text", "dedup_hash", "dedup_row"))
    # Null and empty are one text; which of them the kept row has is part of its order.
    order.append(F.col(text_col).isNull().alias(fresh("null_text", names)))
    best = (
        docs.withColumn(texts, content(text_col))
        .groupBy(F.md5(texts).alias(digest), texts)
        .agg(pick(F.struct(*order)).alias(row))
    )
    null_text = F.col(row)[fresh("null_text", names)]
    return best.select(
        *[
            F.when(~null_text, F.col(texts)).alias(c) if c == text_col else F.col(row)[c].alias(c)
            for c in names
        ]
    )
