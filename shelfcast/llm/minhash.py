"""MinHash fingerprints of documents over runs of five words.

Words are hashed once per distinct word of a batch, runs of words are combined from them, and every
universal hash function of the family is applied to all runs in numpy; the least value of each
function is one position of the signature. The share of equal positions estimates the Jaccard
likeness of two texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.components import components
from shelfcast.llm.words import distinct, slices, split_words
from shelfcast.plans.durable import durable

SHINGLE = 5
PERMUTATIONS = 128
ROWS_PER_BAND = 4
SIMILAR = 0.8
SEED = 3
BLOCK = 1024

_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SHINGLE)], np.uint64)
_EMPTY = np.uint64(0xD6E8FEB86659FD93)


def family(count: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of ``count`` multiply-add hash functions on 64 bits."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, count, dtype=np.uint64)


FAMILY = family()


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the runs of SHINGLE words; of the whole sequence if it is shorter; one value for no words."""
    n = len(hashes)
    if n == 0:
        return np.array([_EMPTY])
    width = min(n, SHINGLE)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out += hashes[k : k + n - width + 1] * _FACTORS[k]
    return _mix(out)


def signature(runs: np.ndarray) -> np.ndarray:
    """16 mixed bits of the least value of each hash function over the runs."""
    a, b = FAMILY
    least = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(runs), BLOCK):
        values = a[:, None] * runs[at : at + BLOCK]
        values += b[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return (_mix(least) >> np.uint64(48)).astype(">u2")


def run_sets(texts: pa.Array) -> list[np.ndarray]:
    """Run hashes of each text, in order, repeats included."""
    words = split_words(texts)
    codes, entries = distinct(words.words)
    table = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in entries), np.uint64, len(entries))
    hashes = table[codes]
    return [shingles(hashes[a:b]) for a, b in zip(words.first[:-1], words.first[1:])]


def signatures(texts: pa.Array) -> np.ndarray:
    """One row per text. Equal texts have equal rows; null counts as empty."""
    found = [signature(runs) for runs in run_sets(texts)]
    return np.array(found, ">u2").reshape(len(found), len(FAMILY[0]))


def likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Share of equal positions."""
    return (one == other).mean(axis=-1)


# ---- a document and the one after it ----------------------------------------------------------


def edit(text: str, after: str) -> str:
    """The last floor(n / 2) code points give way to as many of the start of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Rows (doc_id, text, part, guest): each part is a stretch of the descending order of ids.

    The first row of a part goes to the part before it as well, marked as a guest, and the first of
    all to the last part. So each part sees the row after each of its own, and texts are shuffled
    once. Null ids come last; rows of one id follow each other in an order fixed by their texts.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shares = [k / parts for k in range(1, parts)]
    found = rows.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] if shares else None
    cuts = np.unique(np.array(found or [], np.int64))

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        low = np.zeros(len(ids), np.int64)
        low[known.to_numpy()] = np.searchsorted(cuts, ids[known].astype("int64").to_numpy(), side="right")
        return pd.Series(len(cuts) - low).astype("int32")

    heads = rows.select(part_of("doc_id").alias("part"), "doc_id").groupBy("part").agg(F.max("doc_id").alias("head"))
    firsts = sorted((r["part"], r["head"]) for r in heads.collect())
    # One entry per part: the head's id and the part that sees it as a guest.
    host = {head: firsts[k - 1][0] for k, (_, head) in enumerate(firsts)}

    @F.pandas_udf("int")
    def guest_of(ids: pd.Series) -> pd.Series:
        return pd.Series([host.get(None if pd.isna(i) else int(i)) for i in ids], dtype="Int32")

    places = F.array(F.struct(part_of("doc_id").alias("part"), F.lit(False).alias("guest")))
    again = F.struct(F.col("host").alias("part"), F.lit(True).alias("guest"))
    dealt = rows.withColumn("host", guest_of("doc_id")).withColumn("places", places)
    dealt = dealt.withColumn("place", F.explode(F.when(F.col("host").isNull(), F.col("places")).otherwise(F.array_append("places", again))))
    return (
        dealt.select("doc_id", "text", "place.part", "place.guest")
        .repartition("part")
        .sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    )


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and their likeness and the next one's.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null
    counts as empty. The next document is that of the next lower id, after the last the first; a
    single document is its own next. An empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part in slices(batch, "text"):
                ids, texts, parts_, guests = (part.column(c).to_pylist() for c in ("doc_id", "text", "part", "guest"))
                texts = [t or "" for t in texts]
                found = signatures(part.column("text"))
                if held:
                    ids, texts, parts_, guests = ([h, *x] for h, x in zip(held, (ids, texts, parts_, guests)))
                    found = np.concatenate([held[4][None], found])
                held = (ids[-1], texts[-1], parts_[-1], guests[-1], found[-1])
                own = [i for i in range(len(ids) - 1) if not guests[i] and parts_[i] == parts_[i + 1]]
                edited = [edit(texts[i], texts[i + 1]) for i in own]
                changed = signatures(pa.array(edited, pa.string()))
                mine, after = found[own], found[[i + 1 for i in own]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in own], pa.int64()),
                        pa.array([len(texts[i]) for i in own], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                        pa.array([m.tobytes().hex() for m in mine], pa.string()),
                        pa.array([m.tobytes().hex() for m in changed], pa.string()),
                        pa.array(likeness(mine, changed)),
                        pa.array(likeness(mine, after)),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return in_order(docs, id_col, text_col, parts).mapInArrow(
        work,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double",
    )


# ---- near duplicates --------------------------------------------------------------------------


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = signatures(part.column("text"))
                bands = rows.reshape(len(rows), -1, ROWS_PER_BAND).astype(">u2").tobytes()
                keys = np.frombuffer(bands, ">i8").astype(np.int64).reshape(len(rows), -1)
                ends = np.arange(len(rows) + 1, dtype=np.int32) * keys.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), lists], ["doc_id", "digest", "bands"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("digest"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return source.mapInArrow(work, f"doc_id {kind}, digest string, bands array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, text_col: str, similar: float) -> DataFrame:
    """The pairs (src, dst) of text digests whose runs of words have at least that Jaccard likeness."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (run_sets(batch.column(c)) for c in ("text_src", "text_dst"))
            near = [k for k, (a, b) in enumerate(zip(one, other)) if jaccard(a, b) >= similar]
            yield batch.select(["src", "dst"]).take(pa.array(near, pa.int64()))

    text = F.coalesce(F.col(text_col), F.lit(""))
    wanted = pairs.select(F.col("src").alias("digest")).union(pairs.select("dst")).distinct()
    keyed = docs.select(F.sha2(text, 256).alias("digest"), text.alias("text")).join(wanted, "digest", "left_semi")
    texts = durable(keyed.groupBy("digest").agg(F.first("text").alias("text")))
    sides = [texts.select(F.col("digest").alias(c), F.col("text").alias(f"text_{c}")) for c in ("src", "dst")]
    both = pairs.join(sides[0], "src").join(sides[1], "dst").select("src", "dst", "text_src", "text_dst")
    return both.mapInArrow(work, "src string, dst string")


def jaccard(one: np.ndarray, other: np.ndarray) -> float:
    a, b = np.unique(one), np.unique(other)
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row per row of ``docs``: id and class_id, the smallest id that verified links reach.

    Signatures are cut into bands of ROWS_PER_BAND positions; texts that agree on a band are
    candidates, and at a likeness of 0.8 all bands are missed with a chance of 5 in 100 million.
    Copies of a text count as one. Every member of a bucket is first checked against the bucket's
    least text, which settles groups of near copies with one pair a member; then only members of
    one bucket that are still in different classes are checked against each other.
    """
    signed = durable(_signed(docs, id_col, text_col))
    texts = signed.groupBy("digest").agg(F.first("bands").alias("bands"))
    keyed = durable(texts.select("digest", F.posexplode("bands").alias("band", "key")))
    heads = keyed.groupBy("band", "key").agg(F.min("digest").alias("dst"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = keyed.join(heads.drop("n"), ["band", "key"]).where("digest <> dst").select(F.col("digest").alias("src"), "dst").distinct()
    links = durable(_verified(durable(stars), docs, text_col, similar))
    root = durable(components(links))
    named = keyed.join(root, keyed["digest"] == root["node"], "left").select("band", "key", "digest", F.coalesce("root", "digest").alias("root"))
    open_ = named.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    left = durable(named.join(open_.select("band", "key"), ["band", "key"], "left_semi"))
    other = left.select("band", "key", F.col("digest").alias("dst"), F.col("root").alias("other_root"))
    more = left.withColumnRenamed("digest", "src").join(other, ["band", "key"]).where("root > other_root")
    more = durable(more.select("src", "dst").distinct().join(stars.select(F.col("dst").alias("src"), F.col("src").alias("dst")).union(stars), ["src", "dst"], "left_anti"))
    root = durable(components(links.union(_verified(more, docs, text_col, similar))))
    member = signed.join(root, signed["digest"] == root["node"], "left").select("doc_id", F.coalesce("root", "digest").alias("root"))
    least = member.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return member.join(least, "root").select(F.col("doc_id").alias(id_col), "class_id")
