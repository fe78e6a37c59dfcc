"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters are patterns (shouting, runs of exclamation marks, masked words, direct address) and lexicon
entries: whole words and word beginnings, found on a bounded, seeded sample of labelled rows. The
label model estimates how often each voter fires in either class and how strongly voters fire
together within a class, and turns the votes of a row into the probability of the label. A logistic
regression over words and word beginnings is trained on those probabilities and scores all rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.llm.common import fresh, quoted
from shelfcast.llm.words import distinct, slices, split_words, take_runs
from shelfcast.plans.durable import durable

TOXIC_ROWS = 4_000
CLEAN_ROWS = 8_000
VOTERS = 200
FEATURES = 600
CANDIDATES = 20_000
LEAST_ROWS = 3
LEAST_SURPRISE = 6.0
BEGINNINGS = (3, 4, 5, 6)
SEED = 11
MARK_ACCURACY = 0.97

#: Common English insults.
LEXICON = (
    "clown dimwit disgusting dumb filth garbage idiot imbecile jerk loser moron pathetic scum stupid trash vermin"
    " worthless"
).split()

#: Voters that look at the form of a text rather than at single words: name, pattern, least count.
PATTERNS = (
    ("shouting", re.compile(rb"\b[A-Z]{5,}\b"), 3),
    ("exclamations", re.compile(rb"!{2,}"), 1),
    ("masked word", re.compile(rb"\b[A-Za-z][*#@$]{2,}[A-Za-z]*"), 1),
    ("direct address", re.compile(rb"(?i)\byou(?:'re| are)? (?:a |an |all )?(?:" + "|".join(LEXICON).encode() + rb")\b"), 1),
)

_EDGES = re.compile(r"^\W+|\W+$")


def features_of(word: bytes) -> tuple[str, ...]:
    """The word without edge punctuation in lower case, and its beginnings marked with a star."""
    plain = _EDGES.sub("", word.decode()).lower()
    if len(plain) < 3:
        return ()
    return (plain, *(plain[:n] + "*" for n in BEGINNINGS if len(plain) > n))


class Seen:
    """Numbers of the known features of a word, remembered for a bounded number of words."""

    MOST = 200_000

    def __init__(self, names: Iterable[str]):
        self.number = {n: k for k, n in enumerate(names)}
        self.words: dict[bytes, tuple[int, ...]] = {}

    def of(self, word: bytes) -> tuple[int, ...]:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= self.MOST:
                self.words.clear()
            number = self.number
            found = self.words[word] = tuple(number[f] for f in features_of(word) if f in number)
        return found


def presence(texts: pa.Array, seen: Seen) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, feature), each once, for the known features that occur in each text."""
    words = split_words(texts)
    codes, entries = distinct(words.words)
    hits = [seen.of(w) for w in entries]
    counts = np.fromiter(map(len, hits), np.int64, len(hits))
    if not counts.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = np.fromiter((f for h in hits for f in h), np.int64, int(counts.sum()))
    starts = np.cumsum(counts) - counts
    some = np.flatnonzero(counts[codes])
    codes, owners = codes[some], words.owners()[some]
    lengths = counts[codes]
    pairs = np.unique(np.repeat(owners, lengths) * len(seen.number) + flat[take_runs(starts[codes], lengths)])
    return pairs // len(seen.number), pairs % len(seen.number)


def pattern_votes(texts: list[str | None]) -> np.ndarray:
    """One row per text, one column per pattern: whether it fires."""
    out = np.zeros((len(texts), len(PATTERNS)), bool)
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        for k, (_, pattern, least) in enumerate(PATTERNS):
            out[i, k] = sum(1 for _ in zip(range(least), pattern.finditer(raw))) == least
    return out


# ---- label model ------------------------------------------------------------------------------


@dataclass
class LabelModel:
    """Class share, rate of each voter in the clean and the toxic class, weight left after correlation."""

    prior: float
    clean: np.ndarray
    toxic: np.ndarray
    weight: np.ndarray
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray, given: np.ndarray | None = None) -> np.ndarray:
        """Probability of toxic; ``given`` are log odds known of each row, else those of the class share."""
        fired = np.log(self.toxic / self.clean) * self.weight
        silent = np.log((1 - self.toxic) / (1 - self.clean)) * self.weight
        base = math.log(self.prior / (1 - self.prior)) if given is None else given
        x = base + votes @ (fired - silent) + silent.sum()
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_label_model(votes: np.ndarray, first: np.ndarray, rounds: int = 15) -> tuple[LabelModel, np.ndarray]:
    """Expectation maximisation; ``first`` is what a row's own mark says of its class.

    The mark is a voter of known accuracy beside the others, so the classes can't drift to some other
    grouping of the rows, and votes can outweigh a wrong mark. A voter's log odds are divided by the
    number of voters that it amounts to: the sum of its correlations with all voters within the
    classes. These come from the residuals of the votes given the class, so voters that agree only
    because both are right keep their full weight.
    """
    votes = votes.astype(float)
    mark = np.log(first / (1 - first))
    p, model = first, None
    for _ in range(rounds):
        n1, n0 = p.sum(), (1 - p).sum()
        # Smoothed towards the voter's rate over all rows: half a row in either class.
        rate = (votes.sum(axis=0) + 0.5) / (len(votes) + 1)
        toxic = np.clip((p @ votes + 0.5 * rate) / (n1 + 0.5), 1e-4, 0.9999)
        clean = np.clip(((1 - p) @ votes + 0.5 * rate) / (n0 + 0.5), 1e-4, 0.9999)
        cov = sum(((votes - r) * w[:, None]).T @ (votes - r) for w, r in ((p, toxic), (1 - p, clean))) / len(p)
        spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        correlation = np.clip(cov / np.outer(spread, spread), 0, 1)
        np.fill_diagonal(correlation, 1)
        weight = 1 / np.where(correlation > 0.1, correlation, 0).sum(axis=1)
        model = LabelModel(float(np.clip(n1 / len(p), 0.001, 0.999)), clean, toxic, weight, correlation)
        new = np.clip(model.posterior(votes, mark), 0.001, 0.999)
        done = np.abs(new - p).max() < 1e-4
        p = new
        if done:
            break
    return model, p


def fit_linear(rows: np.ndarray, cols: np.ndarray, n_rows: int, n_cols: int, target: np.ndarray,
               penalty: float = 0.1, steps: int = 12) -> tuple[np.ndarray, float]:
    """Logistic regression on presence features with soft labels, by Newton steps.

    Both classes weigh the same in the fit. The pairs (rows, cols) are sorted by row.
    """
    w = np.zeros(n_cols + 1)
    share = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    per_row = target * (0.5 / share) + (1 - target) * (0.5 / (1 - share))
    ridge = np.append(np.full(n_cols, penalty), 1e-6)
    for _ in range(steps):
        x = np.bincount(rows, w[cols], n_rows) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(x, -40, 40)))
        err, curve = (p - target) * per_row, np.maximum(p * (1 - p), 1e-6) * per_row
        slope = np.append(np.bincount(cols, err[rows], n_cols), err.sum()) + ridge * w
        bend = np.diag(ridge)
        for at in range(0, n_rows, 1000):
            stop = min(at + 1000, n_rows)
            a, b = np.searchsorted(rows, [at, stop])
            block = np.zeros((stop - at, n_cols + 1))
            block[rows[a:b] - at, cols[a:b]] = 1
            block[:, -1] = 1
            bend += block.T @ (block * curve[at:stop, None])
        step = np.linalg.solve(bend, slope)
        w = w - step * min(1.0, 8 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


# ---- training ---------------------------------------------------------------------------------


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose crc32 of the id as text is divisible by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> DataFrame:
    """Texts of a bounded, seeded sample of the labelled rows outside the held-out fifth: text, toxic.

    Of the labels that repeat an id the largest counts, of the documents that do the text with the
    smallest hash. The sample is bounded by the two parameters, which is why the broadcast of its ids is.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("label_id")).agg(F.max("toxic").alias("toxic"))
    seeded = known.withColumn("place", F.xxhash64(F.lit(SEED), "label_id"))
    parts = [
        seeded.where(F.col("toxic") == value).orderBy("place", "label_id").limit(most)
        for value, most in ((1, toxic_rows), (0, clean_rows))
    ]
    chosen = durable(parts[0].union(parts[1]).select("label_id", "toxic"))
    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text"))
    found = rows.join(F.broadcast(chosen), "label_id").groupBy("label_id", "toxic")
    return found.agg(F.min_by("text", F.sha2("text", 256)).alias("text")).select("text", "toxic")


def _count_features(wanted: set[str] | None):
    """Task function: rows holding each feature, by label."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield count(part)

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        words = split_words(part.column("text"))
        codes, entries = distinct(words.words)
        held = [features_of(w) for w in entries]
        if wanted is not None:
            held = [tuple(f for f in h if f in wanted) for h in held]
        names = list({f for h in held for f in h})
        seen = Seen(names)
        rows, cols = presence(part.column("text"), seen) if names else (np.zeros(0, int), np.zeros(0, int))
        toxic = part.column("toxic").to_numpy(zero_copy_only=False) == 1
        yes = np.bincount(cols, toxic[rows], len(names)).astype(np.int64)
        every = np.bincount(cols, minlength=len(names)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(yes), pa.array(every - yes)], ["feature", "yes", "no"]
        )

    return work


_COUNTS = "feature string, yes long, no long"


@dataclass
class Scorer:
    """What a task needs to score texts: feature names, their weights, an intercept."""

    names: list[str]
    weights: np.ndarray
    intercept: float

    def score(self, texts: pa.Array, seen: Seen) -> np.ndarray:
        x = np.full(len(texts), self.intercept)
        if self.names:
            rows, cols = presence(texts, seen)
            x += np.bincount(rows, self.weights[cols], len(texts))
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          voters: int = VOTERS, n_features: int = FEATURES) -> Scorer:
    """Fit voters, label model and classifier. With one class only, or none, the score is a constant."""
    sample = durable(training_rows(docs, labels, id_col, text_col))
    totals = dict(sample.groupBy("toxic").count().collect())
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Scorer([], np.zeros(0), math.log((n1 + 0.5) / (n0 + 1.0)) if n1 or n0 else -1.0)

    least = min(LEAST_ROWS, max(2, n1 // 10)) if n1 > 1 else 1
    toxic = sample.where("toxic = 1").mapInArrow(_count_features(None), _COUNTS)
    common = (
        toxic.groupBy("feature").agg(F.sum("yes").alias("yes")).where(F.col("yes") >= least)
        .orderBy(F.desc("yes"), "feature").limit(CANDIDATES)
    )
    candidates = {r["feature"] for r in common.collect()} | set(LEXICON)
    counts = (
        sample.mapInArrow(_count_features(candidates), _COUNTS)
        .groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()
    )
    ranked = sorted(counts, key=lambda r: (-_evidence(r["yes"], r["no"], n1, n0), r["feature"]))
    strong = [r["feature"] for r in ranked if _surprise(r["yes"], r["no"], n1, n0) > LEAST_SURPRISE]
    lexicon = strong[:voters] + [w for w in LEXICON if w not in strong[:voters]]
    names = strong[:n_features] + [w for w in LEXICON if w not in strong[:n_features]]

    # The sample is bounded, so what is known of its rows is too.
    found = sample.mapInArrow(_describe(names), "toxic int, features array<int>, forms array<boolean>").collect()
    at = len(found)
    rows = np.repeat(np.arange(at), [len(r["features"]) for r in found])
    cols = np.array([f for r in found for f in r["features"]], np.int64)
    forms = np.array([r["forms"] for r in found], bool)
    truth = np.array([r["toxic"] for r in found])
    at_name = {n: k for k, n in enumerate(names)}
    votes = np.zeros((at, len(lexicon)), bool)
    number = np.full(len(names), -1)
    number[[at_name[w] for w in lexicon]] = np.arange(len(lexicon))
    inside = number[cols] >= 0
    votes[rows[inside], number[cols[inside]]] = True
    votes = np.concatenate([votes, forms], axis=1)
    mark = np.where(truth == 1, MARK_ACCURACY, 1 - MARK_ACCURACY)
    _, posterior = fit_label_model(votes, mark)
    weights, intercept = fit_linear(rows, cols, at, len(names), posterior)
    return Scorer(names, weights, intercept)


def _evidence(yes: int, no: int, n1: int, n0: int) -> float:
    """Log odds of a feature with a pull to zero, times the root of its toxic rows."""
    odds = math.log((yes + 0.5) / (n1 + 1)) - math.log((no + 0.5) / (n0 + 1))
    return odds * math.sqrt(yes)


def _surprise(yes: int, no: int, n1: int, n0: int) -> float:
    """Likelihood ratio statistic of a feature that toxic rows have more often; 0 for all others."""
    if yes * n0 <= 3 * no * n1:
        return 0.0
    total = 0.0
    for seen, rows in ((yes, n1), (no, n0)):
        rate = (yes + no) / (n1 + n0)
        for k, share in ((seen, rate), (rows - seen, 1 - rate)):
            total += 2 * k * math.log(k / (rows * share)) if k else 0.0
    return total


def _describe(names: list[str]):
    """Task function: label, known features and pattern votes of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(names)
        for batch in batches:
            for part in slices(batch, "text"):
                rows, cols = presence(part.column("text"), seen)
                ends = np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32)
                forms = pattern_votes(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("toxic"),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(cols.astype(np.int32))),
                        pa.array(forms.tolist(), pa.list_(pa.bool_())),
                    ],
                    ["toxic", "features", "forms"],
                )

    return work


def with_score(docs: DataFrame, scorer: Scorer, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each text in 0 to 1; null counts as empty.

    The columns have plain names on their way through Python, so any name of theirs comes back.
    """
    kept = [f for f in docs.schema.fields if f.name != name]
    text = f"c{[f.name for f in kept].index(text_col)}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(scorer.names)
        for batch in batches:
            for part in slices(batch, text):
                found = pa.array(scorer.score(part.column(text), seen))
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, "found"])

    plain = [T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(kept)]
    rows = docs.select(*[F.col(quoted(f.name)).alias(p.name) for f, p in zip(kept, plain)])
    scored = rows.mapInArrow(work, T.StructType([*plain, T.StructField("found", T.DoubleType())]))
    return scored.toDF(*[f.name for f in kept], name)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted (1 from a score of 0.5)."""
    scorer = train(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"))
    found = with_score(rows, scorer)
    return found.select(
        id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not call toxic, with the same columns."""
    name = fresh("score", docs.columns)
    return with_score(docs, train(docs, labels, id_col, text_col), text_col, name).where(F.col(name) < 0.5).select(*map(quoted, docs.columns))
