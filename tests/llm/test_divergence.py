import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
COLUMNS = "doc_id long, text string, lang string, source string"


def brute(rows, least=10, top=10):
    """Rows of the audit from (doc_id, text, lang, source)."""
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        seen[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        v = len(kept)

        def levels(count):
            mass = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 2) // (mass + 2 * v) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        whole = levels(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: levels(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, -value, k + 1) for k, (value, _, o) in enumerate(sorted(pairs))]
            terms = [(-f(p[s][t], whole[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            out += [(lang, s, "term", t, -value, k + 1) for k, (value, _, t) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def audited(df, **options):
    return sorted(tuple(r) for r in divergence.audit(df, **options).collect())


def some_rows(n, sources, seed=7):
    """Words of very unequal frequency; one source holds a third of all rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [f"w{'abcdefghij'[k % 10] * (1 + k // 10)}" for k in (rng.pareto(0.8, rng.integers(0, 40)) * 3).astype(int) % 60]
        rows.append((i, " ".join(words), ("en", "de")[i % 2], "s0" if i % 3 == 0 else f"s{rng.integers(sources)}"))
    return rows


def test_brute_force(spark):
    rows = some_rows(600, 7)
    assert audited(spark.createDataFrame(rows, COLUMNS).repartition(5)) == brute(rows)


@pytest.mark.parametrize(("terms", "sources", "columns"), [(5, 3, 4), (1, 1, 8), (2048, 2, 3)])
def test_blocks(spark, monkeypatch, terms, sources, columns):
    """Many blocks of terms, sources and columns give the same sums."""
    monkeypatch.setattr(divergence, "TERMS_PER_BLOCK", terms)
    rows = some_rows(200, 7)
    found = divergence.audit(spark.createDataFrame(rows, COLUMNS))
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)
    levels = np.random.default_rng(1).integers(1, 9, (50, 11)) ** 9
    expected = np.array([[divergence.price(levels[:, a], levels[:, b]).sum() * (a < b) for b in range(11)] for a in range(11)])
    monkeypatch.setattr(divergence, "MOST_COLUMNS", columns)
    monkeypatch.setattr(divergence, "COLUMNS_AT_ONCE", columns)
    every = np.arange(11)
    assert (divergence.priced_tables(levels, every, every) == expected).all()
    left, right = every[every // sources == 0], every[every // sources == 1]
    part = divergence.priced_tables(levels, left, right)
    assert (part[np.ix_(left, right)] == expected[np.ix_(left, right)]).all()


def test_more_sources_than_a_block(spark):
    rows = [(i, "alpha beta" if i % 5 else "alpha gamma gamma", "en", f"s{i % 300}") for i in range(900)]
    assert audited(spark.createDataFrame(rows, COLUMNS)) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (2, "", "", ""), (3, "x", "en", None), (None, "x X x", "en", "a"), (4, "Ä ä Ⅷ", "en", "b"), (4, "Ä ä Ⅷ", "en", "b"),
        (5, "lone", "xx", "only"), (6, "y " * 60_000 + "z" * 130_000, "en", "long"), *[(10 + i, "x ä tie tied", "en", "ab"[i % 2]) for i in range(12)]]
    df = spark.createDataFrame(rows, COLUMNS)
    assert audited(df) == brute(rows)
    assert audited(df, least_docs=1) == brute(rows, least=1)
    assert audited(df, least_docs=100) == brute(rows, least=100)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], COLUMNS)
    assert audited(df) == []
    rows = some_rows(60, 3)
    more = spark.createDataFrame(rows, COLUMNS)
    for name in ("term", "Parts", "a.b", "value", "total"):
        more = more.withColumn(name, F.lit(None).cast("int"))
    assert audited(more) == brute(rows)


def test_levels_are_exact_for_huge_counts(spark):
    row = spark.createDataFrame([(10**11, 3 * 10**11, 10**6)], "times long, mass long, terms long")
    p = divergence._with_level(row, "p", "times", "mass", "terms").first()["p"]
    assert p == 1 + 10**9 * (10**11 + 2) // (3 * 10**11 + 2 * 10**6)
