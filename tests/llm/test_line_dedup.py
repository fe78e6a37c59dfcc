import hashlib

from pyspark.sql import functions as F

from shelfcast.llm import line_dedup as ld
from tests.llm.conftest import ODD


def brute(rows):
    """Texts and lines removed: all pairs of neighbouring lines and all lines of ten words, by their bytes."""
    def keys(t):
        lines = (t or "").split("\n")
        for i, line in enumerate(lines):
            if len(line.split()) >= ld.LEAST_WORDS:
                yield i, 1, line
            if i + 1 < len(lines) and (pair := f"{line}\n{lines[i + 1]}").strip(" \t\n\x0b\x0c\r"):
                yield i, 2, pair

    def at(i, t, s):
        return (i is not None, i or 0), hashlib.md5((t or "").encode()).digest(), s

    seen = {}
    for i, t in rows:
        for s, _, body in keys(t):
            seen.setdefault(body, set()).add(at(i, t, s))
    smallest = {body: min(places) for body, places in seen.items()}
    out = []
    for i, t in rows:
        first, later = set(), set()
        for s, n, body in keys(t):
            if len(seen[body]) > 1:
                (first if smallest[body] == at(i, t, s) else later).update(range(s, s + n))
        gone = later - first
        kept = [x for k, x in enumerate((t or "").split("\n")) if k not in gone]
        out.append((i, t if t is None else "\n".join(kept), len(gone) if t is not None else 0))
    return sorted(out, key=str)


def run(docs, **options):
    found = ld.deduplicate(docs, **options).collect()
    return sorted(((r["doc_id"], r["text"], r["removed_lines"]) for r in found), key=str)


PASSAGE = [f"This is line {k} of a passage that many documents share." for k in range(12)]


def shared():
    rows = []
    for i in range(30):
        own = [f"document {i} line {k}" for k in range(7)]
        rows.append((i, "\n".join([*own[: i % 7], *PASSAGE, *own[i % 7 :]])))
    return rows


def test_equals_brute_force(make_docs):
    rows = shared() + [(100 + k, t) for k, (_, t) in enumerate(ODD)] + ODD + [(200, "a\n\n\n\n\nb"), (201, "a\n\n\n\n\nb")]
    rows += [(300, "\n".join("aaaabab")), (301, "\n".join("xabay")), (301, "\n".join("baby"))]
    rows += [(400, "tie " * 12), (400, "tie " * 12), (401, "long line\n" * 20_000)]
    assert run(make_docs(rows)) == brute(rows)


def test_whole_passages_and_long_lines_go(make_docs):
    long = "a single line of more than ten words that two of the texts share"
    for i, text, gone in run(make_docs([*shared(), (50, f"one\n{long}\ntwo"), (51, f"three\n{long}")])):
        if i < 30:
            assert gone == (12 if i else 0) and sum(line in text for line in PASSAGE) == (0 if i else 12)
        else:
            assert (gone, long in text) == ((0, True) if i == 50 else (1, False))


def test_short_repeated_lines_and_distinct_texts_stay(make_docs):
    rows = [(i, f"same line here\nonly {i}") for i in range(10)] + [(10, "alone")]
    assert [(i, t) for i, t, _ in run(make_docs(rows))] == sorted(rows, key=str)


def test_sparse_chunks_find_a_part(make_docs):
    every, half = (sum(n for _, _, n in run(make_docs(shared()), mean=m, least_words=100)) for m in (1, 2))
    assert 0 < half < every == 29 * 12


def test_a_third_of_all_rows_share_a_line(make_docs):
    hot = "this very common line is in a third of all rows here"
    rows = [(i, f"a{i}\n{hot}\nb{i}" if i % 3 == 0 else f"c{i}\nd{i}") for i in range(3000)]
    assert sum(n for _, _, n in run(make_docs(rows).repartition(8))) == 999


def test_clashing_dotted_columns_string_ids_and_empty_table(make_docs, no_docs):
    docs = make_docs(shared()[:2])
    for name in ("Spots", "cut", "a.b", "id", "doc", "Removed_Lines"):
        docs = docs.withColumn(name, F.lit(1))
    found = ld.deduplicate(docs, total="all lines")
    assert found.columns == [*docs.columns[:-1], "removed_lines", "all lines"]
    assert sorted((r["removed_lines"], r["all lines"]) for r in found.collect()) == [(0, 19), (12, 19)]
    named = docs.withColumn("doc_id", F.concat(F.lit("x"), "doc_id"))
    assert sorted(r["removed_lines"] for r in ld.deduplicate(named).collect()) == [0, 12]
    assert ld.deduplicate(no_docs).count() == 0


def test_no_python_in_the_plan(make_docs):
    plan = ld.deduplicate(make_docs(shared()))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
