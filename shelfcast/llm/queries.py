"""Registered queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import (
    clustering, decontamination, divergence, exact_dedup, license_scan, line_dedup, minhash, mixing, packing, simhash, token_counts,
    toxicity, url_filter,
)
from shelfcast.llm.common import read
from shelfcast.llm.register import query


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file; every executor has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query(
    "op4_exact_dedup",
    """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
""",
)
def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.membership(read(spark, folder, "documents"), keep="largest")


@query("op7_simhash_near_dedup")
def op7_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, folder, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))


@query("op3_mixing")
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, F.array("source"), mixing.word_count())
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(read(spark, folder, "documents"), read(spark, folder, "labels"))


#: Rules of the URL filter: verdict, host and path.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def _rules_sql(result: int) -> str:
    cases = []
    for rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        at, start = rule[1].split("/", 1)
        cases.append(f"WHEN (host = '{at}' OR suffix(host, '.{at}')) AND starts_with(path, '/{start}') THEN '{rule[result]}'")
    return "CASE " + " ".join(cases) + " END"


_TWO = ", ".join(f"'{s}'" for s in url_filter.TWO_PART)


def _strength_sql(level: str) -> str:
    """One row: size of the beta prior of a level, by the moments of the beta-binomial."""
    return f"""
(SELECT round(1 / least(greatest(CASE WHEN k > 1 AND b > 0 AND b < n AND n - q / n - (k - 1) > 0
   THEN ((w - n * (b / n) * (b / n)) - (k - 1) * (b / n) * (1 - b / n)) / ((n - q / n - (k - 1)) * (b / n) * (1 - b / n))
   ELSE {url_filter.RHO} END, {url_filter.LEAST_RHO}), {url_filter.MOST_RHO}) - 1, 6)
 FROM (SELECT count(*) AS k, sum(seen)::DOUBLE AS n, sum(bad)::DOUBLE AS b, sum(seen::DOUBLE * seen) AS q,
              sum(bad::DOUBLE * bad / seen) AS w FROM {level} WHERE seen > 0))"""


@query(
    "op1_url_filter",
    f"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                            '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
lab AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad
        FROM labels WHERE doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL) GROUP BY doc_id),
hosts AS (
  SELECT host, sum(CASE WHEN bad = 1 THEN 1 ELSE 0 END) AS bad, sum(CASE WHEN bad IS NOT NULL THEN 1 ELSE 0 END) AS seen,
         CASE WHEN list_contains([{_TWO}], array_to_string(string_split(host, '.')[-2:], '.'))
              THEN array_to_string(string_split(host, '.')[-3:], '.')
              ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain,
         CASE WHEN list_contains([{_TWO}], array_to_string(string_split(host, '.')[-2:], '.'))
              THEN array_to_string(string_split(host, '.')[-2:], '.')
              ELSE array_to_string(string_split(host, '.')[-1:], '.') END AS suf
  FROM p LEFT JOIN lab
    ON lab.doc_id = TRY_CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:[.][A-Za-z]+|/)?$', 1), '') AS BIGINT)
  GROUP BY host),
domains AS (SELECT domain, suf, sum(bad) AS bad, sum(seen) AS seen FROM hosts GROUP BY domain, suf),
sufs AS (SELECT suf, sum(bad) AS bad, sum(seen) AS seen FROM domains GROUP BY suf),
s AS (SELECT {_strength_sql('sufs')} AS ss, {_strength_sql('domains')} AS sd, {_strength_sql('hosts')} AS sh,
             (SELECT (sum(bad) + 0.5::DOUBLE) / (sum(seen) + 1.0::DOUBLE) FROM sufs) AS overall),
tops AS (SELECT suf, (bad + ss * overall) / (seen + ss) AS top FROM sufs, s),
mids AS (SELECT domain, (bad + sd * top) / (seen + sd) AS mid FROM domains JOIN tops USING (suf), s),
rated AS (SELECT host, (bad + sh * mid) / (seen + sh) AS rate, seen + sh AS total FROM hosts JOIN mids USING (domain), s)
SELECT page_id, host, path, {_rules_sql(1)} AS rule,
       coalesce({_rules_sql(0)},
         CASE WHEN rate - {url_filter.DEVIATIONS} * sqrt(rate * (1 - rate) / (total + 1)) > {url_filter.MOST_BAD}
              THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN rated USING (host)
""",
)
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """A page's outcome is the label of the document whose number ends its path: bad if toxic or of low quality."""
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    labels = read(spark, folder, "labels").where("toxic is not null or quality is not null")
    outcomes = labels.select(F.col("doc_id").alias("key"), bad.cast("int").alias("bad"))
    found = url_filter.judge(read(spark, folder, "pages"), outcomes, RULES, key=url_filter.last_number)
    return found.select("page_id", "host", "path", "rule", "verdict")


@query(
    "op8_line_dedup",
    f"""
WITH l AS (
  SELECT doc_id, md5(coalesce(text, '')) AS doc, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
c AS (
  SELECT DISTINCT doc_id, doc, i, n, array_to_string(ls[i:i + n - 1], chr(10)) AS body
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM l), (SELECT unnest([1, 2]) AS n)
  WHERE i + n <= len(ls) + 1 AND CASE n
    WHEN 1 THEN regexp_matches(ls[i], '^\\s*(?:\\S+\\s+){{{line_dedup.LEAST_WORDS - 1}}}\\S')
    ELSE regexp_matches(ls[i] || ls[i + 1], '[^\x20\x09-\x0D]') END),
r AS (
  SELECT *, count(*) OVER (PARTITION BY n, body) AS times,
         row_number() OVER (PARTITION BY n, body ORDER BY doc_id NULLS FIRST, doc, i) AS place FROM c),
m AS (SELECT doc_id, doc, unnest(range(i, i + n)) AS line, place = 1 AS is_first FROM r WHERE times > 1),
g AS (
  SELECT doc_id, doc, list(line) AS gone
  FROM (SELECT doc_id, doc, line FROM m GROUP BY doc_id, doc, line HAVING NOT bool_or(is_first)) GROUP BY doc_id, doc)
SELECT l.doc_id, len(ls)::BIGINT AS lines, CASE WHEN text IS NULL THEN 0 ELSE coalesce(len(gone), 0) END::BIGINT AS removed_lines,
       sha256(coalesce(array_to_string(list_transform(
         list_filter(range(1, len(ls) + 1), lambda i: gone IS NULL OR NOT list_contains(gone, i)), lambda i: ls[i]), chr(10)), ''))
         AS text_sha256
FROM l LEFT JOIN g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.doc = g.doc
""",
)
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup.deduplicate(read(spark, folder, "documents").select("doc_id", "text"), total="lines")
    return cleaned.select("doc_id", "lines", "removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, folder, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op10_license_scan")
def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Notices of under five words have a column of their own, so "All rights reserved" counts as no license."""
    templates = license_scan.TEMPLATES | license_scan.full_texts() | license_scan.SHORT_TEMPLATES
    found = license_scan.scan(read(spark, folder, "documents"), templates)
    is_short = lambda n: n["license"].isin(*license_scan.SHORT_TEMPLATES)
    split = found.select(
        "doc_id", F.filter("notices", lambda n: ~is_short(n)).alias("notices"), F.filter("notices", is_short).alias("short")
    )
    return split.select(
        "doc_id",
        F.size("notices").alias("n_licenses"),
        F.array_join(F.transform("notices", lambda n: n["license"]), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("notices", lambda n: n["containment"])), F.lit(0.0)).alias("containment"),
        F.array_min(F.transform("notices", lambda n: n["first_word"])).alias("first_word"),
        F.array_join(F.transform("short", lambda n: n["license"]), ",").alias("short_notices"),
    )


@query("op5_minhash_fingerprints")
def op5_minhash_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.with_next(read(spark, folder, "documents"))


_LOWER = f"'{url_filter.UPPER}', '{url_filter.LOWER}'"
_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


@query(
    "op11_decontamination",
    f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), {_WORDS}) AS ws FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), {_WORDS}) AS ws FROM benchmark),
g AS (
  SELECT DISTINCT item, least(len(ws), {decontamination.WINDOW}) AS n, unnest(list_transform(
           range(1, greatest(len(ws) - {decontamination.WINDOW} + 2, 2)),
           lambda i: array_to_string(ws[i:i + {decontamination.WINDOW} - 1], ' '))) AS w
  FROM b WHERE len(ws) > 0),
o AS (
  SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(ws) >= n)),
m AS (SELECT r, o.n, i, item FROM o JOIN g ON o.w = g.w AND o.n = g.n),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
""",
)
def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.scan(docs, read(spark, folder, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_TERMS = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"


def _level_sql(times: str, mass: str) -> str:
    return f"1 + ({divergence.UNIT}::HUGEINT * ({times} + 2)) // ({mass} + 2 * v)"


@query(
    "op12_divergence_audit",
    f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), {_TERMS}) AS ws FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
u AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
kept AS (
  SELECT lang, term, count(*) AS total FROM u GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(total) AS mass FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS times FROM u JOIN kept USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(times) AS mass FROM c GROUP BY ALL),
p AS (
  SELECT lang, source, term, coalesce(times, 0) AS times, {_level_sql('coalesce(times, 0)', 'coalesce(n.mass, 0)')} AS p
  FROM g JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
pairs AS (
  SELECT g.lang, g.source, o.source AS item, coalesce(value, 0) AS value
  FROM g JOIN g AS o ON g.lang = o.lang AND g.source <> o.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS other, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
             FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL) AS s
    ON s.lang = g.lang AND s.source = g.source AND s.other = o.source),
terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value
  FROM p JOIN (SELECT lang, term, {_level_sql('total', 'mass')} AS q FROM kept JOIN langs USING (lang)) USING (lang, term)
  WHERE times > 0 AND p > q),
parts AS (
  SELECT *, 'pair' AS part FROM pairs UNION ALL SELECT *, 'term' FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}
""",
)
def op12_divergence_audit(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(read(spark, folder, "documents"))


def _rounds_sql() -> str:
    steps = []
    for k in range(clustering.ROUNDS + 1):
        steps.append(f"""
a{k} AS (
  SELECT r, min(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {clustering.CENTROIDS} + no) AS best
  FROM x, k{k} GROUP BY r)""")
        if k < clustering.ROUNDS:
            steps.append(f"""
m{k} AS (
  SELECT no, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
  FROM (SELECT no, i, sum(y) AS s, count(*) AS n
        FROM (SELECT (best % {clustering.CENTROIDS})::INTEGER AS no, unnest(v) AS y, unnest(range(1, len(v) + 1)) AS i
              FROM x JOIN a{k} USING (r)) GROUP BY no, i) GROUP BY no),
k{k + 1} AS (SELECT k.no, coalesce(m.c, k.c) AS c FROM k{k} AS k LEFT JOIN m{k} AS m USING (no))""")
    return ",".join(steps)


@query(
    "op13_centroid_clustering",
    f"""
WITH x AS (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda e: floor({clustering.SCALE} * e::DOUBLE)::HUGEINT) AS v
  FROM embeddings WHERE len(embedding) = {clustering.DIMENSIONS}
    AND len(list_filter(embedding, lambda e: isfinite(e) AND abs(floor({clustering.SCALE} * e::DOUBLE)) <= {clustering.MOST}))
        = {clustering.DIMENSIONS}),
k0 AS (
  SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS no, v AS c
  FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM x ORDER BY h, v LIMIT {clustering.CENTROIDS})),
{_rounds_sql().strip()},
f AS (
  SELECT vec_id, (best % {clustering.CENTROIDS})::INTEGER AS cluster, (best // {clustering.CENTROIDS})::BIGINT AS distance
  FROM x JOIN a{clustering.ROUNDS} USING (r))
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM f JOIN k{clustering.ROUNDS} ON cluster = no
""",
)
def op13_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.cluster(read(spark, folder, "embeddings"))
