import math

import pytest
from pyspark.sql import functions as F

from shelfcast.llm import url_filter as uf
from shelfcast.llm.queries import RULES

URLS = [
    (1, "http://A.Example.ORG/es/5?x#y"), (2, "https://example.org/en/12.html"), (3, "https://www.example.org/en/2"),
    (4, "http://b.com/fr/1#t"), (5, "http://b.com/de/1"), (6, "http://xcom/de/1"), (7, "http://com/de/"), (8, None),
    (9, "no scheme"), (10, ""), (11, "ftp://h.net?x=http://org/"), (12, "http://org"), (13, "a://b://c.org/x"),
    (14, "http://b.com:80/de/1"), (15, "HTTP://ÄB.ORG/"), (16, "://org/es/"), (16, "://org/es/"), (None, "http://h.net/7/"),
    (17, "x\ny://org/\nz"),
]


def brute(url):
    """Host, path and the rule that fits, written out by hand."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [
        (len(r), r, v) for v, r in RULES
        for at, start in [(r.split("/")[0], "/" + r.split("/", 1)[1])]
        if (host == at or host.endswith("." + at)) and path.startswith(start)
    ]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def pages(spark, rows):
    return spark.createDataFrame([(*r, "<p>") for r in rows], "page_id long, url string, html string")


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "key long, bad int")


def test_hosts_paths_and_rules(spark):
    found = uf.judge(pages(spark, URLS).withColumn("host", F.lit(1)), outcomes(spark, []), RULES, key=uf.last_number).collect()
    want = sorted(((i, *brute(u)[:3], brute(u)[3] or "allow") for i, u in URLS), key=str)
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found), key=str) == want


def test_last_number(spark):
    paths = ["/en/12.html", "/7/", "/7", "/7x", "/", "", "/a/123456789012345678901", "/x12"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(uf.last_number(F.col("p")).alias("n")).collect()
    assert [r["n"] for r in rows] == [12, 7, 7, None, None, None, None, None]


def strength(groups):
    """Moments of the beta-binomial over (bad, seen)."""
    groups = [(b, n) for b, n in groups if n]
    k, total, bad = len(groups), sum(n for _, n in groups), sum(b for b, _ in groups)
    rho = uf.RHO
    if k > 1 and 0 < bad < total:
        m = bad / total
        between = sum(n * (b / n - m) ** 2 for b, n in groups)
        rho = (between - (k - 1) * m * (1 - m)) / ((total - sum(n * n for _, n in groups) / total - (k - 1)) * m * (1 - m))
    return 1 / min(max(rho, uf.LEAST_RHO), uf.MOST_RHO) - 1


def test_reputation_is_shrunk_along_the_chain(spark):
    hosts = {"a.x.com": (9, 10), "b.x.com": (1, 10), "y.net": (0, 30), "z.y.net": (5, 6), "new.x.com": (0, 0), "q.co.uk": (2, 3), "p.q.co.uk": (0, 2)}
    domain = {"a.x.com": "x.com", "b.x.com": "x.com", "y.net": "y.net", "z.y.net": "y.net", "new.x.com": "x.com", "q.co.uk": "q.co.uk", "p.q.co.uk": "q.co.uk"}
    suffix = {"x.com": "com", "y.net": "net", "q.co.uk": "co.uk"}
    rows = spark.createDataFrame([(h, *v) for h, v in hosts.items()], "host string, bad long, seen long")
    got = {r["host"]: r for r in uf.reputation(rows).collect()}
    by_domain = {d: tuple(map(sum, zip(*(hosts[h] for h in hosts if domain[h] == d)))) for d in suffix}
    by_suffix = {s: by_domain[d] for d, s in suffix.items()}
    bad, seen = map(sum, zip(*hosts.values()))
    sh, sd, ss = strength(hosts.values()), strength(by_domain.values()), strength(by_suffix.values())
    for h, (b, n) in hosts.items():
        d = domain[h]
        top = (by_suffix[suffix[d]][0] + ss * (bad + 0.5) / (seen + 1)) / (by_suffix[suffix[d]][1] + ss)
        middle = (by_domain[d][0] + sd * top) / (by_domain[d][1] + sd)
        rate = (b + sh * middle) / (n + sh)
        assert got[h]["rate"] == pytest.approx(rate, rel=1e-5)
        assert got[h]["bound"] == pytest.approx(rate - 1.645 * math.sqrt(rate * (1 - rate) / (n + sh + 1)), rel=1e-4)


def test_bad_hosts_are_blocked_and_others_stay(spark):
    rows = [(i, f"http://bad.net/{i}") for i in range(40)] + [(i, f"http://good.net/{i}") for i in range(40, 80)]
    rows += [(80, "http://good.net/80"), (81, "http://bad.net/none"), (82, "http://other.io/none")]
    marks = [(i, int(i < 40)) for i in range(80)] + [(0, 0), (None, 1), (3, None)]
    found = {r["page_id"]: r["verdict"] for r in uf.judge(pages(spark, rows), outcomes(spark, marks), (), key=uf.last_number).collect()}
    assert {i for i, v in found.items() if v == "block"} == {*range(40), 81}


def test_empty_table(spark):
    assert uf.judge(pages(spark, []), outcomes(spark, [(1, 1)]), RULES, key=uf.last_number).count() == 0
