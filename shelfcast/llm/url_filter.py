"""URL filter by empirical-Bayes host reputation.

Labelled pages give each host counts of bad and all outcomes. A host's rate is shrunk towards its
registered domain, the domain's towards its suffix, the suffix's towards the whole table, each time
by a beta-binomial prior whose strength is fitted to how much the rates of that level differ. A
host is blocked when even the lower bound of its posterior bad rate is over a limit. Fixed rules go
first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.plans.durable import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Most bad pages that a host may be sure to have, and the standard deviations that make sure.
MOST_BAD = 0.5
DEVIATIONS = 1.645

#: Second-level suffixes under which names are registered.
TWO_PART = ("ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")

#: Spread of rates within a level where the data can't tell it, and its bounds.
RHO, LEAST_RHO, MOST_RHO = 0.05, 0.001, 0.999


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A to Z in lower case; empty for null or no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_PART), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The suffix and one label before it; the host itself if it has no more."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_PART), F.substring_index(host, ".", -3)).otherwise(two)


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule string and verdict of the longest rule that fits, null for none.

    Rules are (verdict, "host/path"). Of equally long rules the first in order of code points wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        at, start = text.split("/", 1)[0], "/" + text.split("/", 1)[1]
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def strength(groups: DataFrame) -> float:
    """Size of the beta prior that fits the spread of rates over ``groups`` (bad, seen): moments of the beta-binomial."""
    some = groups.where("seen > 0")
    k, n, bad, squares, weighted = some.agg(
        F.count(F.lit(1)),
        F.sum("seen"),
        F.sum("bad"),
        F.sum(F.col("seen").cast("double") * F.col("seen")),
        F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("seen")),
    ).first()
    rho = RHO
    if k and k > 1 and 0 < bad < n:
        mean = bad / n
        free = n - squares / n - (k - 1)
        if free > 0:
            rho = ((weighted - n * mean * mean) - (k - 1) * mean * (1 - mean)) / (free * mean * (1 - mean))
    return round(1 / min(max(rho, LEAST_RHO), MOST_RHO) - 1, 6)


def reputation(hosts: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """host, bad, seen, rate (posterior mean) and bound (lower) for rows (host, bad, seen), one per host.

    Hosts without labels get what their domain, suffix or the whole table says. Without any label
    every rate is one half and every bound lies below it.
    """
    named = hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "bad", "seen")
    domains = durable(named.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("seen").alias("seen")))
    suffixes = durable(domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("seen").alias("seen")))
    bad, seen = suffixes.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("seen"), F.lit(0))).first()
    overall = (bad + 0.5) / (seen + 1.0)
    s_suffix, s_domain, s_host = strength(suffixes), strength(domains), strength(hosts)

    def shrunk(parent: Column, size: float) -> Column:
        return (F.col("bad") + F.lit(size) * parent) / (F.col("seen") + F.lit(size))

    tops = suffixes.select("suffix", shrunk(F.lit(overall), s_suffix).alias("top"))
    middles = domains.join(tops, "suffix").select("domain", shrunk(F.col("top"), s_domain).alias("middle"))
    total = F.col("seen") + F.lit(s_host)
    rate = shrunk(F.col("middle"), s_host)
    return (
        named.join(middles, "domain")
        .select("host", "bad", "seen", rate.alias("rate"), F.sqrt(rate * (1 - rate) / (total + 1)).alias("spread"))
        .select("host", "bad", "seen", "rate", (F.col("rate") - F.lit(deviations) * F.col("spread")).alias("bound"))
    )


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id",
          url_col: str = "url", key=None, most_bad: float = MOST_BAD) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, host_rate, host_bound.

    ``outcomes`` has (key, bad) with bad 0 or 1; ``key`` is a function of the path column that finds
    the key of a page's label. Labels that repeat a key count once, as bad if one of them is; null
    keys and null outcomes are no labels. Empty hosts are one host. An empty table gives no rows.
    """
    url = F.col(url_col)
    parsed = pages.select(F.col(id_col).alias(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    known = outcomes.where("key is not null and bad is not null").groupBy("key").agg(F.max("bad").alias("bad"))
    # Pages are summed by host and key first: a hot host costs one row per task and key.
    sums = parsed.groupBy("host", key(F.col("path")).alias("key")).agg(F.count(F.lit(1)).alias("pages"))
    labelled = sums.join(known, "key", "left")
    hosts = durable(
        labelled.groupBy("host").agg(
            F.sum(F.when(F.col("bad") == 1, F.col("pages")).otherwise(0)).alias("bad"),
            F.sum(F.when(F.col("bad").isNotNull(), F.col("pages")).otherwise(0)).alias("seen"),
        )
    )
    rated = durable(reputation(hosts))
    rule, fixed = rule_columns(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bound") > most_bad, F.lit("block")).otherwise(F.lit("allow"))
    return parsed.join(rated, "host").select(
        id_col, "host", "path", rule.alias("rule"), F.coalesce(fixed, method).alias("verdict"),
        F.col("rate").alias("host_rate"), F.col("bound").alias("host_bound"),
    )


def last_number(path: Column) -> Column:
    """The number that ends a path, before a file ending or a slash; null if there is none."""
    digits = F.regexp_extract(path, r"/([0-9]{1,18})(?:\.[A-Za-z]+|/)?$", 1)
    return F.when(digits != "", digits.cast("long"))
