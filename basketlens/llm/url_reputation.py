"""Empirical-Bayes host reputation for URLs, with explicit rules before it.

Labelled page outcomes (bad or not) are counted per host. Beta-binomial priors pass down from all
pages to suffix, registered domain and host; each level's precision comes from the spread of its
members' rates (moments). A host is blocked when the lower bound of its posterior bad rate, mean
less ``z`` standard deviations, exceeds ``block_above``. Hosts without outcomes get their domain's
mean. A null url, or one without ``://``, has an empty host and path. All of it is DataFrame
operations: hosts are counted before anything is joined, so a hot host costs one row per task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_PAGES = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "co.kr", "co.in", "co.th", "or.th", "go.th", "ac.th", "com.br", "com.mx", "com.cn", "com.tr", "co.za")


@dataclass(frozen=True)
class UrlRule:
    """Allows or blocks a host and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rules_of(verdicts: list[tuple[str, str]]) -> list[UrlRule]:
    """Rules from (verdict, ``host/path``) pairs."""
    return [UrlRule(v, *(lambda h, _, p: (h, "/" + p))(*r.partition("/"))) for v, r in verdicts]


def host_and_path(url: str) -> tuple[Column, Column]:
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(u)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_columns(rules: list[UrlRule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    null = F.lit(None).cast("string")
    return (null if name is None else name), (null if verdict is None else verdict)


def _levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    long = two.isin(*TWO_LABEL_SUFFIXES)
    address = bare.rlike(r"^[0-9]+([.][0-9]+){3}$")
    suffix = F.when(address, "ip").when(long, two).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(address, bare).when(long, F.substring_index(bare, ".", -3)).otherwise(two)
    return domain, suffix


def _precision(members: DataFrame, parent: str, name: str) -> DataFrame:
    """One row: the precision of the Beta prior that members' (n, k) show around their parents' means.

    Their spread beyond what chance gives, as a share of the largest possible; a prior counts for
    LEAST_PAGES pages at least and 999 at most.
    """
    m, p = F.col(parent), F.col("k") / F.col("n")
    sums = members.where("n > 0").agg(
        F.sum(F.col("n") * (p - m) * (p - m)).alias("seen"), F.sum(m * (1 - m)).alias("chance"), F.sum(F.col("n") * m * (1 - m)).alias("most")
    )
    rho = F.coalesce(F.try_divide(F.col("seen") - F.col("chance"), F.col("most") - F.col("chance")), F.lit(0.001))
    rho = F.greatest(F.lit(0.001), F.least(F.lit(1.0 / (1 + LEAST_PAGES)), rho))
    return sums.select(((1 - rho) / rho).alias(name))


def reputations(hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """hosts (host, n, k) with posterior mean and lower bound of the bad rate.

    An empty table gives an empty table. Without any outcome the overall mean is taken as 0.5.
    """
    domain, suffix = _levels(F.col("host"))
    hosts = hosts.select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k"), domain.alias("domain"), suffix.alias("suffix"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    overall = suffixes.agg(F.coalesce(F.try_divide(F.sum("k").cast("double"), F.sum("n").cast("double")), F.lit(0.5)).alias("mean0"))
    shrunk = lambda mean, m: (F.col("k") + F.col(m) * F.col(mean)) / (F.col("n") + F.col(m))
    one = lambda df: F.broadcast(df)  # noqa: E731  an aggregate without keys: one row
    suffixes = suffixes.crossJoin(one(overall))
    s = suffixes.crossJoin(one(_precision(suffixes, "mean0", "m_s"))).select("suffix", shrunk("mean0", "m_s").alias("mean_s"))
    domains = domains.join(s, "suffix")
    d = domains.crossJoin(one(_precision(domains, "mean_s", "m_d"))).select("domain", "suffix", shrunk("mean_s", "m_d").alias("mean_d"))
    hosts = hosts.join(d, ["domain", "suffix"])
    h = hosts.crossJoin(one(_precision(hosts, "mean_d", "m_h")))
    a, b = F.col("k") + F.col("m_h") * F.col("mean_d"), F.col("n") - F.col("k") + F.col("m_h") * (1 - F.col("mean_d"))
    mean, var = a / (a + b), a * b / ((a + b) * (a + b) * (a + b + 1))
    return h.select("host", "domain", "suffix", "n", "k", mean.alias("bad_rate"), (mean - z * F.sqrt(var)).alias("bad_rate_low"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[UrlRule], url: str = "url", key: str = "page_id", z: float = 1.645, block_above: float = 0.5) -> DataFrame:
    """key, host, path, rule and verdict of every page.

    outcomes: (key, bad 0/1), any number of rows per page; null outcomes are left out.
    """
    host, path = host_and_path(url)
    df = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    seen = outcomes.where("bad is not null").groupBy(key).agg(F.count("*").alias("n"), F.sum("bad").alias("k"))
    hosts = df.join(seen, key, "left").groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    bad = reputations(hosts, z).where((F.col("bad_rate_low") > block_above) & (F.col("host") != "")).select("host", F.lit(True).alias("bad"))
    name, verdict = rule_columns(rules, F.col("host"), F.col("path"))
    return df.join(bad, "host", "left").select(key, "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))
