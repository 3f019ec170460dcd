"""URL filter by rules and by empirical-Bayes host reputation; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import written

#: (verdict, host, path): a rule fits its host and all subdomains, where the path starts with the rule's; the longest wins.
RULES: tuple[tuple[str, str, str], ...] = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Least and most pseudo-outcomes behind a level's mean; between them they are fitted to the outcomes.
LEAST, MOST = 1.0, 1000.0
Z = 1.645
BAD_RATE = 0.5
#: How far over the rate of all outcomes a host's lower bound must lie where the bound is relative.
MARGIN = 0.05
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(verdict, rule) of the longest fitting rule, else null. rules is a literal list, so the cost is per row."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(found)
    return found


def domain_of(host: Column) -> Column:
    """The registered domain, taken as the last two labels."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def strength(groups: DataFrame, mean: Column) -> float:
    """Pseudo-outcomes behind the means of groups (n, bad), by the method of moments of the beta-binomial.

    Outcomes of one group are correlated by rho: the squared deviations from the means, each with its group's n, are expected
    to be the sum of v * (1 + (n - 1) * rho), v being mean * (1 - mean). The strength is 1 / rho - 1, within LEAST and MOST.
    """
    v = mean * (1 - mean)
    rho = F.try_divide(F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - mean, F.lit(2))) - F.sum(v), F.sum(v * (F.col("n") - 1)))
    found = groups.agg(rho.alias("rho")).first()["rho"] or 0.0
    return 1 / min(max(found, 1 / (MOST + 1)), 1 / (LEAST + 1)) - 1


class Reputation:
    """Beta-binomial levels fitted to outcomes: the rate of all pages is the prior of a suffix (last label), the suffix's
    posterior mean that of a registered domain (last two labels), and the domain's that of a host. How strongly a level
    shrinks is fitted to the spread of its groups. Tables have a row a host, domain and suffix; they are written once.
    """

    def __init__(self, outcomes: DataFrame):
        """outcomes: host string, bad boolean; null hosts and outcomes are left out."""
        usable = outcomes.where(F.col("host").isNotNull() & F.col("bad").isNotNull())
        counts = usable.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"))
        self.hosts = written(counts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "bad"), "host-outcomes")
        sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
        n, bad = self.hosts.agg(*sums).first()
        self.rate = bad / n if n else None
        shrunk = lambda mean, k: (F.col("bad") + F.lit(k) * mean) / (F.col("n") + F.lit(k))
        suffixes, mean = self.hosts.groupBy("suffix").agg(*sums), F.lit(self.rate)
        self.k_suffix = strength(suffixes, mean)
        self.suffixes = written(suffixes.select("suffix", shrunk(mean, self.k_suffix).alias("s_rate")), "suffix-rates")
        domains, mean = self.hosts.groupBy("domain", "suffix").agg(*sums).join(self.suffixes, "suffix"), F.col("s_rate")
        self.k_domain = strength(domains, mean)
        self.domains = written(domains.select("domain", shrunk(mean, self.k_domain).alias("d_rate")), "domain-rates")
        self.k_host = strength(self.hosts.join(self.domains, "domain"), F.col("d_rate"))

    def bounds(self, hosts: DataFrame, z: float = Z) -> DataFrame:
        """(host, low): the lower posterior bound of each host's rate, mean less z standard deviations of its beta posterior.

        A host without outcomes has its domain's posterior mean, without that its suffix's, without that the rate of all as
        the mean of its prior, with the strength that was fitted below it. Without any outcomes low is null.
        """
        own = hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
        own = own.join(self.hosts.select("host", "n", "bad"), "host", "left").join(self.domains, "domain", "left").join(self.suffixes, "suffix", "left")
        mean = F.coalesce("d_rate", "s_rate", F.lit(self.rate))
        k = F.when(F.col("d_rate").isNotNull(), self.k_host).when(F.col("s_rate").isNotNull(), self.k_domain).otherwise(self.k_suffix)
        n, bad = F.coalesce("n", F.lit(0)), F.coalesce("bad", F.lit(0))
        own = own.select("host", (bad + k * mean).alias("a"), (n - bad + k * (1 - mean)).alias("b"))
        a, b = F.col("a"), F.col("b")
        low = F.greatest(a / (a + b) - F.lit(z) * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), F.lit(0.0))
        return own.select("host", F.when(a.isNotNull(), low).alias("low"))


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, bad_rate: float = BAD_RATE, margin: float | None = None
) -> DataFrame:
    """Verdict of each page: (id, host, path, rule, verdict, bad_low).

    The longest fitting rule decides; else a host is blocked if the lower bound of its bad rate is over bad_rate, or, where
    margin is given, over the rate of all outcomes by more than margin; it is allowed otherwise. Null urls and urls without
    :// have an empty host and path and are judged so. A host without outcomes is judged by its domain's, its suffix's or
    all outcomes; without any, all are allowed and bad_low is null. One row per row of pages, repeated rows included; other
    columns are dropped. Empty tables give no rows. Bounds are worked out once a host; a hot host is one row of them, joined
    by shuffle with skew splits.
    """
    rep = Reputation(outcomes)
    seen = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    low = written(rep.bounds(seen.select("host").distinct()), "host-bounds").withColumnRenamed("low", "bad_low")
    bound = bad_rate if margin is None or rep.rate is None else rep.rate + margin
    return (
        seen.join(low, "host", "left")
        .withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
        .select(
            id_col, "host", "path", F.col("hit.rule").alias("rule"),
            F.coalesce(F.col("hit.verdict"), F.when(F.col("bad_low") > bound, "block").otherwise("allow")).alias("verdict"),
            F.round("bad_low", 6).alias("bad_low"),
        )
    )
