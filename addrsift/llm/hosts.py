"""Reputation of hosts by empirical Bayes, and rules for urls.

Pages with a label say how often a host is good.  The rate of a host is shrunk
towards its registered domain, that towards its suffix, and that towards all
pages: each level is a beta prior around the level above, whose strength is
fitted to how much the rates differ beyond chance.  A host is blocked when
even the upper bound of its posterior rate is too low.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Suffixes of two labels, under which a registered domain has three.
TWO_LABELS = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "gov.uk", "ne.jp", "or.jp", "org.au", "org.uk")


@dataclass(frozen=True)
class Reputation:
    """least_rate: of good pages; deviations: of the posterior that its upper
    bound lies above its mean; least_spread and most_spread: limits of the
    correlation of two pages under one parent."""

    least_rate: float = 0.5
    deviations: float = 1.645
    least_spread: float = 0.001
    most_spread: float = 0.5


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lowered;
    empty for null and where there is no ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _CAPITALS, _CAPITALS.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABELS), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABELS), F.substring_index(host, ".", -3)).otherwise(two)


def _shrunk(units: DataFrame, plan: Reputation) -> DataFrame:
    """Adds rate and strength to units (n, good, prior): the posterior mean of
    each, and the weight of its beta posterior.

    The correlation of a level is fitted by moments: the squared deviation of
    good from n * prior, in units of its binomial variance, is n + n (n - 1)
    times the correlation.
    """
    p = F.least(F.greatest(F.col("prior"), F.lit(1e-6)), F.lit(1 - 1e-6))
    squares = (F.col("good") - F.col("n") * p) ** 2 / (p * (1 - p))
    found = units.agg(
        F.sum(squares).alias("x"), F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).cast("double").alias("pairs")
    ).first()
    spread = (found.x - found.n) / found.pairs if found.pairs else 0.0
    spread = min(max(spread, plan.least_spread), plan.most_spread)
    weight = 1.0 / spread - 1.0
    return units.withColumn("rate", (F.col("prior") * weight + F.col("good")) / (weight + F.col("n"))).withColumn("strength", F.col("n") + weight)


def reputations(hosts: DataFrame, plan: Reputation = Reputation()) -> DataFrame:
    """host, n, good, rate, bound, trusted for hosts with their counts.

    ``hosts`` has one row per host: host, n labelled pages, good ones of them.
    A host without labels has the rate of its domain, an unseen domain that of
    its suffix.  Without any label every rate is 1 and every host trusted.
    """
    units = staged(hosts.select("host", "n", "good", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix")), "hosts")
    all_of = units.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    base = all_of.good / all_of.n if all_of.n else 1.0
    counts = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    suffixes = _shrunk(units.groupBy("suffix").agg(*counts).withColumn("prior", F.lit(base)), plan)
    domains = staged(
        units.groupBy("domain", "suffix").agg(*counts).join(suffixes.select("suffix", F.col("rate").alias("prior")), "suffix"), "domains"
    )
    priors = _shrunk(domains, plan).select("domain", "suffix", F.col("rate").alias("prior"))
    known = _shrunk(staged(units.join(priors, ["domain", "suffix"]), "host-priors"), plan)
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("strength") + 1))
    return known.withColumn("bound", F.least(F.lit(1.0), F.col("rate") + plan.deviations * spread)).select(
        "host", "n", "good", "rate", "bound", (F.col("bound") >= plan.least_rate).alias("trusted")
    )


def fitting_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: for each host the rules of it and of the domains above it,
    the longest first.  ``rules`` has host, path and verdict."""
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    listed = rules.select(F.col("host").alias("above"), "path", "verdict", F.concat("host", "path").alias("rule"))
    return (
        hosts.select("host", F.explode(above).alias("above")).join(listed, "above").groupBy("host")
        .agg(F.sort_array(F.collect_set(F.struct((-F.length("rule")).alias("order"), "rule", "path", "verdict"))).alias("rules"))
    )


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", plan: Reputation = Reputation()) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, rate, bound.

    ``outcomes`` has page_id and good (0 or 1) of labelled pages.  The longest
    rule whose host is the page's or above it and with whose path the page's
    starts decides (allow or block); without one the host's reputation does.

    A null url or one without :// has an empty host and path, and that host is
    judged like others.  Several outcomes of a page all count, null ones not;
    repeated pages are judged alike, each in a row of its own.  Of rules of one
    length the first by its text decides; a very long url is taken whole.
    No pages give no rows; other columns take no part.
    """
    parts = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    votes = outcomes.select("page_id", F.col("good").cast("bigint").alias("good")).dropna().groupBy("page_id").agg(
        F.count("*").alias("n"), F.sum("good").alias("good")
    )
    seen = parts.join(votes, "page_id", "left").groupBy("host").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")
    )
    known = reputations(seen, plan)
    by_host = staged(known.join(fitting_rules(known.select("host"), rules), "host", "left"), "host-verdicts")
    fits = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["path"])), F.lit(0))
    return parts.join(by_host, "host").withColumn("fits", fits).select(
        "page_id", "host", "path", F.col("fits.rule").alias("rule"),
        F.coalesce("fits.verdict", F.when(F.col("trusted"), "allow").otherwise("block")).alias("verdict"), "rate", "bound",
    )
