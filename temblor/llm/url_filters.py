"""URL rules and host reputation, by DataFrame expressions only.

Labelled outcomes of pages are counted for each host. The share of good pages of a host is shrunk
towards that of its registered domain, the domain's towards its suffix's, and that towards the share
of all pages, by beta-binomial priors whose strength is estimated from the spread between siblings.
A host is blocked if even the upper bound of its posterior share stays below the wanted share.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from temblor.llm.graph import settle

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STRENGTH = (1.0, 1000.0)  # bounds of a prior's strength in pages
# Suffixes of two labels under which names are registered. A parameter; these are common ones.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "co.jp", "com.au", "com.br", "co.nz", "co.in")


@dataclass(frozen=True)
class Rule:
    """``host`` with all its subdomains, and a path prefix."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """From behind the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From behind the host to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(text, verdict) of the longest rule that fits, or null; of equally long ones that with the
    longer host, then block before allow."""
    choice = F.lit(None).cast("struct<text: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.verdict == "block")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        choice = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(choice)
    return choice


def suffix_of(host: Column) -> Column:
    name = F.regexp_replace(host, r":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: one label more than the suffix."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two)


def _shrunk(level: DataFrame, child: list[str], parent: list[str], above: DataFrame | tuple[float, float]) -> DataFrame:
    """Posterior of each child: good and bad outcomes plus a prior at the parent's posterior mean.

    The prior's strength s is the method-of-moments value for one shared s: with p the parent's
    mean, sum (x - n p)^2 - n p q over children has expectation sum n (n - 1) p q / (s + 1).

    ``above`` has the mean ``p`` of each parent and ``open``, the variance of its share over p q if
    nothing of it is labelled, else 0. By the law of total variance it widens the child's prior, so
    what is far from any label is judged with more doubt, not with less.
    """
    counted = level.groupBy(*child).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    joined = counted.join(above, parent) if parent else counted.withColumns(
        {"p": F.lit(above[0]), "open": F.lit(above[1])})
    extra = F.pow(F.col("good") - F.col("n") * F.col("p"), 2) - F.col("n") * F.col("p") * (1 - F.col("p"))
    room = F.col("n") * (F.col("n") - 1) * F.col("p") * (1 - F.col("p"))
    sums = joined.agg(F.sum(extra).alias("e"), F.sum(room).alias("r")).first()  # two numbers
    low, high = _STRENGTH
    share = (sums["e"] / sums["r"]) if sums["r"] else 0.0
    strength = high if share <= 0 else min(max(1 / share - 1, low), high)
    strength = round(strength, 6)
    spread = F.col("open") + (1 - F.col("open")) / (strength + 1)
    weight = F.when(F.col("open") == 0, F.lit(strength)).otherwise(1 / spread - 1)
    return joined.withColumns({
        "a": F.col("good") + weight * F.col("p"), "b": F.col("n") - F.col("good") + weight * (1 - F.col("p")),
        "open": F.when(F.col("n") == 0, spread).otherwise(0.0)})


def host_reputation(outcomes: DataFrame, url_col: str = "url", good_col: str = "good", pages: DataFrame | None = None) -> DataFrame:
    """(host, n, good, a, b): labelled pages of each host and its posterior Beta(a, b); with ``pages``
    for their hosts as well.

    ``good_col`` is 0, 1 or null (no label). Hosts without labels have the prior of their domain. An
    unknown suffix has the share of all pages. Counts are combined before the shuffle, so a host
    with a third of all pages is one row for each task.
    """
    host = host_of(F.col(url_col))
    level = outcomes.select(host.alias("host"), F.col(good_col).cast("bigint").alias("g"))
    if pages is not None:
        level = level.union(pages.select(host.alias("host"), F.lit(None).cast("bigint").alias("g")).filter("host != ''"))
    level = level.groupBy("host").agg(
        F.count("g").alias("n"), F.coalesce(F.sum("g"), F.lit(0)).alias("good"))
    # One row for each host from here on.
    level = settle(level).withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    total = level.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    # A uniform prior over the share of all pages.
    p = ((total["good"] or 0) + 1) / ((total["n"] or 0) + 2)
    mean = F.col("a") / (F.col("a") + F.col("b"))
    # Without any label that prior is all there is; its variance is a third of p q.
    suffix = _shrunk(level, ["suffix"], [], (p, 0.0 if total["n"] else 1 / 3))
    domain = _shrunk(level, ["suffix", "domain"], ["suffix"], suffix.select("suffix", mean.alias("p"), "open"))
    hosts = _shrunk(level, ["domain", "host"], ["domain"], domain.select("domain", mean.alias("p"), "open"))
    return hosts.select("host", "n", "good", "a", "b")


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url",
    good_col: str = "good", least_good: float = 0.7, z: float = 1.645,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, good_upper) for every row of ``pages``.

    ``rule`` is the text of the longest fitting rule or null; ``verdict`` is that rule's, else
    ``block`` if the host's upper posterior bound (mean plus ``z`` standard deviations) is below
    ``least_good``, else ``allow``. ``outcomes`` holds url and ``good_col`` of labelled pages. A null
    url or one without ``://`` has empty host and path, no bound and is allowed. A host without outcomes
    is judged by the prior of its domain, suffix or all pages. Repeated rows are judged each; empty
    tables give no rows.
    """
    outcomes = outcomes.filter(F.col(good_col).isNotNull())
    reputation = host_reputation(outcomes.filter(host_of(F.col(url_col)) != ""), url_col, good_col, pages)
    weight = F.col("a") + F.col("b")
    upper = F.col("a") / weight + z * F.sqrt(F.col("a") * F.col("b") / (weight * weight * (weight + 1)))
    bounds = reputation.select("host", F.round(F.least(upper, F.lit(1.0)), 6).alias("good_upper"))
    judged = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    bad = F.coalesce(F.col("good_upper") < least_good, F.lit(False))
    return judged.join(bounds, "host", "left").withColumn("_rule", rule).select(
        id_col, "host", "path", F.col("_rule.text").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(bad, "block").otherwise("allow")).alias("verdict"), "good_upper")
