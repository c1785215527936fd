"""URL filters: explicit host and path rules, and an empirical-Bayes reputation for the rest.

Only DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.text import lower_ascii, quoted
from brindle.operators.joins import join_small
from brindle.sources.shared import materialize

Rule = tuple[str, str]  # ("allow" or "block", "host/path")

# The rules of the registered query.
RULES: tuple[Rule, ...] = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
# Suffixes of two labels under which names are registered.
DOUBLE_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "com.cn", "co.in", "co.za")
#: Standard deviations between a posterior mean and the bound that is compared.
Z = 1.645
#: A host whose share of good pages is below this, even at the upper bound, is blocked.
LEAST_GOOD = 0.5


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #``, A-Z lower-cased; null or no ``://``: empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's.  The rules are
    given in the program, so they become one expression.
    """
    rule = verdict = F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        rule_host, _, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    """The public suffix: the last label, or the last two of ``DOUBLE_SUFFIXES``."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*DOUBLE_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: one label more than the suffix."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*DOUBLE_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def correlation(groups: DataFrame, above: str) -> float:
    """How alike the pages of one group are, beside those of other groups under the same ``above``: 0.01 to 0.99.

    The beta-binomial's analysis-of-variance estimate from each group's pages ``n`` and good pages ``k``; groups are
    compared inside their ``above`` only.  One half where nothing can be compared.  One row of sums is collected.
    """
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    by_above = groups.where("n > 0").groupBy(above)
    by_above = by_above.agg(F.count("*").alias("g"), F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(n * n).alias("nn"), F.sum(k * k / n).alias("kk"))
    s = by_above.agg(
        F.sum(F.col("g") - 1).alias("between"),
        F.sum(F.col("n") - F.col("g")).alias("within"),
        F.sum(F.col("kk") - F.col("k") * F.col("k") / F.col("n")).alias("between_squares"),
        F.sum(F.col("k") - F.col("kk")).alias("within_squares"),
        F.sum(F.col("n") - F.col("nn") / F.col("n")).alias("size"),
    ).first()
    if not s.between or s.within <= 0:
        return 0.5
    between, within, size = s.between_squares / s.between, s.within_squares / s.within, s.size / s.between
    spread = between + (size - 1) * within
    return min(0.99, max(0.01, (between - within) / spread if spread > 0 else 0.01))


def _prior(weight: Column, rho: float) -> Column:
    """The pages that a prior counts as, if what stands above it counts as ``weight`` pages itself.

    A rate that is drawn around the rate above varies by how much groups differ and by how little is known of the
    rate above; a beta with both variances counts as the product of the two counts over their sum and one.
    """
    own = (1 - rho) / rho
    return weight * own / (weight + own + 1)


def reputation(hosts: DataFrame, z: float = Z) -> DataFrame:
    """``hosts`` (distinct ``host``, labelled pages ``n``, good ones ``k``) with ``good`` (posterior mean), ``low`` and ``high`` (bounds).

    A suffix's rate of good pages has a uniform prior, a registered domain's a beta prior around its suffix's, a host's
    around its domain's.  How much a prior counts as follows from how alike a level's groups are and from how
    much is known above, so that the uncertainty of each level is carried down.  Each page counts once: for its
    host, and elsewhere as one of the siblings' pages, those of one host or domain as no more than their likeness
    lets them.  So a host without labelled pages under its suffix keeps the uniform prior.
    """
    hosts = hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "k")
    of_host = correlation(hosts, "domain")
    shrunk = F.greatest(F.lit(0.0), 1 + (F.col("n") - 1) * F.lit(of_host))
    hosts = hosts.withColumns({"host_n": F.when(F.col("n") > 0, F.col("n") / shrunk).otherwise(0.0), "host_k": F.when(F.col("n") > 0, F.col("k") / shrunk).otherwise(0.0)})
    domains = hosts.groupBy("domain", "suffix").agg(*[F.sum(c).alias(c) for c in ("n", "k")], *[F.sum(f"host_{c}").alias(f"in_{c}") for c in ("n", "k")])
    domains = materialize(domains, "domains")
    of_domain = correlation(domains, "suffix")
    shrunk = 1 + (F.col("in_n") - 1) * F.lit(of_domain)
    domains = domains.select("domain", "suffix", "in_n", "in_k", *[F.when(F.col("in_n") > 0, F.col(f"in_{c}") / shrunk).otherwise(0.0).alias(f"domain_{c}") for c in ("n", "k")])
    suffixes = domains.groupBy("suffix").agg(*[F.sum(f"domain_{c}").alias(f"suffix_{c}") for c in ("n", "k")])

    def others(all_: str, own: str) -> Column:
        return F.greatest(F.lit(0.0), F.col(all_) - F.col(own))

    rated = join_small(domains, materialize(suffixes, "suffixes"), "suffix").withColumns(
        {"weight": others("suffix_n", "domain_n") + 2.0, "mean": (others("suffix_k", "domain_k") + 1.0) / (others("suffix_n", "domain_n") + 2.0)}
    )
    rated = materialize(rated.select("domain", "in_n", "in_k", "mean", _prior(F.col("weight"), of_domain).alias("weight")), "domains")
    rated = join_small(hosts.select("host", "domain", "host_n", "host_k", "n", "k"), rated, "domain")
    sibling_n, sibling_k = others("in_n", "host_n"), others("in_k", "host_k")
    rated = rated.withColumn("above", (sibling_k + F.col("weight") * F.col("mean")) / (sibling_n + F.col("weight")))
    rated = rated.withColumn("weight", _prior(sibling_n + F.col("weight"), of_host))
    rated = rated.withColumn("good", (F.col("k") + F.col("weight") * F.col("above")) / (F.col("n") + F.col("weight")))
    width = z * F.sqrt(F.col("good") * (1 - F.col("good")) / (F.col("n") + F.col("weight") + 1.0))
    return rated.select("host", "good", F.greatest(F.lit(0.0), F.col("good") - width).alias("low"), F.least(F.lit(1.0), F.col("good") + width).alias("high"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, outcomes: DataFrame | None = None, z: float = Z, least_good: float = LEAST_GOOD) -> DataFrame:
    """``pages`` (with ``url``) with host, path, rule, verdict and high (the bound that decided, else null).

    The verdict is the fitting rule's.  Elsewhere the host's reputation decides: blocked if even
    the upper bound of its share of good pages is below ``least_good``.  ``outcomes`` (url, good)
    are the labelled pages; by default they are the pages that a rule fits, allow being good.

    Null urls and urls without ``://`` have an empty host, which no rule fits and which is judged
    as any other host.  A bound of exactly ``least_good`` allows.  Repeated rows are judged alike.  An empty
    table gives an empty table.  Other columns are passed on; columns named like the new ones are replaced.

    Pages are read twice: to count by host, and to be judged.
    """
    new = ("host", "path", "rule", "verdict", "high")
    kept = [c for c in pages.columns if c.lower() not in new]
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = pages.select(*[quoted(c) for c in kept], host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumns({"rule": rule, "verdict": verdict})
    labelled = judged.select("host", F.when(F.col("rule").isNotNull(), F.col("verdict") == "allow").alias("good"))
    if outcomes is not None:
        labelled = judged.select("host", F.lit(None).cast("boolean").alias("good"))
        labelled = labelled.unionByName(outcomes.select(host_of(F.col("url")).alias("host"), F.col("good").cast("boolean").alias("good")))
    hosts = labelled.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum(F.col("good").cast("bigint")), F.lit(0)).alias("k"))
    rated = materialize(reputation(materialize(hosts, "hosts"), z).select("host", "high"), "hosts")
    judged = join_small(judged, rated, "host", "left").withColumn("high", F.when(F.col("rule").isNull(), F.col("high")))
    judged = judged.withColumn("verdict", F.coalesce("verdict", F.when(F.col("high") < least_good, "block").otherwise("allow")))
    return judged.select(*[quoted(c) for c in kept], *new)
