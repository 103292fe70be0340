"""URL filter by rules and by empirical-Bayes reputation of hosts.

Rules come first: one fits its host and all subdomains where the path starts
with its path; the longest fitting rule decides. For the other urls, labelled page
outcomes (good or bad) are counted per host, registered domain and public
suffix. The share of bad pages of a suffix is shrunk towards the overall share,
that of a domain towards its suffix, that of a host towards its domain. Each
step is a beta-binomial prior whose weight is estimated from how much the
groups of that level differ (by moments, pooled over the level). A url is
blocked when the lower posterior bound of its host's bad share lies above a limit.

Outcomes are folded per host before any shuffle and only folded tables are
joined, so a host with a third of all pages is one row.

Defined results: a null url, or one without `://`, has an empty host and path;
hosts without outcomes take their domain's, suffix's or the overall share;
without any outcome nothing is blocked. Null outcomes are none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekeep.llm.common import stored

RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)
#: Public suffixes of more than one label that are known without a table of the caller's; all others are taken to have one.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz")
#: A host is blocked when its bad share exceeds LIMIT with the certainty of Z standard deviations.
LIMIT, Z = 0.5, 1.645
#: Bounds on the weight of a prior, in pages.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 1000.0


def host(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end, with A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def server(host: Column) -> Column:
    """The host without a user before `@`, a port, and a dot at its end."""
    bare = F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", "")
    return F.regexp_replace(bare, r"\.$", "")


def is_address(name: Column) -> Column:
    """IPv4 addresses, and IPv6 ones in brackets: such a host is its own domain and suffix."""
    return name.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") | name.startswith("[")


def suffix(name: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The longest public suffix of a server's name: by the table, else its last label.

    As in the public suffix list, an entry `*.ck` makes any label before `ck` part of the suffix,
    and `!www.ck` excepts that name from it.
    """
    held = F.array(*map(F.lit, [s for s in suffixes if s[:1] not in "*!"])).cast("array<string>")
    wild = F.array(*[F.lit(s[2:]) for s in suffixes if s.startswith("*.")]).cast("array<string>")
    excepted = F.array(*[F.lit(s[1:]) for s in suffixes if s.startswith("!")]).cast("array<string>")
    labels = F.split(name, r"\.")
    most = max([s.count(".") + 1 for s in suffixes], default=1)
    found = F.substring_index(name, ".", -1)
    for n in range(1, most + 1):
        tail = F.substring_index(name, ".", -n)
        fits = F.array_contains(held, tail) | (F.array_contains(wild, F.substring_index(name, ".", -(n - 1))) if n > 1 else F.lit(False))
        found = F.when(F.size(labels) >= n, F.when(fits, tail).otherwise(found)).otherwise(found)
    # An exception's suffix is what follows its first label.
    for n in range(2, most + 1):
        tail = F.substring_index(name, ".", -n)
        found = F.when((F.size(labels) >= n) & F.array_contains(excepted, tail), F.substring_index(name, ".", -(n - 1))).otherwise(found)
    return F.when(is_address(name), name).otherwise(found)


def domain(name: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The registered domain of a server's name: one label more than the public suffix."""
    own = suffix(name, suffixes)
    more = F.size(F.split(own, r"\.")) + 1
    taken = F.array_join(F.slice(F.split(name, r"\."), F.greatest(F.size(F.split(name, r"\.")) - more + 1, F.lit(1)), more), ".")
    return F.when(is_address(name), name).otherwise(taken)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = text.index("/") if "/" in text else len(text)
        name, start = text[:at], text[at:]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def prior_weight(groups: DataFrame, mean: str) -> float:
    """The weight of a beta prior with the groups' parent means, by moments over all groups (n, bad).

    Of the squared deviations, what binomial chance explains is taken off; what is
    left is how much the groups differ.
    """
    m, n = F.col(mean), F.col("n")
    chance = m * (1 - m)
    row = groups.where(n > 0).agg(
        F.sum(n * (F.col("bad") / n - m) * (F.col("bad") / n - m)).alias("seen"), F.sum(chance).alias("expected"),
        F.sum(n * chance).alias("scale"),
    ).first()
    if not row["scale"]:
        return MOST_WEIGHT
    # Among n pages of a group with correlation r, the deviation is expected as chance (1 + (n - 1) r).
    excess = row["seen"] - row["expected"]
    spare = row["scale"] - row["expected"]
    r = excess / spare if spare > 0 else 0.0
    return MOST_WEIGHT if r <= 0 else min(MOST_WEIGHT, max(LEAST_WEIGHT, 1 / r - 1))


def shrunk(groups: DataFrame, mean: str, weight: float, name: str) -> DataFrame:
    return groups.withColumn(name, (F.col("bad") + weight * F.col(mean)) / (F.col("n") + weight))


def reputation(outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """host, n, bad, bad_share and bad_low of every host of `outcomes` (host, bad: 0, 1 or null).

    Hosts that differ in user, port or a last dot are hosts of their own within one domain.
    """
    seen = F.count("bad")
    hosts = outcomes.groupBy("host").agg(seen.alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = hosts.withColumn("_name", server(F.col("host")))
    named = {"domain": domain(F.col("_name"), suffixes), "suffix": suffix(F.col("_name"), suffixes)}
    hosts = stored(hosts.withColumns(named).drop("_name"), "url-hosts")
    folded = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = stored(hosts.groupBy("domain", "suffix").agg(*folded), "url-domains")
    suffixes = domains.groupBy("suffix").agg(*folded)
    total = hosts.agg(*folded).first()
    overall = (total["bad"] or 0) / total["n"] if total["n"] else 0.0
    suffixes = stored(suffixes.withColumn("m", F.lit(float(overall))), "url-suffixes")
    suffixes = shrunk(suffixes, "m", prior_weight(suffixes, "m"), "suffix_share").select("suffix", "suffix_share")
    domains = domains.join(suffixes, "suffix")
    domains = shrunk(domains, "suffix_share", prior_weight(domains, "suffix_share"), "domain_share").select("domain", "suffix", "domain_share")
    hosts = hosts.join(domains, ["domain", "suffix"])
    weight = prior_weight(hosts, "domain_share")
    hosts = shrunk(hosts, "domain_share", weight, "bad_share")
    share, size = F.col("bad_share"), F.col("n") + weight
    low = share - Z * F.sqrt(share * (1 - share) / (size + 1))
    return hosts.select("host", "n", "bad", "bad_share", F.greatest(low, F.lit(0.0)).alias("bad_low"))


def judge(
    urls: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, suffixes: Sequence[str] = SUFFIXES
) -> DataFrame:
    """`urls` (with `url`) plus host, path, rule, verdict, labelled, bad and bad_low; `outcomes` has url and bad.

    `suffixes` is a table of public suffixes of more than one label, with wildcards and exceptions, such as the public suffix list.
    Each host of `urls` gets a row of its own, with no outcomes where there are none.
    """
    named = urls.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    known = outcomes.select(host(F.col("url")).alias("host"), F.col("bad").cast("int").alias("bad"))
    every = known.unionByName(named.select("host", F.lit(None).cast("int").alias("bad")))
    hosts = reputation(every, suffixes).select("host", F.col("n").alias("labelled"), F.col("bad").alias("labelled_bad"), "bad_low")
    rule, ruled = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_low") > LIMIT, "block").otherwise("allow")
    return named.join(hosts, "host", "left").withColumns({"rule": rule, "verdict": F.coalesce(ruled, own)})
