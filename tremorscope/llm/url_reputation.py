"""URL filter: explicit rules first, else an empirical-Bayes host reputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, stored

RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Default suffixes of two labels under which names are registered, as a caller without a fuller list gets them; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br")
Z, BLOCK_OVER, MIN_STRENGTH, MAX_STRENGTH = 1.645, 0.25, 1.0, 1000.0


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``. Null url or no ``://``: both empty."""
    text = F.coalesce(F.col(url), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return pages.withColumns({"host": ascii_lower(F.regexp_extract(text, pattern, 1)), "path": F.regexp_extract(text, pattern, 2)})


def with_domains(hosts: DataFrame, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """Adds ``suffix`` and ``domain`` (registered name: the suffix and one label more); ``suffixes`` lists those of two labels, any other suffix is the last label."""
    two = F.substring_index("host", ".", -2)
    suffix = F.when(two.isin(*suffixes), two).otherwise(F.substring_index("host", ".", -1))
    domain = F.when(two.isin(*suffixes), F.substring_index("host", ".", -3)).otherwise(two)
    return hosts.withColumns({"suffix": suffix, "domain": domain})


def _strength(units: DataFrame, mean: str) -> DataFrame:
    """One row: the beta prior's strength by the method of moments over units with n, bad and a prior mean."""
    p = F.col("bad") / F.col("n")
    m = F.col(mean)
    row = units.where("n > 0").agg(
        F.sum(F.col("n") * (p - m) * (p - m)).alias("between"),
        F.sum(m * (1 - m)).alias("chance"),
        F.sum((F.col("n") - 1) * m * (1 - m)).alias("room"),
    )
    # E[n (p - m)^2] = m (1 - m) (1 + (n - 1) / (s + 1)): solve for s over all units
    excess = F.greatest(F.col("between") - F.col("chance"), F.lit(0.0))
    s = F.when(excess > 0, F.col("room") / F.nullif(excess, F.lit(0.0)) - 1).otherwise(F.lit(MAX_STRENGTH))
    return row.select(F.least(F.greatest(F.coalesce(s, F.lit(MAX_STRENGTH)), F.lit(MIN_STRENGTH)), F.lit(MAX_STRENGTH)).alias("strength"))


def host_reputation(outcomes: DataFrame, z: float = Z, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(host, n, bad, rate, bound) from rows (host, bad 0/1 or null), every host once.

    Beta-binomial shrinkage down the name: the suffix's rate is drawn towards
    the global rate, the domain's towards its suffix's, the host's towards its
    domain's, each with a prior strength that the method of moments finds from
    all units of that level with outcomes. A host without any gets its prior:
    the domain's posterior mean, thus the suffix's or the global one where the
    names above have none either. ``bound`` is the posterior mean less ``z``
    posterior standard deviations, a normal bound and not a beta quantile. Rows
    with a null host don't count; a null bad only names the host. No outcomes
    at all: rate and bound are null.

    The first aggregation reduces to one row a host with map-side sums, which
    are stored; what follows works on those counts alone. Only one-row statistics are broadcast.
    """
    counted = outcomes.where("host is not null").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = stored(with_domains(counted, suffixes), "host-counts")
    every = hosts.agg(F.when(F.sum("n") > 0, (F.sum("bad") + 0.5) / (F.sum("n") + 1.0)).alias("m0"))
    shrunk = (F.col("bad") + F.col("strength") * F.col("mean")) / (F.col("n") + F.col("strength"))

    def level(units: DataFrame) -> DataFrame:
        return units.crossJoin(F.broadcast(_strength(units, "mean")))

    counts = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = level(hosts.groupBy("suffix").agg(*counts).crossJoin(F.broadcast(every.withColumnRenamed("m0", "mean")))).select("suffix", shrunk.alias("mean"))
    domains = level(hosts.groupBy("suffix", "domain").agg(*counts).join(suffixes, "suffix")).select("domain", shrunk.alias("mean"))
    out = level(hosts.join(domains, "domain"))
    a, total = F.col("bad") + F.col("strength") * F.col("mean"), F.col("n") + F.col("strength")
    rate = a / total
    sd = F.sqrt(rate * (1 - rate) / (total + 1))
    return out.select("host", "n", "bad", rate.alias("rate"), (rate - z * sd).alias("bound"))


def longest_rule(host, path, rules: Sequence[tuple[str, str, str]] = RULES):
    """The rule with the longest text that fits (its host or a subdomain, its path a prefix), as struct(action, rule); null if none."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    table = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(h).alias("h"), F.lit(p).alias("p"), F.lit(h + p).alias("rule")) for a, h, p in ordered])
    fits = F.filter(table, lambda r: ((host == r["h"]) | F.endswith(host, F.concat(F.lit("."), r["h"]))) & F.startswith(path, r["p"]))
    return F.try_element_at(fits, F.lit(1))


def judge_pages(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, block_over: float = BLOCK_OVER, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """``pages`` with host, path, rule, verdict, and the host's rate and bound.

    ``outcomes`` holds (page_id, bad 0/1); several rows of a page all count,
    nulls don't. A page without a fitting rule is blocked where its host's
    bound is over ``block_over``; a host without outcomes is judged by its
    domain, its suffix or the global rate; with no outcomes at all
    everything is allowed. Null urls share the empty host. Pages
    of an empty table give an empty result. Incoming columns of the added names
    give way.
    """
    added = ("host", "path", "rule", "verdict", "rate", "bound")
    kept = [c for c in pages.columns if c.lower() not in added]
    fit = free_name("fit", pages)
    named = with_host_and_path(pages.select(*[f"`{c}`" for c in kept]))
    judged_ = outcomes.where("bad is not null").select(F.col("page_id").alias("p_"), "bad")
    ids = named.select(F.col("page_id").alias("q_"), "host")
    seen = ids.join(judged_, ids["q_"] == judged_["p_"], "left").select("host", "bad")
    scores = host_reputation(seen, suffixes=suffixes).select("host", "rate", "bound")
    judged = named.withColumn(fit, longest_rule(F.col("host"), F.col("path"), rules)).join(scores, "host", "left")
    by_method = F.when(F.col("bound") > block_over, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(*[named[f"`{c}`"] for c in kept], "host", "path", F.col(f"{fit}.rule").alias("rule"), F.coalesce(F.col(f"{fit}.action"), by_method).alias("verdict"), "rate", "bound")


def labelled_outcomes(labels: DataFrame) -> DataFrame:
    """(page_id, bad): the label with the page's number; bad is toxic or of low quality."""
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))


def digest(pages: DataFrame, labels: DataFrame) -> DataFrame:
    return judge_pages(pages.select("page_id", "url"), labelled_outcomes(labels)).select("page_id", "host", "path", "rule", "verdict")


def _level(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT u.*, least(greatest(coalesce(CASE WHEN t.e > 0 THEN t.room / nullif(t.e, 0.0) - 1 ELSE {MAX_STRENGTH} END, {MAX_STRENGTH}), {MIN_STRENGTH}), {MAX_STRENGTH}) AS strength
  FROM {source} u, (SELECT greatest(sum(n * (bad / n - mean) * (bad / n - mean)) - sum(mean * (1 - mean)), 0.0) AS e,
                           sum((n - 1) * mean * (1 - mean)) AS room FROM {source} WHERE n > 0) t
)"""


_TWO = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
_CASES = {
    what: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p) if what == 'rule' else a}'" for a, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))) + " END"
    for what in ("rule", "action")
}
ORACLE = rf"""
WITH named AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
  FROM pages
), seen AS (
  SELECT host, CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN 0 END AS bad
  FROM named LEFT JOIN labels ON page_id = doc_id
), counted AS (
  SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM seen GROUP BY host
), parts AS (
  SELECT *, string_split(host, '.') AS p FROM counted
), hosts AS (
  SELECT host, n, bad, array_to_string(p[-2:], '.') IN ({_TWO}) AS two,
         CASE WHEN two THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix,
         CASE WHEN two THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain
  FROM parts
), s0 AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT CASE WHEN sum(n) > 0 THEN (sum(bad) + 0.5) / (sum(n) + 1.0) END FROM hosts) AS mean FROM hosts GROUP BY suffix
), {_level("s1", "s0")}, d0 AS (
  SELECT d.domain, d.n, d.bad, (s1.bad + s1.strength * s1.mean) / (s1.n + s1.strength) AS mean
  FROM (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix, domain) d JOIN s1 USING (suffix)
), {_level("d1", "d0")}, h0 AS (
  SELECT host, hosts.n, hosts.bad, (d1.bad + d1.strength * d1.mean) / (d1.n + d1.strength) AS mean FROM hosts JOIN d1 USING (domain)
), {_level("h1", "h0")}, scored AS (
  SELECT host, (bad + strength * mean) / (n + strength) AS rate, rate - {Z} * sqrt(rate * (1 - rate) / (n + strength + 1)) AS bound FROM h1
)
SELECT page_id, host, path, {_CASES["rule"]} AS rule,
       coalesce({_CASES["action"]}, CASE WHEN bound > {BLOCK_OVER} THEN 'block' ELSE 'allow' END) AS verdict
FROM named LEFT JOIN scored USING (host)
"""
