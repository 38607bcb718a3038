"""URL filtering by rules and by host reputation, with DataFrame functions only.

Rules come first: a rule names a host and the start of a path, holds for the
host and all its subdomains, and the longest one that fits decides. All other
pages are judged by the reputation of their host, learned from labelled pages:
counts of blocked pages are shrunk by beta-binomial priors down the chain all
pages, suffix, registered domain, host. The prior mean of a unit is the
posterior mean of the one above it; its strength is fitted to all units of a
level by the method of moments. A host is blocked if the lower bound of its
posterior block rate is above a threshold, so that little evidence blocks
nothing.

Pages are counted by host before anything is shuffled; everything after that
works on one row per host, domain or suffix.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import Tables

#: (host, path, verdict)
Rule = tuple[str, str, str]
RULES: list[Rule] = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Bounds on the share of variance between the units of a level, and the share taken where no unit has two labelled pages.
LEAST_SPREAD, MOST_SPREAD, UNKNOWN_SPREAD = 0.001, 0.9, 0.5
Z, THRESHOLD = 1.645, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first `://`, A-Z lower-cased, and the path after it; both empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; of equal length the one with the longer host."""
    found: Column = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """The last two labels and the last label of a host without user and port; of an address the address itself."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    address = name.rlike(r"^[0-9.]+$|^\[")
    domain = F.when(address, name).otherwise(F.substring_index(name, ".", -2))
    return domain, F.when(address, name).otherwise(F.substring_index(name, ".", -1))


def _spread(units: DataFrame) -> Column:
    """Share of variance between units (n, bad, prior): a scalar over all of them."""
    noise = F.col("prior") * (1 - F.col("prior"))
    sums = units.agg(
        F.sum((F.col("bad") - F.col("n") * F.col("prior")) ** 2).alias("seen"),
        F.sum(F.col("n") * noise).alias("drawn"),
        F.sum(F.col("n") * (F.col("n") - 1) * noise).alias("pairs"),
    )
    share = F.when(F.col("pairs") > 0, F.least(F.greatest((F.col("seen") - F.col("drawn")) / F.col("pairs"), F.lit(LEAST_SPREAD)), F.lit(MOST_SPREAD)))
    return sums.select(F.coalesce(share, F.lit(UNKNOWN_SPREAD))).scalar()


def _posterior(units: DataFrame) -> DataFrame:
    """`units` (n, bad, prior) with the posterior mean `rate` and the weight `seen` behind it."""
    strength = 1 / _spread(units) - 1
    held = units.withColumn("strength", strength)
    rate = (F.col("strength") * F.col("prior") + F.col("bad")) / (F.col("strength") + F.col("n"))
    return held.select(*units.columns, rate.alias("rate"), (F.col("strength") + F.col("n")).alias("seen"))


def reputation(pages: DataFrame, tables: Tables) -> DataFrame:
    """(host, n, bad, rate, lower) for each host of `pages` (host, blocked boolean, null where unlabelled).

    `rate` is the posterior mean of the share of blocked pages, `lower` its
    bound of Z standard deviations. Hosts without labelled pages have the rate
    of their domain.
    """
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = pages.groupBy("host").agg(F.count("blocked").alias("n"), F.count_if("blocked").alias("bad"))
    hosts = tables.save("hosts", hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"))
    totals = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    every = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("rate")).scalar()
    suffixes = tables.save("suffixes", _posterior(hosts.groupBy("suffix").agg(*totals).withColumn("prior", every)).select("suffix", F.col("rate").alias("prior")))
    domains = hosts.groupBy("domain", "suffix").agg(*totals).join(suffixes, "suffix")
    domains = tables.save("domains", _posterior(tables.save("domain-counts", domains)).select("domain", F.col("rate").alias("prior")))
    judged = _posterior(tables.save("host-counts", hosts.join(domains, "domain")))
    margin = Z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("seen") + 1))
    return judged.select("host", "n", "bad", "rate", (F.col("rate") - margin).alias("lower"))


def judge(pages: DataFrame, rules: list[Rule] = RULES, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", blocked_col: str | None = None) -> DataFrame:
    """(id, host, path, rule, verdict) for each row of `pages`.

    Labelled pages are those whose `blocked_col` is not null; without such a
    column they are the pages that a rule decides. Pages without a url or
    without `://` have an empty host and path; the empty host is judged like any
    other. Repeated rows and ids each give a row; null ids stay null. Other
    columns are not read, whatever their names. No rows give no rows.
    """
    tables = Tables(pages.sparkSession, "urls")
    host, path = host_and_path(F.col(url_col))
    label = F.col(blocked_col).cast("boolean") if blocked_col else F.lit(None).cast("boolean")
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), label.alias("blocked"))
    ruled = parsed.withColumn("decided", longest_rule(F.col("host"), F.col("path"), rules))
    if not blocked_col:
        ruled = ruled.withColumn("blocked", F.col("decided.verdict") == "block")
    known = reputation(ruled.select("host", "blocked"), tables)
    verdicts = tables.save("verdicts", known.select("host", F.when(F.col("lower") > threshold, "block").otherwise("allow").alias("learned")))
    out = ruled.join(verdicts, "host")
    return out.select(F.col("page_id").alias(id_col), "host", "path", F.col("decided.rule").alias("rule"), F.coalesce("decided.verdict", "learned").alias("verdict"))


def _rule_sql() -> str:
    """The rules, longest first, as branches of a CASE."""
    ordered = sorted(RULES, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0])))
    return " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p} {v}'" for h, p, v in ordered)


def _level_sql(name: str, source: str) -> str:
    return f"""
{name}_units AS ({source}),
{name}_spread AS (
  SELECT CASE WHEN sum(n * (n - 1) * prior * (1 - prior)) > 0
         THEN least(greatest((sum((bad - n * prior) ** 2) - sum(n * prior * (1 - prior))) / sum(n * (n - 1) * prior * (1 - prior)), {LEAST_SPREAD}), {MOST_SPREAD})
         ELSE {UNKNOWN_SPREAD} END AS spread FROM {name}_units
),
{name}_rates AS (
  SELECT u.*, ((1 / spread - 1) * prior + bad) / (1 / spread - 1 + n) AS rate, 1 / spread - 1 + n AS seen FROM {name}_units u, {name}_spread
)"""


SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT *, CASE {_rule_sql()} END AS decided FROM split
), named AS (
  SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name, decided LIKE '% block' AS blocked FROM ruled
), hosts AS (
  SELECT host, CASE WHEN regexp_matches(name, '^[0-9.]+$|^\\[') THEN name ELSE regexp_extract(name, '([^.]*\\.)?[^.]*$', 0) END AS domain,
         CASE WHEN regexp_matches(name, '^[0-9.]+$|^\\[') THEN name ELSE regexp_extract(name, '[^.]*$', 0) END AS suffix,
         count(blocked) AS n, count(*) FILTER (blocked) AS bad FROM named GROUP BY ALL
), {_level_sql("suffix", "SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM hosts) AS prior FROM hosts GROUP BY suffix")},
{_level_sql("domain", "SELECT h.domain, h.suffix, sum(h.n) AS n, sum(h.bad) AS bad, any_value(s.rate) AS prior FROM hosts h JOIN suffix_rates s USING (suffix) GROUP BY ALL")},
{_level_sql("host", "SELECT h.host, h.n, h.bad, d.rate AS prior FROM hosts h JOIN domain_rates d USING (domain)")}
SELECT page_id, host, path, split_part(decided, ' ', 1) AS rule,
       coalesce(split_part(decided, ' ', 2), CASE WHEN rate - {Z} * sqrt(rate * (1 - rate) / (seen + 1)) > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM named JOIN host_rates USING (host)
"""
