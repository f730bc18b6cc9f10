"""URL filters: allow and block rules first, then an Empirical-Bayes host reputation.

DataFrame functions only. Each labelled page is a Bernoulli outcome (1: good) of its host. Good-rates
shrink down the tree suffix -> registered domain -> host: a node's rate has a beta prior centred on its
parent's posterior mean, whose concentration is fitted per level by the method of moments from the
spread of the nodes' rates. A host is blocked when even the upper bound of its posterior rate (mean plus
``z`` posterior deviations) lies under ``min_good``; hosts without labels get their parents' prior.

Shuffles: page counts are partially aggregated by host before they move; only (page_id, url) is read and
moved, never html. Rules are a parameter held in the plan as one CASE (meant for up to a few hundred).

Defined results: a null url, or one without ``://``, has empty host and path and is judged by the
root's prior; user and port belong to the host but not to its domain and suffix, and an IP address is its own domain and suffix; equal hosts get one verdict; repeated page ids each give a row, and labels of a repeated
page id are averaged to one; without any label every rate is the uniform prior's; empty tables give
empty tables; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_dedup import LOWER, UPPER
from .spark_util import saved

#: Suffixes of two labels; any other host's suffix is its last label. A parameter: pass your own list.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "co.in", "com.br", "com.cn", "com.mx", "co.za")
#: User and port around a host's name, and hosts that are IP addresses.
_AROUND, _ADDRESS = "^[^@]*@|:[0-9]*$", "^([0-9]+[.]){3}[0-9]+$|^[\\[]"
#: (rule string, verdict): host, then the start of the path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(1 << 30))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def domain_suffix(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host without its user and port; an IP address is both itself."""
    bare = F.regexp_replace(host, _AROUND, "")
    two = F.substring_index(bare, ".", -2)
    suffix = F.when(two.isin(*suffixes), two).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(two.isin(*suffixes), F.substring_index(bare, ".", -3)).otherwise(two)
    address = bare.rlike(_ADDRESS)
    return F.when(address, bare).otherwise(domain), F.when(address, bare).otherwise(suffix)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; of equally long ones, the longer host's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda x: (len(x[0]), x[0].find("/"))):  # the last set, hence the longest, wins
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _concentration(level: DataFrame) -> Column:
    """The beta prior's size from one level's (n, k): pooled moments, the intraclass correlation kept in [1e-4, 0.5]."""
    n, k, g = F.sum("n"), F.sum("k"), F.count("*")
    p = k / n
    spread = F.sum(F.col("k") * F.col("k") / F.col("n")) - k * p
    den = n - F.sum(F.col("n") * F.col("n")) / n - (g - 1)
    rho = (spread / (p * (1 - p)) - (g - 1)) / den
    rho = F.when((n > 0) & (p > 0) & (p < 1) & (den > 0), F.greatest(F.lit(1e-4), F.least(F.lit(0.5), rho))).otherwise(F.lit(1e-2))
    return F.round((1 - rho) / rho, 4)


def host_reputation(pages: DataFrame, outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES, z: float = 1.645) -> DataFrame:
    """A row per host of ``pages``: host, n, k, mean, lower, upper. outcomes: page_id, good (0 to 1)."""
    one = outcomes.where("page_id IS NOT NULL AND good IS NOT NULL").groupBy("page_id").agg(F.avg("good").alias("good"))
    host, _ = host_path(F.col("url"))
    named = pages.select("page_id", host.alias("host"))
    known = named.join(one, "page_id").groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("good").cast("double").alias("k"))
    hosts = named.select("host").distinct().join(known, "host", "left").na.fill(0.0, ["n", "k"])
    domain, suffix = domain_suffix(F.col("host"), suffixes)
    hosts = saved(hosts.withColumns({"domain": domain, "suffix": suffix}))  # four steps read them
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = tops.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()  # one row
    size = [x.where("n > 0").agg(_concentration(x).alias("c")).first()["c"] for x in (tops, domains, hosts)]
    root = ((total["k"] or 0.0) + 1) / ((total["n"] or 0.0) + 2)

    def posterior(level: DataFrame, prior: Column, c: float) -> DataFrame:
        return level.withColumn("mean", (F.col("k") + c * prior) / (F.col("n") + c))

    tops = posterior(tops, F.lit(root), size[0]).select("suffix", F.col("mean").alias("top"))
    domains = posterior(domains.join(tops, "suffix"), F.col("top"), size[1]).select("domain", "suffix", F.col("mean").alias("above"))
    hosts = posterior(hosts.join(domains, ["domain", "suffix"]), F.col("above"), size[2])
    dev = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + size[2] + 1))
    return hosts.select("host", "n", "k", "mean", (F.col("mean") - z * dev).alias("lower"), (F.col("mean") + z * dev).alias("upper"))


def url_filter(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, min_good: float = 0.5, suffixes: Sequence[str] = SUFFIXES, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) of every page."""
    host, path = host_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = matching_rule(F.col("host"), F.col("path"), rules)
    judged = host_reputation(pages, outcomes, suffixes, z).select("host", F.when(F.col("upper") < min_good, "block").otherwise("allow").alias("_method"))
    return split.join(judged, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, "_method").alias("verdict"))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Outcomes: a page whose id has a label is good where quality is 1 and toxic is not."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = ((F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("double")
    return url_filter(pages, labels.select(F.col("doc_id").alias("page_id"), good.alias("good")))


def _sql() -> str:
    case, says = "NULL", "NULL"
    for text, verdict in sorted(RULES, key=lambda x: (len(x[0]), x[0].find("/"))):
        name, slash, start = text.partition("/")
        fits = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{start}')"
        case, says = f"CASE WHEN {fits} THEN '{text}' ELSE {case} END", f"CASE WHEN {fits} THEN '{verdict}' ELSE {says} END"
    two = "array_to_string(list_slice(string_split(bare, '.'), greatest(len(string_split(bare, '.')) - 1, 1), len(string_split(bare, '.'))), '.')"
    three = "array_to_string(list_slice(string_split(bare, '.'), greatest(len(string_split(bare, '.')) - 2, 1), len(string_split(bare, '.'))), '.')"
    address = f"regexp_matches(bare, '{_ADDRESS}')"
    listed = ", ".join(f"'{x}'" for x in SUFFIXES)

    def size(level: str) -> str:
        rho = f"(SELECT ((sum(k * k / n) - sum(k) * sum(k) / sum(n)) / ((sum(k) / sum(n)) * (1 - sum(k) / sum(n))) - (count(*) - 1)) / (sum(n) - sum(n * n) / sum(n) - (count(*) - 1)) FROM {level} WHERE n > 0 HAVING sum(n) > 0 AND sum(k) > 0 AND sum(k) < sum(n) AND sum(n) - sum(n * n) / sum(n) - (count(*) - 1) > 0)"
        return f"(SELECT round((1 - r) / r, 4) FROM (SELECT coalesce(greatest(1e-4, least(0.5, {rho})), 1e-2) AS r))"

    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), one AS (
  SELECT doc_id AS page_id, avg(CASE WHEN quality = 1 AND NOT coalesce(toxic = 1, false) THEN 1.0 ELSE 0.0 END) AS good
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), known AS (
  SELECT host, count(*)::DOUBLE AS n, sum(good)::DOUBLE AS k FROM split JOIN one USING (page_id) GROUP BY host
), hosts AS (
  SELECT h.host, coalesce(n, 0.0) AS n, coalesce(k, 0.0) AS k FROM (SELECT DISTINCT host FROM split) h LEFT JOIN known USING (host)
), placed AS (
  SELECT host, n, k, CASE WHEN {address} THEN bare WHEN {two} IN ({listed}) THEN {three} ELSE {two} END AS domain,
         CASE WHEN {address} THEN bare WHEN {two} IN ({listed}) THEN {two} ELSE string_split(bare, '.')[-1] END AS suffix
  FROM (SELECT *, regexp_replace(host, '{_AROUND}', '', 'g') AS bare FROM hosts)
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM placed GROUP BY 1, 2),
tops AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY 1),
root AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM tops),
c AS (SELECT {size("tops")} AS c0, {size("domains")} AS c1, {size("placed")} AS c2),
top_means AS (SELECT suffix, (k + c0 * m) / (n + c0) AS m FROM tops, root, c),
domain_means AS (SELECT d.domain, d.suffix, (d.k + c1 * t.m) / (d.n + c1) AS m FROM domains d JOIN top_means t USING (suffix), c),
host_means AS (SELECT p.host, p.n, (p.k + c2 * d.m) / (p.n + c2) AS m, c2 FROM placed p JOIN domain_means d ON p.domain = d.domain AND p.suffix = d.suffix, c),
judged AS (SELECT host, CASE WHEN m + 1.645 * sqrt(m * (1 - m) / (n + c2 + 1)) < 0.5 THEN 'block' ELSE 'allow' END AS method FROM host_means)
SELECT page_id, host, path, {case} AS rule, coalesce({says}, method) AS verdict FROM split JOIN judged USING (host)
"""


OP1_SQL = _sql()
