"""URL filters with DataFrame functions only: explicit rules, else an empirical-Bayes reputation of the host.

Labelled pages are successes (good) or failures.  Good rates are shrunk along host -> registered domain ->
suffix -> everything: a level's posterior mean is the beta prior mean of the level below, and each level's prior
strength is fitted by moments to the spread of its members (beta-binomial).  A host is blocked when the upper
bound of its posterior good rate lies below a limit; hosts without labels get their domain's posterior.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickmill.llm.tables import stored

#: (verdict, rule) of the contract query.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: More rules than these are joined by host instead of being spelled out.
MAX_SPELLED = 200
#: Hosts whose bounds are sent to every task (about 60 bytes each); more are joined by a shuffle.
MOST_SENT = 300_000
#: Labels that, before a country's two letters, make a suffix under which names are registered.
SECOND_LABELS = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "go", "id", "info", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch", "web")
LONG_SUFFIX = rf"^({'|'.join(SECOND_LABELS)})[.][a-z][a-z]$"
#: Addresses instead of names.
ADDRESS = r"^[0-9]+([.][0-9]+){3}$|^\[.*\]$"
#: Strength of every prior lies between these (pseudo-counts).
WEAKEST, STRONGEST = 1.0, 1000.0
#: A host is blocked when its good rate is below LIMIT with about 95 % certainty.
LIMIT, Z = 0.5, 1.6448536269514722


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def name_of(host: Column) -> Column:
    """The host without user, port and a dot at its end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), "[.]$", "")


def suffix_of(host: Column) -> Column:
    """The last label, or two of them; addresses share one suffix."""
    name = name_of(host)
    pair = F.substring_index(name, ".", -2)
    return F.when(F.rlike(name, F.lit(ADDRESS)), "address").when(F.rlike(pair, F.lit(LONG_SUFFIX)), pair).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column) -> Column:
    """The suffix and one label more; an address is its own domain."""
    name = name_of(host)
    pair = F.substring_index(name, ".", -2)
    return F.when(F.rlike(name, F.lit(ADDRESS)), name).when(F.rlike(pair, F.lit(LONG_SUFFIX)), F.substring_index(name, ".", -3)).otherwise(pair)


def parts(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((host == rule_host) | F.endswith(host, F.concat(F.lit("."), rule_host))) & F.startswith(path, rule_path)


def with_rule(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``pages`` (host, path, ...) with ``rule`` and ``rule_verdict`` of the longest rule that fits (of equally long ones the least), or nulls."""
    ordered = sorted({r: v for v, r in rules}.items(), key=lambda x: (-len(x[0]), x[0]))
    if len(ordered) <= MAX_SPELLED:
        rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for r, v in reversed(ordered):
            own_host, own_path = parts(r)
            fit = fits(F.col("host"), F.col("path"), F.lit(own_host), F.lit(own_path))
            rule, verdict = F.when(fit, F.lit(r)).otherwise(rule), F.when(fit, F.lit(v)).otherwise(verdict)
        return pages.withColumns({"rule": rule, "rule_verdict": verdict})
    spark = pages.sparkSession
    table = spark.createDataFrame([(*parts(r), r, v, len(r)) for r, v in ordered], "rule_host string, rule_path string, rule string, rule_verdict string, size int")
    places = pages.select("host", "path").distinct()
    ends = places.withColumn("_labels", F.split("host", "[.]")).withColumn("rule_host", F.explode(F.transform(F.sequence(F.lit(1), F.size("_labels")), lambda i: F.array_join(F.slice("_labels", i, F.size("_labels")), "."))))
    best = ends.join(table, "rule_host").filter(F.startswith("path", "rule_path")).groupBy("host", "path").agg(F.min(F.struct(-F.col("size"), "rule", "rule_verdict")).alias("r"))
    return pages.join(best.select("host", "path", "r.rule", "r.rule_verdict"), ["host", "path"], "left")


def strength(counts: DataFrame) -> Column | float:
    """Moment estimate of the beta prior's pseudo-counts from (n, k) of a level's members; one row."""
    s = counts.filter("n > 0").agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kkn"))
    p = F.try_divide(F.col("k").cast("double"), F.col("n"))
    spread = F.round(F.col("kkn"), 6) - F.col("k") * p
    noise = p * (1 - p)
    rho = F.try_divide(spread - noise * (F.col("m") - 1), noise * (F.col("n") - F.try_divide(F.col("nn").cast("double"), F.col("n")) - (F.col("m") - 1)))
    fitted = F.when(rho <= 0, F.lit(STRONGEST)).otherwise(F.try_divide(F.lit(1.0), rho) - 1)
    return s.select(F.round(F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), F.coalesce(fitted, F.lit(STRONGEST)))), 6).alias("s"))


def reputations(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """From (host, n, k) per host: hosts, domains, suffixes and everything, each with its posterior (a, b)."""
    hosts = outcomes.select("host", "n", "k", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    everything = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    top = everything.select((F.col("k") + 0.5).alias("a"), (F.col("n") - F.col("k") + 0.5).alias("b"))
    mean = top.select(F.col("a") / (F.col("a") + F.col("b"))).scalar()

    def posterior(level: DataFrame, prior: Column, size: Column) -> DataFrame:
        return level.withColumns({"a": size * prior + F.col("k"), "b": size * (1 - prior) + F.col("n") - F.col("k")})

    by_suffix = posterior(suffixes, mean, strength(suffixes).scalar())
    up = by_suffix.select("suffix", (F.col("a") / (F.col("a") + F.col("b"))).alias("up"))
    by_domain = posterior(domains.join(up, "suffix"), F.col("up"), strength(domains).scalar()).drop("up")
    up = by_domain.select("domain", (F.col("a") / (F.col("a") + F.col("b"))).alias("up"))
    by_host = posterior(hosts.join(up, "domain"), F.col("up"), strength(hosts).scalar()).drop("up")
    return by_host, by_domain, by_suffix, top


def upper_bound(a: Column, b: Column, z: float = Z) -> Column:
    """Upper bound of a beta(a, b) rate: mean plus z standard deviations, at most 1."""
    mean = a / (a + b)
    return F.least(F.lit(1.0), mean + z * F.sqrt(mean * (1 - mean) / (a + b + 1)))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", limit: float = LIMIT) -> DataFrame:
    """(id_col, host, path, rule, verdict, good_bound) for every row of ``pages``.

    ``outcomes``: (id_col, good 0/1), labelled pages.  ``good_bound`` is the upper bound of the host's good rate.
    The rule that fits decides; without one, a bound below ``limit`` blocks.

    A null url or one without ``://`` has empty host and path and is judged like a host named ''.
    Null ids are kept (and match no outcome); repeated rows are judged alike; repeated outcomes count each;
    null outcomes don't count.  Empty tables give an empty result; without outcomes every page that no rule
    blocks is allowed.  Very long urls are judged whole.  Other columns are ignored, whatever their names.
    """
    places = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    labels = outcomes.filter(F.col("good").isNotNull()).select(F.col(id_col).alias("id"), F.col("good").cast("long").alias("good"))
    seen = places.select("id", "host").join(labels, "id").groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("k"))
    every = places.select("host").distinct().join(seen, "host", "left").select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k"))
    by_host, _, _, _ = reputations(stored(every, "hosts"))
    bound = stored(by_host.select("host", upper_bound(F.col("a"), F.col("b")).alias("good_bound")), "bounds")
    ruled = with_rule(places, rules).join(F.broadcast(bound) if bound.count() <= MOST_SENT else bound, "host")
    verdict = F.coalesce("rule_verdict", F.when(F.col("good_bound") < limit, "block").otherwise("allow"))
    return ruled.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "good_bound")


def page_outcomes(labels: DataFrame) -> DataFrame:
    """Labels as outcomes of the pages of the same number: good is of quality and not toxic."""
    return labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0).alias("good"))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Contract query: every url of ``pages``; outcomes are the labels of the same number."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(pages, page_outcomes(labels)).select("page_id", "host", "path", "rule", "verdict")


def _strength_sql(level: str) -> str:
    return f"""(SELECT round(least({STRONGEST}, greatest({WEAKEST}, coalesce(CASE WHEN rho <= 0 THEN {STRONGEST} ELSE 1.0::DOUBLE / nullif(rho, 0) - 1 END, {STRONGEST}))), 6) FROM (
    SELECT (round(kkn, 6) - k * (k::DOUBLE / n) - (k::DOUBLE / n) * (1 - k::DOUBLE / n) * (m - 1)) / nullif((k::DOUBLE / n) * (1 - k::DOUBLE / n) * (n - nn::DOUBLE / n - (m - 1)), 0) AS rho FROM (
      SELECT count(*) AS m, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k, sum(n * n)::BIGINT AS nn, sum(k * k / n::DOUBLE) AS kkn FROM {level} WHERE n > 0)))"""


_SHORT = "regexp_extract(name, '([^.]*[.])?[^.]*$')"
_LONG = "regexp_extract(name, '([^.]*[.])?([^.]*[.])?[^.]*$')"
_IS_LONG = f"regexp_matches({_SHORT}, '{LONG_SUFFIX}')"
_IS_ADDRESS = f"regexp_matches(name, '{ADDRESS}')"
_CASES = "\n".join(f"    WHEN (host = '{parts(r)[0]}' OR ends_with(host, '.{parts(r)[0]}')) AND starts_with(path, '{parts(r)[1]}') THEN '{{}}'".replace("{}", "{%d}" % i) for i, (v, r) in enumerate(sorted(RULES, key=lambda x: (-len(x[1]), x[1]))))
_ORDERED = sorted(RULES, key=lambda x: (-len(x[1]), x[1]))

OP1_SQL = f"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
l AS (
  SELECT doc_id AS page_id, CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END AS good FROM labels),
seen AS (SELECT host, count(*) AS n, sum(good)::BIGINT AS k FROM p JOIN l USING (page_id) WHERE good IS NOT NULL GROUP BY host),
h AS (
  SELECT host, coalesce(n, 0) AS n, coalesce(k, 0) AS k, CASE WHEN {_IS_ADDRESS} THEN name WHEN {_IS_LONG} THEN {_LONG} ELSE {_SHORT} END AS domain,
    CASE WHEN {_IS_ADDRESS} THEN 'address' WHEN {_IS_LONG} THEN {_SHORT} ELSE regexp_extract(name, '[^.]*$') END AS suffix
  FROM (SELECT DISTINCT host, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[.]$', '') AS name FROM p) LEFT JOIN seen USING (host)),
d AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM d GROUP BY ALL),
sp AS (SELECT suffix, (z * m + k) / (z + n) AS up FROM (SELECT *, {_strength_sql('s')} AS z, (SELECT (sum(k) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE) FROM s) AS m FROM s)),
dp AS (SELECT domain, (z * up + k) / (z + n) AS up FROM (SELECT d.*, sp.up, {_strength_sql('d')} AS z FROM d JOIN sp USING (suffix))),
hp AS (SELECT host, (z * up + k) / (z + n) AS mean, z + n AS size FROM (SELECT h.*, dp.up, {_strength_sql('h')} AS z FROM h JOIN dp USING (domain))),
j AS (
  SELECT page_id, p.host, path, least(1.0, mean + {Z} * sqrt(mean * (1 - mean) / (size + 1))) AS bound FROM p JOIN hp USING (host))
SELECT page_id, host, path,
  CASE
{_CASES.format(*[r for _, r in _ORDERED])}
  END AS rule,
  CASE
{_CASES.format(*[v for v, _ in _ORDERED])}
    WHEN bound < {LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""
