"""Operator 9: URL filter with rules and Empirical-Bayes host reputation. DataFrame functions only.

A rule that fits (host and subdomains, path prefix; the longest wins) decides. Any other url is judged by
its host's record: pages that a label marks good or bad are counted by host, registered domain and public
suffix. Each level's share of bad pages is shrunk towards its parent's by a beta-binomial prior whose
strength is fitted from the spread of the children's shares (method of moments, between bounds), and a url
is blocked when the lower bound (mean less ``z`` standard deviations) of its host's posterior share of bad
pages is above ``limit``. Hosts without labelled pages take their domain's posterior, then their suffix's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import only, table

#: (verdict, host, path) of the fixed rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Second-level names under which country domains register.
SECOND_LEVEL = ("co", "com", "org", "net", "ac", "gov", "edu", "ne", "or", "go")
LIMIT, Z, PRIOR_MIN, PRIOR_MAX = 0.5, 1.64, 2.0, 200.0


def _lower_ascii(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """pages with host and path; both empty where url is null or holds no '://'."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    before = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)  # up to the first ? or #
    host = F.substring_index(before, "/", 1)
    return pages.withColumns({"host": _lower_ascii(host), "path": F.substr(before, F.char_length(host) + 1)})


def _fits(rule: tuple[str, str, str]) -> Column:
    _, host, path = rule
    return ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with rule and rule_verdict: the longest fitting rule's, by host and path together; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tried first
        rule, verdict = F.when(_fits(r), F.lit(r[1] + r[2])).otherwise(rule), F.when(_fits(r), F.lit(r[0])).otherwise(verdict)
    return pages.withColumns({"rule": rule, "rule_verdict": verdict})


def with_domain_and_suffix(pages: DataFrame) -> DataFrame:
    """pages with domain (a label and the suffix) and suffix (the last label, or two under second-level names)."""
    last2 = F.substring_index("host", ".", -2)
    two = F.substring_index(last2, ".", 1).isin(*SECOND_LEVEL) & (F.char_length(F.substring_index("host", ".", -1)) == 2) & (F.substring_index("host", ".", -3) != last2)
    return pages.withColumns({"domain": F.when(two, F.substring_index("host", ".", -3)).otherwise(last2), "suffix": F.when(two, last2).otherwise(F.substring_index("host", ".", -1))})


def _strength(children: DataFrame, parent: str) -> DataFrame:
    """parent, s: prior strength from the children's counts (n, bad): pooled share m, between-child variance v, s = m(1-m)/v - 1."""
    share = F.col("bad") / F.col("n")
    sums = children.groupBy(parent).agg(F.sum("n").alias("tn"), F.sum("bad").alias("tb"), F.count("*").alias("k"), F.sum(F.col("n") * share * share).alias("q"), F.sum(F.col("n") * F.col("n")).alias("n2"))
    m = F.col("tb") / F.col("tn")
    within = m * (1 - m) * F.col("k")  # expected weighted spread without differences between children
    spread = F.col("q") - F.col("tn") * m * m
    room = F.col("tn") - F.col("n2") / F.col("tn")
    v = F.when((F.col("k") > 1) & (room > 0), F.greatest((spread - within + m * (1 - m)) / room, F.lit(0.0))).otherwise(F.lit(0.0))
    s = F.when(v > 0, m * (1 - m) / v - 1).otherwise(F.lit(PRIOR_MAX))
    return sums.select(parent, F.least(F.greatest(s, F.lit(PRIOR_MIN)), F.lit(PRIOR_MAX)).alias("s"))


def reputation(outcomes: DataFrame) -> dict[str, DataFrame]:
    """From rows (host, domain, suffix, bad): posterior mean and strength (mu, nu) by host, domain and suffix, and of all."""
    counts = outcomes.groupBy("host", "domain", "suffix").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    domains = counts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("all", F.lit(0))
    top = suffixes.groupBy("all").agg(F.sum("n").alias("tn"), F.sum("bad").alias("tb")).select("all", ((F.col("tb") + 0.5) / (F.col("tn") + 1)).alias("m"), (F.col("tn") + 1.0).alias("nu"))

    def level(rows: DataFrame, parents: DataFrame, parent: str, key: str) -> DataFrame:
        prior = parents.join(_strength(rows, parent), parent)
        return rows.join(prior, parent).select(key, ((F.col("bad") + F.col("s") * F.col("m")) / (F.col("n") + F.col("s"))).alias("m"), (F.col("n") + F.col("s")).alias("nu"))

    suffix = level(suffixes, top.select("all", "m"), "all", "suffix")
    domain = level(domains, suffix.select("suffix", "m"), "suffix", "domain")
    host = level(counts, domain.select("domain", "m"), "domain", "host")
    return {"all": top, "suffix": suffix, "domain": domain, "host": host}


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_bound (the lower bound that the method compares).

    A page's outcome is bad when the label of the same id says quality 0; several labels of one id count as
    bad if any does; null labels and ids say nothing. Urls without host have the empty host, which is judged
    by the overall share. Repeated pages give repeated results and count as often as they appear. Other
    columns are ignored, an empty labels table leaves the overall prior (a share of one half, which blocks
    nothing), an empty pages table gives an empty result.
    """
    pages = with_domain_and_suffix(with_rule(with_host_and_path(only(pages, page_id="long", url="string"))))
    labels = only(labels, doc_id="long", quality="int").dropna().groupBy("doc_id").agg(F.max((F.col("quality") == 0).cast("int")).alias("bad"))
    outcomes = pages.select("page_id", "host", "domain", "suffix").join(labels, F.col("page_id") == F.col("doc_id")).where("host <> ''")
    levels = reputation(outcomes)
    keys = pages.select("host", "domain", "suffix").distinct()  # a row per host: the large hosts meet their reputation pre-aggregated
    for level in ("host", "domain", "suffix"):
        keys = keys.join(levels[level].select(level, F.struct("m", "nu").alias(f"_{level}")), level, "left")
    keys = keys.withColumn("all", F.lit(0)).join(levels["all"].select("all", F.struct("m", "nu").alias("_all")), "all", "left")
    p = F.coalesce("_host", "_domain", "_suffix", "_all", F.struct(F.lit(0.5).alias("m"), F.lit(1.0).alias("nu")))
    bound = p.getField("m") - z * F.sqrt(p.getField("m") * (1 - p.getField("m")) / (p.getField("nu") + 1))
    found = keys.select("host", F.round(bound, 6).alias("bad_bound"))
    return pages.join(found, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("bad_bound") > limit, "block").otherwise("allow")).alias("verdict"), "bad_bound")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _level_sql(name: str, rows: str, parents: str, parent: str, key: str) -> str:
    return f"""{name}_s AS (
  SELECT {parent}, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 200.0 END, 2.0), 200.0) AS s
  FROM (SELECT *, CASE WHEN k > 1 AND tn - n2 / tn > 0 THEN greatest((q - tn * m * m - m * (1 - m) * k + m * (1 - m)) / (tn - n2 / tn), 0.0) ELSE 0.0 END AS v
        FROM (SELECT {parent}, sum(n)::DOUBLE AS tn, sum(bad)::DOUBLE / sum(n) AS m, count(*) AS k,
                     sum(n * (bad::DOUBLE / n) * (bad::DOUBLE / n)) AS q, sum(n * n)::DOUBLE AS n2 FROM {rows} GROUP BY {parent}))),
{name}_p AS (SELECT {key}, (bad + s * m) / (n + s) AS m, n + s AS nu FROM {rows} JOIN {name}_s USING ({parent}) JOIN {parents} USING ({parent})),"""


def _rules_sql(of: int) -> str:
    return "CASE " + " ".join(f"WHEN (host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}') THEN '{(r[0], r[1] + r[2])[of]}'" for r in sorted(RULES, key=lambda r: -len(r[1] + r[2]))) + " END"


OP9_SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(url, '://([^?#]*)', 1) ELSE '' END AS b FROM pages),
h AS (SELECT page_id, translate(regexp_extract(b, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(b, '^[^/]*(.*)$', 1, 's') AS path FROM u),
sl AS (SELECT *, string_split(host, '.') AS a FROM h),
p AS (SELECT page_id, host, path,
        CASE WHEN two THEN array_to_string(a[-3:], '.') ELSE array_to_string(a[-2:], '.') END AS domain,
        CASE WHEN two THEN array_to_string(a[-2:], '.') ELSE a[-1] END AS suffix
      FROM (SELECT *, len(a) > 2 AND length(a[-1]) = 2 AND a[-2] IN {SECOND_LEVEL} AS two FROM sl)),
lab AS (SELECT doc_id AS page_id, max((quality = 0)::INT) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT host, domain, suffix, count(*) AS n, sum(bad) AS bad FROM p JOIN lab USING (page_id) WHERE host <> '' GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, 0 AS every FROM domains GROUP BY ALL),
top AS (SELECT 0 AS every, (sum(bad) + 0.5) / (sum(n) + 1) AS m, sum(n) + 1.0 AS nu FROM suffixes HAVING count(*) > 0),
{_level_sql("sfx", "suffixes", "top", "every", "suffix").replace("JOIN top", "JOIN (SELECT every, m FROM top)")}
{_level_sql("dom", "domains", "(SELECT suffix, m FROM sfx_p)", "suffix", "domain")}
{_level_sql("hst", "hosts", "(SELECT domain, m FROM dom_p)", "domain", "host")}
j AS (SELECT p.*, coalesce(hst_p.m, dom_p.m, sfx_p.m, (SELECT m FROM top), 0.5) AS m, coalesce(hst_p.nu, dom_p.nu, sfx_p.nu, (SELECT nu FROM top), 1.0) AS nu
      FROM p LEFT JOIN hst_p USING (host) LEFT JOIN dom_p USING (domain) LEFT JOIN sfx_p USING (suffix)),
b AS (SELECT *, round(m - 1.64 * sqrt(m * (1 - m) / (nu + 1)), 6) AS bad_bound, {_rules_sql(1)} AS rule, {_rules_sql(0)} AS rv FROM j)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN bad_bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, bad_bound FROM b
"""
