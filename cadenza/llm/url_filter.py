"""URL filters: listed rules first, then an empirical-Bayes reputation of the host.

A page that a rule decides is a labelled outcome (block 1, allow 0); more can be passed. Rates are shrunk level by level: all pages, the
suffix (the last label, or two where they are a listed suffix), the registered domain (one label more), the host. Each level has a
beta prior around the posterior mean of the level above; its strength comes from the spread of the rates of that level (method of
moments), between WEAK and STRONG pseudo-pages. A page without a rule is blocked when the lower bound of its host's
posterior, mean - Z standard deviations, exceeds LIMIT: the rate at which a bad page let through costs as much as the good ones blocked
with it, a bad page counting (1 - LIMIT) / LIMIT good ones.

Counts per host are aggregated once and written; the levels above are aggregates of that table, a row a host. The rules are configuration: they are part of the plan, at
most RULES of them.

A null url, or one without `://`, has an empty host and path, no rule, and the reputation of the empty host. Repeated rows are judged
each. Rules of one length that fit one url are the same rule. Urls are read whole, however long. Extra columns are ignored, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.shared import BROADCAST_IDS, materialize

RULES = 1000
#: The listed rules (verdict, host and path).
LISTED = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Suffixes of two labels under which domains are registered. A fuller list can be passed.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr", "co.in", "co.za",
    "com.br", "com.ar", "com.mx", "com.cn", "com.hk", "com.sg", "com.tw", "com.tr", "com.ua", "co.il", "github.io", "blogspot.com",
)
WEAK, STRONG, Z, LIMIT = 1.0, 1000.0, 1.645, 0.35
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<size, rule, verdict> of the longest rule that fits, or null."""
    if len(rules) > RULES:
        raise ValueError(f"{len(rules)} rules; at most {RULES} fit in a plan")
    fits = []
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        ok = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        fits.append(F.when(ok, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits)))


def _posterior(table: DataFrame, above: DataFrame, key: str) -> DataFrame:
    """Add a, b (of the beta posterior) and mean to a level's counts; above: key, mean0."""
    rows = table.join(above, key)
    used = rows.where("n > 0").agg(
        F.sum("n").alias("pages"), F.count("*").alias("groups"),
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("mean0"), F.lit(2))).alias("spread"),
        F.sum(F.col("n") * F.col("mean0") * (1 - F.col("mean0"))).alias("within"),
    )
    one = used.first()
    strength = STRONG
    if one["groups"] and one["within"]:
        # the spread of rates beyond what sampling explains: share = (1 + (n - 1) / (s + 1)) / n for n pages a group
        size = one["pages"] / one["groups"]
        share = one["spread"] / one["within"]
        excess = (share * size - 1) / (size - 1) if size > 1 else 0.0
        strength = min(max(1 / excess - 1, WEAK), STRONG) if excess > 0 else STRONG
    a, b = F.col("bad") + F.col("mean0") * strength, F.col("n") - F.col("bad") + (1 - F.col("mean0")) * strength
    return rows.withColumns({"a": a, "b": b}).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))


def reputations(judged: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """host, n, bad, mean, bound for every host; judged: host and outcome (1 bad, 0 good, null unknown)."""
    hosts = judged.groupBy("host").agg(F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).alias("bad"))
    labels = F.split("host", r"\.")
    tail = lambda k: F.array_join(F.slice(labels, F.greatest(-F.size(labels), F.lit(-k)), k), ".")
    listed = tail(2).isin(*suffixes) if suffixes else F.lit(False)
    hosts = hosts.withColumns({"suffix": F.when(listed, tail(2)).otherwise(F.element_at(labels, -1)), "domain": F.when(listed, tail(3)).otherwise(tail(2))})
    hosts = materialize(hosts, "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((whole["bad"] or 0) + 0.5) / ((whole["n"] or 0) + 1)
    level = _posterior(suffixes, suffixes.select("suffix", F.lit(overall).alias("mean0")), "suffix")
    level = _posterior(domains, level.select("suffix", F.col("mean").alias("mean0")), "suffix")
    level = _posterior(hosts, level.select("domain", F.col("mean").alias("mean0")), "domain")
    total = F.col("a") + F.col("b")
    bound = F.col("mean") - Z * F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return level.select("host", "n", "bad", "mean", bound.alias("bound"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, outcomes: DataFrame | None = None, limit: float = LIMIT, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, mean, bound of every page; outcomes (page_id, outcome) add labels of their own."""
    rules = LISTED if rules is None else rules
    host, path = parts(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules) if rules else F.expr("cast(null as struct<size:int,rule:string,verdict:string>)"))
    labelled = rows.withColumn("outcome", (F.col("fit.verdict") == "block").cast("int"))
    if outcomes is not None:
        given = outcomes.groupBy("page_id").agg(F.max("outcome").alias("given"))
        labelled = labelled.join(given, "page_id", "left").withColumn("outcome", F.coalesce("outcome", "given"))
    found = materialize(reputations(labelled.select("host", "outcome"), suffixes).select("host", "mean", "bound"), "reputations")
    few = found.limit(BROADCAST_IDS // 8 + 1).count() <= BROADCAST_IDS // 8
    method = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return rows.join(F.broadcast(found) if few else found, "host").select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), "mean", "bound")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    found = judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "host", "path", "rule", "verdict", F.round("mean", 6).alias("mean"), F.round("bound", 6).alias("bound"))


def _sql_level(name: str, table: str, above: str, key: str) -> str:
    used = f"(SELECT sum(n) AS pages, count(*) AS groups, sum(n * pow(bad / n - mean0, 2)) AS spread, sum(n * mean0 * (1 - mean0)) AS within FROM {name}0 WHERE n > 0)"
    excess = "CASE WHEN pages > groups THEN (spread / within * (pages / groups) - 1) / (pages / groups - 1) ELSE 0 END"
    return f"""
{name}0 AS (SELECT t.*, u.mean AS mean0 FROM {table} t JOIN {above} u USING ({key})),
{name}s AS (SELECT CASE WHEN groups > 0 AND within > 0 AND {excess} > 0 THEN least(greatest(1 / ({excess}) - 1, {WEAK}), {STRONG}) ELSE {STRONG} END AS s FROM {used}),
{name} AS (SELECT * , a / (a + b) AS mean FROM (SELECT *, bad + mean0 * s AS a, n - bad + (1 - mean0) * s AS b FROM {name}0, {name}s)),"""


def _sql() -> str:
    values = ", ".join(f"('{v}', '{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for v, r in LISTED)
    listed = ", ".join(f"'{s}'" for s in SUFFIXES)
    return f"""
WITH r(v, rule, h, p) AS (VALUES {values}),
u AS (SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
x AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
f AS (SELECT x.*, (SELECT arg_max(rule, length(rule)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule FROM x),
g AS (SELECT f.*, r.v FROM f LEFT JOIN r USING (rule)),
l AS (SELECT *, string_split(host, '.') AS labels, array_to_string(string_split(host, '.')[-2:], '.') IN ({listed}) AS two FROM g),
hosts AS (SELECT host, count(v)::DOUBLE AS n, count(*) FILTER (v = 'block')::DOUBLE AS bad, CASE WHEN any_value(two) THEN array_to_string(any_value(labels)[-2:], '.') ELSE any_value(labels)[-1] END AS suffix,
  CASE WHEN any_value(two) THEN array_to_string(any_value(labels)[-3:], '.') ELSE array_to_string(any_value(labels)[-2:], '.') END AS domain FROM l GROUP BY host),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
overall AS (SELECT suffix, (SELECT (sum(bad) + 0.5) / (sum(n) + 1) FROM suffixes) AS mean FROM suffixes),
{_sql_level("ls", "suffixes", "overall", "suffix")}{_sql_level("ld", "domains", "ls", "suffix")}{_sql_level("lh", "hosts", "ld", "domain")}
b AS (SELECT host, mean, mean - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM lh)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN bound > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, round(mean, 6) AS mean, round(bound, 6) AS bound FROM g JOIN b USING (host)
"""


SQL = _sql()
