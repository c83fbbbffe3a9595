"""URL filters: rules by host and path, and empirical-Bayes reputations of hosts for what no rule decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labels that stand before a country code in a suffix of two labels (fixed values).
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]
#: Rules are tested one by one in each row, so a longer list is refused.
MOST_RULES = 500
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_DOMAIN = rf"([^.]+\.)?((?:{'|'.join(SECOND_LEVEL)})\.[a-z][a-z]|[^.]+)$"
_ADDRESS = r"^[0-9.]+$|[:\[\]]"
#: Prior strengths are held between these; WEAK stands where no unit has two outcomes.
LEAST, MOST, WEAK = 2.0, 1000.0, 10.0
#: What all outcomes together are shrunk to: so many bad ones of one more; nothing known counts as good.
PRESUMED = 0.05


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is missing or has no `://`."""
    whole = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    return F.translate(F.regexp_extract(whole, _URL, 1), _UPPER, _LOWER), F.regexp_extract(whole, _URL, 2)


def units(host: str) -> tuple[Column, Column, Column]:
    """The name of a host (no user, no port, no last dot), its registered domain, and that one's suffix.

    A suffix is the last label, or two where a SECOND_LEVEL label stands before a country code; the registered domain has one
    label more. A numeric address is a domain of its own with the empty suffix."""
    name = F.regexp_replace(F.col(host), r"^.*@|:[0-9]*$|\.+$", "")
    domain = F.when(name.rlike(_ADDRESS), name).otherwise(F.regexp_extract(name, _DOMAIN, 0))
    suffix = F.when(name.rlike(_ADDRESS), "").otherwise(F.regexp_replace(domain, r"^[^.]+\.", ""))
    return name, domain, suffix


def rule_columns(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule (host and path joined) that decides a row with columns host and path, and its verdict; null where none fits.

    rules: (verdict, host, path). A rule fits its host and all subdomains where the path starts with the rule's; of those
    that fit the longest wins, of equally long ones that of the longer host, then the smaller one."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are tested row by row")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decides, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1:]))[::-1]:
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, decides).otherwise(verdict)
    return name, verdict


def _strength(children: DataFrame) -> float:
    """The strength of the beta prior from which the rates of children(n, f, m) come, m being its mean for each child.

    Method of moments: (f - n m)^2 exceeds its binomial share n m (1 - m) by n (n - 1) m (1 - m) / (strength + 1) on average."""
    spread = F.col("m") * (1 - F.col("m"))
    beyond = F.pow(F.col("f") - F.col("n") * F.col("m"), F.lit(2.0)) - F.col("n") * spread
    above, pairs = children.filter("n > 0").agg(F.sum(beyond), F.sum(F.col("n") * (F.col("n") - 1) * spread)).first()
    if not pairs:
        return WEAK
    return min(max(pairs / above - 1, LEAST), MOST) if above > 0 else MOST


def _shrunk(children: DataFrame, key: str, strength: float) -> DataFrame:
    return children.select(key, ((F.col("f") + F.col("m") * strength) / (F.col("n") + strength)).alias("m"))


def reputations(hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """hosts(name, domain, suffix, n, f), one row for each name, with bad_rate and bad_bound: the mean and the lower posterior bound of its rate of bad outcomes.

    n outcomes of a host are known, f of them bad. Rates shrink from level to level: a suffix towards all outcomes, a
    registered domain towards its suffix, a host towards its domain; each level's prior strength is fitted to the spread
    of its rates. The bound lies `z` posterior deviations below the mean. A host without outcomes has its domain's prior."""
    n, f = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("f"), F.lit(0))).first()
    sums = lambda *keys: hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    suffixes = sums("suffix").withColumn("m", F.lit((f + PRESUMED) / (n + 1)))
    suffixes = _shrunk(suffixes, "suffix", _strength(suffixes))
    domains = common.store(sums("domain", "suffix").join(suffixes, "suffix"), "domains")
    domains = common.store(_shrunk(domains, "domain", _strength(domains)), "domain_rates")
    own = common.store(hosts.join(domains, "domain"), "hosts")
    s = _strength(own)
    a, b = F.col("f") + F.col("m") * s, F.col("n") - F.col("f") + (1 - F.col("m")) * s
    own = own.withColumn("bad_rate", a / (a + b)).withColumn("_sd", F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))
    return own.select("name", "domain", "suffix", "n", "f", "bad_rate", (F.col("bad_rate") - z * F.col("_sd")).alias("bad_bound"))


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = (), page_id: str = "page_id", url: str = "url", limit: float = 0.25, z: float = 1.645,
) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate and bad_bound of every page's url.

    outcomes(page_id, bad): labelled outcomes of pages; a page with several counts once, as bad if any is. A page that a rule fits has the
    rule's verdict; any other one is blocked where the lower posterior bound of its host's rate of bad outcomes is above `limit` (see
    reputations()), and allowed else: a host needs evidence against it, its own or its domain's.

    A missing url or one without `://` has an empty host and path; such pages share the reputation of the empty host. A missing
    outcome or page id is no evidence. Ids may repeat: each row is judged by itself and counts as an outcome of its own host.
    An empty table gives an empty result; without outcomes all pages that no rule blocks are allowed. Other columns are not
    read. Rows of a hot host are summed before the shuffle, and verdicts are joined to a hot host by a broadcast or a split join, as their size is.
    """
    host, path = host_and_path(url)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = common.store(rows.withColumn("name", units("host")[0]), "urls")
    seen = rows.groupBy("page_id", "name").agg(F.count(F.lit(1)).alias("rows"))
    known = outcomes.select(F.col(page_id).cast("long").alias("page_id"), F.col("bad").cast("boolean").alias("bad")).filter("page_id is not null and bad is not null")
    known = known.groupBy("page_id").agg(F.bool_or("bad").alias("bad"))
    counts = seen.join(known, "page_id", "left").groupBy("name").agg(
        F.coalesce(F.sum(F.when(F.col("bad").isNotNull(), F.col("rows"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("bad"), F.col("rows"))), F.lit(0)).alias("f")
    )
    _, domain, suffix = units("name")
    hosts = common.store(counts.select("name", domain.alias("domain"), suffix.alias("suffix"), "n", "f"), "outcomes")
    judged = reputations(hosts, z).select("name", "bad_rate", "bad_bound")
    rule, decides = rule_columns(list(rules))
    out = rows.join(judged, "name", "left")
    verdict = F.coalesce(decides, F.when(F.col("bad_bound") > limit, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "bad_rate", "bad_bound")


#: The rules of the registered query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op11_query(spark, sf_dir: str) -> DataFrame:
    """Outcomes are the labels of the documents that bear the pages' ids: bad are poor (quality 0) and toxic ones."""
    labels = common.table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).alias("bad"))
    out = filter_urls(common.table(spark, sf_dir, "pages"), outcomes, RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def _strength_sql(table: str) -> str:
    return f"""(SELECT CASE WHEN coalesce(p, 0) = 0 THEN {WEAK} WHEN x > 0 THEN least(greatest(p / x - 1, {LEAST}), {MOST}) ELSE {MOST} END
  FROM (SELECT sum(n * (n - 1) * m * (1 - m)) AS p, sum(power(f - n * m, 2) - n * m * (1 - m)) AS x FROM {table} WHERE n > 0))"""


OP11_SQL = rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{_URL}', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '{_URL}', 2) AS path FROM pages),
v AS (SELECT *, regexp_replace(host, '^.*@|:[0-9]*$|\.+$', '', 'g') AS name FROM u),
l AS (SELECT doc_id AS page_id, bool_or(quality = 0 OR coalesce(toxic, 0) = 1) AS bad FROM labels GROUP BY doc_id),
c AS (SELECT name, count(bad)::DOUBLE AS n, count(*) FILTER (WHERE bad)::DOUBLE AS f FROM v LEFT JOIN l USING (page_id) GROUP BY name),
d AS (SELECT *, CASE WHEN regexp_matches(name, '{_ADDRESS}') THEN name ELSE regexp_extract(name, '{_DOMAIN}', 0) END AS domain FROM c),
h AS (SELECT *, CASE WHEN regexp_matches(name, '{_ADDRESS}') THEN '' ELSE regexp_replace(domain, '^[^.]+\.', '') END AS suffix FROM d),
s AS (SELECT suffix, sum(n) AS n, sum(f) AS f, (SELECT (sum(f) + {PRESUMED}) / (sum(n) + 1) FROM h) AS m FROM h GROUP BY suffix),
s1 AS (SELECT suffix, (f + m * k) / (n + k) AS m FROM s, (SELECT {_strength_sql('s')} AS k)),
e AS (SELECT x.*, s1.m FROM (SELECT domain, suffix, sum(n) AS n, sum(f) AS f FROM h GROUP BY domain, suffix) x JOIN s1 USING (suffix)),
e1 AS (SELECT domain, (f + m * k) / (n + k) AS m FROM e, (SELECT {_strength_sql('e')} AS k)),
g AS (SELECT h.*, e1.m FROM h JOIN e1 USING (domain)),
p AS (SELECT name, f + m * k AS a, n - f + (1 - m) * k AS b FROM g, (SELECT {_strength_sql('g')} AS k)),
q AS (SELECT name, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.25 AS bad FROM p),
r AS (SELECT * FROM (VALUES {', '.join(f"('{w}', '{x}', '{y}')" for w, x, y in RULES)}) t(verdict, rhost, rpath)),
w AS (SELECT v.page_id, v.host, v.path, q.bad, (SELECT max_by(rhost || rpath || ' ' || r.verdict, length(rhost || rpath)) FROM r
  WHERE (v.host = rhost OR ends_with(v.host, '.' || rhost)) AND starts_with(v.path, rpath)) AS fit FROM v JOIN q USING (name))
SELECT page_id, host, path, split_part(fit, ' ', 1) AS rule, CASE WHEN fit IS NOT NULL THEN split_part(fit, ' ', 2) WHEN bad THEN 'block' ELSE 'allow' END AS verdict FROM w
"""
