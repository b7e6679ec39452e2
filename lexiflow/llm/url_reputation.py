"""URL filter: explicit host/path rules, then an empirical-Bayes reputation of the host.

Labelled page outcomes (1 good, 0 bad) are counted per host, registered domain and suffix. The suffix is the last label,
or the last two where these are in ``SUFFIXES``; the registered domain has one label more. Each level is a beta-binomial whose prior mean is the posterior mean of the level above and whose prior
strength is the method-of-moments estimate over all groups of that level. A host is allowed if its posterior lower
bound reaches ``floor``. Counts are partial aggregates, so a host with a third of all pages costs no more than others;
the join back goes by host and leaves hot hosts to Spark's skew-join splitting.

Edge cases: a null url or one without ``://`` has an empty host and path; such pages form one host like any other.
Null outcomes count as unlabelled; pages with several outcomes are good only if all are. With no outcomes at all the
base rate is 0.5. Repeated pages are judged alike; ties between rules of equal length go to the first in the table.
Empty tables give empty results. Extra columns of the input stay; those named like an output are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: (verdict, host, path prefix): a rule fits its host and every subdomain.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Suffixes of two labels below which names are registered; others have one label. Pass a table of your own for more.
SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.nz", "org.nz", "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp",
    "co.kr", "or.kr", "com.cn", "net.cn", "org.cn", "gov.cn", "com.tw", "org.tw", "com.hk", "com.sg", "com.my", "co.id", "co.th", "com.vn", "com.ph", "co.in", "net.in",
    "org.in", "com.br", "org.br", "gov.br", "com.ar", "com.mx", "com.co", "com.pe", "co.za", "org.za", "com.ng", "co.ke", "com.eg", "com.tr", "org.tr", "com.ua", "co.il",
    "org.il", "com.pl", "com.pt", "com.es", "com.gr",
)
Z, FLOOR = 1.645, 0.5
STRENGTH = (2.0, 1000.0)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    return F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """The path right behind the host; empty where ``?``, ``#`` or the end comes first."""
    return F.regexp_extract(_rest(url), "^[^/?#]*(/[^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null: one CASE, longest first."""
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2]) for r in order]
    case = lambda values: reduce(lambda c, x: c.when(x[0], F.lit(x[1])), zip(fits[1:], values[1:]), F.when(fits[0], F.lit(values[0])))
    if not order:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return case([r[1] + r[2] for r in order]), case([r[0] for r in order])


def _last(n: int) -> Column:
    """The last ``n`` labels of the host, or all where it has fewer."""
    labels = F.split("host", r"\.")
    return F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n))


def domain_and_suffix(suffixes=SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of the column ``host``."""
    two = _last(2).isin(*suffixes) if suffixes else F.lit(False)
    return F.when(two, _last(3)).otherwise(_last(2)), F.when(two, _last(2)).otherwise(_last(1))


def _strength(groups: DataFrame) -> tuple[float, float]:
    """Base rate and prior strength of (g, n) groups, as one row of moments."""
    row = groups.agg(F.sum("g").alias("g"), F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("g") * F.col("g") / F.col("n")).alias("q")).first()
    if not row["n"]:
        return 0.5, STRENGTH[0]
    p = row["g"] / row["n"]
    within = p * (1 - p)
    between = row["q"] / row["n"] - p * p - within * row["k"] / row["n"]
    k = within / between - 1 if between > 1e-9 else STRENGTH[1]
    return p, min(max(k, STRENGTH[0]), STRENGTH[1])


def host_reputation(outcomes: DataFrame, z: float = Z, suffixes=SUFFIXES) -> DataFrame:
    """(host, n, g, mean, lower) of labelled hosts, and the rows of domains and suffixes under level.

    ``outcomes``: (host, good). The result has a row per (level, name), level one of host, domain, suffix.
    """
    from .common import stored

    domain, suffix = domain_and_suffix(suffixes)
    hosts = stored(outcomes.groupBy("host").agg(F.sum("good").cast("double").alias("g"), F.count("good").cast("double").alias("n")).withColumns({"domain": domain, "suffix": suffix}).filter("n > 0"), "hosts")
    up = lambda by: hosts.groupBy(*by).agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    domains, suffixes = up(["domain", "suffix"]), up(["suffix"])
    base, k_suffix = _strength(suffixes)
    k_domain, k_host = _strength(domains)[1], _strength(hosts)[1]
    mean = lambda prior, k: (F.col("g") + prior * k) / (F.col("n") + k)
    s = suffixes.withColumn("m", mean(F.lit(base), k_suffix)).select("suffix", F.col("m").alias("m_suffix"), F.col("n").alias("n_suffix"))
    d = domains.join(s, "suffix").withColumn("m", mean(F.col("m_suffix"), k_domain)).select("domain", F.col("m").alias("m_domain"), F.col("n").alias("n_domain"))
    h = hosts.join(d, "domain").withColumn("m", mean(F.col("m_domain"), k_host))
    bound = lambda m, n: m - F.lit(z) * F.sqrt(m * (1 - m) / (n + 1))
    rows = [
        h.select(F.lit("host").alias("level"), F.col("host").alias("name"), "m", (F.col("n") + k_host).alias("w")),
        d.select(F.lit("domain").alias("level"), F.col("domain").alias("name"), F.col("m_domain").alias("m"), F.lit(k_host).alias("w")),
        s.select(F.lit("suffix").alias("level"), F.col("suffix").alias("name"), F.col("m_suffix").alias("m"), F.lit(min(k_host, k_domain)).alias("w")),
        hosts.sparkSession.range(1).select(F.lit("base").alias("level"), F.lit("").alias("name"), F.lit(base).alias("m"), F.lit(min(k_host, k_domain, k_suffix)).alias("w")),
    ]
    return reduce(DataFrame.unionByName, rows).withColumn("lower", bound(F.col("m"), F.col("w")))


def url_verdicts(pages: DataFrame, outcomes: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, z: float = Z, floor: float = FLOOR, suffixes=SUFFIXES) -> DataFrame:
    """Pages with host, path, rule, verdict and ``lower``, the posterior bound of the most specific level that is known.

    ``outcomes``: (``key``, good), any number of rows per page.
    """
    from .common import stored

    domain, suffix = domain_and_suffix(suffixes)
    new = {"host", "path", "rule", "verdict", "lower"}
    pages = pages.drop(*new).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    good = outcomes.filter(F.col("good").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min("good").alias("good"))
    reputation = stored(host_reputation(pages.select(key, "host").join(good, key).select("host", "good"), z, suffixes), "reputation")
    level = lambda name: reputation.filter(F.col("level") == name).select(F.col("name").alias(f"__{name}"), F.col("lower").alias(f"__{name}_lower"))
    base = reputation.filter("level = 'base'").first()["lower"]
    # The levels are joined to the distinct hosts, then once to the pages.
    known = pages.select("host").distinct().withColumns({"__domain": domain, "__suffix": suffix}).withColumn("__host", F.col("host"))
    for name in ("host", "domain", "suffix"):
        known = known.join(level(name), f"__{name}", "left")
    known = known.select("host", F.coalesce("__host_lower", "__domain_lower", "__suffix_lower", F.lit(base)).alias("lower"))
    # Written, so that the join with the pages shares its shuffle with no aggregate and Spark can split a hot host.
    known = stored(known, "known")
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    out = pages.join(known, "host", "left").withColumn("rule", rule)
    return out.withColumn("verdict", F.coalesce(verdict, F.when(F.col("lower") >= floor, F.lit("allow")).otherwise(F.lit("block"))))


def page_outcomes(labels: DataFrame) -> DataFrame:
    """Outcome of a page from its labels: good if of quality and not toxic; null where either is missing."""
    return labels.select(F.col("doc_id").alias("page_id"), F.when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good"))


def op10_url_reputation(spark, sf_dir: str) -> DataFrame:
    from .common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_verdicts(pages, page_outcomes(table(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict")


def _last_sql(n: int) -> str:
    return f"array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - {n - 1}, 1), len(string_split(host, '.'))), '.')"


def _k(t: str) -> str:
    return f"""(SELECT CASE WHEN n IS NULL THEN {STRENGTH[0]} ELSE least(greatest(CASE WHEN q / n - p * p - p * (1 - p) * k / n > 1e-9
        THEN p * (1 - p) / (q / n - p * p - p * (1 - p) * k / n) - 1 ELSE {STRENGTH[1]} END, {STRENGTH[0]}), {STRENGTH[1]}) END
        FROM (SELECT sum(n) AS n, sum(g) / sum(n) AS p, count(*) AS k, sum(g * g / n) AS q FROM {t}))"""


_TWO = f"{_last_sql(2)} IN ({', '.join(repr(x) for x in SUFFIXES)})"
_NAMES = f"CASE WHEN {_TWO} THEN {_last_sql(3)} ELSE {_last_sql(2)} END AS domain, CASE WHEN {_TWO} THEN {_last_sql(2)} ELSE {_last_sql(1)} END AS suffix"
_FITS = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
ORACLE_SQL = f"""
WITH p0 AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p1 AS (SELECT page_id, rest, split_part(split_part(split_part(rest, '/', 1), '?', 1), '#', 1) AS name FROM p0),
p AS (SELECT page_id, translate(name, '{UPPER}', '{LOWER}') AS host,
      CASE WHEN substr(rest, length(name) + 1, 1) = '/' THEN split_part(split_part(substr(rest, length(name) + 1), '?', 1), '#', 1) ELSE '' END AS path FROM p1),
o AS (SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels
      WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1),
h AS (SELECT host, {_NAMES}, sum(good)::DOUBLE AS g, count(*)::DOUBLE AS n FROM p JOIN o USING (page_id) GROUP BY host),
d AS (SELECT domain, suffix, sum(g) AS g, sum(n) AS n FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(g) AS g, sum(n) AS n FROM h GROUP BY ALL),
k AS (SELECT {_k('h')} AS kh, {_k('d')} AS kd, {_k('s')} AS ks, coalesce((SELECT sum(g) / sum(n) FROM s), 0.5) AS base),
ms AS (SELECT suffix, (g + base * ks) / (n + ks) AS m FROM s, k),
md AS (SELECT domain, (g + m * kd) / (n + kd) AS m FROM d JOIN ms USING (suffix), k),
mh AS (SELECT host, (g + m * kh) / (n + kh) AS m, n + kh AS w FROM h JOIN md USING (domain), k),
u AS (SELECT *, {_NAMES} FROM p),
r AS (SELECT page_id, u.host, path, coalesce(mh.m - {Z} * sqrt(mh.m * (1 - mh.m) / (mh.w + 1)), md.m - {Z} * sqrt(md.m * (1 - md.m) / (kh + 1)),
             ms.m - {Z} * sqrt(ms.m * (1 - ms.m) / (least(kh, kd) + 1)), base - {Z} * sqrt(base * (1 - base) / (least(kh, kd, ks) + 1))) AS lower
      FROM u LEFT JOIN mh ON u.host = mh.host LEFT JOIN md ON u.domain = md.domain LEFT JOIN ms ON u.suffix = ms.suffix, k)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {c} THEN '{t}'" for c, t, _ in _FITS)} END AS rule,
       CASE {' '.join(f"WHEN {c} THEN '{v}'" for c, _, v in _FITS)} WHEN lower >= {FLOOR} THEN 'allow' ELSE 'block' END AS verdict
FROM r
"""
