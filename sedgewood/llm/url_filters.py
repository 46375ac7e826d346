"""URL filters: host rules, and link-graph propagation of trust and distrust for pages that no rule judges.

A rule names a host and a path; it fits the host and its subdomains where the page's path starts with the rule's, and
the longest fitting rule decides.  A host of whose pages rules allow over half is a trusted seed, one of whose pages
rules block over half is a blocked seed; a rule for a part of a host says nothing about the rest.  Trust is PageRank
personalised on the trusted seeds along links between hosts; distrust is the same along reversed links from the blocked
seeds.  A host is blocked if its share of distrust passes a threshold; a host that neither reaches is allowed.  Both
spread for ``ITERATIONS`` rounds, so a host more than 10 links from every seed is reached by neither, and a fifth of the
scores at most would still move in more rounds.  All of it is DataFrame functions.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; null html
has no links; repeated rows are judged alike and their links count once; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sedgewood.llm._state import settle

#: Fixed values of the production query: (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ITERATIONS, DAMPING, THRESHOLD = 10, 0.85, 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# no part of the pattern may run past the next "<", nor two parts over the same spaces: a page of open tags is read in linear time
_LINK = r"""(?i)<a\s[^<>]*?href\s{0,8}=\s{0,8}["']?\s{0,8}https?://([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule, else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct links (src, dst) between different hosts."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(_LINK), F.lit(1)))).alias("dst"))
    return links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> '' and dst <> src").distinct()


def propagate(links: DataFrame, seeds: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """(host, score): PageRank personalised on seeds(host); what hosts without links hold goes back to the seeds.

    Only hosts that some seed reaches have a row.  Scores sum to 1, or there is no row if there are no seeds.
    """
    degree = links.groupBy("src").agg(F.count("*").alias("degree"))
    weighted = settle(links.join(degree, "src"))
    n = seeds.count()
    if not n:
        return seeds.select("host", F.lit(0.0).alias("score")).limit(0)
    start = settle(seeds.select("host", F.lit(1.0 / n).alias("score")))
    ranks = start
    for _ in range(iterations):
        passed = ranks.join(weighted, ranks["host"] == weighted["src"]).select(F.col("dst").alias("host"), (damping * F.col("score") / F.col("degree")).alias("score"))
        moved = passed.groupBy("host").agg(F.sum("score").alias("score"))
        # a single row: what was not passed on
        back = moved.agg((1.0 - F.coalesce(F.sum("score"), F.lit(0.0))).alias("back")).first()["back"]
        ranks = settle(moved.union(start.select("host", (F.col("score") * F.lit(back)).alias("score"))).groupBy("host").agg(F.sum("score").alias("score")))
    return ranks


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, iterations: int = ITERATIONS, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule and verdict of each row."""
    verdicts = F.lit(None).cast("string")
    for rule, verdict in rules:
        verdicts = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(verdicts)
    named = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    ruled = named.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("by_rule", verdicts)
    links = settle(host_links(pages, url_col, html_col))
    empty = links.isEmpty()
    judged = settle(ruled.groupBy("host").agg(F.count("*").alias("n"), *(F.count_if(F.col("by_rule") == v).alias(v) for v in ("allow", "block"))))
    scores = {}
    for name, verdict in (("trust", "allow"), ("distrust", "block")):
        seeds = judged.where(2 * F.col(verdict) > F.col("n")).select("host")
        ways = links if name == "trust" else links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        if empty:  # nothing spreads: the seeds hold all
            n = seeds.count()
            scores[name] = seeds.select("host", F.lit(1.0 / max(n, 1)).alias(name))
        else:
            scores[name] = propagate(ways, seeds, iterations, damping).withColumnRenamed("score", name)
    both = scores["trust"].join(scores["distrust"], "host", "full").select("host", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")))
    hosts = both.withColumn("bad", F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")))
    out = ruled.join(hosts, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.coalesce("bad", F.lit(False)), "block").otherwise("allow")).alias("verdict"))


def judge_sql(rules=RULES, iterations: int = ITERATIONS, damping: float = DAMPING, threshold: float = THRESHOLD) -> str:
    """The same as DuckDB SQL, the iterations written out."""
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        name, _, rest = rule.partition("/")
        fits.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN '{rule}'")
    by = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in rules)
    link = _LINK.replace("'", "''")
    sql = f"""WITH p AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE {' '.join(fits)} END AS rule FROM p),
v AS (SELECT *, CASE rule {by} END AS by_rule FROM r),
links AS (SELECT DISTINCT src, dst FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{_UPPER}', '{_LOWER}') AS dst FROM p) WHERE src <> '' AND dst <> src)"""
    for name, verdict, a, b in (("trust", "allow", "src", "dst"), ("distrust", "block", "dst", "src")):
        sql += f""",
{name}_links AS (SELECT {a} AS src, {b} AS dst, count(*) OVER (PARTITION BY {a}) AS degree FROM links),
{name}_seeds AS (SELECT host, 1.0::DOUBLE / count(*) OVER () AS score FROM (SELECT host FROM v GROUP BY host HAVING 2 * count(*) FILTER (by_rule = '{verdict}') > count(*))),
{name}_0 AS (SELECT * FROM {name}_seeds)"""
        for i in range(iterations):
            sql += f""",
{name}_m{i} AS (SELECT dst AS host, sum({damping}::DOUBLE * score / degree) AS score FROM {name}_{i} JOIN {name}_links ON host = src GROUP BY dst),
{name}_{i + 1} AS (SELECT host, sum(score) AS score FROM (SELECT * FROM {name}_m{i} UNION ALL
    SELECT host, score * (1.0 - coalesce((SELECT sum(score) FROM {name}_m{i}), 0.0)) FROM {name}_seeds) GROUP BY host)"""
    last = f"_{iterations}"
    return sql + f"""
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN coalesce(d.score, 0) > {threshold}::DOUBLE * (coalesce(t.score, 0) + coalesce(d.score, 0)) THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN trust{last} AS t USING (host) LEFT JOIN distrust{last} AS d USING (host)"""
