"""URL filters: host-suffix and path-prefix expressions, an equi-join on short hash prefixes, digests and precedence.

Each distinct URL is expanded into the expressions that any rule could name (every host suffix with every path prefix
of a length that occurs among the rules), hashed once with SHA-256. Rules and expressions meet in an equi-join on the
first four bytes; the full digest confirms a match, and the longest rule wins. Copies of a URL are judged once, and
the verdicts come back by an equi-join on the URL that Spark may split where one URL holds many pages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import fresh, lower_az

#: (verdict, host, path) of the given rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: The deployment's own list of hosts, which decides only where no given rule fits.
OWN_RULES = (
    ("block", "cheap-pills.example.com", ""),
    ("block", "cheap-pills.example.net", ""),
    ("block", "spam-farm.example.com", ""),
    ("block", "spam-farm.example.net", ""),
)
#: Hex digits of the hash prefix that rules and expressions are joined on.
PREFIX_DIGITS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A–Z lower-cased) and path; both empty for a null url or one without ``://``."""
    rest = F.regexp_extract(url, r"(?s)://(.*)", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(lower_az(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(docs: DataFrame, rules: Sequence[tuple[str, str, str]], own: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules with their digests: verdict, rule, size, given (own rules have lower precedence)."""
    rows = [(*r, True) for r in rules] + [(*r, False) for r in own]
    frame = docs.sparkSession.createDataFrame(rows, "verdict string, rule_host string, rule_path string, given boolean")
    return frame.select(
        "verdict",
        "given",
        F.length("rule_path").alias("path_size"),
        F.concat("rule_host", "rule_path").alias("rule"),
        F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256).alias("digest"),
    )


def expressions(host: Column, path: Column, path_sizes: Sequence[int]) -> Column:
    """(host suffix, path prefix) of all suffixes at a dot and all prefixes of one of the sizes."""
    labels = F.split(host, r"\.")
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    )
    sizes = F.filter(F.array(*[F.lit(n) for n in path_sizes]), lambda n: n <= F.length(path))
    return F.flatten(
        F.transform(
            hosts, lambda h: F.transform(sizes, lambda n: F.struct(h.alias("h"), F.substring(path, F.lit(1), n).alias("p")))
        )
    )


def judged_urls(
    urls: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    own: Sequence[tuple[str, str, str]] = OWN_RULES,
) -> DataFrame:
    """url, host, path, rule, verdict of the distinct urls in the column ``url``."""
    table = rule_table(urls, rules, own)
    # the sizes of a rule list's paths are few: none is longer than a URL
    sizes = sorted({len(p) for _, _, p in (*rules, *own)})
    host, path = host_and_path(F.col("url"))
    distinct = urls.groupBy("url").agg(F.lit(1).alias("one")).select("url", host.alias("host"), path.alias("path"))
    expanded = distinct.select("url", "host", "path", F.explode_outer(expressions(F.col("host"), F.col("path"), sizes)).alias("x"))
    hashed = expanded.withColumn("full", F.sha2(F.concat_ws("\n", "x.h", "x.p"), 256))
    short = F.substring("full", 1, PREFIX_DIGITS)
    hit = hashed.withColumn("short", short).join(
        table.withColumn("short", F.substring("digest", 1, PREFIX_DIGITS)), "short", "left"
    )
    hit = hit.withColumn("ok", F.coalesce(F.col("full") == F.col("digest"), F.lit(False)))
    # the given rules first, then the longest; a tie goes to block, the later word
    rank = F.when(F.col("ok"), F.struct("given", F.length("rule").alias("n"), "verdict", "rule"))
    best = hit.groupBy("url", "host", "path").agg(F.max(rank).alias("best"))
    other = F.when(F.col("host") == "", F.lit("block")).otherwise(F.lit("allow"))
    return best.select(
        "url",
        "host",
        "path",
        F.when(F.col("best.given"), F.col("best.rule")).alias("rule"),
        F.coalesce("best.verdict", other).alias("verdict"),
    )


def filter_urls(
    pages: DataFrame,
    *,
    keep: Sequence[str] = ("page_id",),
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    own: Sequence[tuple[str, str, str]] = OWN_RULES,
) -> DataFrame:
    """Columns ``keep``, host, path, rule and verdict of every page.

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest wins. Where no given
    rule fits, rule is null and the deployment's own rules decide, then: an empty host is blocked, others are allowed.
    A null or malformed url has empty host and path.
    """
    url = fresh([*pages.columns, "host", "path", "rule", "verdict"], "url__")
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{url_col}`").alias(url))
    # a null url is judged like the empty one, so that a plain equi-join brings all verdicts back
    rows = rows.withColumn(url, F.coalesce(url, F.lit("")))
    found = judged_urls(rows.select(F.col(url).alias("url")), rules, own).withColumnRenamed("url", url)
    return rows.join(found, url).select(*[F.col(f"`{c}`") for c in keep], "host", "path", "rule", "verdict")


#: DuckDB SQL of ``filter_urls`` with the rules above: every rule is tried on every page.
SQL = r"""
WITH p AS (SELECT page_id, coalesce(regexp_extract(url, '://((?s:.*))', 1), '') AS rest FROM {pages}),
hp AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h0, rest FROM p),
u AS (SELECT row_number() OVER () AS k, page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') AS path FROM hp),
r(verdict, rh, rp, given) AS (VALUES {rules}),
hit AS (SELECT k, r.* FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
best AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY given DESC, length(rh || rp) DESC, verdict DESC) AS n FROM hit)
SELECT page_id, host, path, CASE WHEN given THEN rh || rp END AS rule,
       coalesce(verdict, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN (SELECT * FROM best WHERE n = 1) b USING (k)
"""


def sql(pages: str = "pages") -> str:
    rows = [(r, "true") for r in RULES] + [(r, "false") for r in OWN_RULES]
    values = ", ".join(f"('{v}', '{h}', '{p}', {given})" for (v, h, p), given in rows)
    return SQL.format(pages=pages, rules=values)
