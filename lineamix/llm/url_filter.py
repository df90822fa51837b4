"""URL filter: host and path rules, and block decisions handed on to redirect and canonical aliases.

DataFrame functions only. Rules meet addresses by equi-joins on host suffix and path prefix;
aliases are connected components over the links between addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lineamix.llm.common import LOWER, UPPER, table, written
from lineamix.llm.components import components

ALLOW, BLOCK = "allow", "block"
#: Fixed rules of the registered query.
QUERY_RULES = (
    ("com/", ALLOW),
    ("example.com/en/", BLOCK),
    ("www.example.com/en/", ALLOW),
    ("net/es/", BLOCK),
    ("net/fr/", BLOCK),
)
CANONICAL = r"(?i)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)"
REFRESH = r"(?i)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_URL = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or end; empty without ``://``."""
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """What names one page among its aliases: host, path and query. NULL without a host.

    Scheme and fragment are left out: they do not lead to another document.
    """
    query = F.regexp_extract(_rest(url), r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(host(url) != "", F.concat(host(url), path(url), query))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise("")


def _absolute(target: Column, base: Column) -> Column:
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    return (
        F.when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.contains("://"), target)
        .when(target.startswith("/"), F.concat(F.lit("http://"), host(base), target))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target): the first canonical link and the first meta refresh of each page.

    Targets that are neither absolute nor begin with ``/`` are no links; NULL html has none.
    """
    tags = pages.select(
        "url",
        F.explode(F.array(
            F.regexp_extract(F.regexp_extract("html", CANONICAL, 1), HREF, 1),
            F.regexp_extract(F.regexp_extract("html", REFRESH, 1), REFRESH_URL, 1),
        )).alias("target"),
    )
    found = tags.where("target <> ''").select("url", _absolute(F.col("target"), F.col("url")).alias("target"))
    return found.where("target IS NOT NULL")


def match_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest fitting rule of each distinct (host, path): (host, path, rule, verdict).

    ``rules`` has (rule, verdict) with rules like ``net/`` (host, then the path's beginning); of
    the same rule with two verdicts, allow holds. Hosts are cut into their suffixes and paths into
    prefixes of those lengths that rules of that suffix have, so that no pair is formed that does
    not fit, however many rules a host has. Places without a fitting rule are not returned.
    """
    rules = rules.groupBy("rule").agg(F.min("verdict").alias("verdict")).select(
        "rule", "verdict",
        F.substring_index("rule", "/", 1).alias("suffix"),
        F.expr("substring(rule, instr(rule, '/'))").alias("prefix"),
    ).where("instr(rule, '/') > 0")
    lengths = rules.select("suffix", F.length("prefix").alias("n")).distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    cut = (
        places.select("host", "path").distinct()
        .withColumn("suffix", F.explode(suffixes))
        .join(lengths, "suffix")
        .where("n <= length(path)")
        .withColumn("prefix", F.expr("substring(path, 1, n)"))
    )
    best = cut.join(rules, ["suffix", "prefix"]).groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best")
    )
    return best.select("host", "path", "best.rule", "best.verdict")


def filter_urls(urls: DataFrame, links: DataFrame, rules: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Judge every row of ``urls`` (id, url): (id, host, path, rule, verdict, component).

    ``links`` has (url, target). The verdict is that of the longest rule that fits the row's own
    url. Without such a rule the row takes part in the decision of its aliases, the component of
    its address over all links in either direction: an explicit allow anywhere in it allows, else
    an explicit block blocks. Else the row is allowed. NULL urls and urls without ``://`` have
    empty host and path and no aliases, and are allowed; repeated rows are judged alike.
    ``component`` is the smallest address among the aliases, NULL without links.
    """
    ends = links.select(
        *(f(F.col(c)).alias(name) for c, side in (("url", "a"), ("target", "b"))
          for f, name in ((address, side), (host, f"{side}_host"), (path, f"{side}_path")))
    ).where("a IS NOT NULL AND b IS NOT NULL")
    ends = written(ends, "links")
    linked = ends.select(F.col("a").alias("node"), F.col("a_host").alias("host"), F.col("a_path").alias("path")).union(
        ends.select("b", "b_host", "b_path")
    ).distinct()
    judged = urls.select(
        F.col(id_col).alias(id_col), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
        address(F.col("url")).alias("node"),
    )
    matches = written(
        match_rules(judged.select("host", "path").union(linked.select("host", "path")), rules), "matches"
    )
    aliases = written(components(ends.select("a", "b")), "aliases")
    decided = (
        aliases.join(linked, "node").join(matches, ["host", "path"])
        .groupBy("component").agg(F.min("verdict").alias("handed_on"))
    )
    inherited = written(aliases.join(decided, "component", "left"), "inherited")
    return (
        judged.join(matches, ["host", "path"], "left").join(inherited, "node", "left")
        .select(id_col, "host", "path", "rule", F.coalesce("verdict", "handed_on", F.lit(ALLOW)).alias("verdict"), "component")
    )


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(QUERY_RULES, "rule string, verdict string")
    return filter_urls(pages, page_links(pages), rules)


def _sql_rest(url: str) -> str:
    return f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"


def _sql_host(url: str) -> str:
    return f"translate(regexp_extract({_sql_rest(url)}, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}')"


def _sql_path(url: str) -> str:
    return f"regexp_extract({_sql_rest(url)}, '^[^/?#]*([^?#]*)', 1)"


def _sql_address(url: str) -> str:
    query = rf"regexp_extract({_sql_rest(url)}, '^[^?#]*(\?[^#]*)', 1)"
    return f"CASE WHEN {_sql_host(url)} <> '' THEN {_sql_host(url)} || {_sql_path(url)} || {query} END"


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


URL_FILTER_SQL = f"""
WITH RECURSIVE rules(rule, verdict) AS (VALUES {", ".join(f"('{r}', '{v}')" for r, v in QUERY_RULES)}),
tags AS (
  SELECT url, regexp_extract(regexp_extract(html, {_sql_text(CANONICAL)}, 1), {_sql_text(HREF)}, 1) AS target FROM pages
  UNION ALL
  SELECT url, regexp_extract(regexp_extract(html, {_sql_text(REFRESH)}, 1), {_sql_text(REFRESH_URL)}, 1) FROM pages
), links AS (
  SELECT url, CASE WHEN starts_with(t, '//') THEN 'http:' || t WHEN contains(t, '://') THEN t
    WHEN starts_with(t, '/') THEN 'http://' || {_sql_host("url")} || t END AS target
  FROM (SELECT url, replace(target, '&amp;', '&') AS t FROM tags WHERE target <> '')
), ends AS (
  SELECT DISTINCT {_sql_address("url")} AS a, {_sql_address("target")} AS b, {_sql_host("target")} AS host, {_sql_path("target")} AS path
  FROM links WHERE {_sql_address("url")} IS NOT NULL AND {_sql_address("target")} IS NOT NULL
), steps AS (SELECT a, b FROM ends UNION SELECT b, a FROM ends),
reach(node, other) AS (
  SELECT a, a FROM steps UNION SELECT r.node, s.b FROM reach r JOIN steps s ON s.a = r.other
), aliases AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
own AS (
  SELECT page_id, {_sql_host("url")} AS host, {_sql_path("url")} AS path, {_sql_address("url")} AS node FROM pages
), places AS (SELECT host, path, node FROM own UNION SELECT host, path, b FROM ends),
fits AS (
  SELECT host, path, node, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM places JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
    AND starts_with(path, substr(rule, strpos(rule, '/')))
  GROUP BY host, path, node
), decided AS (
  SELECT component, min(verdict) AS handed_on FROM aliases JOIN fits USING (node) GROUP BY component
)
SELECT page_id, own.host, own.path, rule, coalesce(verdict, handed_on, 'allow') AS verdict, component
FROM own LEFT JOIN fits ON fits.host = own.host AND fits.path = own.path AND fits.node IS NOT DISTINCT FROM own.node
LEFT JOIN aliases ON aliases.node = own.node LEFT JOIN decided USING (component)
"""
