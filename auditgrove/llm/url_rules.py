"""URL verdicts with redirect equivalence.

A rule (host, path, verdict) fits its host and all subdomains if the path of the URL starts with the rule's; of the rules that fit, the
longest wins. URLs without a rule of their own take part in an equivalence relation: canonical links and refresh redirects found
in the pages, plus given redirect edges, join URLs into connected components, and a component with a URL that a rule
blocks blocks its other members. A URL's own rule comes first, so an explicit allow is never overridden by an alias;
a URL that neither rule nor alias decides is allowed.

Nodes are URLs without scheme and fragment, host in lower case. Only DataFrame functions are used. Rules are plan
expressions, so their number should stay in the hundreds.

Defined results: null URLs and URLs without ``://`` have empty host and path, fit no rule and have no alias; links without
``://`` are taken relative to the page's host or folder, other schemes than those with ``://`` and bare queries are ignored; repeated pages share a
node; null html has no links; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditgrove.llm.components import connected_components
from auditgrove.llm.shared import Scratch, alias_free

#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
LINK = r"(?is)<link\b[^>]*\brel\s*=\s*(?:\"[^\">]*\bcanonical\b|'[^'>]*\bcanonical\b|canonical\b)[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """Identity of a URL as a node; null without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), rest))


def rule_column(host: Column, path: Column, rules=None) -> Column:
    """The rule that decides, as a struct of name and verdict; null if none fits."""
    out = F.lit(None)
    for verdict, rule_host, rule_path in sorted(rules or RULES, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def link_edges(pages: DataFrame) -> DataFrame:
    """Edges (a, b) from page URLs to their canonical and refresh targets."""
    html = F.coalesce(F.col("html"), F.lit(""))
    tags = F.concat(F.regexp_extract_all(html, F.lit(LINK), 0), F.regexp_extract_all(html, F.lit(REFRESH), 0))
    found = pages.where(F.contains(html, F.lit("<"))).select(F.col("url").alias("page"), F.explode(tags).alias("tag"))
    href = F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    target = F.regexp_extract("tag", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    link = F.when(href != "", href).otherwise(target)
    for reference, character in (("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&")):  # what URLs in attributes need
        link = F.replace(link, F.lit(reference), F.lit(character))
    plain = (link != "") & ~F.contains(link, F.lit("://")) & ~link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~link.rlike("^[/?#]")
    folder = F.regexp_extract(path_of(F.col("page")), r"(?s)^(.*/)", 1)
    link = F.when(plain, F.concat(F.lit("http://"), host_of(F.col("page")), F.when(folder == "", "/").otherwise(folder), link)).otherwise(link)
    link = F.when(F.startswith(link, F.lit("//")), F.concat(F.lit("http:"), link)).when(F.startswith(link, F.lit("/")), F.concat(F.lit("http://"), host_of(F.col("page")), link)).otherwise(link)
    return found.select(node_of(F.col("page")).alias("a"), node_of(link).alias("b")).where("a is not null and b is not null")


def judge_pages(pages: DataFrame, redirects: DataFrame | None = None, rules=None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; ``redirects`` has columns source and target (URLs)."""
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "urls")
    pages = alias_free(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("own", rule_column(F.col("host"), F.col("path"), rules))
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b")))
    comps = scratch.keep(connected_components(edges, scratch), "components")
    member = F.concat(F.lit("x://"), F.col("node"))
    blocked = comps.withColumn("own", rule_column(host_of(member), path_of(member), rules)).groupBy("component").agg(F.coalesce(F.bool_or(F.col("own.verdict") == "block"), F.lit(False)).alias("blocked"))
    aliases = comps.join(blocked.where("blocked"), "component").select("node", F.lit("block").alias("alias_verdict"))
    known = judged.withColumn("node", node_of(F.col("url")))
    # pages without a node, however many, take no part in the join
    out = known.where("node is not null").join(aliases, "node", "left").unionByName(known.where("node is null").withColumn("alias_verdict", F.lit(None).cast("string")))
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "alias_verdict", F.lit("allow")).alias("verdict"))


#: The test pages hold no canonical links or redirects, so on them the verdict of a page without a rule is allow.
ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(verdict, rule_host, rule_path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
"""
