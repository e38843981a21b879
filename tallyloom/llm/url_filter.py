"""URL rules with redirect equivalence.

Rules name a host (with its subdomains) and a path prefix; the longest that fits decides. A page that
no rule names takes the decision of its aliases: redirect and canonical-link edges join URLs into
components, found by distributed connected components, and a component with a blocked member is blocked
unless one of its members is explicitly allowed.

Defined cases: a null URL or one without :// has an empty host and path and fits no rule; pages without
aliases and rules are allowed; edges to URLs that are no pages count, as those URLs are judged by the
rules too; repeated rows are judged alike; null html has no edges, nor have links inside comments or inside elements whose
content is no markup of the page (scripts, styles, templates, text areas, titles). Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, connected_components, lookup_by_group, stage

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


RAW = ("script", "style", "template", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
#: Comments and raw elements, whichever begins first; one that never ends goes on to the end of the page.
UNSEEN = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{e}\b[^>]*>.*?(?:</{e}\b|\z)" for e in RAW)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(F.coalesce(rest, F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The URL as a node: without scheme and fragment, host in lower case. Null without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(F.lit("x://"), host_of(url), rest))


def _without_dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for k, part in enumerate(parts):
        if part in (".", ".."):
            if part == "..":
                del out[-1:]
            if k == len(parts) - 1:
                out.append("")
        else:
            out.append(part)
    return "/" + "/".join(out)


def resolve(base: str, reference: str) -> str | None:
    """The URL that a reference names, read from base; None if it is empty, of a scheme without ://, or base is no URL."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", reference):
        return reference if "://" in reference else None
    if reference.startswith("//"):
        return f"x:{reference}"
    whole = re.match(r"(?s)(.*?://[^/?#]*)([^?#]*)(\?[^#]*)?", base)
    if not whole or not reference:
        return None
    host, path, query = whole[1], whole[2], whole[3] or ""
    if reference[0] == "#":
        return host + path + query
    if reference[0] == "?":
        return host + path + reference
    own, rest = re.match(r"(?s)([^?#]*)(.*)", reference).groups()
    return host + _without_dots(own if own[0] == "/" else (path[: path.rfind("/") + 1] or "/") + own) + rest


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (url, base, target): the page and its target, with character references read and <base href> heeded."""
    for batch in batches:
        urls, bases, targets = ([unescape(v).strip(" \t\n\f\r") if k else v for v in c.to_pylist()] for k, c in enumerate(batch.columns))
        found = [resolve(resolve(u, b) or u, t) for u, b, t in zip(urls, bases, targets)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["url", "whole"])


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b): from each page to its canonical link and its redirect by meta refresh, absolute or relative to the page or its base."""
    attribute = r"(?is)\b%s\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    first_base = F.regexp_extract("html", r"(?is)<base\b[^>]*\bhref\b[^>]*>", 0)
    seen = F.regexp_replace("html", UNSEEN, "")  # what stands in a comment or a script is no link
    named = pages.where(F.col("html").rlike("(?i)canonical|refresh")).select("url", seen.alias("html"))
    tag = named.select("url", first_base.alias("base"), F.explode(tags).alias("t"))
    tag = stage(tag.where(F.col("t").rlike("(?i)canonical|refresh")), "tags")

    def value(name: str, of: str = "t") -> Column:
        return F.concat(*[F.regexp_extract(of, attribute % name, k) for k in (1, 2, 3)])

    link = F.when(F.lower(value("rel")).rlike(r"\bcanonical\b"), value("href"))
    refresh = F.when(F.lower(value("http-equiv")) == "refresh", F.regexp_extract(value("content"), r"(?is)\burl\s*=\s*['\"]?([^'\"]*)", 1))
    aimed = tag.select("url", value("href", "base").alias("base"), F.coalesce(link, refresh).alias("target"))
    aimed = stage(aimed.where("url is not null and target is not null"), "targets")
    links = stage(aimed.mapInArrow(_resolved, "url string, whole string"), "links")
    return links.select(node_of(F.col("url")).alias("a"), node_of(F.col("whole")).alias("b")).where("a is not null and b is not null")


def judged(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Add rule and action (null where none fits) to staged rows with host and path.

    Rules are joined to the distinct hosts, one suffix each; rows then look up their host's rules,
    longest first, whatever share of them one host has.
    """
    hosts = rows.groupBy("host").agg(F.count("*").alias("_n"))
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fit = F.struct(
        (-F.length(F.concat("rule_host", "rule_path"))).alias("order"), "rule_path", F.concat("rule_host", "rule_path").alias("rule"), "action"
    )
    suffixed = hosts.select("host", F.explode(suffixes).alias("rule_host"))
    fitting = suffixed.join(rules, "rule_host").groupBy("host").agg(F.sort_array(F.collect_list(fit)).alias("_rules"))
    known = stage(hosts.join(fitting, "host", "left"), "hosts")
    found = lookup_by_group(rows, known, "host", "_n")
    first = F.get(F.filter("_rules", lambda r: F.col("path").startswith(r["rule_path"])), 0)
    return found.withColumn("_rule", first).select(*rows.columns, F.col("_rule.rule").alias("rule"), F.col("_rule.action").alias("action"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, action string").dropDuplicates(["rule_host", "rule_path"])


def filter_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every page. redirects: further (a, b) URL pairs."""
    urls = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    rows = stage(judged(stage(urls, "urls"), rules), "judged")
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")))
    joined = connected_components(edges)
    nodes = joined.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    members = stage(judged(stage(nodes, "nodes"), rules), "members")
    verdicts = members.groupBy("component").agg(
        F.max((F.col("action") == "allow").cast("int")).alias("allow"), F.max((F.col("action") == "block").cast("int")).alias("block"), F.count("*").alias("_n")
    )
    alias = lookup_by_group(members, stage(verdicts, "verdicts"), "component", "_n").select(
        "node", F.when((F.col("block") == 1) & (F.coalesce("allow", F.lit(0)) == 0), "block").otherwise("allow").alias("alias_verdict")
    )
    # a URL that many pages share, or none, is one row of `known`: such rows are not shuffled by it
    rows = rows.withColumn("node", F.coalesce("node", F.lit("")))
    known = stage(rows.groupBy("node").agg(F.count("*").alias("_n")).join(alias, "node", "left"), "aliases")
    found = lookup_by_group(rows, known, "node", "_n")
    return found.select("page_id", "host", "path", "rule", F.coalesce("action", "alias_verdict", F.lit("allow")).alias("verdict"))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, RULES))


_HOST = r"CASE WHEN contains({0}, '://') THEN translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
_PATH = r"CASE WHEN contains({0}, '://') THEN regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END"
_NODE = r"CASE WHEN contains({0}, '://') THEN 'x://' || " + _HOST + r" || regexp_extract({0}, '(?s)^.*?://[^/?#]*([^#]*)', 1) END"


def _attribute(name: str) -> str:
    pattern = rf"""'(?is)\b{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))'"""
    return "(" + " || ".join(f"regexp_extract(t, {pattern}, {k})" for k in (1, 2, 3)) + ")"


_UNSEEN = "(?is)<!--.*?(?:-->|\\z)" + "".join(
    rf"|<{e}\b[^>]*>.*?(?:</{e}\b|\z)" for e in "script style template textarea title xmp iframe noembed noframes".split()
)

URL_FILTER_SQL = f"""
WITH RECURSIVE p AS (SELECT page_id, coalesce(url, '') AS url, regexp_replace(coalesce(html, ''), '{_UNSEEN}', '', 'g') AS html FROM pages),
rules(h, p, a) AS (VALUES {", ".join(str(r) for r in RULES)}),
tag AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS t FROM p WHERE regexp_matches(html, '(?i)canonical|refresh')),
aim AS (
  SELECT url, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS base, trim(CASE WHEN regexp_matches(lower({_attribute("rel")}), '\\bcanonical\\b') THEN {_attribute("href")}
    WHEN lower({_attribute("http-equiv")}) = 'refresh' THEN regexp_extract({_attribute("content")}, '(?is)\\burl\\s*=\\s*[''"]?([^''"]*)', 1) END) AS g FROM tag),
link AS (SELECT url, CASE WHEN regexp_matches(g, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN g WHEN g LIKE '//%' THEN 'x:' || g WHEN g LIKE '/%' THEN base || g END AS g FROM aim),
edge AS (SELECT {_NODE.format("url")} AS a, {_NODE.format("g")} AS b FROM link WHERE contains(url, '://') AND contains(g, '://')),
pair AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(a, b) AS (SELECT a, a FROM pair UNION SELECT r.a, e.b FROM reach r JOIN pair e ON e.a = r.b),
named AS (SELECT {_NODE.format("url")} AS node, page_id, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path FROM p
  UNION ALL SELECT DISTINCT b, NULL, {_HOST.format("b")}, {_PATH.format("b")} FROM reach),
judged AS (
  SELECT n.*, r.rule, r.a AS action FROM named n LEFT JOIN LATERAL (SELECT h || p AS rule, a FROM rules
    WHERE (n.host = h OR n.host LIKE '%.' || h) AND starts_with(n.path, p) ORDER BY length(h || p) DESC LIMIT 1) r ON TRUE),
alias AS (
  SELECT r.a AS node, bool_or(coalesce(j.action = 'allow', FALSE)) AS allowed, bool_or(coalesce(j.action = 'block', FALSE)) AS blocked
  FROM reach r JOIN (SELECT DISTINCT node, action FROM judged WHERE page_id IS NULL) j ON j.node = r.b GROUP BY r.a)
SELECT page_id, host, path, rule, CASE WHEN action IS NOT NULL THEN action WHEN blocked AND NOT allowed THEN 'block' ELSE 'allow' END AS verdict
FROM judged LEFT JOIN alias USING (node) WHERE page_id IS NOT NULL
"""
