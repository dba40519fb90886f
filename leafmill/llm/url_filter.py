"""URL rules whose blocks reach aliases.

A url is judged by the longest rule that fits its host and path. Redirects and canonical links
between urls are edges; their connected components are alias classes. A url without a rule of its
own is blocked if an alias is blocked by rule and none is explicitly allowed; a rule of its own
always decides, so an explicit allow takes precedence over what aliases carry. What neither rules
nor aliases decide is allowed.

A node is a url without scheme and fragment: host, path and query. Rules see its host and path.
All canonical links and refresh redirects of a page count; they are resolved against the page's url
as RFC 3986 has it, dot segments included. Only DataFrame functions are used.

Defined cases: a null url, or one without "://", has an empty host and path, fits no rule and has
no alias; a link that resolves to such a url is no edge; repeated urls and pages are judged alike,
row by row, and urls of any length whole; a null html has no links; an empty table gives no rows;
extra columns stay, but for those named as the columns added, which are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import connected_components
from ._spark import Scratch, join_groups

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^"'\s>]+)"""


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The fitting rule as struct (rule, verdict), or null. The longest wins, an allow among equally long."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0]))
    out = None
    for verdict, h, p in ranked:
        fits = ((host_ == h) | F.endswith(host_, F.lit("." + h))) & F.startswith(path_, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def node(url: Column) -> Column:
    """Host, path and query; null for a url without host and path."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^#]*?://[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.when(F.concat(host(url), path(url)) != "", F.concat(host(url), path(url), query))


def without_dots(path_: Column) -> Column:
    """A path from the root with its . and .. segments resolved."""
    parts = F.split(F.regexp_replace(path_, "^/", ""), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(p == ".", a).otherwise(F.concat(a, F.array(p))))
    end = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("/"), F.array_join(F.concat(kept, end), "/"))


def absolute(link: Column, base: Column) -> Column:
    """A link resolved against its page's url; null if that has no host to resolve against."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    own, rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path(base), r"(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    begins = lambda t: F.startswith(link, F.lit(t))

    def tidy(url: Column) -> Column:
        top = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
        tail = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(.*)$", 1)
        return F.when(path(url) != "", F.concat(top, without_dots(path(url)), tail)).otherwise(url)

    out = F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), tidy(link)).when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
    out = out.when(root == "", F.lit(None)).when(begins("//"), tidy(F.concat(scheme, F.lit(":"), link)))
    out = out.when(begins("/"), F.concat(root, without_dots(own), rest)).when(begins("#"), F.concat(F.regexp_extract(base, r"(?s)^([^#]*)", 1), link))
    return out.when(begins("?"), F.concat(root, path(base), link)).otherwise(F.concat(root, without_dots(F.concat(folder, own)), rest))


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) urls from all canonical links and refresh redirects in the pages' html."""
    found = [F.regexp_extract_all(F.col("html"), F.lit(pattern), F.lit(1)) for pattern in (CANONICAL, REFRESH)]
    links = pages.select(F.col("url").alias("src"), F.explode(F.concat(*found)).alias("_to")).filter("_to != ''")
    links = links.select("src", absolute(F.replace(F.col("_to"), F.lit("&amp;"), F.lit("&")), F.col("src")).alias("dst"))
    return links.filter("dst is not null")


ADDED = ("host", "path", "rule", "verdict", "alias_root")


def judge(urls: DataFrame, edges: DataFrame, scratch: Scratch, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow", url_col: str = "url") -> DataFrame:
    """Add host, path, rule, verdict and alias_root (smallest node of the class; null if alone).

    ``edges`` has the columns src and dst: redirects and canonical links between urls.
    """
    links = edges.select(node(F.col("src")).alias("u"), node(F.col("dst")).alias("v"))
    classes = connected_components(links, scratch)
    # Every node of a class votes, also one that is only a link's target.
    at = F.regexp_extract("node", r"(?s)^([^/?]*)", 1)
    own_rule = rule(at, F.regexp_extract("node", r"(?s)^[^/?]*([^?]*)", 1), rules)
    voted = scratch.save(classes.select("node", "root", own_rule["verdict"].alias("v")), "votes")
    votes = voted.groupBy("root").agg(
        F.bool_or(F.col("v") == "block").alias("_block"), F.bool_or(F.col("v") == "allow").alias("_allow"), F.count("*").alias("_size")
    )
    met = join_groups(voted, votes, "root", "_size", voted.count())
    inherited = F.when(F.col("_allow"), "allow").when(F.col("_block"), "block")
    nodes = scratch.save(met.select(F.col("node").alias("_node"), F.col("root").alias("alias_root"), inherited.alias("_inherited")), "aliases")
    url = urls[f"`{url_col}`"]
    packed = urls.select(F.struct(*(urls[f"`{c}`"] for c in urls.columns)).alias("_row"), host(url).alias("host"), path(url).alias("path"), node(url).alias("_node"))
    packed = packed.withColumn("_own", rule(F.col("host"), F.col("path"), rules))
    if nodes.limit(1).count():
        sizes = packed.groupBy("_node").agg(F.count("*").alias("_rows"))
        nodes = scratch.save(nodes.join(sizes, "_node"), "sized")
        met = join_groups(packed, nodes, "_node", "_rows", urls.count())
    else:
        met = packed.withColumn("alias_root", F.lit(None).cast("string")).withColumn("_inherited", F.lit(None).cast("string"))
    verdict = F.coalesce(F.col("_own.verdict"), F.col("_inherited"), F.lit(default))
    stay = [F.col(f"_row.`{c}`") for c in urls.columns if c.lower() not in ADDED]
    return met.select(*stay, "host", "path", F.col("_own.rule").alias("rule"), verdict.alias("verdict"), "alias_root")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    out = judge(pages.select("page_id", "url"), page_edges(pages), Scratch(spark))
    return out.select("page_id", "host", "path", "rule", "verdict", "alias_root")


#: For tables whose html holds no canonical link or refresh redirect, as the given ones.
SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^(?:[^:]|:[^/]|:/[^/])*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?:[^:]|:[^/]|:/[^/])*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (
  SELECT *, CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                 WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
                 WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
                 WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM u)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict,
       CAST(NULL AS VARCHAR) AS alias_root
FROM r
"""

QUERIES = {"op2_url_filter": op2_url_filter}
ORACLES = {"op2_url_filter": SQL}
