"""URL rules spread over redirect equivalence.

Rules name a host with its subdomains and a path prefix; the longest one that
fits decides.  Redirect and canonical-link edges make URLs aliases of each
other: a block rule that decides any URL of a connected component blocks its
aliases, except those that an allow rule of their own protects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_row, field, stored
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """From after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty for null or no "://"."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From after the host up to "?", "#" or the end; empty for null or no "://"."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What aliases are told apart by: host, path and query, hashed; scheme and fragment do not count.  Null without a host."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.md5(F.concat(host_of(url), path_of(url), query)))


def resolved(target: Column, base: Column) -> Column:
    """A link target as an absolute URL; null for fragments and other schemes."""
    link = F.trim(F.replace(target, F.lit("&amp;"), F.lit("&")))
    start = F.concat(F.substring_index(base, "://", 1), F.lit("://"), host_of(base))
    folder = F.regexp_extract(path_of(base), "^(.*/)", 1)
    return (F.when(link.rlike("^(?i)https?://"), link)
            .when(link.startswith("//"), F.concat(F.substring_index(base, "://", 1), F.lit(":"), link))
            .when(link.startswith("/"), F.concat(start, link))
            .when((link == "") | link.startswith("#") | link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
            .otherwise(F.concat(start, F.when(folder == "", F.lit("/")).otherwise(folder), link)))


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): URLs of pages and of their canonical links and meta-refresh redirects; none for null pages."""
    url, html = F.col(url_col), F.col(html_col)
    value = r"""(?is)\b%s\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

    def attribute(tag: Column, name: str) -> Column:
        return F.concat(*[F.regexp_extract(tag, value % name, k) for k in (1, 2, 3)])

    canonical = attribute(F.regexp_extract(html, r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*>""", 0), "href")
    refresh = F.regexp_extract(attribute(F.regexp_extract(
        html, r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*>""", 0), "content"),
        r"""(?is)^\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"']*)""", 1)
    links = pages.select(url.alias("src"), F.explode(F.filter(F.array(canonical, refresh), lambda x: x != "")).alias("link"))
    return links.select("src", resolved(F.col("link"), F.col("src")).alias("dst")).filter("dst IS NOT NULL")


def decide(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, rule_verdict) for the distinct (host, path) of ``urls`` that a rule fits.

    ``rules``: host, path, verdict.  A URL is looked up by its host suffixes
    and, for each, only by the path lengths that occur there, so a host with
    many rules costs no more than a URL's length.  The longest rule wins, of
    equals an allow rule.
    """
    lengths = rules.groupBy(F.col("host").alias("rh")).agg(F.collect_set(F.length("path")).alias("sizes"))
    labels = F.split("host", r"\.")
    places = F.sequence(F.lit(1), F.size(labels))
    probes = (urls.select("host", "path").distinct()
              .withColumn("rh", F.explode(F.transform(places, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
              .join(lengths, "rh")
              .withColumn("size", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))))
              .withColumn("rp", F.expr("substr(path, 1, size)")))
    fits = probes.join(rules.select(F.col("host").alias("rh"), F.col("path").alias("rp"), "verdict"), ["rh", "rp"])
    best = F.max(F.struct((F.length("rh") + F.length("rp")).alias("n"), (F.col("verdict") == "allow").alias("allow"),
                          F.concat("rh", "rp").alias("rule"), "verdict"))
    return fits.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", F.col("b.verdict").alias("rule_verdict"))


def judge_urls(pages: DataFrame, edges: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """One row per input row: row (struct of all its columns), host, path, rule, verdict, component.

    ``edges``: (src, dst) URLs.  The rule's verdict holds where a rule fits;
    else "block" if a URL of the component is blocked by a rule, else
    "allow".  ``component`` is null for URLs without edges.  URLs that are
    null or lack "://" have empty host and path, fit no rule and are allowed;
    repeated URLs are judged alike, empty tables give an empty result.
    """
    ends = edges.select(F.col(edges.columns[0]).alias("s"), F.col(edges.columns[1]).alias("d"))
    ends = stored(ends.select("s", "d", node_of(F.col("s")).alias("a"), node_of(F.col("d")).alias("b"))
                  .filter("a IS NOT NULL AND b IS NOT NULL AND a <> b"), "alias-edges")
    parts = stored(connected_components(ends.select("a", "b")), "alias-components")
    nodes = ends.select(F.col("a").alias("node"), F.col("s").alias("u")).union(ends.select("b", "d"))
    nodes = nodes.select("node", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path")).distinct()
    blocked = (nodes.join(decide(nodes, rules).filter("rule_verdict = 'block'"), ["host", "path"]).select("node").distinct()
               .join(parts, "node").select(F.col("component").alias("bad")).distinct())
    spread = parts.join(blocked, F.col("component") == F.col("bad"), "left").select(
        F.col("node").alias("n"), "component", F.col("bad").isNotNull().alias("bad"))

    url = field("row", url_col)
    rows = as_row(pages).select("row", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    found = decide(rows, rules).select(F.col("host").alias("h"), F.col("path").alias("p"), "rule", "rule_verdict")
    judged = rows.join(found, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    judged = judged.join(spread, F.col("node") == F.col("n"), "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("bad"), "block"), F.lit("allow"))
    return judged.select("row", "host", "path", "rule", verdict.alias("verdict"), "component")
