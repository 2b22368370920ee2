"""URL filters by redirect equivalence: block decisions reach the aliases of a blocked address."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components

#: (verdict, host, path prefix); a rule holds for its host and all subdomains.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: A canonical link, and a refresh of the page, in raw HTML.
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^"'\s>]+)"""


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(_lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """A node of the alias graph: the url without its fragment, which no server sees; scheme and host lower-cased."""
    bare = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    return F.when(F.instr(bare, "://") > 0, F.concat(
        _lower_ascii(F.substring_index(bare, "://", 1)), F.lit("://"), host_of(bare),
        F.regexp_extract(bare, r"(?s)^.*?://[^/?#]*(.*)", 1)))


def alias_edges(pages: DataFrame) -> DataFrame:
    """``(u, v)`` from each page to its canonical link and to its refresh target, relative ones resolved."""
    base = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    link = F.explode(F.array_compact(F.array(*[
        F.nullif(F.regexp_extract("html", p, 1), F.lit("")) for p in (CANONICAL, REFRESH)])))
    found = pages.where(F.col("html").isNotNull() & (F.instr("url", "://") > 0)).select("url", link.alias("link"))
    target = (F.when(F.col("link").startswith("//"), F.concat(F.substring_index("url", "://", 1), F.lit(":"), F.col("link")))
              .when(F.instr("link", "://") > 0, F.col("link"))
              .when(F.col("link").startswith("/"), F.concat(base, "link"))
              .otherwise(F.concat(folder, F.when(F.col("link").isNotNull() & ~folder.endswith("/"), F.lit("/")).otherwise(F.lit("")), "link")))
    return found.select(address_of(F.col("url")).alias("u"), address_of(target).alias("v"))


def ruled(urls: DataFrame, rules: Sequence[tuple[str, str, str]], key: str) -> DataFrame:
    """``urls`` (``key``, host, path) with the longest fitting rule and its verdict, null where none fits.

    Every suffix of the host, joined to the path cut at each length that rule paths have, is looked up by an
    equi-join, so the work is bounded by the url's own length and not by the number of rules. Of equally long
    rules an allowing one wins.
    """
    spark = urls.sparkSession
    table = spark.createDataFrame([(h, p, h + p, v) for v, h, p in rules], "rule_host string, rule_path string, rule string, rule_verdict string")
    lengths = sorted({len(p) for _, _, p in rules})
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    candidates = urls.where("host <> ''").select(key, "path", F.explode(F.array_distinct(hosts)).alias("rule_host")).select(
        key, "rule_host", F.explode(F.array_distinct(F.filter(
            F.array(*[F.substring("path", 1, n) for n in lengths]), lambda x: x.isNotNull()))).alias("rule_path"))
    best = candidates.join(table, ["rule_host", "rule_path"]).groupBy(key).agg(F.max(F.struct(
        F.length("rule").alias("n"), (F.col("rule_verdict") == "allow").alias("allow"), "rule", "rule_verdict")).alias("best"))
    return urls.join(best, key, "left").select(
        *urls.columns, F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, by_alias)`` for every row of ``pages(page_id, url, html)``.

    A url's own rule decides. Without one, the url takes part in its alias class, the connected component
    over canonical links, refreshes and the ``edges(u, v)`` of urls given (a redirect log): if a rule allows
    a member, the class is allowed; else if a rule blocks a member, it is blocked; else it is allowed.
    Members that are only linked to, and not crawled, carry their rule's decision too.
    Null or malformed urls have empty host and path, no rule, and are allowed; a null html has no links.
    Repeated rows are judged each, also with equal page_id; extra columns are ignored.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    links = alias_edges(pages)
    if edges is not None:
        links = links.unionByName(edges.select(address_of(F.col("u")).alias("u"), address_of(F.col("v")).alias("v")))
    classes = components(links)
    distinct_paths = rows.select("host", "path").distinct().withColumn("place", F.concat_ws("\x00", "host", "path"))
    own = ruled(distinct_paths, rules, "place").where("rule is not null").select("host", "path", "rule", "rule_verdict")
    members = classes.select("component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    spots = members.select("host", "path").distinct().withColumn("place", F.concat_ws("\x00", "host", "path"))
    verdicts = members.join(ruled(spots, rules, "place").where("rule is not null"), ["host", "path"]).groupBy("component").agg(
        F.min("rule_verdict").alias("class_verdict"))  # "allow" sorts before "block"
    alias = classes.join(verdicts, "component").select(F.col("node").alias("address"), "class_verdict")
    judged = rows.withColumn("address", address_of(F.col("url"))).join(own, ["host", "path"], "left").join(alias, "address", "left")
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", "class_verdict", F.lit("allow")).alias("verdict"),
        (F.col("rule_verdict").isNull() & F.col("class_verdict").isNotNull()).alias("by_alias"))
