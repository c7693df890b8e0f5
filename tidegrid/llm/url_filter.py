"""URL rules with redirect equivalence: block decisions reach all aliases of a URL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.components import connected_components
from tidegrid.staging import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str  # lower case; fits the host and all its subdomains
    path: str = "/"  # fits URLs whose path starts with it

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end; empty without ``://`` or URL."""
    return F.coalesce(lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """``struct(rule, verdict)`` of the longest fitting rule; among equally long ones allow wins; null if none fits."""
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "allow", r.name))
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in ranked
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def node_of(url: Column) -> Column:
    """Alias node: the URL without its fragment, scheme and host in lower case, an empty path as ``/``."""
    bare = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    scheme = F.regexp_extract(bare, r"(?s)^(.*?)://", 1)
    rest = F.regexp_extract(bare, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(bare.contains("://"), F.concat(lower(scheme), F.lit("://"), host_of(bare), rest))


def alias_edges(pages: DataFrame, url: str, html: str) -> DataFrame:
    """``(source, target)`` nodes of canonical links and refresh redirects found in whole pages."""
    tag = F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), 0))
    tags = pages.where(F.col(url).contains("://")).select(F.col(url).alias("url"), tag.alias("tag"))
    tags = tags.where(F.col("tag").rlike(r"(?is)\bcanonical\b|\brefresh\b"))
    canonical = F.when(
        F.col("tag").rlike(r"""(?is)^<link\b.*\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""),
        F.regexp_extract("tag", r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1),
    )
    refresh = F.when(
        F.col("tag").rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b"""),
        F.regexp_extract("tag", r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1),
    )
    href = F.replace(F.coalesce(canonical, refresh), F.lit("&amp;"), F.lit("&"))
    found = tags.select("url", href.alias("href")).where("href <> ''")
    scheme = F.regexp_extract("url", r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(F.col("url")))
    folder = F.regexp_extract(F.concat(site, path_of(F.col("url"))), r"(?s)^(.*?://[^/]*(?:/.*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    absolute = (
        F.when(F.col("href").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("href"))
        .when(F.col("href").startswith("//"), F.concat(scheme, F.lit(":"), F.col("href")))
        .when(F.col("href").startswith("/"), F.concat(site, F.col("href")))
        .otherwise(F.concat(folder, F.col("href")))
    )
    return found.select(node_of(F.col("url")).alias("source"), node_of(absolute).alias("target")).where("source <> target")


def filter_urls(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``verdict``, ``blocked_by_alias``.

    The longest fitting rule decides, so an explicit allow holds whatever its aliases are.  A
    URL without a rule is blocked if a URL of its component over redirects and canonical
    links, crawled or not, falls under a block rule, and allowed otherwise.  Null URLs and URLs
    without ``://`` have empty host and path, no aliases, and are allowed; null pages give no links.
    """
    edges = stage(alias_edges(pages, url, html).distinct(), "aliases")
    ends = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    ends = stage(ends.withColumn("k", F.xxhash64("node")), "alias-nodes")
    keyed = edges.select(F.xxhash64("source").alias("a"), F.xxhash64("target").alias("b"))
    member = ends.join(connected_components(keyed).withColumnRenamed("node", "k"), "k")
    verdict = best_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    blocked = member.where(verdict == "block").select("component").distinct()
    tainted = member.join(blocked, "component", "left_semi").select("node", F.lit(True).alias("tainted"))
    judged = pages.select(F.col(id_col).alias("id"), F.col(url).alias("u")).select(
        "id", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"), node_of(F.col("u")).alias("node")
    )
    judged = judged.join(tainted, "node", "left").withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    alias = F.col("best").isNull() & F.col("tainted").isNotNull()
    return judged.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.when(alias, "block").otherwise("allow")).alias("verdict"),
        alias.alias("blocked_by_alias"),
    )
