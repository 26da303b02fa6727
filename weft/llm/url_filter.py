"""URL filters with redirect equivalence.

Rules judge a url by host (with its subdomains) and path prefix; the longest fitting
rule wins. Urls that redirect to each other, or name each other as canonical, are
aliases: connected components over those edges. A url without a rule takes the
decision of its aliases: allow if any of them is allowed by a rule, else block if any
is blocked by one, else allow. Edge targets that are no pages are judged as well. A few
rules are one expression; more of them, or a table of rules, are joined by the suffixes of
the host. DataFrame functions only.

Defined results: a null url or one without `://` has an empty host and path, no rule
and no aliases, and is allowed; null html has no edges; rows that repeat are each
answered; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.components import connected_components

#: Rules that are one expression, evaluated for each url; more of them are joined.
MOST_RULES = 1000
#: Fixed values of the production query: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """What urls of one resource share: host, path and query; null without a host."""
    rest = F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^#]*)", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    host = host_of(url)
    return F.when(host != "", F.concat(host, rest))


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])


def _longest(host: Column, path: Column, rules, value) -> Column:
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    return reduce(lambda rest, r: F.when(_fits(host, path, r), F.lit(value(r))).otherwise(rest), reversed(ordered), F.lit(None).cast("string"))


def _joined(places: DataFrame, rules: DataFrame) -> DataFrame:
    """__host, __path, __own and __rule of the places (host, path) that a rule (verdict, host, path) fits."""
    labels = F.split("__host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels) - k + 1), "."))
    listed = rules.select(F.col("verdict").alias("__verdict"), F.col("host").alias("__suffix"), F.col("path").alias("__start")).distinct()
    met = places.where(F.col("__host") != "").withColumn("__suffix", F.explode(suffixes)).join(listed, "__suffix").where(F.col("__path").startswith(F.col("__start")))
    best = F.min(F.struct((-F.length("__suffix") - F.length("__start")).alias("n"), "__verdict", "__suffix", "__start"))
    return met.groupBy("__host", "__path").agg(best.alias("b")).select("__host", "__path", F.col("b.__verdict").alias("__own"), F.concat("b.__suffix", "b.__start").alias("__rule"))


def _decided(df: DataFrame, host: Column, path: Column, rules) -> DataFrame:
    """The rows with __own and __rule, the verdict and name of the longest rule that fits, or null."""
    if not isinstance(rules, DataFrame) and len(rules) <= MOST_RULES:
        return df.withColumns({"__own": _longest(host, path, rules, lambda r: r[0]), "__rule": _longest(host, path, rules, lambda r: r[1] + r[2])})
    table = rules if isinstance(rules, DataFrame) else df.sparkSession.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    placed = df.withColumns({"__host": host, "__path": path})
    return placed.join(_joined(placed.select("__host", "__path").distinct(), table), ["__host", "__path"], "left").drop("__host", "__path")


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?i)\b{name}{_VALUE}"
    return F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)))


def _absolute(target: Column, base: Column) -> Column:
    target = F.trim(F.replace(target, F.lit("&amp;"), F.lit("&")))
    folder = F.regexp_extract(path_of(base), r"^(.*/)?", 0)
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(F.lit("http://"), host_of(base), target))
        .when(target != "", F.concat(F.lit("http://"), host_of(base), F.when(folder == "", "/").otherwise(folder), target))
    )


def page_edges(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """from_url, to_url: canonical links and redirects by meta refresh."""
    html, url = F.col(html_column), F.col(url_column)
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    tagged = pages.where(html.isNotNull() & url.isNotNull()).select(url.alias("from_url"), F.explode(tags).alias("tag"))
    canonical = F.col("tag").rlike(r"(?i)^<link") & _attribute(F.col("tag"), "rel").rlike(r"(?i)(^|\s)canonical(\s|$)")
    refresh = F.col("tag").rlike(r"(?i)^<meta") & _attribute(F.col("tag"), "http-equiv").rlike(r"(?i)^\s*refresh\s*$")
    to = F.when(canonical, _attribute(F.col("tag"), "href")).when(refresh, F.regexp_extract(_attribute(F.col("tag"), "content"), r"""(?i)url\s*=\s*['"]?([^'"]*)""", 1))
    return tagged.select("from_url", _absolute(to, F.col("from_url")).alias("to_url")).where(F.col("to_url").isNotNull())


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """id, host, path, rule and verdict of every page. rules: tuples (verdict, host, path), or a
    table of them; redirects: more edges (from_url, to_url)."""
    edges = page_edges(pages, url_column, html_column)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("from_url", "to_url"))
    ends = edges.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b"))
    members = connected_components(ends.where(F.col("a").isNotNull() & F.col("b").isNotNull()))
    as_url = F.concat(F.lit("http://"), F.col("node"))
    decided = _decided(members, host_of(as_url), path_of(as_url), rules).select("node", "component", F.col("__own").alias("own"))
    decisions = decided.groupBy("component").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
    blocked = decisions.where(F.col("blocked") & ~F.coalesce("allowed", F.lit(False))).select("component")
    aliases = decided.join(blocked, "component", "left_semi").where(F.col("own").isNull()).select(F.col("node").alias("__node")).withColumn("__blocked", F.lit(True))
    host, path = host_of(F.col(url_column)), path_of(F.col(url_column))
    # urls without a host are no node; a stand-in that no node is spreads them over the tasks of the join
    node = F.coalesce(node_of(F.col(url_column)), F.concat(F.lit("/"), F.xxhash64(F.col(id_column)).cast("string")))
    judged = _decided(pages.select(F.col(id_column), host.alias("host"), path.alias("path"), node.alias("__node")), F.col("host"), F.col("path"), rules)
    joined = judged.join(aliases, "__node", "left")
    return joined.select(id_column, "host", "path", F.col("__rule").alias("rule"), F.coalesce("__own", F.when(F.col("__blocked"), "block"), F.lit("allow")).alias("verdict"))
