"""Operator 4: URL rules whose block decisions reach aliases.

Addresses are nodes, named by a normalised form of the URL; redirects (a page's meta
refresh) and canonical links are edges.  A page with a rule of its own gets that rule's
verdict, so an explicit allow stays.  A page without one is blocked if a rule blocks any
address of its connected component, and allowed otherwise.  Everything is DataFrame
expressions; the rules are a short list that the caller passes in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, written
from .components import connected_components

Rule = tuple[str, str, str]  # verdict, host, path


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    return F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null.

    A rule fits its host and all subdomains if the path starts with the rule's path.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def address_of(url: Column) -> Column:
    """The normalised form that names a node: no scheme, ``www.``, default port, fragment,
    tracking parameter or closing slash; null without ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^www\.", "")
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")), "&")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    address = F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(F.locate("://", url) > 0, address)


def _first_value(html: Column, tag: str, value: str) -> Column:
    """What ``value`` matches in the first ``tag`` that has it; empty without one."""
    found = F.transform(F.regexp_extract_all(html, F.lit(tag), 1), lambda t: F.regexp_extract(t, value, 1))
    return F.coalesce(F.try_element_at(F.filter(found, lambda v: v != ""), F.lit(1)), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` steps."""
    steps = F.split(path, "/", -1)
    kept = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda done, step: F.when(step == ".", done).when(step == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.array_append(done, step)),
    )
    return F.array_join(kept, "/")


def absolute(url: Column, to: Column) -> Column:
    """The address that a link ``to`` on the page ``url`` leads to; null for other schemes."""
    site = F.regexp_extract(url, r"^(.*?://[^/?#]*)", 1)
    path, query = F.regexp_extract(to, r"^([^?#]*)", 1), F.regexp_extract(to, r"^[^?#]*(\?[^#]*)", 1)
    folder = F.regexp_extract(path_of(url), r"^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(F.locate("://", to) > 0, to)
        .when(to.startswith("//"), F.concat(F.regexp_extract(url, r"^(.*?:)//", 1), to))
        .when(to.startswith("/"), F.concat(site, without_dots(path), query))
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | to.startswith("#"), None)
        .when(to.startswith("?"), F.concat(site, path_of(url), query))
        .otherwise(F.concat(site, without_dots(F.concat(folder, path)), query))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target): canonical links and meta-refresh redirects of the pages, made absolute.

    The first canonical tag that has an address counts, and the first refresh that has one.
    """
    html = F.col("html")
    canonical = _first_value(html, r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
    refresh = _first_value(html, r"(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)")
    marked = F.lower(html).contains("canonical") | F.lower(html).contains("refresh")
    found = pages.where(marked & (F.locate("://", F.col("url")) > 0)).select("url", F.explode(F.array(canonical, refresh)).alias("to")).where("to <> ''")
    return found.select("url", absolute(F.col("url"), F.col("to")).alias("target")).where("target is not null")


def judge_urls(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url, html).

    ``redirects`` may add edges (url, target) from a crawl log.  A url that is null or has no
    ``://`` has empty host and path, no address and no rule, and is allowed.  A null html has
    no links.  Rows that repeat an id or a url each get a row; other columns are ignored; an
    empty table gives no rows.
    """
    narrow = pages.select("page_id", "url", "html")
    links = page_links(narrow)
    if redirects is not None:
        links = links.unionByName(redirects.select("url", "target"))
    links = written(links, "url-links")
    edges = links.select(address_of(F.col("url")).alias("a"), address_of(F.col("target")).alias("b")).where("a is not null and b is not null")
    roots = connected_components(edges)

    def judged(url: str) -> list[Column]:
        return [rule_of(host_of(F.col(url)), path_of(F.col(url)), rules)["verdict"].alias("verdict"), address_of(F.col(url)).alias("address")]

    # addresses that a rule blocks, then all addresses of their components
    named = narrow.select(*judged("url")).union(links.select(*judged("target")))
    blocked = named.where("verdict = 'block'").select("address").distinct()
    reached = blocked.join(roots, blocked["address"] == roots["node"]).select("component").distinct().join(roots, "component").select(F.col("node").alias("address"))
    blocked = blocked.union(reached).distinct().withColumn("aliased", F.lit(True))
    found = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)
    rows = narrow.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), found.alias("found"), address_of(F.col("url")).alias("address"))
    verdict = F.coalesce("found.verdict", F.when(F.col("aliased"), "block"), F.lit("allow"))
    return rows.join(blocked, "address", "left").select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), (F.col("found").isNull() & F.col("aliased").isNotNull()).alias("by_alias"))
