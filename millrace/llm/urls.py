"""URL filters over redirect equivalence.

Addresses are equivalent if redirects, canonical links or refresh tags connect them, in any direction and
over any number of steps, or if they differ only in scheme, host case, default port, fragment or tracking
parameters. Connected components over these edges carry a block to every alias. An explicit allow has
precedence: an address with a rule of its own keeps that rule's verdict, and a component that holds an
explicitly allowed address blocks none of its addresses that have no rule.

Edge ends that are no page of the table are judged too, so a redirect to a blocked address counts.

Null and relative addresses (no ``://``) have an empty host and path; no rule fits them, they have no
aliases and are allowed. Repeated rows are judged alike. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.freeze import freeze
from millrace.llm.components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str  # fits this host and every subdomain of it
    path: str  # fits every path that starts so

    @property
    def name(self) -> str:
        return self.host + self.path


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host(url: Column) -> Column:
    rest = after_scheme(url)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_: Column, path_: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct (name, verdict); null if none does."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host_ == r.host) | F.endswith(host_, F.lit("." + r.host))) & F.startswith(path_, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def alias_key(url: Column) -> Column:
    """One text for addresses that differ only in scheme, host case, default port, fragment and
    tracking parameters; null without ``://``."""
    rest = F.regexp_replace(after_scheme(url), r"(?s)#.*$", "")
    query = F.when(F.instr(rest, "?") > 0, F.substr(rest, F.instr(rest, "?") + 1))
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(?i:utm_[a-z]+|gclid|fbclid)=")), "&")
    site = F.regexp_replace(host(url), r":(80|443)$", "")
    where = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    return F.when(rest.isNotNull(), F.concat(site, where, F.when(F.coalesce(kept, F.lit("")) != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _absolute(link: Column, base: Column) -> Column:
    """``link`` as a full address; links relative to a folder are resolved against the page's folder."""
    scheme = F.substring_index(base, "://", 1)
    site = F.concat(scheme, F.lit("://"), host(base))
    folder = F.regexp_extract(path(base), r"^.*/", 0)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(site, link))
        .when(link != "", F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def page_edges(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(source, target): canonical links and refresh tags of pages."""
    tags = pages.where(F.col(html).rlike("(?i)canonical|http-equiv")).select(
        F.col(url).alias("source"), F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag")
    )
    href = F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    refresh = F.regexp_extract("tag", r"(?is)\bcontent\s*=\s*[\"']?[^\"'>]*?url\s*=\s*['\"]?\s*([^\"'\s>]+)", 1)
    target = F.when(F.col("tag").rlike(r"(?is)\brel\s*=\s*[\"']?canonical\b"), href).when(
        F.col("tag").rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"), refresh
    )
    return tags.select("source", _absolute(target, F.col("source")).alias("target")).where("target IS NOT NULL")


def judge(urls: DataFrame, url: str, edges: DataFrame, rules: Sequence[Rule], source: str = "source", target: str = "target") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (name or null) and ``verdict`` to every row of ``urls``.

    ``edges`` holds redirects and canonical links between addresses. Rows may come in any number per address."""
    key, own = "_alias", "_own"
    u = F.col(url)
    rows = urls.withColumns({"host": host(u), "path": path(u), key: alias_key(u)}).withColumn(own, rule_of(F.col("host"), F.col("path"), rules))
    ends = edges.select(F.col(source).alias("a"), F.col(target).alias("b"))
    linked = components(ends.select(alias_key(F.col("a")).alias("a"), alias_key(F.col("b")).alias("b")), "a", "b")
    addresses = urls.select(u.alias("url")).union(ends.select("a")).union(ends.select("b")).where("url IS NOT NULL")
    told = addresses.select(alias_key(F.col("url")).alias("node"), rule_of(host(F.col("url")), path(F.col("url")), rules)["verdict"].alias("said"))
    said = told.dropna().groupBy("node").agg(F.max(F.col("said") == "block").alias("blocks"), F.max(F.col("said") == "allow").alias("allows"))
    in_group = freeze(said.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node")))
    groups = freeze(in_group.groupBy("component").agg(F.max("blocks").alias("blocks"), F.max("allows").alias("allows")).where("blocks AND NOT allows").select("component"))
    blocked = freeze(
        linked.join(groups, "component", "left_semi").select("node").union(groups.select(F.col("component").alias("node"))).distinct()
    ).select(F.col("node").alias(key), F.lit(True).alias("_blocked"))
    return (
        rows.join(blocked, key, "left")
        .withColumn("rule", F.col(own)["name"])
        .withColumn("verdict", F.coalesce(F.col(own)["verdict"], F.when(F.col("_blocked"), F.lit("block")), F.lit("allow")))
        .drop(key, own, "_blocked")
    )
