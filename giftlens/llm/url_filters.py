"""URL filters: allow and block rules by host and path, and block decisions that reach aliases.

Two addresses are aliases if a redirect or a canonical link joins them. Aliases are
connected components of those links; a component with a blocked address is blocked
as a whole, except for addresses that a rule of their own allows.

Rules are a table (host, path, verdict). A rule fits its host and all subdomains, if
the path starts with the rule's; the longest rule (host and path together) wins, of
equally long ones an allowing one, then the first in order. Hosts, not pages, are
joined with the rules, so a hot host meets them once.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no
rule and is allowed; null html has no links; targets that are relative are resolved
against the page; links to the page itself, repeated links and links to addresses that
are no pages do no harm (such an address still carries its block); fragments do not
tell addresses apart; every input row gives one row, also with repeated or null
ids; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checkpoints import stored
from .components import components

#: Parts that a host's urls are dealt to; every part gets the host's rules.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)"
_CANONICAL = r"""(?is)<link\b[^>]*?\brel\s*=\s*["']?[^"'>]*\bcanonical\b[^>]*>"""
_REFRESH = r"""(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_TARGET = r"""(?is)\bcontent\s*=\s*(?:"[^"]*?url\s*=\s*'?\s*([^"']*)|'[^']*?url\s*=\s*"?\s*([^"']*))"""


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 2), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _URL, 3), F.lit(""))


def address(url: Column) -> Column:
    """The url without its fragment, scheme and host lower-cased: what tells two addresses apart. Null without ``://``."""
    plain = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(plain, r"(?s)^(.*?://[^/?]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(F.translate(head, UPPER, LOWER), F.substr(plain, F.length(head) + 1)))


def _first_group(text: Column, pattern: str, groups: int) -> Column:
    found = [F.regexp_extract(text, pattern, k + 1) for k in range(groups)]
    return F.trim(F.regexp_replace(F.concat(*found), "&amp;", "&"))


def _resolved(target: Column, url: Column) -> Column:
    """An absolute address of a link target on the page ``url``."""
    scheme, name = F.regexp_extract(url, _URL, 1), F.regexp_extract(url, _URL, 2)
    site = F.concat(scheme, F.lit("://"), name)
    folder = F.regexp_extract(path(url), r"(?s)^(.*/)", 1)
    return (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("/"), F.concat(site, target))
            .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^#|^$"), F.lit(None))
            .when(target.startswith("?"), F.concat(site, path(url), target))
            .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target)))


def alias_links(pages: DataFrame) -> DataFrame:
    """(a, b): addresses joined by a canonical link or a refresh redirect in the html of a page with columns url, html."""
    tags = F.concat(F.transform(F.regexp_extract_all("html", F.lit(_CANONICAL), F.lit(0)), lambda t: _first_group(t, _HREF, 3)),
                    F.transform(F.regexp_extract_all("html", F.lit(_REFRESH), F.lit(0)), lambda t: _first_group(t, _TARGET, 2)))
    return (pages.select("url", F.explode(tags).alias("target"))
            .select(address(F.col("url")).alias("a"), address(_resolved(F.col("target"), F.col("url"))).alias("b"))
            .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))))


def with_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (with columns host and path) with the winning ``rule`` and its verdict ``ruled``, both null if none fits.

    Every distinct host is looked up once, by each of its suffixes; what fits comes
    back as one short list per host, to each of the parts that a hot host's urls are split into.
    """
    rules = rules.select(F.col("host").alias("rule_host"), F.struct(
        (-F.length(F.concat("host", "path"))).alias("size"), (F.col("verdict") != "allow").alias("second"),
        F.concat("host", "path").alias("rule"), "path", "verdict").alias("rule"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    found = (urls.select("host").where("host != ''").distinct().select("host", F.explode(suffixes).alias("rule_host"))
             .join(rules, "rule_host").groupBy("host").agg(F.sort_array(F.collect_list("rule")).alias("fitting")))
    fits = F.try_element_at(F.filter("fitting", lambda r: F.col("path").startswith(r["path"])), F.lit(1))
    salted = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (urls.withColumn("part", F.pmod(F.xxhash64("path", *[c for c in urls.columns if c in ("url", "node")]), F.lit(SALTS)).cast("int"))
            .join(salted, ["host", "part"], "left").withColumn("fitting", fits)
            .withColumns({"rule": F.col("fitting.rule"), "ruled": F.col("fitting.verdict")}).drop("fitting", "part"))


def judged(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None, id_col: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict) of every page: its own rule's verdict, else ``block`` if an alias is blocked, else ``allow``.

    ``links`` (a, b) joins urls by redirects known from elsewhere; those in the pages' html are always used.
    """
    edges = alias_links(pages.select("url", "html"))
    if links is not None:
        known = links.select(address(F.col("a")).alias("a"), address(F.col("b")).alias("b"))
        edges = edges.unionByName(known.where("a is not null and b is not null and a != b"))
    groups = stored(components(stored(edges), "a", "b"))
    nodes = with_rules(groups.select("node", "component", host(F.col("node")).alias("host"), path(F.col("node")).alias("path")), rules)
    blocked = nodes.where("ruled = 'block'").select("component").distinct()
    aliases = groups.join(blocked, "component", "left_semi").select(F.col("node").alias("address"), F.lit(True).alias("by_alias"))
    own = with_rules(pages.select(F.col(id_col), F.col("url"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path")), rules)
    open_ = own.withColumn("address", F.when(F.col("ruled").isNull(), address(F.col("url"))))
    verdict = F.coalesce("ruled", F.when(F.col("by_alias"), "block"), F.lit("allow"))
    return open_.join(aliases, "address", "left").select(id_col, "host", "path", "rule", verdict.alias("verdict"))
