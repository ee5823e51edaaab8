"""URL filters with redirect equivalence, with DataFrame operations only.

Rules on (host, path prefix) judge the addresses they fit. Redirects and canonical links say that
two addresses are one resource; connected components over those edges carry a block to aliases that
no rule names, so a blocked page does not come back by another name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.core.scratch import Scratch
from webloom.operators.components import connected_components


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)


def host(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """Identity of a resource: host, path and query; scheme and fragment do not tell pages apart."""
    rest = _after(url)
    return F.concat(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1))


def fitting_rule(h: Column, p: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(name, verdict), or null.

    A rule fits its host and all subdomains, if the path starts with the rule's. The longest name (host
    and path together) wins, then the longest host; of equal ones an allow wins.
    """
    ordered = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.verdict != "allow", r.name))
    fits = lambda r: ((h == r.host) | h.endswith(f".{r.host}")) & p.startswith(r.path)
    return F.coalesce(*[F.when(fits(r), F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))) for r in ordered])


# The entities that addresses are written with.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&#47;", "/"), ("&#x2F;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def _unescaped(text: Column) -> Column:
    for name, value in ENTITIES:  # the ampersand comes last, so nothing is decoded twice
        text = F.regexp_replace(text, f"(?i){name}", value)
    return text


def _resolved(path: Column) -> Column:
    """A path from / on, without . and .. segments; .. above the top is dropped."""
    segments = F.split(F.substring(path, 2, 1 << 30), "/")
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    ends = F.when(F.element_at(segments, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), ends)


def _joined(base: Column, href: Column) -> Column:
    """An absolute address for a link found on a page: absolute, //, /, ?, # and relative links, with
    . and .. segments resolved."""
    scheme = F.regexp_extract(base, r"^([^:/?#]*):", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    whole = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(F.regexp_extract(base, r"(?s)^[^?#]*", 0), href))
        .when(href.startswith("#"), base)
        .otherwise(F.concat(folder, href))
    )
    part = lambda i: F.regexp_extract(whole, r"(?s)^(.*?://[^/?#]*)([^?#]*)(.*)$", i)
    dotted = part(2).rlike(r"(^|/)\.\.?(/|$)")
    return F.when(dotted, F.concat(part(1), _resolved(part(2)), part(3))).otherwise(whole)


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) addresses: canonical links and immediate redirects that pages declare in their html.

    What stands in comments, scripts, styles or textareas declares nothing. Entities are decoded. A tag ends
    at the next < outside quotes, so markup that never closes its tags is read in time that grows with its
    length: from no three places can the rest be in different quotes, and from two in the same it is one."""
    rest = r"""\b(?:[^"'<>]++|"[^"]*+"|'[^']*+')*+>"""
    hidden = rf"(?is)<!--.*?(?:-->|$)|<(script|style|textarea){rest}.*?(?:</\1\s*+>|$)"
    shown = F.regexp_replace(F.col(html_col), hidden, " ")
    tags = F.regexp_extract_all(shown, F.lit(f"(?is)<(?:link|meta){rest}"), F.lit(0))
    rows = pages.where(F.col(html_col).rlike(r"(?i)canonical|http-equiv")).select(F.col(url_col).alias("url"), F.explode(tags).alias("tag"))
    value = lambda name: F.coalesce(*[F.nullif(F.regexp_extract("tag", rf"""(?is)[\s"'/]{name}\s*=\s*{form}""", 1), F.lit("")) for form in ('"([^"]*)"', "'([^']*)'", "([^\\s\"'>]+)")])
    content = F.regexp_replace(_unescaped(value("content")), r"\s+", " ")  # or long runs would be cut in many ways
    refresh = F.regexp_extract(content, r"""(?is)^\s*\d*(?:\.\d*)?\s*[;,\s]\s*(?:url\s*=\s*)?["']?\s*([^"'\s]+)""", 1)
    canonical = F.col("tag").rlike(r"(?i)^<link") & F.lower(value("rel")).rlike(r"(^|\s)canonical(\s|$)")
    redirect = F.col("tag").rlike(r"(?i)^<meta") & (F.lower(F.trim(value("http-equiv"))) == "refresh")
    target = F.trim(F.when(canonical, _unescaped(value("href"))).when(redirect, refresh))
    rows = rows.withColumn("target", target).where("target <> '' and url is not null")
    return rows.select(address(F.col("url")).alias("src"), address(_joined(F.col("url"), F.col("target"))).alias("dst")).where("src <> '' and dst <> ''")


def judge(
    pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html"
) -> DataFrame:
    """(id, host, path, rule, verdict, verdict_by) for every row.

    redirects: further (src, dst) urls, such as a crawler's redirect log. An address that a rule fits
    takes the rule's verdict, so an explicit allow comes before a block that an alias would bring.
    Any other takes `block` if a rule blocks one of its aliases, else `allow`; an alias that is allowed
    does not lift another's block, or one page's link would open the gate to all. Addresses that
    occur only in edges are judged too, so a blocked redirect target counts without a row of its
    own. Null, empty and malformed urls have empty parts, fit no rule and have no aliases. Rows stay
    one for one, repeated ids included; urls of any length are read whole. An empty table gives no rows.
    Without edges no component is computed.
    """
    edges = None
    if html_col is not None:
        edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        more = redirects.select(address(F.col("src")).alias("src"), address(F.col("dst")).alias("dst"))
        edges = more if edges is None else edges.unionByName(more)
    rows = pages.select(F.col(id_col).alias(id_col), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"), address(F.col(url_col)).alias("_at"))
    rows = rows.withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    own = F.col("_rule.verdict")
    if edges is not None:
        edges = Scratch(pages.sparkSession, "aliases").write(edges.where("src <> dst").distinct(), "edges")
        edges = None if edges.isEmpty() else edges
    if edges is None:
        rows = rows.withColumn("_alias", F.lit(None).cast("string"))
    else:
        scratch = Scratch(pages.sparkSession, "verdicts")
        members = scratch.write(connected_components(edges), "members")
        at = F.concat(F.lit("x://"), F.col("node"))
        ruled = members.withColumn("v", fitting_rule(host(at), path(at), rules)["verdict"]).where("v is not null")
        spread = scratch.write(ruled.groupBy("component").agg(F.max("v").alias("_alias")), "spread")  # 'block' > 'allow'
        known = scratch.write(members.join(spread, "component").select(F.col("node").alias("_at"), "_alias"), "known")
        rows = rows.join(known, "_at", "left")
    verdict = F.coalesce(own, F.col("_alias"), F.lit("allow"))
    by = F.when(own.isNotNull(), "rule").when(F.col("_alias").isNotNull(), "alias").otherwise("default")
    return rows.select(id_col, "host", "path", F.col("_rule.name").alias("rule"), verdict.alias("verdict"), by.alias("verdict_by"))
