"""URL and host expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = r"(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/:?#]+)"
HOST = rf"^[A-Za-z][A-Za-z0-9+.\-]*://{_NAME}"
LOOSE_HOST = rf"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//{_NAME}"
#: Link prefixes that lead nowhere.
DEAD_PREFIX = "^(#|mailto:|javascript:)"


def host(url: Column) -> Column:
    """Lower-cased host of an absolute URL, or an empty string; an IPv6 address without its brackets."""
    return F.lower(F.btrim(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1), F.lit("[]")))


def link_host(href: Column) -> Column:
    """Host that a link names itself; links such as //h/x name one too."""
    return F.lower(F.btrim(F.regexp_extract(F.coalesce(href, F.lit("")), LOOSE_HOST, 1), F.lit("[]")))


def requested(url: Column) -> Column:
    """A url as a server is asked for it: scheme and host in lower case, / for an empty path, no fragment.
    What is not an absolute url stays as it is."""
    part = lambda i: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)([^#]*)", i)
    root, rest = part(1), part(2)
    return F.when(root == "", url).otherwise(F.concat(F.lower(root), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def is_hidden(domain: Column, suffix: str = ".onion") -> Column:
    """Whether a domain lies in the hidden network."""
    return F.coalesce(F.lower(domain).endswith(suffix), F.lit(False))


def is_v3(domain: Column) -> Column:
    return F.length(F.split_part(domain, F.lit("."), F.lit(1))) == 56


def is_external(href: Column, base_host: Column) -> Column:
    """Whether a link leads to another host. Empty, fragment, mail and script links do not."""
    h = link_host(href)
    return ~F.coalesce(href, F.lit("")).rlike(DEAD_PREFIX) & (h != "") & (h != F.coalesce(base_host, F.lit("")))


def url_key(url: Column) -> Column:
    return F.sha2(F.lower(url), 256)


def content_hash(html: Column) -> Column:
    return F.sha2(html, 256)


def has_tls(url: Column) -> Column:
    return F.coalesce(url.startswith("https://"), F.lit(False))


def is_ok(status: Column) -> Column:
    """Any answer below 500 counts, 404 too; no answer does not."""
    return F.coalesce(status < 500, F.lit(False))


def seed_url(seed: Column) -> Column:
    return F.when(seed.startswith("http"), seed).otherwise(F.concat(F.lit("http://"), seed))


def quoted(text: Column) -> Column:
    """Percent-encoded, with %20 for a space."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
