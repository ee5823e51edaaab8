"""One pass over a page's markup, as one Arrow UDF.

Everything that needs a tree comes from a single parse: whether a page has style and script, their
text, the visible text, tags, links and the paths of its upper levels.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from html.entities import html5
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = ("script", "style", "noscript")
DEPTH, PATHS = 4, 200
ROOT = "[document]"
DEAD = ("#", "mailto:", "javascript:")

FIELDS = T.StructType(
    [
        T.StructField("uses_css", T.BooleanType()),
        T.StructField("uses_js", T.BooleanType()),
        T.StructField("css_text", T.StringType()),
        T.StructField("js_text", T.StringType()),
        T.StructField("clean_text", T.StringType()),
        T.StructField("classifier_text", T.StringType()),
        T.StructField("num_img_tags", T.LongType()),
        T.StructField("num_button_tags", T.LongType()),
        T.StructField("num_input_tags", T.LongType()),
        T.StructField("hrefs", T.ArrayType(T.StringType())),
        T.StructField("links", T.ArrayType(T.StringType())),
        T.StructField("dom_paths", T.ArrayType(T.StringType())),
    ]
)


#: One attribute, and what follows a <: a tag as far as it goes, a comment, or a declaration. Nothing in them
#: gives back what it took, so each character is looked at once or twice.
_ATTRIBUTE = r"""[^\s/>][^\s/=>]*+(?:\s*+=++\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+"""
_MARKUP = re.compile(
    rf"""<(?:(?P<close>/?)(?P<name>[a-zA-Z][^\t\n\r\f />\x00]*+)(?P<body>(?:[\s/]++|{_ATTRIBUTE})*+)(?P<end>>?)|!--(?:-?>|.*?(?:--!?>|\Z))|[!?/][^>]*+>?)""",
    re.DOTALL,
)
_VALUES = re.compile(r"""([^\s/>][^\s/=>]*+)(?:\s*+=++\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in ("script", "style")}
_LONG_REFERENCE = re.compile(r"&#(?:\d{8,}|[xX][0-9a-fA-F]{8,});?")


_CLOSED_REFERENCE = re.compile(r"&(?:#(?:[0-9]++|[xX][0-9a-fA-F]++)|[a-zA-Z][a-zA-Z0-9]*+);")


def _unescaped(text: str) -> str:
    return unescape(_LONG_REFERENCE.sub("\ufffd", text)) if "&" in text else text


def _closed_unescaped(text: str) -> str:
    """As _unescaped, but what has no semicolon is no reference: &amp stays as it is."""
    return _CLOSED_REFERENCE.sub(lambda m: _unescaped(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0]), text) if "&" in text else text


class _Page:
    """Collects what FIELDS names in one pass over the markup, in time that grows with its length.

    An end tag closes the nearest open element of its name and what is open within it; one that matches
    nothing is ignored. Void elements never open. Scripts and styles are text up to their end tags. Markup
    that ends within a tag or a comment ends before it. Open elements are also kept by name, and silent
    ones counted, so nothing looks through all of them: each is opened and closed once. With `closed_only`
    text keeps references without a semicolon, which HTML reads as well.
    """

    def __init__(self, strict_css: bool, closed_only: bool = False):
        self.strict_css = strict_css
        self.unescaped = _closed_unescaped if closed_only else _unescaped
        self.open: list[str] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # of open elements, by name
        self.silent = 0
        self.css = self.js = False
        self.sheets: list[str] = []
        self.scripts: list[str] = []
        self.text: list[str] = []
        self.all_text: list[str] = []
        self.tags = {"img": 0, "button": 0, "input": 0}
        self.hrefs: list[str] = []
        self.shown_hrefs: list[str] = []
        self.paths = [ROOT]

    def feed(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            found = html.find("<", at)
            if found < 0:
                found = n
            if found > at:
                self.data(self.unescaped(html[at:found]))
            if found == n:
                return
            m = _MARKUP.match(html, found)
            if m is None:
                self.data("<")
                at = found + 1
                continue
            at = m.end()
            if m["name"] is None:
                continue
            if not m["end"]:
                return
            name = m["name"].lower()
            if m["close"]:
                self.closed(name)
            else:
                at = self.started(name, m["body"], html, at)

    def started(self, tag: str, body: str, html: str, at: int) -> int:
        """Takes in a start tag; where to go on, which for scripts and styles is behind their text."""
        given = {k.lower(): _unescaped(a or b or c) for k, a, b, c in _VALUES.findall(body)} if body and tag in ("a", "link", "script") else {}
        if tag == "style" or (tag == "link" and not self.strict_css and "stylesheet" in given.get("rel", "").lower().split()):
            self.css = True
        if tag == "script":
            self.js = True
        linked = tag == "a" and "href" in given
        if linked:
            self.hrefs.append(given["href"])
        if not self.silent and tag not in SILENT:
            if tag in self.tags:
                self.tags[tag] += 1
            if linked:
                self.shown_hrefs.append(given["href"])
            if len(self.open) < DEPTH and len(self.paths) < PATHS:
                self.paths.append(">".join([ROOT, *self.open, tag]))
        if tag in VOID or _self_closing(body):
            if tag == "style":
                self.sheets.append("\n")
            if tag == "script" and not given.get("src"):
                self.scripts.append("\n")
            return at
        self.places[tag].append(len(self.open))
        self.open.append(tag)
        self.silent += tag in SILENT
        if tag not in _RAW_END:
            return at
        end = _RAW_END[tag].search(html, at)
        if end is None:
            return len(html)
        if tag == "style":
            self.sheets.append(html[at : end.start()] + "\n")
        elif not given.get("src"):
            self.scripts.append(html[at : end.start()] + "\n")
        return end.start()

    def closed(self, tag: str) -> None:
        if not self.places[tag]:
            return
        at = self.places[tag][-1]
        for gone in self.open[at:]:
            self.places[gone].pop()
            self.silent -= gone in SILENT
        del self.open[at:]

    def data(self, data: str) -> None:
        piece = data.strip()
        if piece:
            self.all_text.append(piece)
            if not self.silent:
                self.text.append(piece)


def _self_closing(body: str) -> bool:
    """Whether a tag ends with a slash that is not part of an attribute's value."""
    if not body.endswith("/"):
        return False
    last = None
    for last in _VALUES.finditer(body):
        pass
    return last is None or last.end() < len(body)


def absolute_links(base: str, hrefs: list[str]) -> list[str]:
    """Links that can be crawled: absolute, http or https. A malformed one is left out."""
    out = []
    for href in hrefs:
        href = href.strip()
        if not href or href.startswith(DEAD):
            continue
        try:
            full = urljoin(base, href)
            if urlsplit(full).scheme in ("http", "https"):
                out.append(full)
        except ValueError:
            continue
    return out


def parse(html: str | None, url: str | None, strict_css: bool = False, closed_only: bool = False) -> tuple:
    """Values of FIELDS. A null page is an empty one."""
    p = _Page(strict_css, closed_only)
    p.feed(html or "")
    text = re.sub(r"\s+", " ", " ".join(p.text))
    counts = (p.tags["img"], p.tags["button"], p.tags["input"])
    return (p.css, p.js, "".join(p.sheets), "".join(p.scripts), text, " ".join(p.all_text), *counts, p.shown_hrefs, absolute_links(url or "", p.hrefs), p.paths)


def with_dom(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None, strict_css: bool = False, closed_only: bool = False) -> DataFrame:
    """`keep` columns (None: all) and `dom`, a struct of FIELDS, for every row."""
    columns = list(pages.columns if keep is None else keep)
    schema = T.StructType([*(pages.schema[c] for c in columns), T.StructField("dom", FIELDS)])
    kinds = pa.struct([(f.name, {"boolean": pa.bool_(), "string": pa.string(), "bigint": pa.int64()}.get(f.dataType.simpleString(), pa.list_(pa.string()))) for f in FIELDS])
    names = FIELDS.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(columns)
        for b in batches:
            rows = [dict(zip(names, parse(h, u, strict_css, closed_only), strict=True)) for u, h in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(rows, kinds)], names=[*columns, "dom"])

    return pages.select(*columns, F.col(url_col).alias("_url"), F.col(html_col).alias("_html")).mapInArrow(run, schema)
