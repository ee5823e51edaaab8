"""Crawling as search over captured pages; nothing is fetched from a network.

A page source is a DataFrame with url and html and, if the crawler stored them, final_url, status_code,
server, error, content_type, captured_at and links: see captured(). A search never touches the markup: an
index is written once, a row for each address with its links, hidden names and the key of its markup, laid
out by address, so that each round shuffles the addresses it asks for and nothing else. Of several captures
of one address the latest counts, whole. The markup joins by its key, when all pages are known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.core.scratch import Scratch
from webloom.functions import dom, text, urls

MAX_PAGES = 75


# Names of failures, and what a crawler's message for them holds.
ERRORS = (("ssl_error", "ssl"), ("connect_timeout", "connect ?time"), ("read_timeout", "read ?time"))


def captured(source: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(url, final_url, status_code, html, server, error, captured_at, links) of a capture that may lack some of it.

    Without a status a page with markup was answered with 200; without a final url a page is where it
    was asked for; links are null where the capture has none. The markup counts only where the content
    type, where that is a column, says html. An error that is none of ERRORS stays as it is.
    only: (domain), hosts to which the capture is cut down first."""
    have = set(source.columns)
    value = lambda name, default: F.col(name) if name in have else default
    if only is not None:
        source = source.withColumn("_domain", F.coalesce(F.nullif(urls.host(F.col("url")), F.lit("")), "url"))
        source = source.join(only.select(F.col("domain").alias("_domain")).distinct(), "_domain", "left_semi")
    html = F.when(F.lower(value("content_type", F.lit("text/html"))).contains("html"), F.col("html")).otherwise("")
    error = value("error", F.lit(None).cast("string"))
    for name, pattern in ERRORS:
        error = F.when(F.lower(error).rlike(pattern), name).otherwise(error)
    return source.select(
        "url",
        F.coalesce(value("final_url", F.lit(None).cast("string")), "url").alias("final_url"),
        value("status_code", F.when(F.col("html").isNotNull(), 200)).cast("int").alias("status_code"),
        html.alias("html"),
        value("server", F.lit(None).cast("string")).alias("server"),
        error.alias("error"),
        value("captured_at", F.lit(None).cast("timestamp")).alias("captured_at"),
        value("links", F.lit(None).cast("array<string>")).alias("links"),
    )


#: What tells two captures of one address apart, the latest first; the rest only makes the choice a defined one.
_ORDER = ("captured_at", "status_code", "html_key", "final_url", "error", "server")


def _keyed(rows: DataFrame) -> DataFrame:
    """Captured rows by the address that was asked for, with a key of their markup."""
    return rows.withColumns({"address": urls.requested(F.col("url")), "html_key": F.sha2(F.coalesce("html", F.lit("")), 256)})


def _latest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(address, columns) of the last capture of each address; what has no time is older than all that has."""
    best = rows.groupBy("address").agg(F.max_by(F.struct(*columns), F.struct(*_ORDER)).alias("one"))
    return best.select("address", "one.*")


def page_index(source: DataFrame, only: DataFrame | None = None, names: bool = False) -> DataFrame:
    """A written table, a row for each captured address: (address, final_url, status_code, error, server, links,
    names, blank, html_key). Each page's markup is parsed once, and only where the capture has no links.

    only: as for captured(). names: whether the hidden names in the markup are wanted."""
    scratch = Scratch(source.sparkSession, "index")
    rows = _keyed(captured(source, only))
    found = text.hidden_names(F.col("html")) if names else F.lit(None).cast("array<string>")
    rows = rows.withColumns({"names": found, "blank": F.coalesce("html", F.lit("")) == ""})
    slim = ["address", "names", "blank", *_ORDER]
    if "links" in source.columns:
        rows = rows.select(*slim, "links")
    else:
        rows = dom.with_dom(rows, "final_url", "html", slim).withColumn("links", F.col("dom.links"))
    return scratch.bucketed(_latest(rows, ["final_url", "status_code", "error", "server", "links", "names", "blank", "html_key"]), "pages", "address")


def fetch(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """One answer for each wanted url, with the columns of a page index: https before http, http only where
    https met a TLS error.

    A url that the index does not have answers with an error and no status."""
    secure = F.regexp_replace("url", "^http://", "https://")
    tries = wanted.select("*", F.explode(F.when(secure != F.col("url"), F.array(F.struct(F.lit(0).alias("o"), secure.alias("u")), F.struct(F.lit(1).alias("o"), F.col("url").alias("u")))).otherwise(F.array(F.struct(F.lit(0).alias("o"), F.col("url").alias("u"))))).alias("t"))
    got = tries.withColumn("_asked", urls.requested(F.col("t.u"))).join(index.withColumn("_u", F.col("address")), F.col("_asked") == F.col("_u"), "left")
    got = got.withColumn("error", F.when(F.col("_u").isNull(), F.coalesce("error", F.lit("not captured"))).otherwise(F.col("error")))
    usable = (F.col("t.o") == 0) & ~F.coalesce(F.col("error") == "ssl_error", F.lit(False)) & F.col("_u").isNotNull()
    rank = F.when(usable, 0).when(F.col("t.o") == 1, 1).otherwise(2)
    one = got.withColumn("_n", F.row_number().over(Window.partitionBy(*wanted.columns).orderBy(rank, "t.o"))).where("_n = 1")
    final = F.coalesce("final_url", "t.u")
    rest = [c for c in index.columns if c != "final_url"]
    return one.select(*wanted.columns, final.alias("final_url"), urls.host(final).alias("host"), *rest, urls.has_tls(final).alias("has_tls"))


def check(domains: DataFrame, source: DataFrame) -> DataFrame:
    """(domain, is_available) of one http request each, of the address that a crawl of the domain begins with."""
    wanted = domains.select("domain", urls.requested(urls.seed_url(F.col("domain"))).alias("address")).distinct()
    hosts = wanted.select(F.coalesce(F.nullif(urls.host(F.col("address")), F.lit("")), "address").alias("domain"))
    answers = _latest(_keyed(captured(source, hosts)), ["status_code"])
    got = wanted.join(answers, "address", "left")
    return got.groupBy("domain").agg(F.max(urls.is_ok(F.col("status_code"))).alias("is_available"))


def _hosts(seeds: DataFrame) -> DataFrame:
    """(domain, url) of each seed."""
    start = seeds.select(urls.seed_url(F.col("seed")).alias("url"))
    return start.select(F.coalesce(F.nullif(urls.host(F.col("url")), F.lit("")), "url").alias("domain"), "url")


def _visits(seeds: DataFrame, index: DataFrame, max_pages: int | None, max_rounds: int, scratch: Scratch) -> DataFrame:
    """What crawl() gives, with the key of the markup in place of the markup."""
    front = _hosts(seeds).select("domain", "url", F.lit(0).cast("long").alias("parent"), F.lit(0).alias("place"))
    had = None
    for depth in range(max_rounds):
        front = front.withColumn("key", urls.url_key(F.col("url")))
        one = Window.partitionBy("domain", "key").orderBy("parent", "place")
        front = front.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
        if had is None:
            front = front.withColumn("had", F.lit(0).cast("long"))
        else:
            front = front.join(scratch.table("visited").select("domain", "key"), ["domain", "key"], "left_anti").join(had, "domain", "left")
        order = Window.partitionBy("domain").orderBy("parent", "place", "key")
        front = front.withColumn("seq", F.coalesce("had", F.lit(0)) + F.row_number().over(order))
        if max_pages is not None:
            front = front.where(F.col("seq") <= max_pages)
        got = scratch.write(fetch(front.select("domain", "url", "key", "seq", F.lit(depth).alias("depth")), index), f"round{depth}")
        if got.isEmpty():
            break
        scratch.append(got, "visited")
        ok = got.where(urls.is_ok(F.col("status_code")) & ~F.col("blank"))
        links = ok.select("domain", F.col("seq").alias("parent"), F.posexplode("links").alias("place", "url"))
        front = links.where(urls.host(F.col("url")) == F.col("domain"))
        counts = got.groupBy("domain").agg(F.max("seq").alias("had"))  # seq goes on from what a host had
        had = scratch.write(counts if had is None else had.unionByName(counts).groupBy("domain").agg(F.max("had").alias("had")), f"had{depth}")
        scratch.drop(f"round{depth - 1}", f"had{depth - 1}")
    else:
        raise RuntimeError(f"there are links to follow after {max_rounds} rounds")
    return scratch.table("visited") if had is not None else got


def _with_markup(visited: DataFrame, source: DataFrame) -> DataFrame:
    """Visits with the markup that their keys name; the capture is read once more, and not parsed."""
    rows = _keyed(captured(source, visited.select(F.coalesce(F.nullif(urls.host(F.col("address")), F.lit("")), "address").alias("domain"))))
    markup = rows.groupBy("address", "html_key").agg(F.first("html").alias("html"))
    out = visited.join(markup, ["address", "html_key"], "left")
    return out.select("domain", "url", "seq", "depth", "final_url", "host", "status_code", "html", "links", "server", "error", "has_tls")


def crawl(seeds: DataFrame, source: DataFrame, max_pages: int | None = MAX_PAGES, max_rounds: int = 10_000) -> DataFrame:
    """(domain, seq, url, answer ...) of a breadth-first crawl of each seed's host, a row a page.

    seeds: (seed). Pages of a host come in the order of a first-in, first-out queue: by depth, then by
    the page that named them, then by the place of the link. A page is visited once whatever the case
    of its url, pages that fail count, and a host gets max_pages at most, or any number where that is None.
    Of several captures of a url the latest counts. Raises if there are links to follow after max_rounds.
    """
    index = page_index(source, _hosts(seeds))
    return _with_markup(_visits(seeds, index, max_pages, max_rounds, Scratch(seeds.sparkSession, "crawl")), source)


def explore(seeds: DataFrame, source: DataFrame, max_pages: int | None = MAX_PAGES, max_rounds: int = 100) -> DataFrame:
    """As crawl, and then again from the hidden names that the pages hold, until there are no new ones; all
    rounds read one index of the whole capture.

    Raises if there are some after max_rounds."""
    spark = seeds.sparkSession
    scratch, index = Scratch(spark, "explore"), page_index(source, names=True)
    known = scratch.write(seeds.select("seed").distinct(), "known0")
    todo = known
    for k in range(1, max_rounds + 1):
        got = scratch.write(_visits(todo, index, max_pages, 10_000, Scratch(spark, "crawl")), f"visits{k}")
        scratch.append(got, "all")
        found = got.select(F.explode("names").alias("seed")).distinct()
        todo = scratch.write(found.join(known, "seed", "left_anti"), f"todo{k}")
        if todo.isEmpty():
            return _with_markup(scratch.table("all"), source)
        known = scratch.write(known.unionByName(todo), f"known{k}")
        scratch.drop(f"visits{k}", f"todo{k - 1}", f"known{k - 1}")
    raise RuntimeError(f"hidden names are still new after {max_rounds} rounds")
