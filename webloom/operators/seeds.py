"""Seed collection: hidden-service names from captured sources, by set algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions import text, urls

# Words that searches start from.
SEED_WORDS = (
    "forum", "market", "shop", "service", "news", "blog", "wiki", "library", "privacy", "security", "anonymous",
    "hidden", "dark", "chat", "email", "hosting", "file", "search", "index", "link", "crypto", "bitcoin", "exchange",
    "wallet", "monero", "drug", "pharmacy", "hacking", "exploit", "leak", "форум", "рынок", "новости", "Forum",
    "Markt", "Nachrichten", "forum", "marché", "actualités",
)


def names_in(df: DataFrame, column: str) -> DataFrame:
    """Distinct hidden-service names in a column of texts."""
    return df.select(F.explode(text.hidden_names(F.col(column))).alias("domain")).distinct()


def fetched(wanted: DataFrame, source: DataFrame, on: str = "url") -> DataFrame:
    """Texts of wanted urls from captured (url, body) rows; empty where there is none."""
    return wanted.join(source.select(on, "body"), on, "left").withColumn("body", F.coalesce("body", F.lit("")))


# Fixed value: the namespace of sitemaps.
SITEMAPS = "http://www.sitemaps.org/schemas/sitemap/0.9"
_ENTRIES = "url array<struct<loc: array<string>>>, sitemap array<struct<loc: array<string>>>, _corrupt string"


def sitemap_locs(body: Column) -> Column:
    """Texts of the <loc> entries of a sitemap or a sitemap index, by a parse of its XML. Elements count that are
    in the sitemaps' namespace, by default or by a prefix; comments and other namespaces' elements do not.
    Null for what is no XML, or names the namespace nowhere."""
    name = rf"""\s*=\s*["']{SITEMAPS.replace(".", "[.]")}["']"""
    prefix = F.regexp_extract(body, rf"xmlns:([A-Za-z_][\w.-]*){name}", 1)
    plain = F.when(body.rlike(rf"\bxmlns{name}"), body).when(prefix != "", F.regexp_replace(body, F.concat(F.lit("<(/?)"), prefix, F.lit(":")), F.lit("<$1")))
    found = F.from_xml(plain, _ENTRIES, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    entries = F.concat(*[F.coalesce(found[c], F.array().cast("array<struct<loc: array<string>>>")) for c in ("url", "sitemap")])
    return F.when(found["_corrupt"].isNull(), F.flatten(F.filter(F.transform(entries, lambda e: e["loc"]), lambda x: x.isNotNull())))


def sitemap_names(sitemap: DataFrame, blacklist: DataFrame | None, body: str = "body") -> DataFrame:
    """Names in the <loc> entries of sitemaps, or anywhere in one that has no such entry or is no XML, less the
    blacklist (domain)."""
    rows = sitemap.select(F.col(body).alias("t"), sitemap_locs(F.col(body)).alias("locs"))
    found = names_in(rows.select(F.when(F.size("locs") > 0, F.array_join("locs", "\n")).otherwise(F.col("t")).alias("t")), "t")
    return found if blacklist is None else found.join(blacklist.select("domain"), "domain", "left_anti")


def indexer_pages(index: DataFrame, most: int = 5) -> DataFrame:
    """(url, next_url) of up to `most` pages of each indexer (url, links): itself first, then links to
    the same host that look like pages of a list."""
    own = index.select("url", F.col("url").alias("next_url"), F.lit(0).alias("o"))
    links = index.select("url", F.explode("links").alias("next_url"), F.lit(1).alias("o"))
    links = links.where((urls.host(F.col("url")) == urls.host(F.col("next_url"))) & F.col("next_url").rlike(r"(?i)page|next|p=\d"))
    rows = own.unionByName(links.where("next_url <> url")).distinct()
    order = Window.partitionBy("url").orderBy("o", "next_url")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("url", "next_url")


def word_queries(words: DataFrame, first: int = 20, max_pairs: int = 50, word: str = "word", seq: str = "seq") -> DataFrame:
    """(n, query): the words in order, then pairs of the first `first`, the earlier one first."""
    w = words.select(F.col(seq).alias("seq"), F.col(word).alias("word"))
    head = w.orderBy("seq").limit(first)
    a, b = head.alias("a"), head.alias("b")
    pairs = a.join(F.broadcast(b), F.col("a.seq") < F.col("b.seq"))  # `first` rows
    pairs = pairs.select(F.col("a.seq").alias("s1"), F.col("b.seq").alias("s2"), F.concat_ws(" ", "a.word", "b.word").alias("query"))
    pairs = pairs.orderBy("s1", "s2").limit(max_pairs)
    both = w.select(F.lit(0).alias("k"), F.col("seq").alias("s1"), F.lit(0).cast("long").alias("s2"), F.col("word").alias("query"))
    both = both.unionByName(pairs.select(F.lit(1).alias("k"), "s1", F.col("s2").cast("long").alias("s2"), "query"))
    return both.select(F.row_number().over(Window.orderBy("k", "s1", "s2")).alias("n"), "query")  # a word list and max_pairs rows


def search_urls(queries: DataFrame, template: str, max_queries: int = 30) -> DataFrame:
    """(n, query, url) of the first `max_queries`; {query} in the template is filled percent-encoded."""
    head, _, tail = template.partition("{query}")
    rows = queries.orderBy("n").limit(max_queries)
    return rows.withColumn("url", F.concat(F.lit(head), urls.quoted(F.col("query")), F.lit(tail)))


def collect(sources: list[DataFrame], blacklist: DataFrame | None) -> DataFrame:
    """Distinct names of all sources less the blacklist. Without a blacklist nothing is let through:
    an unreadable list must not open the gate."""
    if blacklist is None:
        raise ValueError("a blacklist is needed; pass an empty one to say that nothing is on it")
    found = sources[0].select("domain")
    for s in sources[1:]:
        found = found.unionByName(s.select("domain"))
    return found.distinct().join(blacklist.select("domain"), "domain", "left_anti")


def words(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """(seq, word): the built-in words, and behind them the extra ones (seq, word)."""
    own = spark.createDataFrame(list(enumerate(SEED_WORDS)), "seq long, word string")
    return own if extra is None else own.unionByName(extra.select((F.col("seq") + len(SEED_WORDS)).alias("seq"), "word"))
