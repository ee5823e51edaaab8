"""Roll-ups of crawled pages, and the figures that reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import urls


def domain_rollup(pages: DataFrame) -> DataFrame:
    """(domain, is_available, server, has_tls, is_v3, n_pages) from pages (domain, seq, status_code,
    server, has_tls): the server is the first one named, over all answers."""
    ok = urls.is_ok(F.col("status_code"))
    named = F.when(F.col("server") != "", F.col("seq"))
    return pages.groupBy("domain").agg(
        F.bool_or(ok).alias("is_available"),
        F.coalesce(F.min_by("server", named), F.lit("")).alias("server"),
        F.coalesce(F.bool_or(ok & F.col("has_tls")), F.lit(False)).alias("has_tls"),
        F.first(urls.is_v3(F.col("domain"))).alias("is_v3"),
        F.count(F.lit(1)).alias("n_pages"),
    )


def homepages(pages: DataFrame) -> DataFrame:
    """The first page of each domain that answered, even an empty one."""
    order = Window.partitionBy("domain").orderBy("seq")
    return pages.where(urls.is_ok(F.col("status_code"))).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def concatenated(pages: DataFrame, key: str = "domain", seq: str = "seq", text: str = "html", sep: str = "") -> DataFrame:
    """(key, text): all texts of a key in order, joined."""
    parts = F.array_sort(F.collect_list(F.struct(seq, text)))
    return pages.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: F.coalesce(p[text], F.lit(""))), sep).alias(text))


def share(n: Column, total: Column) -> Column:
    """'n/total (x.x%)', or '0/0' where there is nothing."""
    return F.when(total > 0, F.format_string("%d/%d (%.1f%%)", n, total, F.lit(100.0) * n / total)).otherwise("0/0")


def top_counts(df: DataFrame, column: str, k: int, seq: str | None = None) -> DataFrame:
    """(value, n) of the k most frequent values, null and empty ones left out; of equals, the one
    that comes first by `seq`, else by value."""
    rows = df.where(F.col(column).isNotNull() & (F.col(column) != ""))
    first = F.min(F.col(seq)) if seq else F.first(F.col(column))
    got = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
    return got.orderBy(F.desc("n"), "first", "value").limit(k).select("value", "n")


def top_shares(df: DataFrame, column: str, k: int, seq: str | None = None) -> DataFrame:
    """As top_counts, with each value's share of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return top_counts(df, column, k, seq).crossJoin(F.broadcast(total)).select("value", "n", share(F.col("n"), F.col("total")).alias("share"))  # one row


def content(domains: DataFrame) -> DataFrame:
    """(metric, value, share) of illicit, tracked and attributed domains."""
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    counts = domains.agg(F.count(F.lit(1)).alias("total"), yes("is_illicit").alias("illicit"), yes("has_tracking").alias("tracked"), yes("has_attribution").alias("attributed"))
    return _with_shares(counts, ("illicit", "tracked", "attributed"))


def _with_shares(counts: DataFrame, names: tuple[str, ...]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"), share(F.col(n), F.col("total")).alias("share")) for n in names])
    return counts.select(F.explode(rows).alias("m")).select("m.*")


def summary(domains: DataFrame, pages: DataFrame, addresses: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, value): the eight counts that a report begins with."""
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c)
    d = domains.agg(F.count(F.lit(1)).alias("domains"), flag("is_available"), flag("is_illicit"), flag("has_tracking"), flag("has_attribution"))
    names = {"domains": "domains", "is_available": "available", "is_illicit": "illicit", "has_tracking": "tracked", "has_attribution": "attributed"}
    out = d.select(F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(k).alias("value")) for k, v in names.items()])).alias("m")).select("m.*")
    for name, df in (("pages", pages), ("addresses", addresses), ("edges", edges)):
        out = out.unionByName(df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value"))
    return out


def operations(domains: DataFrame) -> DataFrame:
    """(metric, value, share) of v3, v2, TLS and available domains. A null is_v3 is neither."""
    total = F.count(F.lit(1))
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    counts = domains.agg(total.alias("total"), yes(F.col("is_available")).alias("available"), yes(F.col("is_v3")).alias("v3"), yes(~F.col("is_v3")).alias("v2"), yes(F.col("has_tls")).alias("tls"))
    return _with_shares(counts, ("available", "v3", "v2", "tls"))


def online_rate(checked: DataFrame) -> DataFrame:
    """(up, total, percent) of availability checks."""
    got = checked.agg(F.count_if(F.coalesce(F.col("is_available"), F.lit(False))).alias("up"), F.count(F.lit(1)).alias("total"))
    return got.withColumn("percent", F.when(F.col("total") > 0, F.round(F.lit(100.0) * F.col("up") / F.col("total"), 1)))
