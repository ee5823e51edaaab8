"""Schemas of the tables that a crawl's analysis reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def _schema(text: str) -> T.StructType:
    """A schema from 'name type [not null], ...'; needs no running session."""
    fields = [f.split(" ", 2) for f in text.split(", ")]
    return T.StructType([T.StructField(f[0], _TYPES[f[1]], len(f) < 3) for f in fields])


DOMAINS = _schema(
    "domain string not null, first_seen timestamp not null, last_checked timestamp, is_v3 boolean, is_available boolean, "
    "server string, has_tls boolean, language string, language_conf double, is_illicit boolean, illicit_conf double, "
    "category string, category_conf double, template_group string, template_conf double, has_tracking boolean, "
    "tracking_conf double, has_attribution boolean, attribution_conf double, num_crypto_addrs bigint"
)
PAGES = _schema("id bigint, url string not null, domain string not null, status_code int, crawled_at timestamp not null, content_hash string, num_links bigint")
ADDRESSES = _schema(
    "address string not null, currency string not null, domain string not null, self_attributed boolean, context_tags array<string>, "
    "wallet_id string, num_txns bigint, deposits_usd double, withdrawals_usd double, is_outlier boolean, is_malicious boolean"
)
EDGES = _schema("src string not null, dst string not null, weight bigint")

TABLES = {"domains": DOMAINS, "pages": PAGES, "crypto_addresses": ADDRESSES, "graph_edges": EDGES}
