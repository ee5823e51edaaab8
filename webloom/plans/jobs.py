"""Jobs: whole runs from captured pages to tables, and from tables to results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.core.scratch import Scratch
from webloom.functions import addresses, counts, dom, text, urls
from webloom.operators import crawl, graph, merge, rollups, seeds, wallets
from webloom.operators.models import Classifiers, template_text
from webloom.sources.tables import Store


def page_features(pages: DataFrame, keep: Sequence[str] = ("domain",), url_col: str = "final_url") -> DataFrame:
    """Features of each page: one parse of its markup, and expressions on what it yields. Its address
    contexts are a table of their own (addresses.scan)."""
    d = dom.with_dom(pages.select(*keep, url_col, "html"), url_col, "html")
    css, calls = text.css_selectors(F.col("dom.css_text")), text.tracking_calls(F.col("dom.js_text"))
    outside = F.filter("dom.hrefs", lambda h: urls.is_external(h, urls.host(F.col(url_col))))
    found = F.array_distinct(F.filter(text.runs(F.col("html")), lambda x: x.rlike(f"^(?:{addresses.ANY})$")))
    return d.select(
        *keep,
        "dom.uses_css",
        "dom.uses_js",
        F.length("dom.clean_text").alias("num_chars"),
        "dom.num_img_tags",
        "dom.num_button_tags",
        "dom.num_input_tags",
        F.size(outside).alias("num_external_urls"),
        css.alias("css_rule_sequences"),
        F.col("dom.dom_paths").alias("dom_tree_sequence"),
        calls.alias("tracking_calls"),
        F.size(calls).alias("num_blacklisted_js"),
        (F.size(calls) > 0).alias("has_js_tracking"),
        F.size(found).alias("num_crypto_addresses"),
        "dom.clean_text",
        "dom.classifier_text",
        F.lit(None).cast("string").alias("perceptual_hash"),
        F.lit(None).cast("string").alias("prnu_hash"),
    )


def term_features(features: DataFrame, key: str = "domain", column: str = "clean_text") -> DataFrame:
    """(key, tfidf_top_terms, lda_top_terms, char_3grams) of each row's text; nothing is shuffled."""
    rows = features.select(key, F.col(column).alias("_text"))
    rows = counts.top_words(rows, [key, "_text"], text.content_words(F.col("_text"), 3), 10)
    rows = counts.word_buckets(rows, [key, "_text", "top"], text.content_words(F.col("_text"), 4), 10)
    rows = counts.top_grams(rows, [key, "top", "topics"], F.lower(F.col("_text")), 500)
    return rows.select(
        key,
        F.transform("top", lambda t: t["term"]).alias("tfidf_top_terms"),
        F.transform("topics", lambda t: t["term"]).alias("lda_top_terms"),
        F.map_from_entries("grams").alias("char_3grams"),
    )


def analyse(pages: DataFrame, classifiers: Classifiers | None = None) -> dict[str, DataFrame]:
    """Tables of facts from crawled pages (domain, seq, final_url, status_code, html, links, server,
    has_tls): domains, pages, addresses, edges, and the verdicts on homepages."""
    scratch = Scratch(pages.sparkSession, "analysis")
    classifiers = classifiers or Classifiers()
    ok = pages.where(urls.is_ok(F.col("status_code")))
    links = ok.select(F.col("domain").alias("src"), "seq", F.posexplode("links").alias("p", "url")).select("src", "url", F.struct("seq", "p").alias("seq"))
    home = rollups.homepages(pages).where(F.coalesce("html", F.lit("")) != "")
    features = scratch.write(page_features(home), "features")
    terms = scratch.write(term_features(features), "terms")
    sites = features.join(terms, "domain").withColumn("template_text", template_text(F.col("css_rule_sequences"), F.col("dom_tree_sequence"), F.col("tfidf_top_terms")))
    near = addresses.scan(home.select("domain", "html"), ["domain"], "html")
    contexts = near.select("domain", *[c.alias(n) for n, c in addresses.context_flags(F.col("context")).items()])
    verdicts = classifiers.classify(sites, contexts)
    names = ("domain", "language", "language_conf", "is_illicit", "illicit_conf", "category", "category_conf", "template_group", "template_conf", "has_tracking", "tracking_conf", "has_attribution", "attribution_conf")
    verdicts = verdicts.select(*names, F.col("num_crypto_addresses").cast("long").alias("num_crypto_addrs"))
    seen = ok.join(home.select("domain"), "domain", "left_semi").select("domain", "seq", "html")
    found = addresses.scan(seen, ["domain", "seq"], "html")
    found = found.select("address", "currency", "domain", "seq", addresses.self_attributed(F.col("context")).alias("self_attributed"), text.context_tags(addresses.snippet(F.col("context"))).alias("context_tags"))
    return {
        "domains": rollups.domain_rollup(pages),
        "verdicts": scratch.write(verdicts, "verdicts"),
        "pages": ok.select(
            F.col("final_url").alias("url"),
            F.coalesce(F.nullif(F.col("host"), F.lit("")), F.col("domain")).alias("domain"),
            "status_code",
            urls.content_hash(F.coalesce("html", F.lit(""))).alias("content_hash"),
            F.greatest(F.size("links"), F.lit(0)).cast("long").alias("num_links"),
            "seq",
        ),
        "addresses": found,
        "edges": graph.edges_from_links(links),
    }


def crawl_job(
    store: Store,
    seed_names: DataFrame,
    source: DataFrame,
    mode: str = "crawl",
    max_pages: int = crawl.MAX_PAGES,
    classifiers: Classifiers | None = None,
    now: Column | None = None,
    run: int | None = None,
) -> DataFrame:
    """Crawls captured pages (see crawl.captured) from seeds, analyses them and merges the facts into the store,
    in one commit of all four tables.

    run: a number of this run, larger than those before; a run that is given again changes nothing. None: the next one."""
    now = F.current_timestamp() if now is None else now
    scratch = Scratch(store.spark, "crawl-job")
    search = crawl.explore if mode == "explore" else crawl.crawl
    pages = scratch.write(search(seed_names, source, max_pages), "pages")
    run = store.mark("crawl") + 1 if run is None else run
    if run > store.mark("crawl"):
        _merge_facts(store, analyse(pages, classifiers), now, run, scratch)
    return pages.groupBy("domain").agg(F.count(F.lit(1)).alias("pages"), F.bool_or(urls.is_ok(F.col("status_code"))).alias("available")).orderBy("domain")


def _merge_facts(store: Store, facts: dict[str, DataFrame], now: Column, run: int, scratch: Scratch) -> None:
    both = facts["domains"].drop("n_pages").join(facts["verdicts"], "domain", "left").withColumn("seq", F.lit(0))
    columns = [c for c in both.columns if c not in ("domain", "seq")]
    top = store.numbers().get("last page id", 0)
    new = scratch.write(facts["pages"].withColumn("id", F.lit(top) + F.monotonically_increasing_id() + 1).withColumn("crawled_at", now), "new-pages")
    last = new.agg(F.max("id")).first()[0] or top
    blank = {"wallet_id": "string", "num_txns": "long", "deposits_usd": "double", "withdrawals_usd": "double", "is_outlier": "boolean", "is_malicious": "boolean"}
    first = facts["addresses"].withColumns({c: F.lit(None).cast(t) for c, t in blank.items()}).withColumn("seq", F.struct("domain", "seq"))
    changes = {
        "domains": (lambda old, batch: merge.upsert_columns(old, batch, "domain", columns, now), both),
        "pages": (lambda old, batch: merge.replace_rows(old, batch, "url"), new),
        "crypto_addresses": (lambda old, batch: merge.keep_first(old, batch, "address"), first),
        "graph_edges": (merge.add_weights, facts["edges"].select("src", "dst", "weight")),
    }
    batches = {name: (step, scratch.write(batch, f"{name}-batch")) for name, (step, batch) in changes.items()}  # read twice
    store.commit(batches, mark=("crawl", run), numbers={"last page id": last})


def check_job(store: Store, source: DataFrame, now: Column | None = None) -> DataFrame:
    """Asks every known domain once more; (up, total, percent)."""
    now = F.current_timestamp() if now is None else now
    got = Scratch(store.spark, "check-job").write(crawl.check(store.read("domains"), source).withColumn("seq", F.lit(0)), "got")
    store.commit({"domains": (lambda old, batch: merge.upsert_columns(old, batch, "domain", ["is_available"], now), got)})
    return rollups.online_rate(got)


def graph_job(store: Store, top_n: int = 10, use_weights: bool = False, suffix: str = ".onion") -> dict[str, DataFrame]:
    """Figures, top nodes and json of the stored graph; every edge weighs 1 unless asked otherwise. `document` is
    one json document over its rows in order, `lines` has one for each node and edge."""
    scratch = Scratch(store.spark, "graph-job")
    edges = scratch.write(store.read("graph_edges"), "edges")
    nodes = scratch.write(graph.nodes_of(edges, store.read("domains"), suffix), "nodes")
    components = scratch.write(graph.strong_components(nodes, edges), "components")
    parts = scratch.write(graph.bow_tie(nodes, edges, components), "parts")
    return {
        "stats": graph.stats(nodes, edges, suffix, components, parts),
        "top": graph.node_stats(nodes, edges, top_n, use_weights, parts),
        "document": graph.document(nodes, edges),
        "lines": graph.as_json(nodes, edges),
    }


def wallets_job(store: Store, transactions: DataFrame | None = None) -> DataFrame:
    """Clusters stored addresses into wallets, flags outliers, and writes both back; the flagged wallets."""
    known = store.read("crypto_addresses")
    scratch = Scratch(store.spark, "wallets-job")
    members = scratch.write(wallets.clusters(known, transactions), "members")
    w = scratch.write(wallets.flag_outliers(wallets.wallets(known, transactions, members)), "wallets")
    update = members.join(w.select("wallet_id", "is_outlier"), "wallet_id").select("address", "wallet_id", F.lit(0).cast("long").alias("num_txns"), F.lit(0.0).alias("deposits_usd"), F.lit(0.0).alias("withdrawals_usd"), "is_outlier")
    columns = ["wallet_id", "num_txns", "deposits_usd", "withdrawals_usd", "is_outlier"]
    store.commit({"crypto_addresses": (lambda old, batch: merge.update_known(old, batch, "address", columns), scratch.write(update, "update"))})
    return w


def report_job(store: Store) -> dict[str, DataFrame]:
    """Tidy tables of a report: counts, and with their shares of all domains the ways they are run, what
    they show, and their top servers, languages and categories."""
    d = store.read("domains")
    top = lambda c, k: rollups.top_shares(d, c, k)
    return {
        "summary": rollups.summary(d, store.read("pages"), store.read("crypto_addresses"), store.read("graph_edges")),
        "operations": rollups.operations(d),
        "servers": top("server", 5),
        "content": rollups.content(d),
        "languages": top("language", 5),
        "categories": top("category", 6),
    }


def seed_job(
    capture: DataFrame,
    blacklist: DataFrame | None,
    sitemaps: DataFrame | None = None,
    indexers: DataFrame | None = None,
    search: str | None = None,
    extra_words: DataFrame | None = None,
    max_queries: int = 30,
) -> DataFrame:
    """Sorted hidden names that captured pages (url, body) hold, less the blacklist (domain).

    sitemaps: (url) of sitemaps. indexers: (url) of lists of names, whose next pages are followed. search: a search engine's address with {query} in it, asked for the built-in words, the extra ones (seq, word)
    and pairs of them. A source that names nothing is left out; pages that were not captured hold nothing.
    """
    spark = capture.sparkSession
    sources = []
    if sitemaps is not None:
        sources.append(seeds.sitemap_names(seeds.fetched(sitemaps.select("url").distinct(), capture), None))
    if indexers is not None:
        index = dom.with_dom(seeds.fetched(indexers.select("url").distinct(), capture), "url", "body", ["url"]).select("url", F.col("dom.links").alias("links"))
        pages = seeds.indexer_pages(index).select(F.col("next_url").alias("url")).distinct()
        sources.append(seeds.names_in(seeds.fetched(pages, capture), "body"))
    if search:
        asked = seeds.search_urls(seeds.word_queries(seeds.words(spark, extra_words)), search, max_queries)
        sources.append(seeds.names_in(seeds.fetched(asked.select("url").distinct(), capture), "body"))
    if not sources:
        raise ValueError("no source of seeds is named")
    return seeds.collect(sources, blacklist).orderBy("domain")
