import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.functions import dom
from webloom.operators import crawl, merge, wallets
from webloom.plans import jobs
from webloom.sources.tables import Store

A, B = "a" * 16, "b" * 56
ETH = "0x" + "ab" * 20
PAGE = f"<html><head><style>p{{margin:0}}</style><script>document.cookie</script></head><body><p>forum market market <a href='/x'>x</a><a href='http://{B}.onion/'>b</a> tip {ETH}</p></body></html>"


def captured(spark):
    rows = [
        (f"http://{A}.onion", None, 200, PAGE, [f"http://{A}.onion/x", f"http://{B}.onion/"], "nginx", None),
        (f"http://{A}.onion/x", None, 404, "<p>gone</p>", [], "", None),
        (f"http://{B}.onion", None, 503, "", [], "Apache", None),
    ]
    return spark.createDataFrame(rows, "url string, final_url string, status_code int, html string, links array<string>, server string, error string")


def test_crawl_to_report(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    start = spark.createDataFrame([(f"{A}.onion",)], "seed string")
    done = {r.domain: (r.pages, r.available) for r in jobs.crawl_job(store, start, captured(spark), mode="explore").collect()}
    assert done == {f"{A}.onion": (2, True), f"{B}.onion": (1, False)}
    d = {r.domain: r for r in store.read("domains").collect()}
    assert d[f"{A}.onion"].server == "nginx" and d[f"{A}.onion"].has_tracking and d[f"{A}.onion"].has_attribution and d[f"{A}.onion"].num_crypto_addrs == 1
    assert d[f"{B}.onion"].is_v3 and not d[f"{B}.onion"].is_available and d[f"{B}.onion"].language is None
    (addr,) = store.read("crypto_addresses").collect()
    assert (addr.address, addr.currency, addr.domain, addr.self_attributed) == (ETH, "ethereum", f"{A}.onion", True)
    assert {(r.src[0], r.dst[0], r.weight) for r in store.read("graph_edges").collect()} == {("a", "a", 1), ("a", "b", 1)}
    jobs.crawl_job(store, start, captured(spark))  # a second run adds to the weights, and to nothing else
    assert {r.weight for r in store.read("graph_edges").collect()} == {2}
    assert store.read("pages").count() == 2 and store.read("crypto_addresses").count() == 1
    for _ in range(2):
        jobs.crawl_job(store, start, captured(spark), run=7)  # and the same run again to nothing
    assert {r.weight for r in store.read("graph_edges").collect()} == {3}
    jobs.wallets_job(store)
    assert store.read("crypto_addresses").first().wallet_id == ETH
    summary = {r.metric: r.value for r in jobs.report_job(store)["summary"].collect()}
    assert summary == {"domains": 2, "available": 1, "illicit": 0, "tracked": 1, "attributed": 1, "pages": 2, "addresses": 1, "edges": 2}
    out = jobs.graph_job(store)
    stats = {r.metric: r.value for r in out["stats"].collect()}
    assert stats["nodes"] == 2 and stats["components"] == 2 and stats["core"] == 1
    whole = json.loads("".join(r.json for r in out["document"].collect()))
    assert [n["id"] for n in whole["nodes"]] == [f"{A}.onion", f"{B}.onion"] and [e["weight"] for e in whole["edges"]] == [3, 3]
    rate = jobs.check_job(store, captured(spark).withColumn("url", F.concat("url", F.lit("/")))).first()
    assert (rate.up, rate.total, rate.percent) == (1, 2, 50.0)


def test_a_batch_rewrites_its_own_partitions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db", buckets=8)
    edges = lambda names: spark.createDataFrame([(n, "z", 1) for n in names], "src string, dst string, weight long")
    files = lambda: {f.relative_to(tmp_path) for f in tmp_path.glob("db/graph_edges/bucket=*/*.parquet")}
    store.commit({"graph_edges": (merge.add_weights, edges([f"n{i}" for i in range(100)]))})
    before = files()
    store.commit({"graph_edges": (merge.add_weights, edges(["n5"]))})
    gone, new = before - files(), files() - before
    assert {f.parent for f in gone} == {f.parent for f in new} and len({f.parent for f in new}) == 1 and len({f.parent for f in before}) == 8
    assert store.one("graph_edges", "n5", "z").first().weight == 2 and store.read("graph_edges").count() == 100
    plan = store.one("graph_edges", "n5", "z")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and Store(spark, f"file://{tmp_path}/db").buckets == 8


def test_a_commit_that_dies_is_whole_or_nothing(spark, tmp_path, monkeypatch):
    from webloom.sources import tables

    root = f"file://{tmp_path}/db"
    edges = spark.createDataFrame([("a", "b", 1)], "src string, dst string, weight long")
    found = spark.createDataFrame([("x", "bitcoin", "a")], "address string, currency string, domain string")
    batch = {"graph_edges": (merge.add_weights, edges), "crypto_addresses": (lambda old, new: old.unionByName(new, allowMissingColumns=True), found)}
    count = lambda: tuple(Store(spark, root).read(t).count() for t in batch)
    Store(spark, root).commit({"graph_edges": batch["graph_edges"]}, mark=("s", 1))

    def dies(*args):
        raise KeyboardInterrupt

    broken = batch | {"crypto_addresses": (dies, found)}
    with pytest.raises(KeyboardInterrupt):  # with one table aside
        Store(spark, root).commit(broken, mark=("s", 2))
    assert count() == (1, 0) and Store(spark, root).mark("s") == 1
    recover = tables.Store.recover
    monkeypatch.setattr(tables.Store, "recover", lambda self, drop=False: recover(self, drop) if drop else dies())
    with pytest.raises(KeyboardInterrupt):  # with all aside and nothing in place
        Store(spark, root).commit(batch, mark=("s", 3))
    monkeypatch.setattr(tables.Store, "recover", recover)
    assert count() == (1, 1) and Store(spark, root).mark("s") == 3
    assert Store(spark, root).read("graph_edges").first().weight == 2
    assert not Store(spark, root).commit(batch, mark=("s", 3)) and Store(spark, root).read("graph_edges").first().weight == 2


def test_column_upsert(spark):
    t = [F.lit(f"200{k}-01-01").cast("timestamp") for k in range(4)]
    old = spark.createDataFrame([], "domain string, first_seen timestamp, last_checked timestamp, is_available boolean, language string")
    give = lambda a, l: spark.createDataFrame([("d", a, l, 0)], "domain string, is_available boolean, language string, seq long")
    one = merge.upsert_columns(old, give(True, None), "domain", ["is_available", "language"], t[1])
    two = merge.upsert_columns(one, give(None, "en"), "domain", ["is_available", "language"], t[2])
    three = merge.upsert_columns(two, give(None, None), "domain", ["is_available", "language"], t[3])
    row = three.first()
    assert (row.is_available, row.language, row.first_seen.year, row.last_checked.year) == (True, "en", 2001, 2002)


def test_wallets(spark):
    known = spark.createDataFrame([(x, "d") for x in "pqrs"] + [("z", "")], "address string, domain string")
    tx = spark.createDataFrame([("1", ["p", "q"], [], 1.0, False), ("2", ["q", "r"], [], 1.0, False), ("3", ["m", "n"], [], 1.0, True)], "txid string, inputs array<string>, outputs array<string>, value_usd double, is_deposit boolean")
    got = {r.address: r.wallet_id for r in wallets.clusters(known, tx).collect()}
    assert got == {"p": "p", "q": "p", "r": "p", "s": "s", "m": "m", "n": "m"}
    flow = wallets.flows(wallets.clusters(known, tx), spark.createDataFrame([("t", ["p"], ["q"], 10.0, True)], tx.schema)).first()
    assert (flow.num_transactions, flow.num_distinct_tx, flow.total_deposits_usd) == (2, 1, 20.0)
    assert not any(r.is_outlier for r in wallets.flag_outliers(wallets.wallets(known, tx)).collect())


def test_outliers_equal_a_plain_forest(spark):
    """Trees over samples drawn from all rows by their own hashes, and the exact cut, against one process."""
    rng = np.random.default_rng(6)
    x = np.round(rng.lognormal(1, 1.5, (3000, 3)))
    rows = spark.createDataFrame([(f"w{i}", *map(float, r)) for i, r in enumerate(x)], "wallet_id string, size double, total_deposits_usd double, num_transactions double")
    trees = []
    for t in range(wallets.TREES):
        h = [r.h for r in rows.select(F.xxhash64(F.lit(42), F.lit(t), "wallet_id").alias("h")).collect()] if t < 3 else None
        if h is None:
            break
        first = np.argsort(h, kind="stable")[: wallets.SAMPLE]
        trees.append(wallets._grow(x[first], np.random.default_rng((42, t)), 0, 8))
    forest, size = wallets.grown(rows, ("size", "total_deposits_usd", "num_transactions"), "wallet_id", 3000)
    assert size == 256 and len(forest) == wallets.TREES and wallets.anomaly((forest[:3], size), x).tolist() == wallets.anomaly((trees, size), x).tolist()
    scores = wallets.anomaly((forest, size), x)
    want = {f"w{i}" for i in np.flatnonzero(scores > np.quantile(scores, 0.95))}
    got = wallets.flag_outliers(rows).collect()
    assert {r.wallet_id for r in got if r.is_outlier} == want and len(got) == 3000 and 100 < len(want) <= 150


def test_explore_raises_rather_than_stop_early(spark):
    names = [c * 16 + ".onion" for c in "cde"]
    page = "url string, final_url string, status_code int, html string, links array<string>, server string, error string"
    source = spark.createDataFrame([(f"http://{a}", None, 200, f"see {b} now", [], "", None) for a, b in zip(names, names[1:] + ["nothing"], strict=True)], page)
    start = spark.createDataFrame([(f"http://{names[0]}",)], "seed string")
    assert {r.domain for r in crawl.explore(start, source).collect()} == set(names)
    with pytest.raises(RuntimeError):
        crawl.explore(start, source, max_rounds=2)


def test_crawl_without_a_page_cap(spark):
    page = "url string, final_url string, status_code int, html string, links array<string>, server string, error string"
    leaves = [f"http://h.test/p{i}" for i in range(crawl.MAX_PAGES + 5)]
    source = spark.createDataFrame([("http://h.test", None, 200, "x", leaves, "", None)], page)
    start = spark.createDataFrame([("http://h.test",)], "seed string")
    assert crawl.crawl(start, source).count() == crawl.MAX_PAGES
    assert crawl.crawl(start, source, max_pages=None).count() == len(leaves) + 1


def test_latest_capture_counts_whole(spark, monkeypatch):
    """Captures of one url are chosen between once, by time, whatever their order; roots have one spelling."""
    rows = [
        ("http://H.test", "<a href='/old'>o</a>", 500, 5), ("http://h.test/", "<a href='/new'>n</a>", 200, 9), ("http://h.test/#x", "<a href='/none'>n</a>", 200, None),
        ("http://h.test/new", "first", 200, 1), ("http://h.test/new", "<p>second</p>", 404, 2),
    ]
    start = spark.createDataFrame([("h.test",)], "seed string")
    parsed, with_dom = [], dom.with_dom
    monkeypatch.setattr(dom, "with_dom", lambda *a, **k: parsed.append(1) or with_dom(*a, **k))
    for order in (rows, rows[::-1]):
        source = spark.createDataFrame(order, "url string, html string, status_code int, at int").withColumn("captured_at", F.timestamp_seconds("at"))
        got = [(r.seq, r.url, r.status_code, r.html, r.links) for r in crawl.crawl(start, source).orderBy("seq").collect()]
        assert got == [(1, "http://h.test", 200, "<a href='/new'>n</a>", ["http://h.test/new"]), (2, "http://h.test/new", 404, "<p>second</p>", [])]
        domains = spark.createDataFrame([("h.test",), ("other.test",)], "domain string")
        assert {r.domain: r.is_available for r in crawl.check(domains, source).collect()} == {"h.test": True, "other.test": False}
    assert len(parsed) == 2  # once a crawl


def test_rounds_read_the_index_where_it_lies(spark):
    source = spark.createDataFrame([(f"http://h.test/{i}", "x") for i in range(20)], "url string, html string")
    index = crawl.page_index(source)
    want = index.select(F.col("address").alias("url")).repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = crawl.fetch(want, index)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    asked = [line for line in plan.splitlines() if "Exchange hashpartitioning(_u" in line or "Exchange hashpartitioning(address" in line]
    assert "Bucketed: true" in plan and not asked, plan


def test_crawl_of_urls_and_markup_only(spark, tmp_path):
    """Links come from the markup, a page that is not html has none, and messages get their names."""
    html = "<a href='/x'>x</a><a href='http://other.test/'>o</a> see " + "d" * 16 + ".onion"
    source = spark.createDataFrame([("http://h.test/", html), ("http://h.test/x", "<a href='y'>y</a>"), ("http://h.test/y", "last")], "url string, html string")
    start = spark.createDataFrame([("http://h.test/",)], "seed string")
    got = [(r.seq, r.url, r.status_code) for r in crawl.crawl(start, source).orderBy("seq").collect()]
    assert got == [(1, "http://h.test/", 200), (2, "http://h.test/x", 200), (3, "http://h.test/y", 200)]
    typed = source.withColumn("content_type", F.when(F.col("url").endswith("x"), "image/png").otherwise("text/HTML"))
    assert [r.html for r in crawl.crawl(start, typed).orderBy("seq").collect()] == [html, ""]
    failed = spark.createDataFrame([("http://h.test/", None, "SSLError(certificate)"), ("http://i.test/", None, "ConnectTimeout"), ("http://j.test/", None, "Read timed out"), ("http://k.test/", None, "refused")], "url string, html string, error string")
    assert [r.error for r in crawl.captured(failed).orderBy("url").collect()] == ["ssl_error", "connect_timeout", "read_timeout", "refused"]
    store = Store(spark, f"file://{tmp_path}/db")
    done = {r.domain: r.pages for r in jobs.crawl_job(store, start, source, mode="explore").collect()}
    assert done == {"h.test": 3, "d" * 16 + ".onion": 1} and store.read("graph_edges").count() == 2
    with pytest.raises(RuntimeError):
        crawl.crawl(start, source, max_rounds=1)


def test_command_line(spark, tmp_path, capsys):
    from webloom.plans import cli

    at = f"file://{tmp_path}"
    name = lambda c: c * 16 + ".onion"
    pages = [
        ("http://map.test/s.xml", f"<urlset><url><loc>http://{name('a')}/</loc></url><url><loc>http://{name('z')}/</loc></url></urlset>"),
        ("http://list.test/", f"{name('b')} <a href='/p=2'>2</a>"), ("http://list.test/p=2", name("c")),
        ("http://find.test/?q=forum", name("d")), ("http://find.test/?q=my%20word", name("e")),
    ]
    spark.createDataFrame(pages, "url string, body string").write.parquet(f"{at}/capture")
    (tmp_path / "listed.txt").write_text(f"{name('z')}\n")
    (tmp_path / "words.txt").write_text("my word\n")
    sources = ["--sitemap", "http://map.test/s.xml", "--indexers", "http://list.test/", "--search", "http://find.test/?q={query}", "--words", f"{at}/words.txt", "--max-queries", "99"]
    run = lambda *a: cli.main(["--db", f"{at}/db", *a])
    seeds = lambda: [r.value[0] for r in spark.read.text(f"{at}/seeds").collect()]
    base = ["seed", "--capture", f"{at}/capture", "--blacklist", f"{at}/listed.txt", "--output", f"{at}/seeds"]
    assert run(*base, *sources) == 0 and seeds() == list("abcde")
    assert run(*base, *sources[:-1], "1") == 0 and seeds() == list("abcd")
    assert run(*base, *sources, "--no-sitemap", "--no-search") == 0 and seeds() == list("bc")
    with pytest.raises(ValueError):
        run(*base, *sources, "--no-sitemap", "--no-search", "--no-indexers")
    spark.createDataFrame([(f"http://{name('b')}", f"<p>forum {ETH}</p><a href='http://{name('c')}'>c</a>")], "url string, html string").write.parquet(f"{at}/pages")
    assert run("crawl", "--seeds", f"{at}/seeds", "--pages", f"{at}/pages", "--max-pages", "3") == 0
    assert run("check", "--pages", f"{at}/pages") == run("wallets") == run("report") == 0
    out = capsys.readouterr().out
    assert "1/2 (50.0%)" in out and all(x in out for x in ("summary", "operations", "servers", "content", "languages", "categories"))
    assert run("graph", "--output", f"{at}/g") == run("graph", "--output", f"{at}/l", "--lines") == 0
    parts = sorted((tmp_path / "g").glob("part-*"))
    whole = json.loads("".join(p.read_text() for p in parts))
    assert (len(whole["nodes"]), len(whole["edges"])) == (2, 1) and spark.read.text(f"{at}/l").count() == 3
