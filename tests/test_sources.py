import pytest
from pyspark.sql import functions as F

from webloom.operators import crawl, merge, seeds
from webloom.sources import tables
from webloom.streaming import merges

A, B, C, D = ("a" * 16, "b" * 16, "c" * 16, "d" * 16)


def test_text_sources(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("# note\none.onion\n\n  # kept\n two \n")
    assert [r.seed for r in tables.read_seeds(spark, f"file://{tmp_path}/seeds.txt").collect()] == ["one.onion", "# kept", "two"]
    (tmp_path / "words.txt").write_text("b\n\n a \nc")
    assert [r.word for r in tables.read_words(spark, f"file://{tmp_path}/words.txt").orderBy("seq").collect()] == ["b", "a", "c"]
    assert tables.split_list(" a, ,b ,") == ["a", "b"]
    tables.write_seeds(spark.createDataFrame([("z",), ("a",), ("z",)], "domain string"), f"file://{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/out").collect()] == ["a", "z"]


def test_seed_sources(spark):
    ns = seeds.SITEMAPS
    own = f"<?xml version='1.0'?><!-- <loc>{C}.onion</loc> --><urlset xmlns='{ns}' xmlns:i='http://i'><url><loc>http://{A}.onion/</loc><i:loc>{C}.onion</i:loc></url><p>{C}.onion</p></urlset>"
    named = f"<s:sitemapindex xmlns:s=\"{ns}\"><s:sitemap><s:loc>http://{D}.onion/</s:loc></s:sitemap><loc>{C}.onion</loc></s:sitemapindex>"
    sitemap = spark.createDataFrame([(own,), (named,), (f"plain {B}.onion",), (None,), ("",)], "body string")
    raw = [(f"<urlset><url><loc>{A}.onion</loc></url>{B}.onion</urlset>",), (f"<urlset xmlns='{ns}'><url><loc>{D}.onion",)]  # in no namespace, cut
    assert {r.domain for r in seeds.sitemap_names(spark.createDataFrame(raw, "body string"), None).collect()} == {f"{x}.onion" for x in (A, B, D)}
    listed = spark.createDataFrame([(f"{B}.onion",)], "domain string")
    assert {r.domain for r in seeds.sitemap_names(sitemap, None).collect()} == {f"{A}.onion", f"{B}.onion", f"{D}.onion"}
    assert {r.domain for r in seeds.sitemap_names(sitemap, listed).collect()} == {f"{A}.onion", f"{D}.onion"}
    with pytest.raises(ValueError):
        seeds.collect([listed], None)
    index = spark.createDataFrame([("http://i.test/", ["http://i.test/page/2", "http://i.test/other", "http://x.test/page/1", "http://i.test/?p=3"])], "url string, links array<string>")
    assert [r.next_url for r in seeds.indexer_pages(index).orderBy("next_url").collect()] == ["http://i.test/", "http://i.test/?p=3", "http://i.test/page/2"]
    body = spark.createDataFrame([("http://i.test/", "text")], "url string, body string")
    assert seeds.fetched(index.select("url"), body).first().body == "text"


def test_fetch_order(spark):
    want = spark.createDataFrame([("http://a.test/",), ("http://b.test/",), ("http://c.test/",), ("https://d.test/",)], "url string")
    row = lambda u, s, e: (u, None, s, "x", [], "", e)
    source = [row("https://a.test/", 200, None), row("http://a.test/", 201, None), row("https://b.test/", None, "ssl_error"), row("http://b.test/", 202, None), row("https://d.test/", 203, None)]
    source = spark.createDataFrame(source, "url string, final_url string, status_code int, html string, links array<string>, server string, error string")
    got = {r.url: (r.status_code, r.has_tls, r.error) for r in crawl.fetch(want, crawl.page_index(source)).collect()}
    assert got["http://a.test/"] == (200, True, None) and got["http://b.test/"] == (202, False, None) and got["https://d.test/"] == (203, True, None)
    assert got["http://c.test/"][0] is None and got["http://c.test/"][2] == "not captured"


def test_stream_of_edges(spark, tmp_path):
    store = tables.Store(spark, f"file://{tmp_path}/db")
    for k in range(2):
        spark.createDataFrame([("x", "y")] * (3 - k), "src string, dst string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("src string, dst string").parquet(f"{tmp_path}/in")
        q = merges.edge_counter(store, f"{tmp_path}/cp")(stream).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [(r.src, r.dst, r.weight) for r in store.read("graph_edges").collect()] == [("x", "y", 5)]
    batch = spark.createDataFrame([("x", "y")], "src string, dst string")
    for epoch in (1, 2, 2, 0):  # a batch that a restarted stream gives again is told by its number
        merges.once(store, "graph_edges", merge.add_counts, f"{tmp_path}/cp")(batch, epoch)
    assert store.read("graph_edges").first().weight == 6 and store.mark(f"{tmp_path}/cp") == 2
    merges.once(store, "graph_edges", merge.add_counts, "another")(batch, 0)
    assert store.read("graph_edges").first().weight == 7 and store.mark(f"{tmp_path}/cp") == 2
    assert store.one("graph_edges", "x", "y").count() == 1 and store.read("domains").where(F.lit(True)).count() == 0


def test_captures_feed_a_crawl(spark, tmp_path):
    """Responses written and read by the data source, with and without its filter of hosts."""
    from webloom.sources import captures

    captures.register(spark)
    rows = [
        ("http://h.test/", 200, "<a href='/x'>é</a>\r\n\r\nmore", "nginx\r\nX: y", "text/html; charset=utf-8", None, 5), ("http://h.test/x", 404, "", None, "text/html", None, 6),
        ("http://h.test/", 500, "old", None, None, None, 1), ("http://other.test/", None, None, None, None, "refused", None), ("http://[::1]:8/", 200, "six", None, "text/plain; charset=nonsense", None, 7),
    ]
    df = spark.createDataFrame(rows, "url string, status_code int, html string, server string, content_type string, error string, at int")
    df = df.withColumn("captured_at", F.timestamp_seconds("at")).drop("at")
    folder = f"file://{tmp_path}/c"
    df.repartition(2).write.format(captures.FORMAT).mode("append").save(folder)
    back = spark.read.format(captures.FORMAT).load(folder)
    columns = ["url", "status_code", "error", "captured_at"]
    assert sorted(map(tuple, back.select(columns).collect()), key=str) == sorted(map(tuple, df.select(columns).collect()), key=str)
    assert back.rdd.getNumPartitions() == len(list((tmp_path / "c").glob("*.capture"))) and not list((tmp_path / "c").glob(".*.part"))
    mine = spark.read.format(captures.FORMAT).option("hosts", "H.test,none").load(folder)
    assert {r.host for r in mine.collect()} == {"h.test"} and mine.count() == 3 and mine.where("host = 'other.test'").count() == 0
    assert back.where("host = 'h.test'").count() == 3 and {r.host for r in back.collect()} == {"h.test", "other.test", "::1"}
    got = crawl.crawl(spark.createDataFrame([("h.test",)], "seed string"), back).orderBy("seq").collect()
    assert [(r.url, r.status_code, r.html, r.server) for r in got] == [("http://h.test", 200, "<a href='/x'>é</a>\r\n\r\nmore", "nginx X: y"), ("http://h.test/x", 404, "", None)]
    (cut,) = [f for f in (tmp_path / "c").glob("*.capture") if "old" in f.read_text()][:1]
    cut.write_bytes(cut.read_bytes()[:-2])
    with pytest.raises(Exception, match="ends within"):
        back.collect()


def test_functions_in_sql(spark):
    from webloom.functions import addresses, sql, text, urls

    sql.register(spark)
    eth = "0x" + "ab" * 20
    texts = [f"İ tip <a href='x'> {eth} x{eth} {eth} {A}.onion.{B}.onion _{C}.onion {D.upper()}.ONION", "", None, f"x{eth} then {eth}!"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    df.createOrReplaceTempView("texts")
    scanned = addresses.scan(df, ["i"], "t")
    assert sorted(map(tuple, spark.sql("select i, s.* from texts, lateral address_scan(t) s").collect())) == sorted(map(tuple, scanned.collect()))
    names = spark.sql("select i, hidden_names(t) as n from texts").collect()
    assert {r.i: r.n for r in names} == {r.i: r.n for r in df.select("i", text.hidden_names(F.col("t")).alias("n")).collect()}
    scanned.createOrReplaceTempView("scanned")
    flags = scanned.select(F.struct(*[c.alias(k) for k, c in addresses.context_flags(F.col("context")).items()]).alias("f"), addresses.self_attributed(F.col("context")).alias("s"))
    assert spark.sql("select context_flags(context) as f, self_attributed(context) as s from scanned").collect() == flags.collect()
    hosts = ["http://U:p@A.test:1/x", "https://[::1]:80/x", "nothing", None]
    got = spark.createDataFrame([(h,) for h in hosts], "u string").selectExpr("url_host(u) as h", "is_hidden(u) as k", "u")
    assert [r.h for r in got.collect()] == ["a.test", "::1", "", ""] == [r[0] for r in got.select(urls.host(F.col("u"))).collect()]
