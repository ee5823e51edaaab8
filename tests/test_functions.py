import time

import duckdb
from pyspark.sql import functions as F

from webloom import queries
from webloom.functions import addresses, dom, text, urls
from webloom.operators import graph

G, B, E, X = "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", "0x" + "ab" * 20, "4A" + "b" * 93
SCANS = {
    f"Please donate to {G} now": [(G, "bitcoin", 17, False, False, False, False)],
    f"tip {E} or {E}": [(E, "ethereum", 4, True, True, False, False)],
    f"example: tip {B}": [(B, "bitcoin", 13, False, True, True, False)],
    f"_{G}": [],
    f"é{G}": [],
    B.upper(): [],
    "bc1q" + "a" * 58: [],
    f"{X} {B}": [(X, "monero", 0, False, False, False, False), (B, "bitcoin", 96, False, False, False, False)],
    f'<a href="bitcoin:{G}">pay</a>': [(G, "bitcoin", 17, False, True, False, True)],
    f"{E}ab": [],
    f"😀 accept {E}": [(E, "ethereum", 9, True, False, False, False)],
}


def test_address_scan(spark):
    df = spark.createDataFrame(list(enumerate(SCANS)), "i int, t string")
    rows = addresses.scan(df, ["i"], "t")
    flags = addresses.context_flags(F.col("context"))
    got: dict = {}
    for r in rows.select("*", addresses.self_attributed(F.col("context")).alias("own"), *[flags[n].alias(n) for n in ("near_donate", "near_example", "in_url")]).collect():
        got.setdefault(r.i, []).append((r.address, r.currency, r.pos, r.own, r.near_donate, r.near_example, r.in_url))
    for i, want in enumerate(SCANS.values()):
        assert sorted(got.get(i, [])) == sorted(want), i


def test_hidden_names(spark):
    cases = {f"http://{'a' * 56}.onion/x": ["a" * 56], f"WWW.{'B' * 16}.Onion": ["b" * 16], f"x{'a' * 56}.onion": [], "a" * 20 + ".onion": [], "a" * 15 + "1.onion": [], "a" * 16 + ".onions": []}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", text.hidden_names(F.col("t")).alias("n"))
    for r in df.collect():
        assert r.n == [f"{x}.onion" for x in list(cases.values())[r.i]]


def test_text(spark):
    one = lambda t, c: spark.createDataFrame([(t,)], "t string").select(c.alias("v")).first().v
    t = F.col("t")
    assert one("ab", text.trigrams(t)) == [] and one(None, text.trigrams(t)) == [] and one("aaaa", text.trigrams(t)) == ["aaa", "aaa"]
    assert one("abab😀", text.trigrams(t)) == ["aba", "bab", "ab😀"]
    assert one("the cat cat dog réseau", text.content_words(t, 3)) == ["cat", "cat", "dog"]
    css = {"p{margin:0}": ["p"], "@media x { a {c:d} b {e:f} } i{x:y}": ["@media x", "b", "} i"], "/*k*/ a b c d e f g h {x:y}": ["/*k*/ a b c d e"], "{}": [], " {a} b{c}": ["b"]}
    for sheet, want in css.items():
        assert one(sheet, text.css_selectors(t)) == want
    assert one("my_GAme webkitIndexedDB", text.tracking_calls(t)) == ["_ga", "indexedDB", "webkitIndexedDB"]
    words = " ".join(f"word{chr(97 + i)}" for i in range(19))
    df = spark.createDataFrame([(1, words)], "k int, t string")
    assert [r.term for r in text.topic_buckets(df, "k", "t").orderBy("bucket").collect()] == [f"word{chr(97 + i)}" for i in range(10)]


def test_external_links(spark):
    cases = {"//h/x": True, "ftp://h/x": True, "#a": False, "mailto:x": False, "javascript:x": False, "/rel": False, "http://own/x": False, "": False, "http://[x": True}
    df = spark.createDataFrame([(k,) for k in cases], "h string").select("h", urls.is_external(F.col("h"), F.lit("own")).alias("v"))
    got = {r.h: r.v for r in df.collect()}
    del got["http://[x"]  # malformed: whatever it says, it must not fail
    assert all(got[k] == cases[k] for k in got)


def test_dom():
    page = '<html><head><title>T</title><link rel="stylesheet" href="x"><script>var t="</p>";</script></head><body><p><b>x<br><p>y<noscript><img>n</noscript><img><a href="/r">l</a></body></html>'
    css, js, sheets, scripts, clean, whole, img, button, inputs, hrefs, links, paths = dom.parse(page, "http://h/d/")
    assert (css, js, img, button, inputs) == (True, True, 1, 0, 0) and sheets == "" and 'var t="</p>"' in scripts
    assert clean == "T x y l" and whole == "T x y n l" and hrefs == ["/r"] and links == ["http://h/r"]
    assert dom.parse(page, None, strict_css=True)[0] is False
    assert paths[:4] == ["[document]", "[document]>html", "[document]>html>head", "[document]>html>head>title"]
    assert dom.parse(None, None)[4] == ""


def test_graph(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("i", "a"), ("c", "o"), ("t", "o"), ("a", "a")]
    edges = spark.createDataFrame([(*e, 1) for e in rows], "src string, dst string, weight long")
    nodes = spark.createDataFrame([(x, x in "abciz") for x in "abciotz"], "id string, is_onion boolean")
    assert graph.strong_components(nodes, edges).select("component").distinct().count() == 5
    assert {r.id: r.part for r in graph.bow_tie(nodes, edges).collect()} == {"a": "core", "b": "core", "c": "core", "i": "in", "o": "out", "t": "tendrils", "z": "tendrils"}
    assert abs(graph.clustering(nodes, edges).agg(F.avg("coefficient")).first()[0] - 7 / 15) < 1e-12
    assert {r.id: r.total_degree for r in graph.degrees(nodes, edges).collect()}["a"] == 5
    ranks = graph.pagerank(nodes, edges, fixed=5).agg(F.sum("pagerank")).first()[0]
    assert abs(ranks - 1) < 1e-9


def test_markup_takes_time_in_proportion():
    """A megabyte of markup that never closes what it opens, in each of many ways."""
    pieces = ["<p>", "<a ", "<", "</", "<!--", "<!", "<?", "&", "<a b='", '<a b="c', "<script>", "<script ", "<script></", "</script ", "<![CDATA[", "&#", "&#9", "<a/", "<a =", "<a b", "<a b=c ", "<a '", "<i></p>", "<p></q>", "<noscript>", "<a =\"' ", "=\"<a b='"]
    for piece in pieces:
        began = time.perf_counter()
        dom.parse(piece * ((1 << 20) // len(piece)), "http://h/")
        assert time.perf_counter() - began < 4, piece
    assert dom.parse("a&#" + "9" * 5000 + ";b", None)[4] == "a\ufffdb"


def test_markup_that_is_cut_or_odd():
    text = lambda html: dom.parse(html, None)[5]
    assert text("a < b <3 c") == "a < b < 3 c"
    assert text("x<p title='a>b' y=\"<b>\">z</p ><br/>w") == "x z w"
    assert text("x<!-- > <p>y --> z<!--> u<!-- never") == "x z u"
    assert text("x<p cl") == "x" and text("x</p") == "x" and text("x<![CDATA[y]]>z<?php ?>") == "x z"
    page = "<SCRIPT>if (a</b) '</scripted>'</SCRIPT ><a HREF=x/y>l</a><script src=q>no</script><script/>t<style>s"
    css, js, sheets, scripts, clean, *_, hrefs, _, paths = dom.parse(page, None)
    assert (css, js, sheets, scripts, clean, hrefs) == (True, True, "", "if (a</b) '</scripted>'\n\n", "l t", ["x/y"])
    assert dom.parse("<noscript><p>a</noscript>b<i>c</p>d", None)[4:6] == ("b c d", "a b c d")


def test_references_without_semicolon(spark, tmp_path):
    """dom_paths counts them as its SQL does; the parser reads them as HTML does unless told otherwise."""
    pages = ["<title>A &amp;&amp; b&amp</title><p>&amp;quot; &copy; &quot x", "<p>&am</p>&copy<i>&middot;</i>&amp&amp;", "<p>&amp", "&copyb;", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("*", "'http://h/' as url").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in queries.dom_paths(spark, str(tmp_path)).collect())
    with duckdb.connect() as db:
        db.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        assert got == sorted(db.sql(queries.SQL["dom_paths"]).fetchall())
    assert dom.parse("a&amp&lt;b&#65;&#66", None)[4] == "a&<bAB"
    assert dom.parse("a&amp&lt;b&#65;&#66&nosuch;&#x110000000;", None, closed_only=True)[4] == "a&amp<bA&#66&nosuch;\ufffd"
