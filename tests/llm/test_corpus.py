import hashlib
import math
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from webloom.llm import files, language_id, mixing, queries, toxicity, url_filters, warc
from webloom.core.scratch import Scratch


def quantile(u, rate):
    k, term = 0, math.exp(-rate)
    below = term
    while u >= below and k < 400:
        k += 1
        term *= rate / k
        below += term
    return k


def test_mixing_against_brute_force(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", "t") for i in range(300)] + [(1000, None, None), (None, "hot", "x"), (7, "hot", "again")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, cdf string")
    weights = {"hot": 1.0, "s0": 8.0, None: 1.0}
    out = mixing.mix(docs, weights, rows_out=1500.0, seed=3)
    assert out.columns == [*docs.columns, "mix_copy", "mix_key"]
    got = Counter((r.doc_id, r.source) for r in out.collect())
    counts = Counter(s for _, s, _ in rows)
    want: Counter = Counter()
    for i, s, _ in rows:
        rate = 1500 * weights.get(s, 0) / 10 / counts[s]
        parts = max(1, math.ceil(rate / mixing.PART))
        draw = lambda p: int(hashlib.md5(f"3:{p}:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        want[i, s] += sum(quantile(draw(p), rate / parts) for p in range(parts))
    assert got == +want and any(c > 40 for c in want.values())
    assert mixing.mix(docs.limit(0)).collect() == []
    assert mixing.mix(docs, {}).collect() == []


def test_toxicity_edges_and_held_out(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "word " * 100_000, "s"), (None, "x", "s"), (3, "twice", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.without_toxic(docs, labels).columns == docs.columns
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels)).collect() == []
    d = "/root/testdata/sf0.1"
    got = queries.op1_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    rank, pos = got["score"].rank(), got["toxic"] == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.95 and (got["predicted"] == got["toxic"]).mean() > 0.96


def test_pairs_carry_meaning():
    """Two terms that are harmless alone and bad together, which no sum of weights can say."""
    import numpy as np

    rng = np.random.default_rng(0)
    a, b = toxicity.text_terms("clown"), toxicity.text_terms("group")
    terms, y = [], []
    for _ in range(1200):
        has = rng.random(2) < 0.5
        terms.append(np.unique(np.concatenate([toxicity.text_terms(f"filler{rng.integers(9)}"), a if has[0] else a[:0], b if has[1] else b[:0]])))
        y.append(int(has.all()))
    m = toxicity.fit_machine(terms, np.array(y))
    say = lambda *t: m.margin(sorted({int(m.slot[x]) for p in t for x in p if m.slot[x] >= 0}))
    assert say(a, b) > 0 > max(say(a), say(b), say())


def test_exactly_one_of_two_terms():
    """Neither term says anything by itself, so a test of single terms would leave both out."""
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = toxicity.text_terms("clown"), toxicity.text_terms("group")
    has = rng.random((1600, 2)) < 0.5
    terms = [np.unique(np.concatenate([toxicity.text_terms(f"filler{rng.integers(9)}"), a if x else a[:0], b if y else b[:0]])) for x, y in has]
    m = toxicity.fit_machine(terms, has.sum(axis=1) == 1)
    say = lambda *t: m.margin(sorted({int(m.slot[x]) for p in t for x in p if m.slot[x] >= 0}))
    assert min(say(a), say(b)) > 0 > max(say(a, b), say())


def test_machine_against_plain_sums_and_slopes():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    w0, w, v = 0.3, rng.normal(size=30), rng.normal(size=(30, 4))
    m = toxicity.Machine(np.arange(30, dtype=np.int32), w0, w, v)
    plain = lambda kept, w0, w, v: w0 + sum(w[i] for i in kept) + sum(float(v[i] @ v[j]) for i, j in itertools.combinations(kept, 2))
    rows = [np.sort(rng.choice(30, size=k, replace=False)) for k in (0, 1, 2, 5, 12)]
    for kept in rows:
        assert m.margin(kept.tolist()) == pytest.approx(plain(kept, w0, w, v))
    y = np.array([0, 1, 1, 0, 1.0])

    def loss(w0, w, v):
        p = [1 / (1 + math.exp(-plain(r, w0, w, v))) for r in rows]
        return -sum(math.log(q if t else 1 - q) for q, t in zip(p, y, strict=True)) / len(y) + toxicity.DECAY / 2 * (float(w @ w) + float((v * v).sum()))

    d0, dw, dv = toxicity.gradients(rows, y, w0, w, v)
    e = 1e-5
    assert d0 == pytest.approx((loss(w0 + e, w, v) - loss(w0 - e, w, v)) / 2 / e, abs=1e-6)
    for i in range(0, 30, 7):
        s, t = np.zeros(30), np.zeros((30, 4))
        s[i] = t[i, i % 4] = e
        assert dw[i] == pytest.approx((loss(w0, w + s, v) - loss(w0, w - s, v)) / 2 / e, abs=1e-6)
        assert dv[i, i % 4] == pytest.approx((loss(w0, w, v + t) - loss(w0, w, v - t)) / 2 / e, abs=1e-6)


def test_samples_do_not_round_to_nothing(spark):
    """Shares of 1e13 rows: what a share of a million parts would lose."""
    for n in (10**5, 10**10, 10**13):
        assert (toxicity.sample_bound(12_000, n) + 2**63) / 2**64 == pytest.approx(12_000 / n, rel=1e-3)
    ids = spark.range(100_000)
    assert 11_000 < ids.where(toxicity.sampled(F.col("id"), 12_000, 100_000)).count() < 13_000
    assert ids.where(toxicity.sampled(F.col("id"), 12_000, 12_000)).count() == 100_000
    assert language_id._share([10, 10**9, 5], 12_000) == 11_985 and language_id._share([4, 4], 100) >= 4


def test_rare_languages_are_learnt(spark):
    rows = [(i, "the cat and the dog of the house", "en") for i in range(3000)] + [(9000 + i, "katten och hunden i huset på vägen", "sv") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language_id.fit(docs, F.lit(True), fit_rows=100)
    got = spark.createDataFrame([(1, "hunden på vägen", "x"), (2, "the dog", "y")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language_id.predict(got, m).collect()} == {1: "sv", 2: "en"}
    assert math.exp(m.log_prior[m.languages.index("sv")]) == pytest.approx(20 / 3020)


def test_language_against_plain_naive_bayes(spark, monkeypatch):
    """Counts, smoothing and posteriors as a dictionary has them; spans of few characters."""
    monkeypatch.setattr(language_id, "SPAN", 7)
    train = [("the cat and the dog", "en"), ("Der Hund, die Katze!", "de"), ("le chat et le chien", "fr"), ("the  house", "en"), ("", "en"), ("DAS Haus 12", "de")]
    tests = ["the haus", "le", "x y z", "katze chat dog 3", "ß", "İstanbul the"]

    def bucket(gram):
        h = 0
        for c in gram:
            h = (h * 0x100000001B3 + ord(c) * 0x9E3779B97F4A7C15) % 2**64
        h = (h + len(gram)) % 2**64
        h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) % 2**64
        return h >> (64 - language_id.BITS)

    def plain(text):
        t = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        return [bucket(t[i : i + n]) for n in language_id.SIZES for i in range(len(t) - n + 1) if "  " not in t[i : i + n] and t[i : i + n] != " "]

    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(train)], "doc_id long, text string, lang string")
    m = language_id.fit(docs, F.lit(True))
    counts = {lang: Counter(b for t, x in train if x == lang for b in plain(t)) for lang in ("de", "en", "fr")}
    seen = Counter(x for _, x in train)
    langs, scores = language_id.classify(tests, m)
    for text, lang, score in zip(tests, langs, scores, strict=True):
        logs = {x: math.log(seen[x] / len(train)) + sum(math.log((c[b] + 0.5) / (c.total() + 0.5 * 2**language_id.BITS)) for b in plain(text)) for x, c in counts.items()}
        best = max(sorted(logs), key=logs.get)
        assert lang == best and score == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), rel=1e-4)


def test_toxic_stage_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", 1, 2)], "doc_id long, text string, _Toxicity int, _toxicity_ int")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [tuple(r) for r in toxicity.without_toxic(docs, labels).collect()] == [(1, "a", 1, 2)]


def test_language_edges_and_held_out(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "123 !!", None), (5, "", "en"), (None, "the und", None), (6, "the " * 400_000, "en")], "doc_id long, text string, lang string")
    m = language_id.fit(docs, F.coalesce(F.col("doc_id") < 6, F.lit(True)))  # the long text is read, not learned from
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, m).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[6][0] == "en" and {got[3], got[4], got[5]} == {("und", 0.0)}
    empty = language_id.fit(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}
    d = "/root/testdata/sf0.01"
    out = queries.op4_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id").where("held_out").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.98


def test_warc_round_trip(spark):
    big, other = "<p>é</p>" * 40, "z" * 300_000
    rows = [(5, "http://a\r\nX: y", big), (3, None, big), (9, "http://b", big), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", other), (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", "no id")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    got = {r.page_id: r for r in warc.archive_round_trip(pages).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 3) if html == big and i != 3 else ("response", None))
    assert warc.archive_round_trip(pages.limit(0)).collect() == []


def test_long_urls(spark):
    url = "http://a.com/en/" + "x" * 3_000_000
    pages = spark.createDataFrame([(1, url, "<p>" * 50), (2, url, "<p>" * 50), (3, "http://b.test", None)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect()) == [(1, "response", None), (2, "revisit", 1), (3, "response", None)]
    assert sorted((r.page_id, len(r.path), r.verdict) for r in url_filters.judge(pages).collect()) == [(1, 3_000_004, "block"), (2, 3_000_004, "block"), (3, 0, "allow")]


def test_warc_members_are_separate(tmp_path, spark):
    import zlib

    pages = spark.createDataFrame([(i, "http://x", "payload %d" % i * 30) for i in range(7)], "page_id long, url string, html string").coalesce(1)
    scratch = Scratch(spark, "test")
    raw = scratch.write(warc.write_archives(warc.record_types(pages, scratch, "page_id", "html"), scratch.path("raw")), "m")
    (before,) = [b"".join(files.chunks(r.archive)) for r in raw.collect()]
    d = zlib.decompressobj(31)
    assert d.decompress(before) and not d.unused_data  # one member over the whole file
    (row,) = warc.normalise(raw, scratch.path("good")).collect()
    data, index = b"".join(files.chunks(row.archive)), b"".join(files.chunks(row["index"])).decode().splitlines()
    assert row.records == 7 == len(index)
    whole = b""
    for line in index:
        at, n = map(int, line.split()[:2])
        one = zlib.decompressobj(31)
        whole += one.decompress(data[at : at + n])
        assert one.eof and not one.unused_data
    assert whole == zlib.decompress(before, 31)
    with pytest.raises(ValueError):
        list(warc.split_records([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"]))


def test_url_rules_and_aliases(spark):
    canonical = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [
        (1, "http://a.com/en/x", None),  # block by com/en/
        (2, "http://Example.COM/en/7", None),  # the longer allow
        (3, "http://free.test/p", canonical("http://a.com/en/x")),  # alias of a blocked page
        (4, "http://free.test/q?z=1#f", '<META http-equiv="refresh" content="0; url=/p">'),  # alias of an alias
        (5, "http://x.net/de/8", canonical("http://a.com/en/x")),  # its own rule comes first
        (6, "http://free.test/r", None),
        (7, None, None), (8, "", canonical("http://a.com/en/x")), (9, "no scheme", None), (10, "://", None), (11, "http://exam.ple/x://y", None),
        (12, "http://sub.example.net/de/8/x", None), (12, "http://sub.example.net/de/8/x", None), (13, "http://notexample.org", None), (14, "http://org/es/", None),
        (15, "http://ok.test/a", canonical("http://ok.test/b")), (16, "http://ok.test/b", canonical("http://example.com/en/7")), (17, "http://ok.test/b?", canonical("http://b.com/en/")),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, rule string")
    got = {}
    for r in url_filters.judge(pages).collect():
        got.setdefault(r.page_id, []).append((r.host, r.path, r.rule, r.verdict, r.verdict_by))
    assert got[1] == [("a.com", "/en/x", "com/en/", "block", "rule")] and got[2] == [("example.com", "/en/7", "example.com/en/7", "allow", "rule")]
    assert got[3][0][2:] == (None, "block", "alias") and got[4] == [("free.test", "/q", None, "block", "alias")]
    assert got[5][0][2:] == ("net/de/", "allow", "rule") and got[6][0][2:] == (None, "allow", "default")
    assert got[7] == got[8] == got[9] == [("", "", None, "allow", "default")] and got[10] == [("", "", None, "allow", "default")]
    assert got[11] == [("exam.ple", "/x://y", None, "allow", "default")]
    assert got[12] == [("sub.example.net", "/de/8/x", "example.net/de/8", "block", "rule")] * 2 and got[14][0][2:] == ("org/es/", "block", "rule")
    # page 5, which is allowed, shares a component with 3 and 4 and does not lift their block
    assert got[15][0][3:] == got[16][0][3:] == ("allow", "alias")
    assert url_filters.judge(pages.limit(0)).collect() == []
    log = spark.createDataFrame([("http://free.test/r", "http://a.com/en/x")], "src string, dst string")
    assert {r.verdict for r in url_filters.judge(pages.where("page_id = 6"), redirects=log).collect()} == {"block"}


def test_links_that_pages_declare(spark):
    edge = lambda html, url="http://h.test/a/b/c?x#f": [tuple(r) for r in url_filters.alias_edges(spark.createDataFrame([(url, html)], "url string, html string")).collect()]
    at = "h.test/a/b/c?x"
    for html, target in [
        ('<link rel="canonical" href="http://o.test/?a=1&amp;b=2">', "o.test/?a=1&b=2"),
        ("<LINK href='../d' REL='alternate Canonical'>", "h.test/a/d"),
        ("<link href=./../../../up/./x/.. rel=canonical>", "h.test/up/"),
        ('<meta http-equiv="refresh" content="0.5,//p.test/q">', "p.test/q"),
        ("<meta content='3; URL=\"e f\"' http-equiv=Refresh>", "h.test/a/b/e"),
        ('<meta http-equiv="refresh" content="0;url=?y">', "h.test/a/b/c?y"),
        ('<link title="a > b" rel="canonical" href="/z">', "h.test/z"),
        ('<!-- x --><link rel=canonical href="/ok"><script>"<!--"</script>', "h.test/ok"),
    ]:
        assert edge(html) == [(at, target)], html
    for html in ['<!-- <link rel="canonical" href="/x"> -->', '<script>"<link rel=canonical href=/x>"</script>', '<link rel="canonicals" href="/x">', '<meta http-equiv="refresh" content="30">', '<link rel="stylesheet" href="/canonical">', "<!-- open <link rel=canonical href=/x>", None, ""]:
        assert edge(html) == [], html


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        if name not in ("mixing", "sentencepiece"):
            assert out.exceptAll(docs).isEmpty()
        assert stage(spark, docs.limit(0), d).count() == 0
    assert pipeline.run(spark, d).columns == [*docs.columns, "piece_ids"]


def test_pipeline_against_brute_force(spark):
    """All five stages on all documents, as loops have them; only the machine's weights are taken as fitted."""
    import itertools
    import re

    import sentencepiece

    from tests.llm.test_dedup import WHITE, near_copies

    pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    m = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))

    def margin(text):
        words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
        kept = {int(m.slot[t]) for w in words for t in toxicity.word_terms(w)} - {-1}
        return m.w0 + sum(m.w[i] for i in kept) + sum(float(m.v[i] @ m.v[j]) for i, j in itertools.combinations(kept, 2)) if len(kept) < 200 else m.margin(sorted(kept))

    rows = sorted((r.doc_id, r.text, r.source) for r in docs.collect())
    rows = [r for r in rows if margin(r[1]) < 0]
    first: dict = {}
    for r in rows:
        first.setdefault(WHITE.sub(" ", r[1] or ""), r)
    rows = sorted(first.values())
    rows = [r for i, (r, c) in enumerate(zip(rows, near_copies([r[1] for r in rows]), strict=True)) if i == c]
    counts = Counter(r[2] for r in rows)
    shares = sum(c**0.5 for c in counts.values())
    library = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    want: Counter = Counter()
    for i, text, source in rows:
        u = int(hashlib.md5(f"17:0:{i}".encode()).hexdigest()[:13], 16) / 2**52
        want[i, tuple(library.encode(text or ""))] += quantile(u, len(rows) * counts[source] ** 0.5 / shares / counts[source])
    got = Counter((r.doc_id, tuple(r.piece_ids)) for r in pipeline.run(spark, d).collect())
    assert got == +want and 0 < len(rows) < docs.count()


def test_cut_archives_raise():
    """Wherever a whole-file stream is cut, between records too, and wherever one of many members is."""
    import zlib

    records = [warc.record(i, "http://x", b"payload %d" % i * 40, "d", None) for i in range(5)]
    gz, ends = zlib.compressobj(6, zlib.DEFLATED, 31), []
    whole = b""
    for r in records:
        whole += gz.compress(r) + gz.flush(zlib.Z_SYNC_FLUSH)  # so that a cut can fall between records
        ends.append(len(whole))
    whole += gz.flush()
    count = lambda data: sum(1 for _ in warc.split_records(warc.inflated([data[i : i + 7] for i in range(0, len(data), 7)])))
    assert count(whole) == 5 and count(whole + b"\0" * 9) == 5 and count(b"") == 0
    for cut in [*ends, *(e + 20 for e in ends[:-1]), 1, len(whole) - 1, len(whole) - 8]:
        with pytest.raises(ValueError, match="ends"):
            count(whole[:cut])
    members = [zlib.compress(r, 6, 31) for r in records]
    assert count(b"".join(members)) == 5 and count(b"".join(members[:3])) == 3
    for cut in (1, 12, len(members[3]) - 1):
        with pytest.raises(ValueError, match="ends"):
            count(b"".join(members[:3]) + members[3][:cut])


def test_hostile_markup_takes_time_in_proportion(spark):
    url, n = "http://a.com/x", 1 << 20
    fill = lambda piece: piece * (n // len(piece))
    pieces = ["<link ", '<link "', "<link '\"", "<script", "<script ", "<!--", "</script ", "<meta http-equiv=refresh content='" + " " * 1000, "<textarea '"]
    rows = [(i, url, "canonical http-equiv " + fill(p)) for i, p in enumerate(pieces)] + [(99, url, f'<meta http-equiv="refresh" content="{" " * n}">')]
    small = spark.createDataFrame([(1, url, '<link rel="canonical" href="http://b.test/">')], "page_id long, url string, html string")
    assert url_filters.alias_edges(small).count() == 1
    for row in rows:
        began = time.perf_counter()
        url_filters.alias_edges(spark.createDataFrame([row], small.schema)).collect()
        assert time.perf_counter() - began < 4, row[2][:60]
