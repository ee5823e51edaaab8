import math
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from webloom.llm import kneser_ney as kn

TEXTS = ["a b a c a b", "A b\tc", None, "", "the the the cat", "cat the dog a b a b a b", "x", "a b c d e f g a b c", "zzz unseen a b", "the cat a dog  the"] * 3
ROWS = [(i, t) for i, t in enumerate(TEXTS)]


def tokens(t):
    return [*(t or "").lower().split(), "</s>"]


def brute(train):
    pair, uni = Counter(), Counter()
    for t in train:
        w = tokens(t)
        uni.update(w)
        pair.update(zip(["<s>", *w], w))
    n = Counter(min(c, 4) if c < 5 else 5 for c in pair.values())
    d = kn.discounts(*(sum(c == k for c in pair.values()) for k in range(1, 5)))
    contexts = Counter(w for _, w in pair)
    dc = kn.discounts(*(sum(c == k for c in contexts.values()) for k in range(1, 5)))
    total, kinds = Counter(), defaultdict(Counter)
    for (u, _), c in pair.items():
        total[u] += c
        kinds[u][min(c, 3)] += 1
    v, m = len(uni), len(pair)
    cut = lambda c, x: max(c - (x[min(c, 3) - 1] if c else 0), 0)
    left = sum(dc[min(c, 3) - 1] for c in contexts.values()) / m

    def p(u, w):
        lower = cut(contexts[w], dc) / m + left / (v + 1)
        if not total[u]:
            return lower
        gamma = sum(d[k - 1] * kinds[u][k] for k in (1, 2, 3)) / total[u]
        return cut(pair[u, w], d) / total[u] + gamma * lower

    return uni, p


@pytest.mark.parametrize("hot", [4, 1000])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(kn, "HOT", hot)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("score", F.lit("clash"))
    train = F.col("doc_id") % 5 != 1
    got = {r.doc_id: r for r in kn.fit_and_score(docs, train).collect()}
    uni, p = brute([t for i, t in ROWS if i % 5 != 1])
    n, v = sum(uni.values()), len(uni)
    assert len(got) == len(ROWS)
    for i, t in ROWS:
        w = tokens(t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(uni[x] > 0 for x in w), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert got[i].score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w], w)))
    # a distribution over known words and one unknown
    for u in ["a", "<s>", "the", "never"]:
        assert sum(p(u, w) for w in [*uni, "?"]) == pytest.approx(1)


def brute_triples(train):
    triple, start, uni = Counter(), Counter(), Counter()
    for t in train:
        w = tokens(t)
        uni.update(w)
        start[w[0]] += 1
        triple.update(zip(["<s>", *w], w, w[1:]))
    pair = Counter((b, c) for _, b, c in triple)
    pair.update({("<s>", w): n for w, n in start.items()})
    before = Counter(w for _, w in pair)

    def level(counts):
        d = kn.discounts(*(sum(c == k for c in counts.values()) for k in range(1, 5)))
        total, left = Counter(), Counter()
        for (*u, _), c in counts.items():
            total[tuple(u)] += c
            left[tuple(u)] += d[min(c, 3) - 1]
        return lambda u, w, lower: (max(counts[*u, w] - ([0, *d][min(counts[*u, w], 3)]), 0) + left[u] * lower) / total[u] if total[u] else lower

    ones = level(Counter({(w,): n for w, n in before.items()}))
    twos, threes = level(pair), level(triple)

    def p(t, u, w):
        two = twos((u,), w, ones((), w, 1 / (len(uni) + 1)))
        return two if t is None else threes((t, u), w, two)

    return uni, p


@pytest.mark.parametrize(("hot", "span"), [(2, 250_000), (1000, 8), (5, 1)])
def test_order_three_equals_brute_force(spark, monkeypatch, hot, span):
    monkeypatch.setattr(kn, "HOT", hot)
    monkeypatch.setattr(kn, "SPAN", span)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = {r.doc_id: r.score for r in kn.fit_and_score(docs, F.col("doc_id") % 5 != 1, order=3).collect()}
    uni, p = brute_triples([t for i, t in ROWS if i % 5 != 1])
    assert len(got) == len(ROWS)
    for i, t in ROWS:
        w = tokens(t)
        assert got[i] == pytest.approx(sum(math.log10(p(a, b, c)) for a, b, c in zip([None, "<s>", *w], ["<s>", *w], w)))
    for t, u in [(None, "<s>"), ("<s>", "a"), ("a", "b"), ("the", "never")]:
        assert sum(p(t, u, w) for w in [*uni, "?"]) == pytest.approx(1)


def test_the_query_looks_at_two_words_before(spark, monkeypatch):
    from webloom.llm import queries

    orders = []
    monkeypatch.setattr(kn, "fit_and_score", lambda docs, train, order=2: orders.append(order) or docs.selectExpr("doc_id", "0 n_tokens", "0 n_known", "0 train_tokens", "0 base_score", "0 score"))
    queries.op8_lm_scoring(spark, "/root/testdata/sf0.001")
    assert orders == [3]


def test_rows_that_repeat_and_long_texts(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "x"), (None, "a b"), (2, "a b " * 400_000)]
    got = kn.fit_and_score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True), order=3).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 3), (1, 2), (1, 4), (1, 4), (2, 800_001)]
    assert len({r.score for r in got if r.n_tokens == 4}) == 1 and all(r.n_known == r.n_tokens and r.train_tokens == 800_014 for r in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert kn.fit_and_score(docs, F.lit(True)).collect() == []
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    (row,) = kn.fit_and_score(docs, F.lit(False)).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0, 0)


def test_blocks_and_groups(monkeypatch):
    import numpy as np
    import pyarrow as pa

    keys = np.array([0, 5, 2**63 + 1, 2**64 - 1], np.uint64)
    k, c = kn.unpack(kn.pack(keys, np.array([1, 2, 3, 4])))
    assert k.tolist() == keys.tolist() and c.tolist() == [1, 2, 3, 4]
    texts = [b"a b", None, b"c d e  f g\th i j\n", b"", b" A\xc3\x89 ", b"abcdefghijklmnop q", b"\x85 \xa0"]
    word = lambda w: int(kn.hashed_words(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    assert word(b"AbZ\x80[") == word(b"abz\x80[") and len({word(w) for w in (b"a", b"aa", b"b", b"ab", b"ba", b"\x00", b"\x00\x00")} | {int(kn.END)}) == 8
    monkeypatch.setattr(kn, "SHORT", 5)
    want = {i: [*map(word, (t or b"").lower().split()), int(kn.END)] for i, t in enumerate(texts)}
    for span in (1, 3, 6, 1000):
        monkeypatch.setattr(kn, "SPAN", span)
        got: dict = {i: [] for i in want}
        for column in (pa.array(texts), pa.array([b"x", *texts, b"y"])[1:-1]):
            got = {i: [] for i in want}
            for g in kn.token_groups(column):
                for r, a, z in zip(g.rows.tolist(), g.starts.tolist(), [*g.starts.tolist()[1:], len(g.hashes)], strict=True):
                    assert not g.lead or g.hashes[: g.lead].tolist() == got[r][-g.lead :]
                    got[r] += g.hashes[max(a, g.lead) : z].tolist()
            assert got == want
    assert list(kn.token_groups(pa.array([], pa.binary()))) == []


def test_numbers_of_any_size():
    import numpy as np

    x = np.array([0, 1, 254, 255, 256, 2**40, 3, 0, 255])
    raw = np.frombuffer(kn.compact(x), np.uint8)
    assert kn.Compact(raw, len(x)).all().tolist() == x.tolist()
    assert kn.Compact(raw, len(x))[np.array([5, 0, 3])].tolist() == [2**40, 0, 255]
    context, word = np.array([2**40, 7, 2**40, 7, 7], np.uint64), np.array([2**33, 1, 2**33, 1, 2], np.uint64)
    for shift in (20, 34):  # in one key, and where one key does not hold both
        c, w, inverse, n = kn.distinct(context, word % np.uint64(1 << 20) if shift == 20 else word, shift)
        assert c.tolist() == [7, 7, 2**40] and n.tolist() == [2, 1, 2] and inverse.tolist() == [2, 0, 2, 0, 1]
    plan = kn.Plan("pairs", 1 << 20, 1 << 24, 1)
    level = kn.Level(plan, 34, np.array([2**40], np.uint64), np.array([plan.buckets, plan.buckets + 3]), None)
    bucket, key = level.deal(context, word)
    assert (bucket[[1, 3, 4]] == 0).all() and plan.buckets <= bucket[0] == bucket[2] < plan.buckets + 3
    assert level.words(key).tolist() == word.tolist()
    assert [int(level.contexts(b, key[i : i + 1])[0]) for i, b in enumerate(bucket.tolist())] == context.tolist()


def test_words_that_collide_under_any_polynomial(spark):
    """The Thue-Morse word and its complement have one hash in every odd base modulo 2^64."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer(f"{word} {other} {word.upper()}\n{other}".encode(), np.uint8)
    starts = np.array([0, 2049, 4098, 6147])
    a, b, c, d = kn.hashed_words(data, starts, starts + 2048).tolist()
    assert a == c != b == d
    docs = spark.createDataFrame([(1, word), (2, f"{other} {other}"), (3, word)], "doc_id long, text string")
    out = kn.fit_and_score(docs, F.col("doc_id") < 3, order=3).collect()
    assert {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens) for r in out} == {1: (2, 2, 5), 2: (3, 3, 5), 3: (2, 2, 5)}
    got = {r.doc_id: r.base_score for r in out}
    term = lambda n: math.log10((n + 0.5) / (5 + 0.5 * 4))
    assert got[1] == pytest.approx(term(1) + term(2)) and got[2] == pytest.approx(2 * term(2) + term(2))


def test_words_are_hashed_as_by_the_library():
    rng = np.random.default_rng(4)
    words = [bytes(rng.choice(np.frombuffer(b"abcXYZ09\xc3\xa9\xff.", np.uint8), n)) for n in [*range(1, 70), *rng.integers(1, 40, 300), 5000]]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - np.array([len(w) for w in words])
    want = [xxhash.xxh64_intdigest(bytes(c + 32 if 65 <= c <= 90 else c for c in w)) for w in words]
    assert kn.hashed_words(data, starts, ends).tolist() == want
    assert kn.hashed_words(data[:0], starts[:0], ends[:0]).tolist() == []


def test_spans_of_a_task_are_dealt_together(monkeypatch):
    """Spans are summed up before they are dealt, so blocks do not grow with spans times buckets."""
    level = kn.Level(kn.Plan("pairs", 4, 10, 1), 8, np.array([5], np.uint64), np.array([4, 6]), None)
    rng = np.random.default_rng(2)
    tokens = [(rng.integers(0, 40, 300).astype(np.uint64), rng.integers(0, 200, 300).astype(np.uint64)) for _ in range(6)]
    want = Counter((int(u), int(w)) for c, x in tokens for u, w in zip(c, x, strict=True))
    spans = [(c, w, n) for c, w, _, n in (kn.distinct(c, w, 8) for c, w in tokens)]
    for limit, batches in ((10_000, 1), (400, 3), (1, 6)):
        monkeypatch.setattr(kn, "SUMMED", limit)
        out = [list(zip(*(c.to_pylist() for c in x.columns), strict=True)) for x in kn._dealt(level, iter(spans))]
        assert len(out) == batches and all(len({b for b, _ in x}) == len(x) for x in out)
        got = Counter()
        for b, blob in (y for x in out for y in x):
            keys, counts = kn.unpack(blob)
            assert (keys[1:] > keys[:-1]).all()
            for u, w, n in zip(level.contexts(b, keys).tolist(), level.words(keys).tolist(), counts.tolist(), strict=True):
                got[u, w] += n
        assert got == want
    assert list(kn._dealt(level, iter([]))) == []


def test_a_model_of_many_gigabytes_stays_mapped():
    """Each span looks into all buckets: a worker that cannot keep their files mapped opens all of them anew
    for each span. The figures are those of 6 GB of documents, with frequent words of 3 million tokens each."""
    model = kn.Model("", 9, 3, 14_000_000, 1_300_000_000)
    fit = SimpleNamespace(model=model, index=lambda name, x: None)
    hot = pd.DataFrame({"number": range(200), "tokens": [3_000_000] * 200})
    pairs, triples = (kn._Fit.plan(fit, kind, n, hot) for kind, n in (("pairs", 14_000_000), ("triples", 600_000_000)))
    files = 4 * pairs.all_buckets + 2 * triples.all_buckets + 3 * (1 << model.bits)
    assert files < kn.MAPS / 2
    assert pairs.all_buckets * triples.all_buckets < 3_000_000  # blocks that go from triples to pairs
