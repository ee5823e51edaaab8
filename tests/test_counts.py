import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from webloom.functions import counts, text
from webloom.plans import jobs

TEXTS = [None, "", "a", "ab", "abc", "aab aab AAB", "The cat, the DOG and a cat_x cat! 😀😀😀 cat", "ÉÉÉ éé", "zz " * 50 + "yy " * 50, "dog cat bird dog " * 9 + "ant bee cow doe elk fox gnu hen"]


def first_places(items):
    n, at = Counter(items), {}
    for i, x in enumerate(items):
        at.setdefault(x, i)
    return n, at


@pytest.mark.parametrize("span", [1 << 20, 7])
def test_counts_against_plain_ones(spark, monkeypatch, span):
    monkeypatch.setattr(counts, "SPAN", span)
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choices(["cat", "dogs", "bird", "the", "x1", "lion", "tiger", "wolves"], k=rng.randint(0, 60))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    grams, terms, topics = {}, {}, {}
    for i, t in enumerate(texts):
        low = (t or "").lower()
        n, at = first_places([low[k : k + 3] for k in range(len(low) - 2)])
        grams[i] = [(g, n[g]) for g in sorted(n, key=lambda g: (-n[g], at[g]))[:5]]
        words = [w for w in spark_words(low) if w not in text.STOPWORDS]
        n, at = first_places([w for w in words if len(w) > 2])
        terms[i] = [(w, n[w]) for w in sorted(n, key=lambda w: (-n[w], at[w]))[:3]]
        n = Counter(w for w in words if len(w) > 3)
        names, size = sorted(n), max(1, len(n) // 3)
        topics[i] = [(b, *min(((w, n[w]) for w in names[b * size : b * size + size]), key=lambda x: (-x[1], x[0]))) for b in range(3) if names[b * size :]]
    got = lambda df, *c: {i: [tuple(r[x] for x in c) for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r[c[0]] if c[0] == "bucket" else r["rank"])] for rows in [df.collect()] for i in range(len(texts))}
    assert got(text.top_trigrams(docs, "doc_id", "text", 5), "term", "cnt") == grams
    assert got(text.top_terms(docs, "doc_id", "text", 3), "term", "cnt") == terms
    assert got(text.topic_buckets(docs, "doc_id", "text", 3), "bucket", "term", "cnt") == topics
    assert text.top_terms(docs.limit(0), "doc_id", "text").collect() == []


def spark_words(low):
    import regex

    return [w for w in regex.findall(r"[\p{L}\p{N}_]+", low) if regex.fullmatch("[a-z]+", w)]


def test_nothing_is_shuffled(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for df in (text.top_trigrams(docs, "doc_id", "text"), text.top_terms(docs, "doc_id", "text"), text.topic_buckets(docs, "doc_id", "text"), jobs.term_features(docs, "doc_id", "text")):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    row = jobs.term_features(docs, "doc_id", "text").where(F.col("doc_id") == 5).first()
    assert row.tfidf_top_terms == ["aab"] and row.lda_top_terms == [] and row.char_3grams["aab"] == 3
