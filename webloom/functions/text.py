"""Text features as column expressions and DataFrame operators.

A word run is a longest stretch of letters, digits and underscores. A pattern that can match word
characters only, with word boundaries at both ends, matches exactly the runs that it covers whole,
so runs are taken first and tested with anchored patterns: no look-around, and the same result in
any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import counts

RUN = r"[\p{L}\p{N}_]+"

# Words that say nothing about a page's topic.
STOPWORDS = (
    "the", "and", "for", "that", "this", "with", "are", "was", "have", "not", "from", "but", "they", "you", "all", "had", "her", "his", "our", "one",
    "been", "has", "its", "can", "who", "him", "get", "did", "use", "two", "also", "more", "will", "just",
)

# Script names that point to tracking or fingerprinting.
TRACKING_CALLS = (
    "fingerprint2", "clientjs", "evercookie", "navigator.plugins", "navigator.mimeTypes", "screen.colorDepth",
    "navigator.hardwareConcurrency", "navigator.deviceMemory", "getBattery", "getGamepads", "RTCPeerConnection",
    "AudioContext", "OfflineAudioContext", "canvas.toDataURL", "canvas.getContext", "document.cookie", "localStorage",
    "sessionStorage", "indexedDB", "webkitIndexedDB", "__utma", "__utmz", "_ga", "_gid",
)

HIDDEN_NAME = r"(?i)^([a-z2-7]{56}|[a-z2-7]{16})$"


def runs(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN), F.lit(0))


def words(text: Column, least: int) -> Column:
    """Lower-case a-z words of at least `least` letters, in order."""
    return F.filter(runs(F.lower(text)), lambda x: x.rlike(f"^[a-z]{{{least},}}$"))


def content_words(text: Column, least: int) -> Column:
    return F.filter(words(text, least), lambda x: ~x.isin(*STOPWORDS))


def trigrams(text: Column) -> Column:
    """All three-character substrings of the lower-cased text, in order."""
    # characters are split off once and bound to a variable; a substring would count from the start
    # of the text for every place
    letters = F.array(F.split(F.lower(F.coalesce(text, F.lit(""))), ""))
    at = lambda c, i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2))
    grams = F.transform(letters, lambda c: F.when(F.size(c) > 2, F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - 3, F.lit(0))), lambda i: at(c, i))))[0]
    return F.coalesce(grams, F.array().cast("array<string>"))


def _ranked(df: DataFrame, key: str, top: str) -> DataFrame:
    """(key, term, cnt, rank) of an array of counted terms."""
    rows = df.select(key, F.posexplode(top).alias("pos", "t"))
    return rows.select(key, "t.term", "t.cnt", (F.col("pos") + 1).alias("rank"))


def top_terms(df: DataFrame, key: str, text: str, k: int = 10) -> DataFrame:
    """(key, term, cnt, rank): the k most frequent content words of each row; of equals, the first."""
    return _ranked(counts.top_words(df, [key], content_words(F.col(text), 3), k), key, "top")


def top_trigrams(df: DataFrame, key: str, text: str, k: int = 500) -> DataFrame:
    """(key, term, cnt, rank): the k most frequent three-character substrings of each row's lower-cased
    text; of equals, the first."""
    return _ranked(counts.top_grams(df, [key], F.lower(F.col(text)), k), key, "grams")


def topic_buckets(df: DataFrame, key: str, text: str, buckets: int = 10) -> DataFrame:
    """(key, bucket, term, cnt): the sorted vocabulary of each row is cut into buckets of V // buckets
    words (one at least); each bucket names its most frequent word, of equals the first. Words past the
    last bucket are left out."""
    rows = counts.word_buckets(df, [key], content_words(F.col(text), 4), buckets)
    return rows.select(key, F.explode("topics").alias("t")).select(key, "t.*")


def css_selectors(css: Column, most: int = 100) -> Column:
    """Selectors of a style sheet: what stands before each {...}, white space collapsed, six parts."""
    found = F.regexp_extract_all(F.coalesce(css, F.lit("")), F.lit(r"([^{]+)\{[^}]*\}"), F.lit(1))
    short = F.transform(found, lambda s: F.array_join(F.slice(F.filter(F.split(s, r"(?U)\s+"), lambda p: p != ""), 1, 6), " "))
    return F.slice(F.filter(short, lambda s: s != ""), 1, most)


def tracking_calls(js: Column) -> Column:
    """Names of TRACKING_CALLS that occur anywhere in a script, in any case, sorted."""
    low = F.lower(F.coalesce(js, F.lit("")))
    return F.filter(F.array(*[F.lit(c) for c in sorted(TRACKING_CALLS)]), lambda c: F.contains(low, F.lower(c)))


def hidden_names(text: Column) -> Column:
    """Distinct lower-cased hidden-service names in a text, sorted."""
    chains = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"{RUN}(?:\.{RUN})+"), F.lit(0))
    labels = F.flatten(F.transform(chains, lambda c: _names_in(F.split(c, r"\."))))
    return F.array_sort(F.array_distinct(labels))


def _names_in(parts: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(F.element_at(parts, i).alias("a"), F.element_at(parts, i + 1).alias("b")))
    good = F.filter(pairs, lambda p: p["a"].rlike(HIDDEN_NAME) & (F.lower(p["b"]) == "onion"))
    return F.transform(good, lambda p: F.concat(F.lower(p["a"]), F.lit(".onion")))


def context_tags(snippet: Column, most: int = 50) -> Column:
    return F.filter(F.split(F.substring(snippet, 1, most), r"(?U)\s+"), lambda x: x != "")
