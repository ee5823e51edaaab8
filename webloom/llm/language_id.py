"""Language identification by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and everything but letters becomes a space, so n-grams know where words begin
and end. Counts per language and bucket are made in Spark; the log-probability matrix (languages x
buckets) is broadcast, and numpy scores a batch of texts as the product of their sparse n-gram rows
with it: one gather and one sum by text for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.memory import tidy
from webloom.llm.toxicity import sampled

SIZES = (1, 2, 3)
BITS = 15
SMOOTHING = 0.5
#: Rows that the counts are made from at most, in expectation, by a hash of the identifier. Languages
#: share them evenly, so a rare one keeps all its rows; how frequent each is counts over all rows.
FIT_ROWS = 12_000
#: Characters looked at a time: beyond the text itself, memory does not grow with its length.
SPAN = 1 << 20
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every n-gram that does not hold two spaces in a row, span by span."""
    joined = "".join(f" {(t or '').lower()} " for t in texts)
    ends = np.cumsum([len((t or "").lower()) + 2 for t in texts])
    most = max(SIZES)
    for at in range(0, len(joined), SPAN):
        raw = np.frombuffer(joined[at : at + SPAN + most - 1].encode("utf-32-le", "surrogatepass"), "<u4")
        p = np.where(_letters()[raw], raw, 32).astype(np.uint64)
        gap = (p[:-1] == 32) & (p[1:] == 32)
        h = np.zeros(len(p), np.uint64)
        ok = np.ones(len(p), bool)
        for n in range(1, most + 1):
            h = h[: len(p) - n + 1] * np.uint64(0x100000001B3) + p[n - 1 :] * np.uint64(0x9E3779B97F4A7C15)
            ok = ok[: len(p) - n + 1] & (~gap[n - 2 :] if n > 1 else p != 32)
            if n == 1:
                keep = ok
                ok = np.ones(len(p), bool)  # a longer n-gram may begin with a space
            else:
                keep = ok
            if n in SIZES:
                keep = np.flatnonzero(keep[: min(SPAN, len(keep))])
                x = h[keep] + np.uint64(n)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                yield np.searchsorted(ends, at + keep, side="right"), (x >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # buckets x languages


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SPAN characters together; a longer text is a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > SPAN:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def fit(docs: DataFrame, train: Column, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> LanguageModel:
    """Learns from rows where `train` holds, text and label are not null."""
    rows = docs.where(train & F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).withColumn("_lang", F.col(label_col).cast("string"))
    seen = {r[0]: r[1] for r in rows.groupBy("_lang").count().collect()}  # languages
    languages = sorted(seen)
    if sum(seen.values()) > fit_rows:
        share = _share(list(seen.values()), fit_rows)
        some = F.lit(False)
        for lang in languages:
            some = F.when(F.col("_lang") == lang, sampled(F.col(id_col), share, seen[lang])).otherwise(some)
        rows = rows.where(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in set(langs):
                mine = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                total = counts.setdefault(lang, np.zeros(1 << BITS, np.int64))
                for a, z in _groups(mine):
                    for _, bucket in grams(mine[a:z]):
                        total += np.bincount(bucket, minlength=1 << BITS)
        for lang, total in counts.items():
            at = np.flatnonzero(total)
            arrays = [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "bucket", "n"])

    got = rows.select(F.col(text_col).alias("text"), F.col("_lang").alias("lang")).mapInArrow(tidy(run), "lang string, bucket long, n long")
    got = got.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets
    c = np.zeros((1 << BITS, len(languages)))
    for j, lang in enumerate(languages):
        mine = got[got["lang"] == lang]
        c[mine["bucket"].to_numpy(np.int64), j] = mine["n"]
    prior = np.array([seen[x] for x in languages], float)
    log_prob = np.log((c + SMOOTHING) / (c.sum(axis=0) + SMOOTHING * (1 << BITS)))
    return LanguageModel(languages, np.log(prior / max(prior.sum(), 1)), log_prob.astype(np.float32))


def _share(counts: list[int], rows: int) -> float:
    """What each language may have of `rows`, if those that have less than that leave the rest to others."""
    left, n = float(rows), len(counts)
    for c in sorted(counts):
        if c > left / n:
            break
        left, n = left - c, n - 1
    return left / max(n, 1)


def classify(texts: list[str | None], m: LanguageModel) -> tuple[list[str], np.ndarray]:
    """(language, posterior) of each text; `und` and 0 where there is no letter or no model."""
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not m.languages:
        return langs, scores
    for a, z in _groups(texts):
        logs = np.tile(m.log_prior, (z - a, 1))
        found = np.zeros(z - a, bool)
        for owner, bucket in grams(texts[a:z]):
            found[owner] = True
            for j in range(len(m.languages)):
                logs[:, j] += np.bincount(owner, m.log_prob[bucket, j], z - a)
        best = logs.argmax(axis=1)
        share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        for i in np.flatnonzero(found):
            langs[a + i], scores[a + i] = m.languages[best[i]], share[i]
    return langs, scores


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row. A text that is null or has no letter is `und`, score 0;
    of languages with equal posteriors the alphabetically first wins."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages
    schema = T.StructType([docs.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = classify(b.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, F.col(text_col).alias("_text_to_read")).mapInArrow(tidy(run), schema)
