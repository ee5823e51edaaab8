"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]); x_i is 1 if
the text has term i. The pairwise part learns that two terms together mean more than their sum, as
an insult next to the mention of a group does, which additive weights cannot say. Terms are words
and word beginnings, hashed. All that LEAST training texts or more have, and as many lack, are fitted: a test of each
term by itself would drop those that say something only together. Instead every step draws each weight,
and each term's factors as one, a little towards zero, and those that nothing holds stay there.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.memory import in_small_batches, tidy

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)
BUCKETS = 1 << 18
#: Labelled rows that the model is fitted to at most, in expectation, by a hash of the identifier.
FIT_ROWS = 16_000
LEAST, FACTORS, STEPS, BATCH = 3, 4, 400, 256
#: Rates of weights and of factors; the square and the absolute penalty.
RATE, PAIR_RATE, DECAY, SPARSE = 0.1, 0.01, 1e-4, 1e-3
#: Words that a worker remembers before it starts anew.
MEMO = 100_000


def word_terms(word: str) -> list[int]:
    """Buckets of a lower-case word and its beginnings."""
    terms = [word, *(f"^{word[:k]}" for k in PREFIXES if len(word) >= k)]
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in terms]


def text_terms(text: str | None) -> np.ndarray:
    """Distinct buckets of a whole text, sorted."""
    found: set[int] = set()
    for w in set(WORD.findall((text or "").lower())):
        found.update(word_terms(w))
    return np.array(sorted(found), np.int32)


@dataclass
class Machine:
    """slot: bucket -> kept term or -1."""

    slot: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, kept: list[int]) -> float:
        if not kept:
            return self.w0
        v = self.v[kept]
        s = v.sum(axis=0)
        return self.w0 + float(self.w[kept].sum()) + 0.5 * float((s * s - (v * v).sum(axis=0)).sum())


def fit_machine(terms: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> Machine:
    """AdaGrad with proximal steps on the logistic loss, over the terms that LEAST texts have and lack.

    Without rows, or with one label only, the model is a constant that says so.
    """
    slot = np.full(BUCKETS, -1, np.int32)
    y = labels.astype(np.float64)
    n, pos = len(y), y.sum()
    if n == 0 or pos in (0, n):
        w0 = float(np.log((pos + 0.5) / (n - pos + 0.5))) if n else -20.0
        return Machine(slot, w0, np.zeros(0), np.zeros((0, FACTORS)))
    df = np.zeros(BUCKETS, np.int32)
    for t in terms:  # a text's terms are distinct
        df[t] += 1
    best = np.flatnonzero((df >= LEAST) & (n - df >= LEAST))
    slot[best] = np.arange(len(best))
    kept = [k[k >= 0] for k in (slot[t] for t in terms)]
    del terms
    rng = np.random.default_rng(seed)
    w0, w, v = float(np.log(pos / (n - pos))), np.zeros(len(best)), rng.normal(0, 0.01, (len(best), FACTORS))
    g0, gw, gv = 1e-8, np.full(w.shape, 1e-8), np.full(v.shape, 1e-8)
    order = np.concatenate([rng.permutation(n) for _ in range(-(-STEPS * BATCH // n))])
    for at in range(0, STEPS * BATCH, BATCH):
        pick = order[at : at + BATCH]
        d0, dw, dv = gradients([kept[i] for i in pick], y[pick], w0, w, v)
        g0, gw, gv = g0 + d0 * d0, gw + dw * dw, gv + dv * dv
        step_w, step_v = RATE / np.sqrt(gw), PAIR_RATE / np.sqrt(gv)
        w0, w, v = w0 - RATE * d0 / np.sqrt(g0), w - step_w * dw, v - step_v * dv
        w = np.sign(w) * np.maximum(np.abs(w) - step_w * SPARSE, 0)
        size = np.sqrt((v * v).sum(axis=1))
        v *= np.maximum(1 - step_v.mean(axis=1) * SPARSE / np.maximum(size, 1e-12), 0)[:, None]
    some = np.flatnonzero((w != 0) | v.any(axis=1))  # what is zero says nothing
    slot[best] = -1
    slot[best[some]] = np.arange(len(some))
    return Machine(slot, float(w0), w[some], v[some])


def gradients(rows: list[np.ndarray], y: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Of the mean logistic loss of some rows of terms, with decay, by w0, w and v."""
    sizes = np.array([len(r) for r in rows])
    row, term = np.repeat(np.arange(len(rows)), sizes), np.concatenate(rows)
    by_row = lambda x: np.bincount(row, x, len(rows))
    by_term = lambda x: np.bincount(term, x, len(w))
    columns = [v[term, f] for f in range(v.shape[1])]
    sums = [by_row(c) for c in columns]
    z = w0 + by_row(w[term]) + 0.5 * sum(s * s - by_row(c * c) for s, c in zip(sums, columns, strict=True))
    err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(rows)
    each = err[row]
    dw = by_term(each)
    dv = np.stack([by_term(each * s[row]) for s in sums], axis=1) - v * dw[:, None] + DECAY * v
    return float(err.sum()), dw + DECAY * w, dv


def sample_bound(rows: float, n: int) -> int:
    """What 64-bit hashes must be below for `rows` of n rows to pass in expectation. However large n is,
    the share is not rounded to nothing."""
    return int(rows / n * 2.0**64) - 2**63


def sampled(key: Column, rows: float, n: int) -> Column:
    """Holds for `rows` of n rows in expectation, by a 64-bit hash of the key; for all if n is no more."""
    return F.lit(True) if n <= rows else F.xxhash64(F.lit("fit"), key) < F.lit(sample_bound(rows, n))


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int, id_col: str, text_col: str, label_col: str, folds: int, held: int) -> DataFrame:
    """(text, label) of labelled documents outside the held-out fold: `fit_rows` of them at most, in
    expectation. A document with several labels takes the largest."""
    use = F.crc32(F.col(id_col).cast("string")) % folds != held
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & use)
    marks = marks.groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    marks = marks.where(sampled(F.col(id_col), fit_rows, marks.count()))
    return docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(marks), id_col).select("text", F.col("_label").alias("label"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    fit_rows: int = FIT_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 5,
    held: int = 0,
) -> Machine:
    """Fits the machine; only the bounded sample's term numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [text_terms(t.as_py()).tobytes() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), b.column(1)], names=["terms", "label"])

    rows = training_rows(docs, labels, fit_rows, id_col, text_col, label_col, folds, held)
    got = in_small_batches(rows).mapInArrow(tidy(run), "terms binary, label int").toArrow().combine_chunks()
    labels = got["label"].to_numpy()
    bags = [np.frombuffer(t.as_buffer(), np.int32) for t in got["terms"]]  # views of what has arrived
    order = sorted(range(len(bags)), key=lambda i: (labels[i], xxhash.xxh3_128_digest(bags[i])))  # the same model whatever order tasks end in
    return fit_machine([bags[i] for i in order], labels[order])


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, out_col: str = "score") -> DataFrame:
    """(id, score) or (`keep` columns, score) for every row, the score under the name `out_col`. Null and empty texts score as a text
    without terms does. Whole texts are read; repeated ids are scored row by row."""
    columns = keep or [id_col]
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # about 1 MB whatever the input
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = shared.value, {}
        for b in batches:
            scores = np.empty(b.num_rows)
            for i, text in enumerate(b.column(len(columns))):
                kept: set[int] = set()
                for word in set(WORD.findall((text.as_py() or "").lower())):
                    got = memo.get(word)
                    if got is None:
                        slots = m.slot[word_terms(word)]
                        memo[word] = got = tuple(slots[slots >= 0].tolist())
                    kept.update(got)
                scores[i] = 1 / (1 + np.exp(-np.clip(m.margin(sorted(kept)), -500, 500)))
                if len(memo) > MEMO:
                    memo.clear()
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(scores)], schema=pa.schema([*(b.schema.field(c) for c in range(len(columns))), (out_col, pa.float64())]))

    return in_small_batches(docs).select(*columns, F.col(text_col).alias("_text_to_score")).mapInArrow(tidy(run), schema)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose score is below `threshold`, with their columns as they were.

    Null and empty texts score as a text without terms does; whole texts are read, one at a time.
    Repeated rows are judged each, and alike. An empty table gives an empty one; without labels, or with
    one label only, the machine is a constant and all rows stay or go together. A column that is called
    like the score, in any case of letters, stays as it is."""
    name, taken = "_toxicity", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    scored = score(docs, fit(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col, docs.columns, name)
    return scored.where(F.col(name) < threshold).drop(name)
