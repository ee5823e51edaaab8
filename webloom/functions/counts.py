"""Counting within a document, as one Arrow function: a document is one row, so nothing is shuffled.

Items are numbered and all documents of a span are counted together in numpy. A document longer than
a span is counted span by span, and the counts are added up, so memory follows the distinct items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

#: Items or characters counted at a time.
SPAN = 1 << 20

TOP = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("cnt", T.LongType())]))
BUCKETS = T.ArrayType(T.StructType([T.StructField("bucket", T.LongType()), T.StructField("term", T.StringType()), T.StructField("cnt", T.LongType())]))

Counts = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # row, item, how often, first place


def _summed(parts: list[Counts]) -> Counts:
    """One entry for each row and item, ordered by both."""
    row, item, n, first = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((first, item, row))
    row, item, n, first = row[order], item[order], n[order], first[order]
    at = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])))[: len(row)])
    return row[at], item[at], np.add.reduceat(n, at) if len(at) else n, first[at]


def _groups(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of a SPAN together; a larger row is a run of its own."""
    first = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and total + n > SPAN:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def _counts(codes_of, sizes: np.ndarray) -> Iterator[tuple[int, int, Counts]]:
    """(first row, end, counts) run by run. codes_of(row, end, a, z): items a to z of rows that lie one
    behind the other."""
    for i, j in _groups(sizes):
        ends, parts = np.cumsum(sizes[i:j]), []
        begins = ends - sizes[i:j]
        for a in range(0, int(ends[-1]), SPAN):
            codes = codes_of(i, j, a, min(a + SPAN, int(ends[-1])))
            place = np.arange(a, a + len(codes))
            row = np.searchsorted(ends, place, side="right")
            parts.append(_summed([(row, codes, np.ones(len(codes), np.int64), place - begins[row])]))
        yield i, j, _summed(parts) if parts else (np.empty(0, np.int64),) * 4


def _ranked(counts: Counts, k: int) -> Counts:
    """The k most frequent items of each row in order; of equals the first."""
    row, item, n, first = counts
    order = np.lexsort((first, -n, row))
    row = row[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    kept = order[rank < k]
    return tuple(x[kept] for x in counts)


def _bucketed(counts: Counts, rank_of: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """(row, bucket, item, n): each row's items in alphabetical order (rank_of) are cut into buckets of
    V // buckets items, one at least; each has its most frequent item, of equals the first."""
    row, item, n, _ = counts
    order = np.lexsort((rank_of[item], row))
    row, item, n = row[order], item[order], n[order]
    begin = np.searchsorted(row, row)
    size = np.maximum(1, (np.searchsorted(row, row, side="right") - begin) // buckets)
    bucket = (np.arange(len(row)) - begin) // size
    some = bucket < buckets
    row, item, n, bucket = row[some], item[some], n[some], bucket[some]
    best = np.lexsort((np.arange(len(row)), -n, bucket, row))
    new = np.concatenate(([True], (row[best][1:] != row[best][:-1]) | (bucket[best][1:] != bucket[best][:-1])))[: len(best)]
    best = best[new]
    return row[best], bucket[best], item[best], n[best]


def _lists(row: np.ndarray, rows: int, columns: list[pa.Array], names: list[str]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), pa.StructArray.from_arrays(columns, names))


def _mapped(df: DataFrame, keep: list[str], value: Column, out: str, kind: T.DataType, work) -> DataFrame:
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, kind)])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, lists in work(b.column(n)):
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns[:n]), lists], names=[*keep, out])

    return df.select(*keep, value.alias("_counted")).mapInArrow(run, schema)


def _words(column: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, number of each word in turn, where each row's words begin, sizes); null is empty."""
    coded = column.flatten().dictionary_encode()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(sizes) - sizes, sizes


def top_words(df: DataFrame, keep: list[str], words: Column, k: int, out: str = "top") -> DataFrame:
    """`keep` and `out`: the k most frequent of each row's words (an array) with their counts; of equals,
    those that come first."""

    def work(column: pa.ListArray) -> Iterator[tuple[int, int, pa.ListArray]]:
        names, codes, begins, sizes = _words(column)
        for i, j, counts in _counts(lambda i, j, a, z: codes[begins[i] + a : begins[i] + z], sizes):
            row, item, n, _ = _ranked(counts, k)
            yield i, j, _lists(row, j - i, [names.take(pa.array(item)), pa.array(n)], ["term", "cnt"])

    return _mapped(df, keep, words, out, TOP, work)


def word_buckets(df: DataFrame, keep: list[str], words: Column, buckets: int, out: str = "topics") -> DataFrame:
    """`keep` and `out`: (bucket, term, cnt) of each row's words, see _bucketed."""

    def work(column: pa.ListArray) -> Iterator[tuple[int, int, pa.ListArray]]:
        names, codes, begins, sizes = _words(column)
        rank = np.empty(len(names), np.int64)
        rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        for i, j, counts in _counts(lambda i, j, a, z: codes[begins[i] + a : begins[i] + z], sizes):
            row, bucket, item, n = _bucketed(counts, rank, buckets)
            yield i, j, _lists(row, j - i, [pa.array(bucket), names.take(pa.array(item)), pa.array(n)], ["bucket", "term", "cnt"])

    return _mapped(df, keep, words, out, BUCKETS, work)


def top_grams(df: DataFrame, keep: list[str], text: Column, k: int, out: str = "grams") -> DataFrame:
    """`keep` and `out`: the k most frequent three-character substrings of each row's text with their
    counts; of equals, those that come first."""

    def work(column: pa.StringArray) -> Iterator[tuple[int, int, pa.ListArray]]:
        texts = [t or "" for t in column.to_pylist()]
        sizes = np.array([max(len(t) - 2, 0) for t in texts], np.int64)

        def codes(i: int, j: int, a: int, z: int) -> np.ndarray:
            # a span lies within the joined texts unless it is part of one text, so only that one is cut
            joined = texts[i][a : z + 2] if j == i + 1 else "".join(texts[i:j])
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            if len(points) < 3:
                return np.empty(0, np.int64)
            grams = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
            if j == i + 1:
                return grams
            whole = np.ones(len(points), bool)  # no substring reaches from one text into the next
            ends = np.cumsum([len(t) for t in texts[i:j]])
            for back in (1, 2):
                at = ends - back
                whole[at[at >= np.concatenate(([0], ends[:-1]))]] = False
            return grams[whole[:-2]]

        for i, j, counts in _counts(codes, sizes):
            row, item, n, _ = _ranked(counts, k)
            points = np.stack([item >> 42, item >> 21 & 0x1FFFFF, item & 0x1FFFFF], axis=1).astype("<u4")
            joined = points.tobytes().decode("utf-32-le", "surrogatepass")
            terms = pa.array([joined[p : p + 3] for p in range(0, len(joined), 3)], pa.string())
            yield i, j, _lists(row, j - i, [terms, pa.array(n)], ["term", "cnt"])

    return _mapped(df, keep, text, out, TOP, work)
