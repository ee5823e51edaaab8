"""Language-model scoring with an interpolated modified Kneser-Ney model of two or three words.

Counting takes two grouped passes. Words are hashed, dealt to buckets by the hash's leading bits and
summed; a word's place in the sorted hash arrays is its number. Then pairs are dealt to buckets by
ranges of their contexts' numbers and summed; within a bucket, the context's place in the range and
the last word's number make one 64-bit key, however many words and contexts there are in all. A
context with more than HOT tokens has buckets of its own, over which its last words are dealt. Tasks
sum what they have read before anything is shuffled, and send it as packed blocks of sorted numbers.
Buckets end as sorted arrays in files of the shared folder, named by kind and number, which workers
map into memory and search. What grows with the tokens on the driver is the size of each bucket and
the hot contexts' numbers: some 100 bytes for every PAIR_TOKENS tokens, written as index files that
workers map too. Nothing of the model's size is collected or broadcast.

P(w|u) = max(c(uw) - D(c(uw)), 0) / c(u.) + gamma(u) Pc(w);  gamma(u) = sum_k D_k N_k(u.) / c(u.)
Pc(w) = max(n(.w) - D'(n(.w)), 0) / n(..) + gamma' / (V + 1);  discounts as Chen and Goodman have them.

With order 3, pairs are numbered as words are, and a third pass counts triples by the number of their
first pair and their last word. P(w|tu) is as above over c(tuw), with P(w|u) below it, and in P(w|u)
c(uw) is the number of distinct words before uw; pairs at the start of a text, which nothing
precedes, keep their counts. The first word of a text has the start alone as its context.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.core.scratch import Scratch
from webloom.llm import files
from webloom.llm.memory import tidy

#: Documents for each word bucket, tokens for each pair bucket, tokens beyond which a context has
#: buckets of its own, bytes of text handled at a time. Each span looks into every bucket, so the fewer
#: of both there are the better; memory bounds them.
WORD_DOCS, PAIR_TOKENS, HOT, SPAN = 16_384, 2_000_000, 1_000_000, 3_000_000
#: Distinct n-grams of a task's spans that are summed up before they are dealt to buckets.
SUMMED = 1_500_000
#: Files that a worker keeps mapped, which are all of a model of some 35 GB of documents (a process may
#: have 65,530 maps), and bytes it holds of files that cannot be mapped.
MAPS, HELD = 32_768 if files.MAPS_ARE_FREE else 512, 256 << 20

WHITE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: The hash of an end; a word's is never that of no bytes.
END = np.uint64(0)
#: The primes of XXH64, and bytes of a word beyond which it is hashed by itself.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SHORT = 31
#: Each byte, A-Z as small letters.
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def hashed_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 of each word data[start:end], with A-Z as small letters: eight bytes of all words that have as
    many left at a time, then four, then the last ones one by one."""
    low = np.concatenate((LOWER[data], np.zeros(8, np.uint8)))
    eights, fours = np.ndarray(len(data) + 1, "<u8", low, 0, 1), np.ndarray(len(data) + 1, "<u4", low, 0, 1)
    at, left = starts.copy(), ends - starts
    h = P5 + left.astype(np.uint64)
    left[left > SHORT] = 0
    on = np.flatnonzero(left >= 8)
    while len(on):
        lane = _turned(eights[at[on]] * P2, 31) * P1
        h[on] = _turned(h[on] ^ lane, 27) * P1 + P4
        at[on] += 8
        left[on] -= 8
        on = on[left[on] >= 8]
    on = np.flatnonzero(left >= 4)
    h[on] = _turned(h[on] ^ fours[at[on]].astype(np.uint64) * P1, 23) * P2 + P3
    at[on] += 4
    left[on] -= 4
    on = np.flatnonzero(left)
    while len(on):
        h[on] = _turned(h[on] ^ low[at[on]].astype(np.uint64) * P5, 11) * P1
        at[on] += 1
        left[on] -= 1
        on = on[left[on] > 0]
    h = (h ^ h >> np.uint64(33)) * P2
    h = (h ^ h >> np.uint64(29)) * P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(ends - starts > SHORT):
        h[i] = xxhash.xxh64_intdigest(low[starts[i] : ends[i]])
    return h


@dataclass
class Group:
    """Tokens of some texts, or of a part of one: their hashes, where each text begins, which row it
    is, and how many tokens at the front were in the group before and are here as contexts only."""

    hashes: np.ndarray
    starts: np.ndarray
    rows: np.ndarray
    lead: int

    @property
    def heads(self) -> np.ndarray:
        """Where texts begin that begin in this group."""
        return self.starts[1:] if self.lead else self.starts

    def sums(self, x: np.ndarray) -> np.ndarray:
        """The sum of each text's values here, without those of the lead."""
        if self.lead:
            x = x.copy()
            x[: self.lead] = 0
        return np.add.reduceat(x, self.starts)


def _tokens(data: np.ndarray, at: np.ndarray, ends: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, where each text begins) of the words of texts data[at[i]:at[i + 1]], each with its end."""
    part = data[at[0] : at[-1]]
    at = at - at[0]
    white = WHITE[part]
    before, behind = np.ones(len(part), bool), np.ones(len(part), bool)
    before[1:], behind[:-1] = white[:-1], white[1:]
    inner = at[(at > 0) & (at < len(part))]
    before[inner] = behind[inner - 1] = True
    first, last = np.flatnonzero(~white & before), np.flatnonzero(~white & behind) + 1
    hashes = hashed_words(part, first, last)
    if not ends:
        return hashes, np.zeros(1, np.int64)
    words = np.searchsorted(first, at)
    starts = words[:-1] + np.arange(len(at) - 1)
    out = np.full(len(first) + len(at) - 1, END)
    out[np.arange(len(first)) + np.searchsorted(at, first, side="right") - 1] = hashes
    return out, starts


def token_groups(texts: pa.Array) -> Iterator[Group]:
    """The words of SPAN bytes or somewhat more at a time, each text's with an end; null is empty. A text
    that is cut goes on in the next group behind its last two tokens."""
    if not len(texts):
        return
    texts = texts.fill_null(b"").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SPAN, side="right")) - 1)
        if offsets[j] - offsets[i] <= 2 * SPAN:
            yield Group(*_tokens(data, offsets[i : j + 1]), np.arange(i, j), 0)
        else:  # one long text
            at, lead = int(offsets[i]), np.empty(0, np.uint64)
            while at < offsets[j] or not len(lead):
                cut = _cut(data, at + SPAN, int(offsets[j]))
                hashes, _ = _tokens(data, np.array([at, cut]), ends=cut == offsets[j])
                if len(hashes):
                    yield Group(np.concatenate((lead, hashes)), np.zeros(1, np.int64), np.array([i]), len(lead))
                    lead = np.concatenate((lead, hashes))[-2:]
                at = cut
                if at == offsets[j]:
                    break
        i = j


def _cut(data: np.ndarray, at: int, end: int) -> int:
    """The first white space from `at` on, or the end."""
    while at < end:
        found = np.flatnonzero(WHITE[data[at : min(at + 4096, end)]])
        if len(found):
            return at + int(found[0])
        at += 4096
    return end


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys and their counts: differences, byte by byte, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    bytewise = lambda x: np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(bytewise(steps) + bytewise(counts.astype(np.uint64)))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    half = len(raw) // 2
    words = lambda x: np.ascontiguousarray(x.reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(words(raw[:half]), dtype=np.uint64), words(raw[half:])


def summed(blobs) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all blocks, sorted, and the sums of their counts."""
    parts = [unpack(b) for b in blobs]
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(counts, at)


def compact(x: np.ndarray) -> bytes:
    """Numbers from 0, a byte each where they are under 255; then places and values of the others."""
    flat = x.ravel()
    over = np.flatnonzero(flat >= 255)
    return b"".join((np.minimum(flat, 255).astype(np.uint8).tobytes(), bytes(-len(flat) % 8), over.astype(np.int64).tobytes(), flat[over].astype(np.int64).tobytes()))


class Compact:
    """Reads numbers by place from what compact() wrote."""

    def __init__(self, raw: np.ndarray, n: int):
        rest = raw[n + -n % 8 :].view(np.int64)
        self.small, self.over, self.values = raw[:n], rest[: len(rest) // 2], rest[len(rest) // 2 :]

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        out = self.small[places].astype(np.int64)
        over = np.flatnonzero(out == 255)
        out[over] = self.values[np.searchsorted(self.over, places[over])]
        return out

    def all(self) -> np.ndarray:
        out = self.small.astype(np.int64)
        out[self.over] = self.values
        return out


def _save(folder: str, name: str, data) -> None:
    """Writes a file under its final name at once, so a repeated task replaces equal by equal."""
    with files.replacing(f"{folder}/{name}") as out:
        out.write(data if isinstance(data, bytes) else np.ascontiguousarray(data).data)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@dataclass
class Plan:
    """How n-grams of one length are dealt: plain buckets hold a range of `per` contexts each, hot
    contexts have several buckets behind those. The hot contexts' numbers are in an index file."""

    kind: str
    buckets: int
    per: int
    hot: int = 0
    all_buckets: int = 0
    types: int = 0
    discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)


@dataclass
class Model:
    """Where the arrays are, and the figures of the whole. Words are numbered by bucket and place;
    the start of a text has the number after the last."""

    folder: str
    bits: int
    order: int
    vocabulary: int = 0
    tokens: int = 0
    pairs: Plan | None = None
    triples: Plan | None = None
    word_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    word_kinds: tuple[int, int, int] = (0, 0, 0)  # words with 1, 2, 3 or more contexts

    @property
    def shift(self) -> int:
        """Bits of a word's number, the start's included."""
        return max(1, self.vocabulary.bit_length())


def _by_bucket(bucket: np.ndarray) -> np.ndarray:
    """Stable order; 16-bit numbers are sorted by radix."""
    small = len(bucket) and bucket.max() < 1 << 16
    return np.argsort(bucket.astype(np.uint16) if small else bucket, kind="stable")


class Level:
    """A worker's view of a Plan: numbers are 64-bit and unsigned."""

    def __init__(self, plan: Plan, shift: int, hot: np.ndarray, first: np.ndarray, offsets: np.ndarray | None):
        self.plan, self.shift, self.hot, self.first, self.offsets = plan, np.uint64(shift), hot, first, offsets
        self.mask = np.uint64((1 << shift) - 1)

    def deal(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, key within it)."""
        per = np.uint64(self.plan.per)
        bucket, key = (context // per).astype(np.int64), (context % per) << self.shift | word
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
            hot = np.flatnonzero(self.hot[at] == context)
            at = at[hot]
            bucket[hot] = self.first[at] + (_mix(word[hot]) % (self.first[at + 1] - self.first[at]).astype(np.uint64)).astype(np.int64)
            key[hot] = word[hot]
        return bucket, key

    def contexts(self, bucket: int, keys: np.ndarray) -> np.ndarray:
        if bucket < self.plan.buckets:
            return (keys >> self.shift) + np.uint64(bucket * self.plan.per)
        return np.full(len(keys), self.hot[np.searchsorted(self.first, bucket, side="right") - 1])

    def words(self, keys: np.ndarray) -> np.ndarray:
        return keys & self.mask


def distinct(context: np.ndarray, word: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, word) in order, the place of each input among them, and how often each is."""
    if len(context) and int(context.max()).bit_length() + shift <= 64:
        keys, inverse, counts = np.unique(context << np.uint64(shift) | word, return_inverse=True, return_counts=True)
        return keys >> np.uint64(shift), keys & np.uint64((1 << shift) - 1), inverse, counts
    order = np.lexsort((word, context))
    context, word = context[order], word[order]
    new = np.concatenate(([True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])))[: len(order)]
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return context[at], word[at], inverse, np.diff(np.append(at, len(order)))


class _Reader:
    """A worker's maps of the model's files, opened when first needed; those least lately used are
    given up first. Files of a store that is not mounted are read into memory instead."""

    def __init__(self, model: Model):
        self.m, self.maps, self.held = model, OrderedDict(), 0
        self.levels: dict[str, Level] = {}

    def file(self, name: str) -> np.ndarray:
        """The bytes of a file."""
        if name in self.maps:
            self.maps.move_to_end(name)
            return self.maps[name][0]
        got, held = files.bytes_of(f"{self.m.folder}/{name}")
        self.maps[name] = got, held
        self.held += held
        while len(self.maps) > MAPS or (self.held > HELD and len(self.maps) > 1):
            self.held -= self.maps.popitem(last=False)[1][1]
        return got

    def numbers_in(self, name: str, kind=np.uint64) -> np.ndarray:
        return self.file(name).view(kind)

    @property
    def offsets(self) -> np.ndarray:
        """The number of each word bucket's first word."""
        return self.numbers_in("index-words", np.int64)

    def level(self, plan: Plan) -> Level:
        got = self.levels.get(plan.kind)
        if got is None:
            hot, first = (self.numbers_in(f"index-{plan.kind}-hot"), self.numbers_in(f"index-{plan.kind}-first", np.int64)) if plan.hot else (np.empty(0, np.uint64), np.empty(0, np.int64))
            got = Level(plan, self.m.shift, hot, first, self.numbers_in(f"index-{plan.kind}", np.int64) if plan.types else None)
            self.levels[plan.kind] = got
        return got

    @property
    def pairs(self) -> Level:
        return self.level(self.m.pairs)

    @property
    def triples(self) -> Level:
        return self.level(self.m.triples)

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count) of sorted distinct hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        offsets = self.offsets
        for b, a, z in _runs((hashes >> np.uint64(64 - self.m.bits)).astype(np.int64)):
            n = int(offsets[b + 1] - offsets[b])
            if n:
                known = self.numbers_in(f"hashes-{b}")
                at = np.minimum(np.searchsorted(known, hashes[a:z]), n - 1)
                hit = np.flatnonzero(known[at] == hashes[a:z])
                ids[a + hit] = offsets[b] + at[hit]
                counts[a + hit] = Compact(self.file(f"counts-{b}"), n)[at[hit]]
        return ids, counts

    def ngrams(self, level: Level, context: np.ndarray, word: np.ndarray, counts: str) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count) of n-grams; the counts are in files of that kind."""
        bucket, keys = level.deal(context, word)
        numbers, out = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        order = _by_bucket(bucket)
        for b, a, z in _runs(bucket[order]):
            n = int(level.offsets[b + 1] - level.offsets[b])
            if n:
                known, mine = self.numbers_in(f"{level.plan.kind}-{b}"), keys[order[a:z]]
                at = np.minimum(np.searchsorted(known, mine), n - 1)
                hit = np.flatnonzero(known[at] == mine)
                numbers[order[a:z][hit]] = level.offsets[b] + at[hit]
                out[order[a:z][hit]] = Compact(self.file(f"{counts}-{b}"), n)[at[hit]]
        return numbers, out

    def last_words(self, numbers: np.ndarray) -> np.ndarray:
        """The second word of pairs with sorted numbers."""
        level, out = self.pairs, np.empty(len(numbers), np.uint64)
        for b, a, z in _runs(bucket_of(numbers, level.offsets)):
            out[a:z] = level.words(self.numbers_in(f"pairs-{b}")[numbers[a:z] - level.offsets[b]])
        return out

    def stats(self, kind: str, rows: int, numbers: np.ndarray, offsets: np.ndarray, extra: int = 0) -> np.ndarray:
        """(tokens after, followers seen once, twice, more often, ..) of sorted numbers; `extra`
        numbers are behind those of the last bucket that has some."""
        out = np.zeros((rows, len(numbers)), np.int64)
        last = int(bucket_of(offsets[-1:], offsets)[0])
        for b, a, z in _runs(bucket_of(numbers, offsets)):
            n = int(offsets[b + 1] - offsets[b]) + (extra if b == last else 0)
            table, at = Compact(self.file(f"{kind}-{b}"), rows * n), numbers[a:z] - offsets[b]
            for row in range(rows):
                out[row, a:z] = table[at + row * n]
        return out

    def word_stats(self, ids: np.ndarray) -> np.ndarray:
        return self.stats("word-stats", 5, ids, self.offsets, 1)

    def pair_stats(self, numbers: np.ndarray) -> np.ndarray:
        return self.stats("pair-stats", 4, numbers, self.pairs.offsets)


def bucket_of(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bucket of a number; the start of a text belongs to the last bucket that has words."""
    return np.searchsorted(offsets, np.minimum(ids, offsets[-1] - 1), side="right") - 1


def _runs(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of each run of equal values."""
    if len(x):
        at = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
        for a, z in zip(at, at[1:], strict=False):
            yield int(x[a]), a, z


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ of the numbers of types seen once to four times; where they say nothing, half."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [k - (k + 1) * y * b / a if a else 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(float(min(max(x, 0.0), k)) for k, x in enumerate(d, 1))


def _discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0)


_BLOBS = "bucket int, blob binary"


def _blobs(ids: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def _dealt_blobs(level: Level, context: np.ndarray, word: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    bucket, keys = level.deal(context, word)
    order = _by_bucket(bucket)
    runs = list(_runs(bucket[order]))
    return _blobs([r[0] for r in runs], [pack(keys[order[a:z]], counts[order[a:z]]) for _, a, z in runs])


def _dealt(level: Level, spans: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The blobs of (contexts, words, counts) of spans; those of SUMMED n-grams are summed up first."""
    held, n = [], 0
    for span in spans:
        held.append(span)
        n += len(span[0])
        if n >= SUMMED:
            yield _dealt_blobs(level, *_merged(held, int(level.shift)))
            held, n = [], 0
    if held:
        yield _dealt_blobs(level, *_merged(held, int(level.shift)))


def _merged(spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]], shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(spans) == 1:
        return spans[0]
    context, word, counts = (np.concatenate(x) for x in zip(*spans, strict=True))
    context, word, inverse, _ = distinct(context, word, shift)
    return context, word, np.bincount(inverse, counts, len(context)).astype(np.int64)


def _context_facts(context: np.ndarray, counts: np.ndarray) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(kind, distinct contexts, values): of sorted contexts, the sum of their counts and how many are
    1, 2 and more."""
    at = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    values = {"total": np.add.reduceat(counts, at), "n1": np.add.reduceat(counts == 1, at, dtype=np.int64), "n2": np.add.reduceat(counts == 2, at, dtype=np.int64), "n3": np.add.reduceat(counts > 2, at, dtype=np.int64)}
    return [(kind, context[at], x) for kind, x in values.items()]


COLUMNS = ["bucket", "kind", "blob", "n", "c1", "c2", "c3", "c4", "c5"]
_FOUND = "bucket int, kind string, blob binary, n long, c1 long, c2 long, c3 long, c4 long, c5 long"


def _fact_rows(facts: list[tuple[str, np.ndarray, np.ndarray]], offsets: np.ndarray) -> list[tuple]:
    """A row for each bucket of the numbers that a fact is not zero for; numbers are sorted."""
    rows = []
    for kind, ids, values in facts:
        some = values > 0
        ids, values = ids[some], values[some]
        for b, a, z in _runs(bucket_of(ids.astype(np.int64), offsets)):
            rows.append((b, kind, pack(ids[a:z], values[a:z]), 0, 0, 0, 0, 0, 0))
    return rows


def _kinds(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3, 4 and more."""
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:].tolist()


def _gathered(pdf: pd.DataFrame, kinds: tuple[str, ...], n: int, offset: int) -> np.ndarray:
    """A row of sums for each kind of fact, a column for each number of a bucket."""
    x = np.zeros((len(kinds), n), np.int64)
    for row, kind in enumerate(kinds):
        blobs = pdf["blob"][pdf["kind"] == kind]
        if len(blobs):
            ids, values = summed(blobs)
            x[row, ids.astype(np.int64) - offset] = values
    return x


class _Fit:
    """The passes of fit(), in turn; what they find is in the model and its folder."""

    def __init__(self, docs: DataFrame, scratch: Scratch, text_col: str, order: int):
        self.spark, self.scratch = docs.sparkSession, scratch
        self.texts = docs.select(F.col(text_col).cast("binary").alias("text"))
        self.n_texts = docs.count()
        bits = max(4, int(np.ceil(np.log2(max(1, self.n_texts / WORD_DOCS)))))
        self.model = Model(scratch.path("model"), bits, order)

    def index(self, name: str, x: np.ndarray) -> None:
        _save(self.model.folder, f"index-{name}", x)

    def reader(self):
        """A function that gives tasks a reader of the model as it is now."""
        shared = self.spark.sparkContext.broadcast(self.model)  # a few numbers and names
        return lambda: _Reader(shared.value)

    def sizes(self, found: DataFrame, kind: str, buckets: int) -> tuple[np.ndarray, list[int]]:
        """Where each bucket's numbers begin, and how many counts are 1, 2, 3, 4 and more."""
        rows = found.where(F.col("kind") == kind)
        got = rows.select("bucket", "n").toPandas()  # two numbers for each bucket
        n = np.zeros(buckets, np.int64)
        n[got["bucket"]] = got["n"]
        kinds = rows.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0)) for k in range(1, 6)]).first()
        return np.concatenate(([0], np.cumsum(n))), list(kinds)

    def plan(self, kind: str, contexts: int, hot: pd.DataFrame) -> Plan:
        """hot: (number, tokens) of the contexts with more than HOT tokens; no more than tokens / HOT."""
        model = self.model
        buckets = min(max(16, -(-model.tokens // PAIR_TOKENS)), contexts)
        per = min(-(-contexts // buckets), 1 << (63 - model.shift))
        plan = Plan(kind, -(-contexts // per), per, len(hot))
        hot = hot.sort_values("number")
        first = plan.buckets + np.concatenate(([0], np.cumsum(-(-hot["tokens"].to_numpy(np.int64) // HOT)))).astype(np.int64)
        plan.all_buckets = int(first[-1])
        if plan.hot:
            self.index(f"{kind}-hot", hot["number"].to_numpy(np.uint64))
            self.index(f"{kind}-first", first)
        return plan

    def words(self) -> None:
        model, bits, folder = self.model, self.model.bits, self.model.folder

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for g in token_groups(b.column(0)):
                    keys, counts = np.unique(g.hashes[g.lead :], return_counts=True)
                    runs = list(_runs((keys >> np.uint64(64 - bits)).astype(np.int64)))
                    yield _blobs([r[0] for r in runs], [pack(keys[a:z], counts[a:z]) for _, a, z in runs])

        def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            b, (keys, counts) = key[0], summed(pdf["blob"])
            counts = counts.astype(np.int64)
            _save(folder, f"hashes-{b}", keys)
            _save(folder, f"counts-{b}", compact(counts))
            hot = np.flatnonzero(counts > HOT)
            rows = [(b, "words", None, len(keys), int(counts.sum()), 0, 0, 0, 0), *((b, "hot", None, int(p), int(counts[p]), 0, 0, 0, 0) for p in hot)]
            return pd.DataFrame(rows, columns=COLUMNS)

        found = self.scratch.write(self.texts.mapInArrow(tidy(words), _BLOBS).groupBy("bucket").applyInPandas(add, _FOUND), "words")
        offsets, kinds = self.sizes(found, "words", 1 << bits)
        model.tokens, model.vocabulary = int(kinds[0]), int(offsets[-1])
        self.index("words", offsets)
        hot = found.where("kind = 'hot'").select("bucket", "n", "c1").toPandas()
        hot = pd.DataFrame({"number": offsets[hot["bucket"].to_numpy(np.int64)] + hot["n"].to_numpy(np.int64), "tokens": hot["c1"]})
        if self.n_texts > HOT:
            hot.loc[len(hot)] = (model.vocabulary, self.n_texts)
        if model.tokens:
            model.pairs = self.plan("pairs", model.vocabulary + 1, hot)

    def pairs(self) -> DataFrame:
        model, folder, order, reader = self.model, self.model.folder, self.model.order, self.reader()

        def spans(r: _Reader, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for b in batches:
                for g in token_groups(b.column(0)):
                    ids = _numbers(r, g)[0].astype(np.uint64)
                    context = _contexts(ids, g.heads, model.vocabulary)
                    context, word, _, counts = distinct(context[g.lead :], ids[g.lead :], model.shift)
                    yield context, word, counts

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = reader()
            yield from _dealt(r.pairs, spans(r, batches))

        def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            b, (keys, counts) = key[0], summed(pdf["blob"])
            counts = counts.astype(np.int64)
            _save(folder, f"pairs-{b}", keys)
            _save(folder, f"pair-counts-{b}", compact(counts))
            rows = [(b, "pairs", None, len(keys), *_kinds(counts))]
            if order == 2:
                rows += _word_facts(reader(), b, keys, counts)
            else:
                rows += [(b, "hot", None, int(p), int(counts[p]), 0, 0, 0, 0) for p in np.flatnonzero(counts > HOT)]
            return pd.DataFrame(rows, columns=COLUMNS)

        found = self.scratch.write(self.texts.mapInArrow(tidy(pairs), _BLOBS).groupBy("bucket").applyInPandas(add, _FOUND), "pairs")
        offsets, kinds = self.sizes(found, "pairs", model.pairs.all_buckets)
        self.index("pairs", offsets)
        model.pairs.types, model.pairs.discounts = int(offsets[-1]), discounts(*kinds[:4])
        if order == 3:
            hot = found.where("kind = 'hot'").select("bucket", "n", "c1").toPandas()
            hot = pd.DataFrame({"number": offsets[hot["bucket"].to_numpy(np.int64)] + hot["n"].to_numpy(np.int64), "tokens": hot["c1"]})
            model.triples = self.plan("triples", model.pairs.types, hot)
        return found

    def triples(self) -> DataFrame:
        model, folder, reader = self.model, self.model.folder, self.reader()

        def spans(r: _Reader, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for b in batches:
                for g in token_groups(b.column(0)):
                    ids = _numbers(r, g)[0].astype(np.uint64)
                    context, word, inverse, _ = distinct(_contexts(ids, g.heads, model.vocabulary), ids, model.shift)
                    before = _contexts(r.ngrams(r.pairs, context, word, "pair-counts")[0][inverse], g.heads, -1)
                    before[: g.lead] = -1
                    some = before >= 0
                    if some.any():
                        context, word, _, counts = distinct(before[some].astype(np.uint64), ids[some], model.shift)
                        yield context, word, counts

        def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = reader()
            yield from _dealt(r.triples, spans(r, batches))

        def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            b, r, (keys, counts) = key[0], reader(), summed(pdf["blob"])
            counts = counts.astype(np.int64)
            _save(folder, f"triples-{b}", keys)
            _save(folder, f"triple-counts-{b}", compact(counts))
            contexts, words = r.triples.contexts(b, keys), r.triples.words(keys)
            rows = [(b, "triples", None, len(keys), *_kinds(counts)), *_fact_rows(_context_facts(contexts, counts), r.pairs.offsets)]
            context, word, _, before = distinct(r.last_words(contexts.astype(np.int64)), words, model.shift)
            blobs = _dealt_blobs(r.pairs, context, word, before)  # by key: no file of pairs is read for them
            rows += [(p, "before", blob, 0, 0, 0, 0, 0, 0) for p, blob in zip(*(c.to_pylist() for c in blobs.columns), strict=True)]
            return pd.DataFrame(rows, columns=COLUMNS)

        found = self.scratch.write(self.texts.mapInArrow(tidy(triples), _BLOBS).groupBy("bucket").applyInPandas(add, _FOUND), "triples")
        offsets, kinds = self.sizes(found, "triples", model.triples.all_buckets)
        self.index("triples", offsets)
        model.triples.types, model.triples.discounts = int(offsets[-1]), discounts(*kinds[:4])
        return found

    def adjusted(self, found: DataFrame) -> DataFrame:
        """Pairs with the number of words before them as counts, and the facts of their words."""
        model, folder, reader = self.model, self.model.folder, self.reader()

        def adjust(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            b, r = key[0], reader()
            n = int(r.pairs.offsets[b + 1] - r.pairs.offsets[b])
            if not n:
                return pd.DataFrame([], columns=COLUMNS)
            keys, counts = r.numbers_in(f"pairs-{b}"), Compact(r.file(f"pair-counts-{b}"), n).all()
            stats, before = _gathered(pdf, ("total", "n1", "n2", "n3"), n, int(r.pairs.offsets[b])), np.zeros(n, np.int64)
            blobs = pdf["blob"][pdf["kind"] == "before"]
            if len(blobs):
                known, sums = summed(blobs)
                before[np.searchsorted(keys, known)] = sums
            before = np.where(r.pairs.contexts(b, keys) == np.uint64(model.vocabulary), counts, before)
            _save(folder, f"pair-stats-{b}", compact(stats))
            _save(folder, f"pair-before-{b}", compact(before))
            return pd.DataFrame([(b, "pairs", None, n, *_kinds(before)), *_word_facts(r, b, np.asarray(keys), before)], columns=COLUMNS)

        every = self.spark.range(model.pairs.all_buckets).select(F.col("id").cast("int").alias("bucket"), F.lit("all").alias("kind"), F.lit(None).cast("binary").alias("blob"))
        facts = found.where("kind <> 'triples'").select("bucket", "kind", "blob").unionByName(every)
        out = self.scratch.write(facts.groupBy("bucket").applyInPandas(adjust, _FOUND), "adjusted")
        self.scratch.drop("triples")
        model.pairs.discounts = discounts(*self.sizes(out, "pairs", model.pairs.all_buckets)[1][:4])
        return out

    def word_stats(self, found: DataFrame) -> None:
        model, folder, reader = self.model, self.model.folder, self.reader()

        def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            b, offsets = key[0], reader().offsets
            n = int(offsets[b + 1] - offsets[b]) + (b == int(bucket_of(offsets[-1:], offsets)[0]))
            x = _gathered(pdf, ("total", "n1", "n2", "n3", "contexts"), n, int(offsets[b]))
            _save(folder, f"word-stats-{b}", compact(x))
            return pd.DataFrame([(b, "stats", None, n, *_kinds(x[4]))], columns=COLUMNS)

        facts = found.where("kind not in ('pairs', 'hot')").select("bucket", "kind", "blob")
        found = self.scratch.write(facts.groupBy("bucket").applyInPandas(add, _FOUND), "stats")
        _, c = self.sizes(found, "stats", 1 << model.bits)
        model.word_discounts, model.word_kinds = discounts(*c[:4]), (c[0], c[1], sum(c[2:]))
        self.scratch.drop("words", "pairs", "adjusted", "stats")


def fit(docs: DataFrame, scratch: Scratch, text_col: str = "text", order: int = 2) -> Model:
    """Counts every token, pair and, with order 3, triple of `docs`; the arrays stay in `scratch`."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    run = _Fit(docs, scratch, text_col, order)
    run.words()
    if run.model.tokens:
        found = run.pairs()
        run.word_stats(found if order == 2 else run.adjusted(run.triples()))
    return run.model


def _numbers(reader: _Reader, g: Group) -> tuple[np.ndarray, np.ndarray]:
    """(number or -1, count) of each token of a group."""
    keys, inverse = np.unique(g.hashes, return_inverse=True)
    ids, counts = reader.words(keys)
    return ids[inverse], counts[inverse]


def _word_facts(reader: _Reader, bucket: int, keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """What a bucket's pairs say of their words."""
    facts = _context_facts(reader.pairs.contexts(bucket, keys), counts)
    followers, before = np.unique(reader.pairs.words(keys), return_counts=True)
    return _fact_rows([*facts, ("contexts", followers, before)], reader.offsets)


def _contexts(ids: np.ndarray, starts: np.ndarray, start: int) -> np.ndarray:
    """What precedes each of ids: `start` at the starts. The first has no meaning unless it is one."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[:1] = start
    before[starts] = start
    return before


def score_tokens(reader: _Reader, g: Group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known, base log10 probability, model's log10 probability) of each token of a group."""
    m = reader.m
    keys, inverse = np.unique(g.hashes, return_inverse=True)
    v = m.vocabulary
    ids, counts = reader.words(keys) if v else (np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64))
    base = np.log10((counts + 0.5) / (m.tokens + 0.5 * (v + 1)))[inverse]
    types = m.pairs.types if m.pairs else 0
    left = sum(d * n for d, n in zip(m.word_discounts, m.word_kinds, strict=True)) / types if types else 1.0
    stats = np.zeros((5, len(ids)), np.int64)
    seen = np.flatnonzero(ids >= 0)
    order = seen[np.argsort(ids[seen], kind="stable")]
    if v:
        stats[:, order] = reader.word_stats(ids[order])
    lower = (_discounted(stats[4], m.word_discounts) / max(types, 1) + left / (v + 1))[inverse]
    if not v:
        return np.zeros(len(inverse), bool), base, np.log10(lower)
    ids = ids[inverse]
    context = _contexts(ids, g.heads, v)
    place = _contexts(inverse.astype(np.int64), g.heads, len(keys))  # column of the context's figures
    figures = np.concatenate([stats[:4], reader.word_stats(np.array([v]))[:4]], axis=1)
    total = figures[0]
    gamma = (np.array(m.pairs.discounts) @ figures[1:4]) / np.maximum(total, 1)
    total, gamma = total[place], gamma[place]
    pair, number = np.zeros(len(ids), np.int64), np.full(len(ids), -1, np.int64)
    both = np.flatnonzero((ids >= 0) & (context >= 0) & (total > 0))
    if len(both):
        before, word, at, _ = distinct(context[both].astype(np.uint64), ids[both].astype(np.uint64), m.shift)
        found, counts = reader.ngrams(reader.pairs, before, word, "pair-counts" if m.order == 2 else "pair-before")
        pair[both], number[both] = counts[at], found[at]
    p = np.where(total > 0, _discounted(pair, m.pairs.discounts) / np.maximum(total, 1) + gamma * lower, lower)
    if m.order == 3:
        p = _with_triples(reader, ids, _contexts(number, g.heads, -1), p)
    return ids >= 0, base, np.log10(p)


def _with_triples(reader: _Reader, ids: np.ndarray, context: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities after two words; context: the number of the pair before each token, or -1."""
    m, p = reader.m, lower.copy()
    some = np.flatnonzero(context >= 0)
    if not len(some):
        return p
    keys, inverse = np.unique(context[some], return_inverse=True)
    total, *kinds = reader.pair_stats(keys)
    gamma = np.array(m.triples.discounts) @ np.array(kinds) / np.maximum(total, 1)
    total, gamma = total[inverse], gamma[inverse]
    some, total, gamma = some[total > 0], total[total > 0], gamma[total > 0]
    count, known = np.zeros(len(some), np.int64), np.flatnonzero(ids[some] >= 0)
    if len(known):
        before, word, at, _ = distinct(context[some[known]].astype(np.uint64), ids[some[known]].astype(np.uint64), m.shift)
        count[known] = reader.ngrams(reader.triples, before, word, "triple-counts")[1][at]
    p[some] = _discounted(count, m.triples.discounts) / total + gamma * lower[some]
    return p


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row.

    Null and empty texts have one token, the end. A very long text is scored part by part, with the
    words before each part as context. Rows that repeat are scored each. A model of no documents gives
    every token probability 1 of the one kind it knows of: unknown."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few numbers and names
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, T.LongType() if "_" in n and n != "base_score" else T.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(shared.value)
        for b in batches:
            counts, sums = np.zeros((2, b.num_rows), np.int64), np.zeros((2, b.num_rows))
            for g in token_groups(b.column(1)):
                known, base, logs = score_tokens(reader, g)
                for out, x in ((counts[0], np.ones(len(known), np.int64)), (counts[1], known.astype(np.int64)), (sums[0], base), (sums[1], logs)):
                    out[g.rows] += g.sums(x)
            columns = [*counts, np.full(b.num_rows, shared.value.tokens), *sums, 10 ** (-sums[1] / counts[0])]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns)], names=[id_col, *names])

    return docs.select(id_col, F.col(text_col).cast("binary").alias("_text_to_score")).mapInArrow(tidy(run), schema)


def fit_and_score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """Scores all rows with a model of those where `train` holds."""
    return score(docs, fit(docs.where(train), Scratch(docs.sparkSession, "kneser-ney"), text_col, order), id_col, text_col)
