"""Byte-level BPE encoding and decoding by a two-tier lookup.

A batch of texts is cut before each space that a non-space character follows; no pre-token reaches across
such a place, so the distinct chunks of a batch can be told first and are split into pre-tokens once. The
first tier resolves the distinct pre-tokens that are in the vocabulary as a whole: a minimal perfect hash
gives each one slot to look at, and the bytes there decide. The second tier merges the others: a heap of
pairs by rank over a linked list of their bytes, whose latest results a worker remembers. Ids of
pre-tokens, chunks and texts are then put together by Arrow.

The hash is built once, on the driver, by hashing and displacing: keys are dealt to buckets, and of each
bucket, the largest first, a displacement is sought that sends all its keys to slots that are still free.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.sentencepiece_codec import Memory, _free, _mapped

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Keys that a bucket of the hash has on average, displacements tried at a time, and all that are tried.
BUCKET, TRIES, MOST_TRIES = 4, 256, 1 << 24
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Merged words of a generation that a worker remembers, of which it keeps two.
MEMO_WORDS = 200_000
#: Bytes that may follow a space for a cut there: no white space begins with them.
FOLLOWS = np.array([0x20 < b < 0x80 or b in range(0xC3, 0xE1) or b > 0xE3 for b in range(256)])


def _mixed(h: np.ndarray, displacement: np.ndarray) -> np.ndarray:
    """A 64-bit hash of a hash and a displacement (the finaliser of splitmix64)."""
    z = h + displacement.astype(np.uint64) * GOLDEN
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def hashes(keys: list) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))


class PerfectHash:
    """Slots 0 to n - 1 for n distinct keys, one each; any other key gets some slot."""

    def __init__(self, keys: list[bytes]):
        h, n = hashes(keys), len(keys)
        if len(np.unique(h)) < n:
            raise ValueError("two keys are equal, or share a 64-bit hash")
        self.n, buckets = n, max(1, n // BUCKET)
        self.displacements = np.zeros(buckets, np.int64)
        order = np.argsort(h % np.uint64(buckets), kind="stable")
        sizes = np.bincount((h % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        starts, free = np.cumsum(sizes) - sizes, np.ones(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            mine = h[order[starts[b] : starts[b] + sizes[b]]]
            self.displacements[b], slots = self._displacement(mine, free)
            free[slots] = False
        single = np.flatnonzero(sizes == 1)  # what is left: a slot by its number
        self.displacements[single] = -1 - np.flatnonzero(free)[: len(single)]

    def _displacement(self, mine: np.ndarray, free: np.ndarray) -> tuple[int, np.ndarray]:
        for first in range(0, MOST_TRIES, TRIES):
            slots = _mixed(mine[None, :], np.arange(first, first + TRIES)[:, None]) % np.uint64(self.n)
            ordered = np.sort(slots, axis=1)
            good = free[slots].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if good.any():
                at = int(np.argmax(good))
                return first + at, slots[at]
        raise RuntimeError("no displacement found")

    def slots(self, h: np.ndarray) -> np.ndarray:
        d = self.displacements[h % np.uint64(len(self.displacements))]
        return np.where(d < 0, -1 - d, (_mixed(h, np.maximum(d, 0)) % np.uint64(self.n)).astype(np.int64))


class Vocabulary:
    """Tokens by rank. `content` is that of a rank file: a token in base64 and its id on each line."""

    def __init__(self, content: bytes, pattern: str):
        pairs = [line.split() for line in content.splitlines() if line.strip()]
        self.rank = {base64.b64decode(t): int(i) for t, i in pairs}
        if not all(bytes([b]) in self.rank for b in range(256)):
            raise ValueError("the vocabulary lacks some bytes")
        keys = list(self.rank)
        self.hash, self.pattern = PerfectHash(keys), regex.compile(pattern)
        slots = self.hash.slots(hashes(keys))
        place = np.empty(len(keys), np.int64)
        place[slots] = np.arange(len(keys))
        self.tokens = pa.array([keys[i] for i in place], pa.binary())
        self.ids = np.array([self.rank[keys[i]] for i in place], np.int32)
        raw: list[bytes | None] = [None] * (max(self.rank.values()) + 1)
        for token, i in self.rank.items():
            raw[i] = token
        self.raw = pa.array(raw, pa.binary())
        # the token that two tokens make, and that two bytes make, or -1
        get, self.bytes = self.rank.get, [self.rank[bytes([b])] for b in range(256)]
        halves = ((get(t[:i]), get(t[i:]), r) for t, r in self.rank.items() for i in range(1, len(t)))
        self.pairs = {a << 32 | b: r for a, b, r in halves if a is not None and b is not None}
        self.first = {(a, b): get(bytes([a, b]), -1) for a in range(256) for b in range(256)}
        self.memory = Memory(MEMO_WORDS)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pattern": self.pattern.pattern, "memory": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"pattern": regex.compile(state["pattern"]), "memory": Memory(MEMO_WORDS)}

    def whole(self, words: pa.StringArray, listed: list[str]) -> np.ndarray:
        """Id of each word that is a token, -1 of others."""
        slots = self.hash.slots(hashes(listed))
        same = pc.equal(self.tokens.take(pa.array(slots)), words.cast(pa.binary()))
        return np.where(same.to_numpy(zero_copy_only=False), self.ids[slots], -1)

    def merged(self, word: bytes) -> list[int]:
        """Ids of a word by merging: the pair of least rank first, the leftmost of equals."""
        pairs, n = self.pairs, len(word)
        ids = [self.bytes[b] for b in word]  # of a part, by its first byte; -1 once it is gone
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i, r in enumerate(map(self.first.__getitem__, zip(word, word[1:], strict=False))) if r >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if j == n or ids[i] < 0 or pairs.get(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j], end = r, -1, after[j]
            after[i] = end
            if end < n:
                ahead[end] = i
                if (more := pairs.get(r << 32 | ids[end])) is not None:
                    heappush(heap, more << 32 | i)
            if i and (more := pairs.get(ids[ahead[i]] << 32 | r)) is not None:
                heappush(heap, more << 32 | ahead[i])
        return [i for i in ids if i >= 0]

    def _words(self, words: pa.StringArray) -> pa.ListArray:
        """Ids of each of some distinct pre-tokens."""
        listed = words.to_pylist()
        ids = self.whole(words, listed)
        missed = np.flatnonzero(ids < 0)
        rest = [listed[i] for i in missed.tolist()]
        for w in self.memory.missing(rest):
            self.memory.young[w] = array("i", self.merged(w.encode("utf-8"))).tobytes()
        packed = [self.memory.young[w] for w in rest]
        counts = np.ones(len(ids), np.int64)
        counts[missed] = [len(x) // 4 for x in packed]
        values = np.repeat(ids, counts)
        values[np.repeat(ids < 0, counts)] = np.frombuffer(b"".join(packed), np.int32)
        return _lists(np.cumsum([0, *counts]), pa.array(values.astype(np.int32)))

    def _chunks(self, chunks: pa.StringArray) -> tuple[pa.ListArray, np.ndarray]:
        """Ids of some distinct chunks, in another order, and the place of each one there."""
        bounds, raw = _buffers(chunks)
        long = np.diff(bounds) > 1
        led = long.copy()
        led[long] = (raw[bounds[:-1][long]] == 0x20) & FOLLOWS[raw[bounds[:-1][long] + 1]]
        # chunks that begin with a space may follow any text, so one search splits them all
        joined = chunks.filter(pa.array(led))
        words = self.pattern.findall("".join(joined.to_pylist()))
        begins = np.cumsum([0, *map(len, words)])[:-1]
        ends = np.searchsorted(begins, np.cumsum(pc.utf8_length(joined).to_numpy())).tolist()
        for chunk in chunks.filter(pa.array(~led)).to_pylist():  # the first of a text
            words += self.pattern.findall(chunk)
            ends.append(len(words))
        place = np.empty(len(led), np.int64)
        place[np.concatenate((np.flatnonzero(led), np.flatnonzero(~led)))] = np.arange(len(led))
        coded = pa.array(words, pa.string()).dictionary_encode()
        return _regrouped(self._words(coded.dictionary), coded.indices, np.array([0, *ends])), place

    def encode(self, texts: pa.StringArray) -> pa.ListArray:
        """Ids of whole texts; null and empty texts have none."""
        if not len(texts):
            return pa.array([], pa.list_(pa.int32()))
        texts = pc.fill_null(texts.cast(pa.string()), "")
        offsets, raw = _buffers(texts)
        begins = np.zeros(offsets[-1] + 1, bool)
        mine = raw[offsets[0] : offsets[-1]]
        begins[offsets[0] : max(offsets[0], offsets[-1] - 1)] = (mine[:-1] == 0x20) & FOLLOWS[mine[1:]]
        begins[np.maximum(offsets[1:] - 1, offsets[0])] = False  # a text's last byte is followed by nothing
        begins[offsets] = True
        at = np.flatnonzero(begins[:-1])
        bounds = np.append(at, offsets[-1]).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(raw))
        coded = chunks.dictionary_encode()
        lists, place = self._chunks(coded.dictionary)
        return _regrouped(lists, pa.array(place[coded.indices.to_numpy()]), np.searchsorted(at, offsets))

    def decode(self, lists: pa.ListArray) -> pa.BinaryArray:
        """Bytes of lists of ids; null lists give null, and ids that the vocabulary lacks raise."""
        if not len(lists):
            return pa.array([], pa.binary())
        found = self.raw.take(lists.values)
        if found.null_count:
            raise ValueError("ids hold null or what the vocabulary lacks")
        return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, found, mask=lists.is_null() if lists.null_count else None), b"")


def _buffers(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins, and the last ends, in the bytes of all."""
    _, offsets, data = texts.buffers()
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1], raw


def _lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _regrouped(lists: pa.ListArray, picked: pa.Array, bounds: np.ndarray) -> pa.ListArray:
    """The lists that are picked, joined from each of `bounds` to the next."""
    taken = lists.take(picked)
    ends = np.append(0, np.cumsum(pc.list_value_length(taken).to_numpy(zero_copy_only=False)))
    return _lists(ends[bounds], taken.flatten())


def vocabulary(path: str | None = None, pattern: str | None = None) -> Vocabulary:
    """The vocabulary of a rank file and the pattern that splits texts; None: the public byte-level ones."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:
        return Vocabulary(f.read(), pattern)


def encode(docs: DataFrame, vocab: Vocabulary | None = None, text_col: str = "text", keep: list[str] | None = None, out_col: str = "token_ids") -> DataFrame:
    """`keep` columns (None: all) and `out_col`, an array of ids, for every row and whole text.

    Null and empty texts give an empty array. A column that is already called `out_col` keeps its name, and
    the new one gets an underscore. An empty table stays empty. The vocabulary (some MB, whatever the
    texts) is read once, on the driver, and broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab or vocabulary())
    columns = list(docs.columns if keep is None else keep)
    field = T.StructField(_free(out_col, columns), T.ArrayType(T.IntegerType(), False))
    return _mapped(docs, columns, F.col(text_col).alias("_to_encode"), [field], lambda texts: [shared.value.encode(texts)])


def decode(encoded: DataFrame, vocab: Vocabulary | None = None, ids_col: str = "token_ids", keep: list[str] | None = None, out_col: str = "decoded") -> DataFrame:
    """`keep` columns (None: all) and `out_col`, the text of the ids; bytes that are no UTF-8 become U+FFFD.
    Null ids give null, empty ones an empty text, and ids that the vocabulary lacks raise."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocab or vocabulary())
    columns = list(encoded.columns if keep is None else keep)
    field = T.StructField(_free(out_col, columns), T.StringType())

    def work(lists: pa.Array) -> list[pa.Array]:
        return [pa.array([None if b is None else b.decode("utf-8", "replace") for b in shared.value.decode(lists).to_pylist()], pa.string())]

    return _mapped(encoded, columns, F.col(ids_col).cast("array<int>").alias("_to_decode"), [field], work)


def round_trip(docs: DataFrame, vocab: Vocabulary | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: the number of its ids, the digest of the ids
    as little-endian unsigned 32-bit integers, and that of the bytes that decoding them gives."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab or vocabulary())
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def digests(values: Iterator) -> pa.Array:
        return pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())

    def work(texts: pa.Array) -> list[pa.Array]:
        lists = shared.value.encode(texts)
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
        back = shared.value.decode(lists)
        return [
            pa.array(np.diff(ends), pa.int64()),
            digests(values[a:z].data for a, z in zip(ends[:-1], ends[1:], strict=True)),
            digests(back.to_pylist()),
        ]

    return _mapped(docs, [id_col], F.col(text_col).alias("_to_encode"), added, work)
