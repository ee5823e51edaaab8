"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text becomes words that begin with the space mark, and a word becomes segments: it is cut between
two characters that stand side by side in no piece, where no path can cross. The distinct new segments
of many texts are sorted, which lays them out as a trie in depth-first order: what a segment shares
with its predecessor keeps its forward states, and only the rest of it is computed.

The forward state of a prefix is its best path. In a unigram model paths are weighed by the sum of
their pieces' scores. In a BPE model (as shipped in /opt/tokenizers) sums of scores do not give what
merging gives, so a path's weight is whether each two neighbouring pieces could be left unmerged
side by side: merging a piece pair's own text must give back that pair. Exactly one path of each
prefix passes, and it is the result of merging.

Ids travel as packed 32-bit numbers, and decoding is one lookup and one join in Arrow.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.memory import in_small_batches, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Words and segments of a generation that a worker remembers, and neighbour tests.
MEMO_WORDS, MEMO_PAIRS = 100_000, 250_000
#: Characters or ids handled at a time; a longer text is handled alone.
SPAN = 1 << 21
NORMAL, UNKNOWN_TYPE, BYTE = 1, 2, 6
UNIGRAM, BPE = 1, 2


class Memory:
    """Results by word, in two generations: of more than `most`, those go that were not asked for lately."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, words: Iterable[str]) -> list[str]:
        """The words without a result; the results of all others are in `young` afterwards."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old, out = self.young, self.old, []
        for w in words:
            if w not in young:
                got = old.get(w)
                if got is None:
                    out.append(w)
                else:
                    young[w] = got
        return out


class Pieces:
    """A model's pieces. `model` is the content of a .model file, or (pieces, kind) for tests, with
    pieces a list of (text, score, type)."""

    def __init__(self, model: bytes | tuple[list[tuple[str, float, int]], int]):
        if isinstance(model, bytes):
            from sentencepiece import sentencepiece_model_pb2

            proto = sentencepiece_model_pb2.ModelProto()
            proto.ParseFromString(model)
            if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces:
                raise ValueError("only models with the identity normaliser are supported")
            pieces, self.kind = [(p.piece, p.score, p.type) for p in proto.pieces], proto.trainer_spec.model_type
            self.prefix = proto.normalizer_spec.add_dummy_prefix
        else:
            (pieces, self.kind), self.prefix = model, True
        self.text = [p[0] for p in pieces]
        self.type = [p[2] for p in pieces]
        self.id = {t: i for i, (t, _, k) in enumerate(pieces) if k == NORMAL}
        self.score = [p[1] for p in pieces]
        self.bytes = {int(t[3:5], 16): i for i, (t, _, k) in enumerate(pieces) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN_TYPE), 0)
        self.longest = max(map(len, self.id), default=1)
        self.least = min((self.score[i] for i in self.id.values()), default=0.0) - 10
        # when merging forms a piece, counted from the first; characters are there from the start
        self.rank = {t: r for r, t in enumerate(sorted((t for t in self.id if len(t) > 1), key=lambda t: (-self.score[self.id[t]], self.id[t])))}
        self.halves: dict[str, tuple[str, str] | None] = {}
        # pieces of two or more characters as a trie from their ends; a node's piece is under ""
        self.tails: dict = {}
        for t in self.rank:
            node = self.tails
            for c in reversed(t):
                node = node.setdefault(c, {})
            node[""] = self.id[t]
        # characters that have neighbours in a piece, and which two stand side by side in one
        joined = {t[i : i + 2] for t in self.id for i in range(len(t) - 1)}
        letters = sorted(set("".join(joined)))
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.joins = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for a, b in joined:
            self.joins[self.letter[ord(a)], self.letter[ord(b)]] = True
        self.pairs: dict[int, bool] = {}
        self.words, self.segments = Memory(MEMO_WORDS), Memory(MEMO_WORDS)
        self.packed = [np.int32(i).tobytes() for i in range(len(pieces))]
        self.raw = pa.array([self._raw(i) for i in range(len(pieces))], pa.binary())
        # pieces that hold the mark after other characters would tie words together
        self.whole = any(MARK in t.lstrip(MARK) for t in self.id)

    def _raw(self, i: int) -> bytes:
        if i in self.byte_of:
            return bytes([self.byte_of[i]])
        text = self.text[i] if self.type[i] in (NORMAL, 4) else " ⁇ " if self.type[i] == UNKNOWN_TYPE else ""
        return text.encode("utf-8", "surrogatepass")

    def merged(self, text: str, trace: list[tuple[str, str]] | None = None) -> list[str]:
        """Pieces of a text by merging: the best-scored pair first, the leftmost of equals."""
        parts: list[str | None] = list(text)
        after = [*range(1, len(parts)), None]
        ahead = [None, *range(len(parts) - 1)]
        queue: list[tuple[float, int, str]] = []

        def offer(i: int | None) -> None:
            if i is not None and after[i] is not None:
                both = parts[i] + parts[after[i]]
                p = self.id.get(both)
                if p is not None:
                    heappush(queue, (-self.score[p], i, both))

        for i in range(len(parts)):
            offer(i)
        while queue:
            _, i, both = heappop(queue)
            j = after[i]
            if parts[i] is None or j is None or parts[i] + parts[j] != both:
                continue
            if trace is not None:
                trace.append((parts[i], parts[j]))
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[i] is not None:
                ahead[after[i]] = i
            offer(ahead[i])
            offer(i)
        return [x for x in parts if x is not None]

    def split(self, text: str) -> tuple[str, str] | None:
        """The two parts that merging joins last to form a piece; None if it never forms it."""
        if text not in self.halves:
            trace: list[tuple[str, str]] = []
            self.halves[text] = trace[-1] if self.merged(text, trace) == [text] and trace else None
        return self.halves[text]

    def neighbours(self, a: str, b: str) -> bool:
        """Whether merging forms a and b and leaves them side by side; a may be empty.

        Goes back in time from the two pieces: the one formed later is taken apart, and the parts on
        either side of the border must not have been a pair that merging prefers to what it did."""
        if (len(b) > 1 and self.split(b) is None) or (len(a) > 1 and self.split(a) is None):
            return False
        if not a:
            return True
        rank, border = self.rank, len(self.rank)
        while True:
            both = rank.get(a + b)
            if both is not None and both < border:
                return False
            left, right = rank.get(a, -1) if len(a) > 1 else -1, rank.get(b, -1) if len(b) > 1 else -1
            if left < 0 and right < 0:
                return True
            if left > right:
                border, a = left, self.split(a)[1]
            else:  # of equal merges the left one comes first, and across the border is further left
                border, b = right + 1, self.split(b)[0]

    def ids_of(self, parts: list[str]) -> bytes:
        out = []
        for p in parts:
            i = self.id.get(p)
            if i is not None:
                out.append(self.packed[i])
            elif self.bytes:
                out += [self.packed[self.bytes[b]] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.packed[self.unknown])
        return b"".join(out)

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """(word, packed ids) of sorted distinct words, each beginning where its predecessor left off."""
        step = self._step_bpe if self.kind == BPE else self._step_unigram
        # forward state of each prefix: (weight, last piece's id or -1, where that begins)
        states: list[tuple[float, int, int]] = [(0.0, -1, 0)]
        before = ""
        for word in words:
            shared = len(commonprefix((before, word)))
            del states[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                states.append(step(word, end, states))
            parts, end = [], len(word)
            while end:
                _, piece, start = states[end]
                parts.append(self.packed[piece] if piece >= 0 else self.ids_of([word[start:end]]))
                end = start
            yield word, b"".join(reversed(parts))
            before = word

    def _step_bpe(self, word: str, end: int, states: list[tuple[float, int, int]]) -> tuple[float, int, int]:
        node, at, found = self.tails.get(word[end - 1]), end - 1, []
        while node is not None:
            piece = node.get("")
            if piece is not None:
                found.append((piece, at))
            if not at:
                break
            at -= 1
            node = node.get(word[at])
        pairs = self.pairs
        for piece, start in reversed(found):
            last = states[start][1]
            key = (last + 1) << 32 | piece
            good = pairs.get(key)
            if good is None:
                if len(pairs) >= MEMO_PAIRS:
                    pairs.clear()
                before = self.text[last] if last >= 0 else word[start - 1 : start]
                good = pairs[key] = self.neighbours(before, self.text[piece])
            if good:
                return 0.0, piece, start
        # one path passes: if no longer piece ends here, a character does
        return 0.0, self.id.get(word[end - 1], -1), end - 1

    def _step_unigram(self, word: str, end: int, states: list[tuple[float, int, int]]) -> tuple[float, int, int]:
        best = (states[end - 1][0] + self.least, self.id.get(word[end - 1], -1), end - 1)
        for start in range(max(0, end - self.longest), end):
            known = self.id.get(word[start:end])
            if known is not None and states[start][0] + self.score[known] > best[0]:
                best = (states[start][0] + self.score[known], known, start)
        return best

    def cut(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The segments of all words in turn, and how many each has; words are not empty."""
        text = "".join(words)
        letter = self.letter[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        begins = np.ones(len(letter), bool)
        begins[1:] = ~self.joins[letter[:-1], letter[1:]]
        starts = np.cumsum([0, *map(len, words)])
        begins[starts[:-1]] = True
        at = np.flatnonzero(begins).tolist()
        counts = np.diff(np.searchsorted(at, starts))
        return [text[a:z] for a, z in zip(at, [*at[1:], len(text)], strict=True)], counts

    def _learn(self, words: list[str]) -> Iterator[bytes]:
        """Packed ids of each word; words are not empty and hold marks at their beginning only."""
        segments, counts = self.cut(words)
        fresh = sorted(self.segments.missing(dict.fromkeys(segments)))
        self.segments.young.update(self.encode_words(fresh))
        known, at = self.segments.young, 0
        for n in counts.tolist():
            yield known[segments[at]] if n == 1 else b"".join(map(known.__getitem__, segments[at : at + n]))
            at += n

    def packed_ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as packed 32-bit numbers; null and empty texts have none."""
        split = [self._split(t) if t else [] for t in texts]
        known, blanks = self.words, {}
        fresh = known.missing(set().union(*split))
        if self.kind == BPE and not self.whole:
            blanks = {w: w.lstrip(MARK) for w in fresh if w.startswith(MARK)}
            fresh = [w for w in fresh if w not in blanks]
            if blanks:
                have = known.young
                fresh = list({*fresh, *(x for core in blanks.values() if core for x in (core, core + MARK) if x not in have)})
        known.young.update(zip(fresh, self._learn([self._marked(w) for w in fresh]), strict=True) if fresh else ())
        for w, core in blanks.items():
            known.young[w] = self._with_blanks(core, len(w) - len(core) + 1)
        young = known.young
        return [b"".join(map(young.__getitem__, words)) for words in split]

    def _marked(self, word: str) -> str:
        """The text of a word as _split names it: without one mark before it, or, where there is none, with one behind."""
        return word[:-1] if word.endswith(MARK) and (self.whole or not word.startswith(MARK)) else MARK + word

    def _split(self, text: str) -> list[str]:
        if self.prefix and not self.whole and "  " not in text and MARK not in text and text[0] != " ":
            return text.split(" ")
        marked = (MARK if self.prefix else "") + text.replace(" ", MARK)
        if self.whole:
            return [marked + MARK]
        return [w[1:] if w.startswith(MARK) else w + MARK for w in WORD.findall(marked)]

    def _with_blanks(self, core: str, n: int) -> bytes:
        """A word after n > 1 marks: they merge last, and only those that the word leaves over."""
        if not core:
            return self.ids_of(self.merged(MARK * n))
        taken = self.words.young[core]
        if taken.startswith(self.ids_of([MARK])):
            return self.ids_of(self.merged(MARK * n)) + self.words.young[core + MARK]
        return self.ids_of(self.merged(MARK * (n - 1))) + taken

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of whole texts; null and empty texts have none."""
        return [np.frombuffer(x, np.int32).tolist() for x in self.packed_ids(texts)]

    def texts_of(self, lists: pa.ListArray) -> list[str | None]:
        """Texts of lists of ids: byte pieces are put together, marks become spaces, the first mark goes."""
        joined = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, self.raw.take(lists.values), mask=lists.is_null()) if len(lists) else pa.array([], pa.list_(pa.binary())), b"")
        out = []
        for raw in joined.to_pylist():
            text = None if raw is None else raw.decode("utf-8", "replace")
            if text and self.prefix and text.startswith(MARK):
                text = text[1:]
            out.append(text and text.replace(MARK, " "))
        return out

    def decode(self, ids: list[int]) -> str:
        return self.texts_of(pa.array([ids], pa.list_(pa.int32())))[0]


def id_lists(packed: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))


_loaded: dict[bytes, Pieces] = {}


def _pieces(model: bytes) -> Pieces:
    """One Pieces a worker process, so what it remembers serves all its tasks."""
    if model not in _loaded:
        _loaded.clear()
        _loaded[model] = Pieces(model)
    return _loaded[model]


def _spans(sizes: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs that hold SPAN in all, or one row that holds more."""
    total, first = 0, 0
    for i, n in enumerate(sizes.to_pylist()):
        if i > first and total + (n or 0) > SPAN:
            yield first, i - first
            total, first = 0, i
        total += n or 0
    if first < len(sizes):
        yield first, len(sizes) - first


def _mapped(df: DataFrame, columns: list[str], value, added: list[T.StructField], work) -> DataFrame:
    schema = T.StructType([*(df.schema[c] for c in columns), *added])
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.list_value_length(b.column(n)) if pa.types.is_list(b.schema.field(n).type) else pc.binary_length(b.column(n))
            for at, rows in _spans(sizes):
                part = b.slice(at, rows)
                arrays = work(part.column(n))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *arrays], names=[f.name for f in schema])

    return in_small_batches(df).select(*columns, value).mapInArrow(tidy(run), schema)


def _free(name: str, columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def encode(docs: DataFrame, model_path: str = MODEL, text_col: str = "text", keep: list[str] | None = None, out_col: str = "piece_ids") -> DataFrame:
    """`keep` columns (None: all) and `out_col`, an array of ids, for every row and whole text.

    Null and empty texts give an empty array. A column that is already called `out_col` keeps its
    name, and the new one gets an underscore. The model is read once, on the driver."""
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # under 1 MB
    columns = list(docs.columns if keep is None else keep)
    field = T.StructField(_free(out_col, columns), T.ArrayType(T.IntegerType(), False))
    work = lambda texts: [id_lists(_pieces(shared.value).packed_ids(texts.to_pylist()))]
    return _mapped(docs, columns, F.col(text_col).alias("_to_encode"), [field], work)


def decode(encoded: DataFrame, model_path: str = MODEL, ids_col: str = "piece_ids", keep: list[str] | None = None, out_col: str = "decoded") -> DataFrame:
    """`keep` columns (None: all) and `out_col`, the text of the ids; null ids give null."""
    with open(model_path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())
    columns = list(encoded.columns if keep is None else keep)
    field = T.StructField(_free(out_col, columns), T.StringType())
    work = lambda lists: [pa.array(_pieces(shared.value).texts_of(lists), pa.string())]
    return _mapped(encoded, columns, F.col(ids_col).cast("array<int>").alias("_to_decode"), [field], work)


def round_trip(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces, ids_sha256, decoded_sha256, same) of every row: the digest of the ids, that of
    the text they decode to, and whether that is the text itself (null counts as empty; a text that
    holds the space mark itself comes back with a space)."""
    import hashlib

    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    added = [
        T.StructField("n_pieces", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("same", T.BooleanType()),
    ]

    def work(column: pa.Array) -> list[pa.Array]:
        pieces, texts = _pieces(shared.value), column.to_pylist()
        ids = pieces.packed_ids(texts)
        back = pieces.texts_of(id_lists(ids))
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return [
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([sha(x) for x in ids], pa.string()),
            pa.array([sha(t.encode("utf-8", "surrogatepass")) for t in back], pa.string()),
            pa.array([t == (o or "") for t, o in zip(back, texts, strict=True)], pa.bool_()),
        ]

    return _mapped(docs, [id_col], F.col(text_col).alias("_to_encode"), added, work)
