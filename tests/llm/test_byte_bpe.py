import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken

from webloom.llm import byte_bpe

CASES = [
    None, "", " ", "  ", "a", " a", "a ", "a  ", "  a  b   c ", "a\n b", "a \n b\n\n  c", "don't I'LL we've 's 't", "x" * 3000, "ab" * 2000, "1234567 12 3",
    "naïve café ñandú", "日本語 テキスト　全角", "a b   c", "  x  y", "🙂🙃 🙂", "\x1c\x1d a \x1f", "\t\tx\r\n", " !?!? -- ...", "é ́", "a 　b", "\x00 \x00", "<|endoftext|>", "tail \t", " " * 50 + "x", "​ ​z",
]


@pytest.fixture(scope="module")
def vocab():
    return byte_bpe.vocabulary()


@pytest.fixture(scope="module")
def library(vocab):
    return tiktoken.Encoding("own", pat_str=vocab.pattern.pattern, mergeable_ranks=vocab.rank, special_tokens={})


def encoded(vocab, texts):
    return vocab.encode(pa.array(texts, pa.string())).to_pylist()


def test_equals_library_on_edge_cases(vocab, library):
    want = [library.encode_ordinary(t or "") for t in CASES]
    assert encoded(vocab, CASES) == want
    assert [encoded(vocab, [t])[0] for t in CASES] == want
    part = vocab.encode(pa.array(CASES, pa.string()).slice(3, 9))
    assert part.to_pylist() == want[3:12]
    assert vocab.decode(vocab.encode(pa.array(CASES, pa.string()))).to_pylist() == [(t or "").encode() for t in CASES]
    assert encoded(vocab, []) == [] and encoded(vocab, [None, ""]) == [[], []]


def test_equals_library_on_random_texts(vocab, library):
    rng = random.Random(11)
    alphabet = [" ", " ", " ", "\n", "\t", " ", "　", "\x85", "'", "s", "ing", "the", "é", "日", "🙂", "7", "42", ".", "--", "Q", "xyzzy", "́", "\x1c", " "]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(3000)]
    assert encoded(vocab, texts) == [library.encode_ordinary(t) for t in texts]


def test_equals_library_on_every_white_space_beside_a_space(vocab, library):
    odd = [chr(c) for c in range(0x3100) if chr(c).isspace() or c < 0x30]
    texts = [f"{a}{b}{c}x" for a in odd for b in (" ", "  ", "") for c in (*odd[:12], "y")] + [f"x {c}" for c in odd]
    assert encoded(vocab, texts) == [library.encode_ordinary(t) for t in texts]


def test_equals_library_on_documents(vocab, library):
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    assert encoded(vocab, texts) == [library.encode_ordinary(t or "") for t in texts]


def test_perfect_hash_has_each_slot_once(vocab):
    keys = list(vocab.rank)
    slots = vocab.hash.slots(byte_bpe.hashes(keys))
    assert np.array_equal(np.sort(slots), np.arange(len(keys)))
    other = ["no such token at all", "zzzzqqqq", "一二"]
    assert vocab.whole(pa.array(other), other).tolist() == [-1, -1, -1]
    for n in (1, 2, 3, 5, 100):
        small = [b"%d" % i for i in range(n)]
        assert sorted(byte_bpe.PerfectHash(small).slots(byte_bpe.hashes(small)).tolist()) == list(range(n))
    with pytest.raises(ValueError):
        byte_bpe.PerfectHash([b"a", b"a"])


def test_long_words_take_time_in_proportion(vocab):
    took = []
    for n in (20_000, 160_000):
        began = time.perf_counter()
        vocab.merged(b"ab" * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * max(took[0], 0.01)


def test_dataframe_round_trip(spark, vocab, library):
    rows = [(i, t, "x", 3) for i, t in enumerate(CASES)] + [(None, "null id", "x", 3), (1, "repeated id", "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string, n_tokens int")
    out = byte_bpe.encode(docs, vocab)
    assert out.columns == [*docs.columns, "token_ids_"]
    assert sorted((r.token_ids_ for r in out.collect())) == sorted(library.encode_ordinary(t or "") for _, t, _, _ in rows)
    back = byte_bpe.decode(out.selectExpr("text", "token_ids_ as ids"), vocab, ids_col="ids").collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert byte_bpe.decode(spark.createDataFrame([(None,), ([],)], "token_ids array<int>"), vocab).collect()[0].decoded is None
    got = sorted((tuple(r) for r in byte_bpe.round_trip(docs, vocab).collect()), key=str)
    want = []
    for i, t, _, _ in rows:
        ids = library.encode_ordinary(t or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((i, len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha((t or "").encode())))
    assert got == sorted(want, key=str)
    assert byte_bpe.round_trip(docs.limit(0), vocab).collect() == [] and byte_bpe.encode(docs.limit(0), vocab).collect() == []
