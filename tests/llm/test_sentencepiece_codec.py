import itertools
import random

import pytest
import sentencepiece

from webloom.llm import sentencepiece_codec as codec

CASES = [None, "", " ", "   ", "a", "  hello   world \n x\t\ty", "é é ﬁ", "▁a ▁▁b", "a　b", "\x00a", "a\r\nb", "门門 the the", "x" * 5000, "trailing  ", "    ", "😀😀 ok  😀", "a  門 b   門", " " * 37 + "z" + " " * 19]


@pytest.fixture(scope="module")
def pieces():
    with open(codec.MODEL, "rb") as f:
        return codec.Pieces(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=codec.MODEL)


def test_equals_library_on_edge_cases(pieces, library):
    for text, ids in zip(CASES, pieces.encode(CASES), strict=True):
        assert ids == library.encode(text or ""), repr(text)
        assert pieces.decode(ids) == (text or "").replace("▁", " ")


def test_equals_library_on_random_words(pieces, library):
    rng = random.Random(3)
    stems = ["tion", "the", "ing", "eau", "schch", "é", "ñ", "ber", "x", "Q", "7", "##", "  ", "\n", "門", "и", "ab", "s", "e", "r", "in", "n", "g"]
    texts = [" ".join("".join(rng.choices(stems, k=rng.randint(1, 7))) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    for text, ids in zip(texts, pieces.encode(texts), strict=True):
        assert ids == library.encode(text), repr(text)


def test_equals_library_on_documents(pieces, library):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    assert pieces.encode(texts) == library.encode([t or "" for t in texts])


def test_forgetting_changes_nothing(pieces, library, monkeypatch):
    """Generations of a few words and neighbour tests only: every text makes the worker forget."""
    monkeypatch.setattr(codec, "MEMO_PAIRS", 20)
    small = codec.Pieces(open(codec.MODEL, "rb").read())
    small.words.most = small.segments.most = 3
    texts = ["the cat, the dog. the\ncat  sat", "sat the 门cat dog, dog", "the  the cat,", None, "dog.the"] * 3
    for text in texts:
        assert small.encode([text]) == [library.encode(text or "")], repr(text)


def test_cuts_are_where_no_piece_reaches_across(pieces):
    words = ["▁don't!!", "▁x\ny", "▁门the", "▁"]
    segments, counts = pieces.cut(words)
    at = 0
    for word, n in zip(words, counts, strict=True):
        mine = segments[at : at + n]
        at += n
        assert "".join(mine) == word
        assert not any(a[-1] + b[0] in piece for a, b in itertools.pairwise(mine) for piece in pieces.id)
    assert at == len(segments)


def test_unigram_paths_against_all_segmentations():
    vocabulary = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.1, 1), ("▁a", -4.0, 1), ("ba", -4.2, 1), ("bab", -5.0, 1)]
    p = codec.Pieces((vocabulary, codec.UNIGRAM))
    for n in range(1, 6):
        for letters in itertools.product("ab", repeat=n):
            word = "▁" + "".join(letters)
            best = max(
                (sum(p.score[p.id[x]] for x in parts), parts)
                for cuts in itertools.product((0, 1), repeat=len(word) - 1)
                for parts in [[word[i:j] for i, j in itertools.pairwise([0, *(k + 1 for k, c in enumerate(cuts) if c), len(word)])]]
                if all(x in p.id for x in parts)
            )
            (got,) = p.encode(["".join(letters)])
            assert sum(p.score[i] for i in got) == pytest.approx(best[0])


def test_dataframe_round_trip(spark):
    rows = [(i, t, "x") for i, t in enumerate(CASES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece_ids string")
    out = codec.encode(docs)
    assert out.columns == ["doc_id", "text", "piece_ids", "piece_ids_"]
    back = {r.doc_id: r.decoded for r in codec.decode(out, ids_col="piece_ids_").collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t, _ in rows}
    same = {r.doc_id: r.same for r in codec.round_trip(docs).collect()}
    assert [i for i, ok in same.items() if not ok] == [CASES.index("▁a ▁▁b")]
    assert codec.round_trip(docs.limit(0)).collect() == []
