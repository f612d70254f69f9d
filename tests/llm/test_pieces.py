"""Piece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from trailmark.llm import pieces
from trailmark.session import table

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a", "b", "e", "th", "in", " ", "  ", "▁", ".", ",", "\n", "\t", "0", "1", "é", "日", "本", "\U0001f600", "\x00", "<s>", "<0x0A>", "İ", "//", "###", "==", "http", "　", "ﬁ", "на", "'s", "�"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def encode(text):
    return np.frombuffer(pieces.model(PATH).encode(text), np.int32).tolist()


def decode(*rows):
    return pieces.model(PATH).decode(np.array([i for r in rows for i in r], np.int64), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)).to_pylist()


def test_random_texts(library):
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choices(ODD, k=rng.randint(0, 40)))
        ids = library.encode(text)
        assert encode(text) == ids and decode([*ids, 2]) == [library.decode([*ids, 2])], repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert encode(text) == library.encode(text)


def test_decode_any_ids(library):
    """Bytes that are no UTF-8, control and unknown ids, alone and beside sound rows."""
    rng = random.Random(2)
    rows = [[rng.choice([0, 1, 2, 3, 100, 131, 200, 230, 239, rng.randrange(32000)]) for _ in range(rng.randint(0, 8))] for _ in range(2000)]
    assert decode(*rows) == [library.decode(r) for r in rows]
    assert decode(*rows[:3], []) == [library.decode(r) for r in [*rows[:3], []]]


def test_long_chunks(library, monkeypatch):
    """Texts without a place to cut, and texts longer than a segment."""
    monkeypatch.setattr(pieces, "SEGMENT", 1000)
    for text in ("ab" * 50_000, " " * 50_000, "日本語" * 20_000, "word, and more. " * 5_000, "x" + " " * 3000 + "y"):
        assert encode(text) == library.encode(text)


def test_bounded_caches(library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_BYTES", 1000)
    monkeypatch.setattr(pieces, "CACHE_PAIRS", 10)
    m = pieces.model(PATH)
    for text in ("some words here and there", "others, of more letters, elsewhere", "some words here and there"):
        assert encode(text) == library.encode(text) and len(m.chunks) < 100


def test_chunks_never_cross(library):
    """Cutting at the pattern's places changes nothing: each vocabulary entry is one chunk or can't be crossed."""
    m = pieces.model(PATH)
    encode("x")
    assert all(m.cut.findall(p) == [p] for p in list(m.ids)[::7])


def test_query(spark, library, odd, none):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = []
    for r in docs.collect():
        ids = [*library.encode(r.text or ""), 2]
        want.append((str(r.doc_id), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(docs, PATH).collect()) == sorted(want)
    assert pieces.digests(none, PATH).count() == 0


def test_columns(spark, odd):
    """The operator's own columns replace clashing ones, others are carried; null ids decode to nothing."""
    made = pieces.encode(odd.withColumnRenamed("label", "ids"), PATH, end=None)
    assert made.columns == ["doc_id", "lang", "source", "n_chars", "kept", "ids"] and made.filter("doc_id = 7").first().ids == [1707]
    back = pieces.decode(made.withColumnRenamed("kept", "decoded"), PATH)
    assert back.columns[-1] == "decoded" and back.filter("doc_id = 7").first().decoded == "word"
    rows = spark.createDataFrame([(1, None), (2, [2, None, 1707]), (3, [])], "n int, ids array<int>")
    assert [r.decoded for r in pieces.decode(rows, PATH).orderBy("n").collect()] == ["", "word", ""]
    with pytest.raises(Exception, match="vocabulary"):
        pieces.decode(spark.createDataFrame([([99_999],)], "ids array<int>"), PATH).collect()
