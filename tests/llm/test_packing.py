"""Packing: a round trip of all ids, full windows, the mixture."""

import itertools
import json
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer
from trailmark.llm import packing
from trailmark.session import table

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(pieces, docs, window=4096):
    tok = Tokenizer.from_file(PATH)
    ids = {d: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in docs}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append((p.start, p.length))
        by_seq[p.sequence_id].append((p.offset, p.length))
        assert p.doc_tokens == len(ids[p.doc_id]) and zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32
    for d, x in ids.items():
        at = 0
        for start, n in sorted(by_doc[d]):
            assert start == at and n > 0
            at += n
        assert at == len(x)
    total = sum(map(len, ids.values()))
    assert sorted(by_seq) == list(range(-(-total // window)))
    for k, parts in by_seq.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == min(window, total - k * window)


def test_round_trip(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    pieces = packing.pack(spark, docs, PATH).collect()
    check(pieces, rows)
    compare(pieces, {r.doc_id: r.source for r in docs.collect()}, packing.PACKET, 4096)
    assert len(pieces) < 2.5 * len(rows)
    total = sum(p.length for p in pieces)
    tokens, served = defaultdict(int), defaultdict(int)
    for p in pieces:
        tokens[p.queue] += p.length
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):  # at any place each queue has had its share, to within what deficits are
        served[p.queue] += p.length
        done = p.sequence_id * 4096 + p.offset + p.length
        spread = packing.PACKET * (1 + len(tokens) * tokens[p.queue] / total) + 4096 * tokens[p.queue] / total
        assert abs(served[p.queue] - done * tokens[p.queue] / total) <= spread


def simulated(queues, quanta, packet):
    """Deficit round-robin by a loop over rounds: (queue, document, start, length) in the order of service."""
    heads = {q: [(d, a, min(packet, n - a)) for d, n in docs for a in range(0, n, packet)] for q, docs in queues.items()}
    deficit, out = dict.fromkeys(queues, Fraction(0)), []
    while any(heads.values()):
        for q in sorted(queues):
            deficit[q] += quanta[q]
            while heads[q] and heads[q][0][2] <= deficit[q]:
                deficit[q] -= heads[q][0][2]
                out.append((q, *heads[q].pop(0)))
    return out


def compare(pieces, source, packet, window, weights=None):
    """The pieces against the simulation, the documents of a queue in the order in which they came."""
    queues, place = defaultdict(list), {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        for x in range(p.length):
            place[p.doc_id, p.start + x] = p.sequence_id * window + p.offset + x
        if p.start == 0:
            queues[source[p.doc_id] or ""].append((p.doc_id, p.doc_tokens))
    tokens = {q: sum(n for _, n in docs) for q, docs in queues.items()}
    share = {q: Fraction(weights[q]) if weights else Fraction(tokens[q]) for q in queues}
    quanta = {q: window * s / sum(share.values()) for q, s in share.items()}
    at = 0
    for _, d, start, n in simulated(queues, quanta, packet):
        assert [place[d, start + x] for x in range(n)] == list(range(at, at + n))
        at += n
    assert at == len(place)


def test_weights(spark):
    rng = random.Random(3)
    rows = [(i, "one two three four five six seven eight nine ten " * rng.randint(0, 9), "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(spark, docs, PATH, window=64, target={"a": 3.0, "b": 1.0}, packet=16).collect()
    check(pieces, [r[:2] for r in rows], 64)
    compare(pieces, {r[0]: r[2] for r in rows}, 16, 64, {"a": 3, "b": 1})
    first = [p for p in pieces if p.sequence_id < 40]
    assert abs(sum(p.length for p in first if p.doc_id % 2 == 0) - 48 * 40) <= 32
    alone = packing.pack(spark, docs, PATH, window=64, target={"b": 2.0}).collect()
    check(alone, [r[:2] for r in rows], 64)
    place = lambda p: p.sequence_id * 64 + p.offset
    assert max(place(p) for p in alone if p.queue == "b") < min(place(p) for p in alone if p.queue == "a")  # sources without a weight come last


def test_levels_and_many_queues(spark, monkeypatch):
    """Prefix sums of many small blocks, and queues beyond the broadcast limit."""
    for name, value in (("SPAN", 2), ("ROUNDS", 3), ("BUCKET", 4), ("SMALL", 3)):
        monkeypatch.setattr(packing, name, value)
    rng = random.Random(8)
    rows = [(f"d{i}", "word " * int(rng.expovariate(0.02)), rng.choice(["hot", "hot", None, *"abcdefghij"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string")
    pieces = packing.pack(spark, docs, PATH, window=128, packet=50).collect()
    check(pieces, [r[:2] for r in rows], 128)
    compare(pieces, {r[0]: r[2] for r in rows}, 50, 128)


def test_cached_words_give_the_same_ids():
    tok = Tokenizer.from_file(PATH)
    mine = packing.CachedTokenizer(PATH)
    for t in ["", " ", "It's  GRÜN\n\n Zażółć é  x y", "a<|endoftext|>b <|startoftext|>", "\x1c\x1d sep\x85arated", "ΑΣ ΑΣ", "x" * 5000, "12 345 !!! 'll", "́ a ́"]:
        assert np.frombuffer(mine.ids([t])[0], mine.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_cached_words_on_random_strings():
    tok = Tokenizer.from_file(PATH)
    mine = packing.CachedTokenizer(PATH)
    rng = random.Random(4)
    letters = "ab AZ'st09 .,*-_|\n\té\u0301ÉΣσİK½²ⅧⅫ…“”·\u00a0\u200b\u2003中あ가🙂=\u0338<>{}[]"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for t, b in zip(texts, mine.ids(texts), strict=True):
        assert np.frombuffer(b, mine.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_plain_words_skip_the_normaliser(monkeypatch):
    """Words of ASCII letters are not encoded by the file's own steps, and have the same ids; a file with other steps has no short way."""
    tok = Tokenizer.from_file(PATH)
    mine = packing.CachedTokenizer(PATH)
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 25))) for _ in range(5000)] + ["x" * 3000]
    seen = []
    monkeypatch.setattr(mine, "tokenizer", type("Spy", (), {"encode": lambda self, t, **k: seen.append(t) or tok.encode(t, **k)})())
    texts = [" ".join(words), "Don't", *words]
    assert [np.frombuffer(b, mine.dtype).tolist() for b in mine.ids(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert " ".join(seen) == "Don't"
    file = json.loads(tok.to_str())
    assert packing._plain(file)[0] and packing._plain(file | {"normalizer": {"type": "NFKC"}})[0] is None and packing._plain(file | {"pre_tokenizer": None})[0] is None


def test_equal_words_are_one_object():
    """Copies of a word, in upper or lower case or before punctuation, are told apart from others on bytes: one entry for all."""
    tok = Tokenizer.from_file(PATH)
    mine = packing.CachedTokenizer(PATH)
    texts = ["Word word WORD, word.", "É é, É. (word", None, "", " \n"]
    to, data = mine.encode(pa.array(texts), b"\2\0")
    assert set(mine.cache) == {b"word", b",", b".", "É".encode(), "é".encode(), b"(word"}
    want = [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert np.frombuffer(data, mine.dtype).tolist() == sum(want, []) and to.tolist() == np.cumsum([0, *(2 * len(x) for x in want)]).tolist()


def test_letters_that_come_apart():
    """Letters that normalisation turns into a letter and a mark, capital letters before marks and apostrophes, added tokens in capital letters."""
    tok = Tokenizer.from_file(PATH)
    mine = packing.CachedTokenizer(PATH)
    texts = ["\u0958.", "a\u0958,b", "\ufb1d.", "İ.", "H\u0331 h\u0331", "IT'S It's it's", "<|EndOfText|> <|endoftext|>", "A<|ENDOFTEXT|>b", "x<|startoftext|>,y", "ΑΣ.Α Σ,", "🙂.a", ".é", "a|b.c"]
    for t in [*texts, " ".join(texts[:5])]:
        assert np.frombuffer(mine.ids([t])[0], mine.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids, t
    assert mine.ids(texts) == packing.CachedTokenizer(PATH, spanning=True).ids(texts)


def test_cuts_and_latin_letters():
    """All characters that a cut may follow, and all words of the short way's letters, against the file's own encoding."""
    tok = Tokenizer.from_file(PATH)
    mine = packing.CachedTokenizer(PATH)
    wholes = [chr(i) for i in np.flatnonzero(packing._wholes())]
    texts = [f"{c}. x{c},{c.upper()}-" for c in wholes] + [f"{c} a{c} {c}a {c}{d}" for c, d in itertools.pairwise(map(chr, range(0x41, 0x250))) if not c.isspace()]
    for t, b, e in zip(texts, mine.ids(texts), tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(b, mine.dtype).tolist() == e.ids, repr(t)


def test_generations_of_words(monkeypatch):
    """Words that come again stay, others go, and ids are the same."""
    tok = Tokenizer.from_file(PATH)
    monkeypatch.setattr(packing, "CACHE_BYTES", 2000)
    mine = packing.CachedTokenizer(PATH)
    learned = []
    monkeypatch.setattr(mine, "_learn", lambda words, real=mine._learn: learned.extend(words) or real(words))
    for i in range(200):
        t = f"again and again word{i}x other{i}y é{i}"
        assert np.frombuffer(mine.ids([t])[0], mine.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids
    assert learned.count(b"again") == 1 and len(mine.cache) + len(mine.old) < 40


def test_odd_rows(spark, odd, none):
    got = packing.pack(spark, odd, PATH).collect()
    assert sum(p.length for p in got if p.doc_id == 1) == 1 and sum(p.length for p in got if p.doc_id == 5) == 2 * next(p.doc_tokens for p in got if p.doc_id == 5)
    assert sum(p.length for p in got if p.doc_id is None) > 3
    assert packing.pack(spark, none, PATH).count() == 0
