"""Tiles against a plain greedy string tiling, and planted passages."""

import random
import time

import numpy as np
import pyarrow as pa
from trailmark.llm import decontaminate


def plain(item, text, least):
    """Greedy string tiling by looking at all places in each round: the covered length."""
    mi, mt, total = [False] * len(item), [False] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and not mi[i + k] and not mt[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return total
        for x in range(k):
            mi[i + x] = mt[j + x] = True
        total += k


def test_tiles_cover_as_the_plain_method():
    rng = random.Random(5)
    for _ in range(150):
        letters = rng.choice([3, 6, 30])
        item = [rng.randrange(letters) for _ in range(rng.randint(5, 40))]
        text = [rng.randrange(letters) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            a, n = rng.randrange(len(item)), rng.randint(3, 15)
            at = rng.randint(0, len(text))
            text[at:at] = item[a : a + n]
        got = decontaminate.tiles(np.array(item, np.uint64), np.array(text, np.uint64), 5)
        for i, j, k in got:
            assert k >= 5 and item[i : i + k] == text[j : j + k]
        assert len({i + x for i, _, k in got for x in range(k)}) == sum(k for *_, k in got) == len({j + x for _, j, k in got for x in range(k)})
        assert sum(k for *_, k in got) >= 0.9 * plain(item, text, 5)


def test_all_pairs_by_brute_force(spark):
    """Every pair of a document and an item, small alphabets, repeated words, short items; the plain method's pairs must be the same."""
    rng = random.Random(15)
    words = [f"w{i}" for i in range(12)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [text(rng.choice([1, 2, 3, 4, 5, 6, 9, 15, 30])) for _ in range(40)] + [["w1"] * 12, ["w1", "w2"] * 6]
    docs = []
    for _ in range(120):
        doc = text(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            item = rng.choice(items)
            cut = rng.randint(0, len(item))
            at = rng.randint(0, len(doc))
            doc[at:at] = item[cut:] + text(rng.randint(0, 2)) + item[:cut] if rng.random() < 0.5 else item[: max(1, cut)]
        docs.append(doc)
    docs += [["w1"] * 100, ["w1", "w2"] * 40, []]
    want = set()
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            least = min(5, len(item))
            if plain([int(w[1:]) for w in item], [int(w[1:]) for w in doc], least) >= (0.5 * len(item) if len(item) >= 5 else len(item)):
                want.add((d, i))
    frame = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    for size in (1 << 20, 200):
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark, frame, bench, block_chars=size).collect()} == want
    assert {r.doc_id for r in decontaminate.without_leaks(frame, bench, block_chars=400).collect()} == set(range(len(docs))) - {d for d, _ in want}


def test_hot_words_are_fast():
    """Equal windows without end: tiling and seeds of many items stay cheap."""
    began = time.perf_counter()
    same = decontaminate.tiles(np.full(1200, 7, np.uint64), np.full(12_000, 7, np.uint64))
    period = decontaminate.tiles(np.array([1, 2, 3] * 400, np.uint64), np.array([1, 2, 3] * 4000 + [9], np.uint64))
    assert sum(n for *_, n in same) == sum(n for *_, n in period) == 1200
    boiler = "choose the best of the following answers to this question "
    items = decontaminate.Items([str(i) for i in range(5000)], [boiler + " ".join(f"x{i}y{j}" for j in range(12)) for i in range(5000)])
    built = time.perf_counter()
    words, first = decontaminate._words(pa.array([boiler * 200, boiler + " ".join(f"x7y{j}" for j in range(12))]))
    assert [(t, some) for t, _, some in items.hits(words, first) if some] == [(1, [7])]
    assert time.perf_counter() - built < 1 and built - began < 4


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("a", "one two three four five six")], "doc_id string, text string")
    bench = spark.createDataFrame([("i", "One two, three four five six"), ("j", "One two, three four five six")], "item_id string, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(spark, docs, bench).collect()) == [("a", "i"), ("a", "j")]


def test_planted_and_clean(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdéfgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.randint(15, 50)))) for i in range(30)]
    docs = []
    for d in range(200):
        words = [word() for _ in range(rng.randint(0, 300))]
        if d % 4 == 0:
            passage = items[d % 30][1].split()
            if d % 8 == 0:  # in another order, in other case and punctuation
                h = len(passage) // 2
                passage = [w.upper() + "," for w in passage[h:]] + [word()] * 3 + passage[:h]
            at = rng.randint(0, len(words))
            words[at:at] = passage
        elif d % 4 == 1:  # too little of an item
            words += items[d % 30][1].split()[:6]
        docs.append((d, " ".join(words)))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 300):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark, frame, bench, block_chars=size).collect()}
        assert got == {(d, d % 30) for d in range(0, 200, 4)}
    left = decontaminate.without_leaks(frame, bench, block_chars=300)
    assert {r.doc_id for r in left.collect()} == {d for d in range(200) if d % 4}


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "the same text of some words that comes twice in here"), (2, None), (3, ""), (4, "word"), (None, "a text without any id at all here now")], "item_id long, text string")
    got = decontaminate.contaminated(spark, odd, bench)
    # Item 4 is the single word `word`, which documents 4 and 7 hold.
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in got.collect()) == [(0, 0), (4, 4), (5, 1), (5, 1), (6, 1), (7, 4)]
    assert decontaminate.contaminated(spark, none, bench).count() == 0
    assert decontaminate.contaminated(spark, odd, bench.limit(0)).count() == 0
    assert sorted(r.doc_id for r in decontaminate.without_leaks(odd, bench).collect()) == [1, 2, 3, 8]
