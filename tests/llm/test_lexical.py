"""Ranked search against SQL and against scoring every document."""

import collections
import math
import random
import re

import numpy as np
from compare import difference
from trailmark.llm import lexical
from trailmark.session import table

WORDS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, top=10):
    words = lambda t: WORDS.findall((t or "").translate(LOWER))
    tf = [(i, collections.Counter(words(t))) for i, t in docs]
    tf = [(i, c, sum(c.values())) for i, c in tf if c]
    n, total = len(tf), sum(x[2] for x in tf)
    df = collections.Counter(w for _, c, _ in tf for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in tf:
            m = 25 + 75 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words(text) if c[w])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scores, key=lambda x: x[:3])[:top])]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(lexical.ranked(spark, table(spark, sf, "documents"), table(spark, sf, "benchmark")), lexical.oracle_sql(), sf) == ""


def test_blocks_and_ties(spark, monkeypatch):
    """Many small blocks of documents and of items, copies with equal scores, repeated ids and items, repeats of terms."""
    monkeypatch.setattr(lexical, "POSTINGS", 40)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)] + ["Éa", "1x"]
    docs = [(i, " ".join(rng.choices(words, [60 // (j + 1) + 1 for j in range(32)], k=rng.randint(0, 30)))) for i in range(200)]
    docs += [(200 + i, docs[5][1]) for i in range(40)] + [(7, "w1 w2"), (7, "w1 w2"), (None, "w3 w4 w5"), (None, "w3 w4 w5"), (500, None), (501, "..")]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(25)] + [(3, "w1 w1 W1 w2"), (4, "w1 w1 W1 w2"), (None, "w3"), (90, None), (91, "nowhere"), (92, "w3 w4 w5")]
    left, right = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    assert got(lexical.ranked(spark, left, right)) == want
    assert got(lexical.ranked(spark, left, right, block_chars=60)) == want
    assert got(lexical.ranked(spark, left, right, top=3)) == plain(docs, items, 3)
    text = got(lexical.ranked(spark, left.selectExpr("CAST(doc_id AS STRING) AS doc_id", "text"), right, top=300))
    assert sorted((i, s) for i, _, _, s in text if i == 3) == sorted((i, s) for i, _, _, s in plain(docs, items, 300) if i == 3)


def test_search_against_all_documents():
    """The interval search alone: scores of the hits are the best ones, for limits that are set before too."""
    rng = np.random.default_rng(5)
    for round_ in range(20):
        docs, terms = int(rng.integers(1, 120)), int(rng.integers(1, 9))
        held = rng.random((docs, terms)) < rng.random()
        impact = np.where(held, rng.integers(1, 6, (docs, terms)), 0)
        doc, term = np.nonzero(held)
        index = lexical.Index(doc, term, impact[doc, term].astype(np.int64), docs, terms)
        queries = object.__new__(lexical.Queries)
        queries.keys = ["a", "b", "c"]
        repeats = rng.integers(0, 3, (3, terms))
        queries.query, queries.term = np.nonzero(repeats)
        queries.repeats = repeats[queries.query, queries.term]
        q, d, s = lexical.search(index, queries, np.zeros(3, np.int64), np.zeros(3, np.int64), top=4)
        every = impact @ repeats.T
        for i in range(3):
            order = sorted((-every[x, i], x) for x in range(docs) if every[x, i] > 0)[:4]
            assert [(-b, a) for a, b in zip(d[q == i].tolist(), s[q == i].tolist(), strict=True)] == [(int(x), y) for x, y in order], round_


def test_few_intervals_are_scored(monkeypatch):
    """A good bound: with one rare term among common ones, nearly all intervals are dropped unsplit."""
    docs = 20_000
    doc = np.concatenate([np.arange(docs), np.array([17, 9_000])])
    term = np.concatenate([np.zeros(docs, np.int64), np.ones(2, np.int64)])
    impact = np.concatenate([np.full(docs, 3), np.array([500, 400])])
    index = lexical.Index(doc, term, impact, docs, 2)
    queries = object.__new__(lexical.Queries)
    queries.keys, queries.query, queries.term, queries.repeats = ["a"], np.zeros(2, np.int64), np.arange(2), np.ones(2, np.int64)
    asked = []
    maximum = lexical.Index.maximum
    monkeypatch.setattr(lexical.Index, "maximum", lambda self, a, b: asked.append(len(a)) or maximum(self, a, b))
    assert lexical.search(index, queries, np.zeros(1, np.int64), np.zeros(1, np.int64), 2)[1].tolist() == [17, 9_000]
    assert sum(asked) < 100


def test_odd(spark, odd, none):
    items = spark.createDataFrame([(1, "Word text", "x"), (2, "", None), (None, "some words", "y")], "item_id long, text string, doc_id string")
    assert got(lexical.ranked(spark, odd, items)) == plain([(r.doc_id, r.text) for r in odd.collect()], [(1, "Word text"), (2, ""), (None, "some words")])
    assert lexical.ranked(spark, none, items).count() == 0 and lexical.ranked(spark, odd, items.limit(0)).count() == 0
