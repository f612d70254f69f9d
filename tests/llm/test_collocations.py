"""Phrase mining against SQL and a plain count, for good, bad and empty samples."""

import collections
import random
import re

import numpy as np
import pytest
from compare import difference
from trailmark.llm import collocations
from trailmark.session import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, most=3, shown=2000):
    """The contract, word by word."""
    f = collections.Counter()
    n = collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f["und" if lang is None else lang, tuple(w[i : i + k])] += 1
    found = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, p), a in found.items():
        longer = [b for (l2, q), b in found.items() if l2 == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= 50 * a for b in longer):
            continue
        score, _, l, r = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, some in out.items() for i, (s, a, p, l, r) in enumerate(sorted(some)[:shown]))


def got(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def texts(seed, n=300):
    rng = random.Random(seed)
    words = ["a", "b", "New", "york", "City", "é", "x-y", "'s"] + [f"w{i}" for i in range(40)]
    weights = [30, 20, 6, 6, 4, 5, 3, 3] + [1] * 40
    rows = []
    for _ in range(n):
        some = rng.choices(words, weights, k=rng.randint(0, 60))
        rows.append((rng.choice(["en", "es", "en", None]), "".join(w + rng.choice([" ", " ", " ", "\t", ". ", "\n", ",", "  "]) for w in some)))
    return rows


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(collocations.collocations(spark, table(spark, sf, "documents")), collocations.oracle_sql(), sf) == ""


@pytest.mark.parametrize(("sample", "proposed"), [(1, 1), (3, 2), (50, 5), (10**9, 1)])
def test_any_sample(spark, sample, proposed):
    """A whole, a usual, a poor and an empty sample give the same phrases: border failures are followed up."""
    rows = [*texts(1), ("en", "es en " * 12), ("es", "en es " * 12)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    counts = collocations.frequent_phrases(spark, docs, sample=sample, proposed=proposed)
    assert counts.groupBy("k", "lang", "phrase").count().filter("count > 1 AND k > 0").isEmpty()
    words = [(k, lang, p, c) for k, lang, p, c in ((r.k, r.lang, r.phrase, r.c) for r in counts.collect()) if k]
    f = collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update((k, lang or "und", " ".join(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert sorted(words) == sorted((*key, c) for key, c in f.items() if c >= 10)


def test_plain(spark, monkeypatch):
    rows = [*texts(2), ("a\tb", "one two " * 12), ("", "one two " * 12)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert got(collocations.collocations(spark, docs)) == plain(rows)
    assert got(collocations.collocations(spark, docs, shown=5)) == plain(rows, shown=5)
    monkeypatch.setattr(collocations, "CHUNK", 64)  # many chunks a task, and bit maps so small that nearly all is let in
    monkeypatch.setattr(collocations, "BITS", 16)
    assert got(collocations.collocations(spark, docs)) == plain(rows)


def test_longer_phrases(spark):
    rows = [("en", "one two three four five. " * 12), ("en", "one two. three four. " * 3), ("en", "two three four six. " * 30)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert got(collocations.collocations(spark, docs, most=4)) == plain(rows, most=4)


def test_odd(spark, odd, none):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert got(collocations.collocations(spark, odd)) == plain(rows)
    assert collocations.collocations(spark, none).count() == 0
    tied = spark.createDataFrame([("en", "b c. a b. é è. ë ê. " * 10)], "lang string, text string")
    assert [(r.phrase, r["rank"]) for r in collocations.collocations(spark, tied).orderBy("rank").collect()] == [("a b", 1)][:0] + [(p, i + 1) for i, p in enumerate(["é è", "ë ê", "a b", "b c"])]
    assert got(collocations.collocations(spark, tied)) == plain([("en", "b c. a b. é è. ë ê. " * 10)])


def test_large_counts(spark):
    """Products beyond 64 bits are exact."""
    counts = spark.createDataFrame([(1, "en", "a", 10**12 + 1), (1, "en", "b", 10**12 + 7), (2, "en", "a b", 10**12 - 3), (0, "en", "", 10**13)], "k int, lang string, phrase string, c long")
    a, l, r = 10**12 - 3, 10**12 + 1, 10**12 + 7
    assert collocations.scored(counts).first().score == 10**6 * a * a // (l * r)


def test_hashes_agree():
    """The hash of a phrase is the same in a text and in a table."""
    import pyarrow as pa

    langs, phrases = pa.array(["en", "es", "en"]), pa.array(["es", "en", "new york city"])
    h = collocations._hashes(langs, phrases)
    assert len(set(h.tolist())) == 3
    p = collocations.Proposal(tuple(np.full(1 << 13, 255, np.uint8) for _ in range(2)))
    seen = [r for t in collocations.chunk_counts(langs, phrases, 3, [p]) for r in t.to_pylist()]
    assert {(r["key"], r["c"]) for r in seen if " " in r["key"]} == {("en\tnew york", 1), ("en\tyork city", 1), ("en\tnew york city", 1)}
