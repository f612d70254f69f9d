"""Near-duplicates against brute force over all pairs of word sets."""

import random
import re

from trailmark.llm import near_dedup


def sets_of(rows, k):
    out = {}
    for d, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[d] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
    return out


def brute(rows, k, percent):
    sets = sets_of(rows, k)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for group in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 12, 40, 120]))]
        for _ in range(rng.choice([1, 1, 2, 6, 25])):
            words = list(base)
            for _ in range(int(len(words) * rng.choice([0, 0.02, 0.05, 0.09, 0.12]))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((n * 7 % 1009, " ".join(words).upper() if rng.random() < 0.1 else " ".join(words)))
            n += 1
    return rows


def test_against_all_pairs(spark):
    for k in (2, 5):
        rows = corpus(k)
        got = near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), k=k).collect()
        want = brute(rows, k, 80)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_groups_of_many_blocks(spark, monkeypatch):
    """Large groups are compared block by block, and tables beyond the broadcast limit are joined by shuffles."""
    rows = corpus(9)
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    monkeypatch.setattr(near_dedup, "SMALL", 10)
    got = near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 2, 80)


def test_ids_of_another_type(spark):
    rows = corpus(4)
    name = lambda d: f"d{d:05d}"
    got = near_dedup.near_duplicates(spark, spark.createDataFrame([(name(d), t) for d, t in rows] + [(None, "a b c")], "doc_id string, text string"), k=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id} == {name(d): (n, name(c)) for d, (n, c) in brute(rows, 2, 80).items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(spark, odd, none):
    got = near_dedup.near_duplicates(spark, odd, k=2).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].kept and by[1].component_id == 1
    assert by[6].component_id == 5 and not by[6].kept and by[7].n_shingles == 1
    assert by[None].component_id is None and by[None].kept
    assert near_dedup.near_duplicates(spark, none).count() == 0
    left = near_dedup.one_of_each(spark, odd, k=2)
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 5, 7, 8] and left.columns == odd.columns


def test_one_row_of_each_text(spark):
    """Unrelated texts under one doc_id all stay; which row of a group stays is defined by its doc_id and its text."""
    a, b = "one two three four five six seven eight nine ten", "a wholly other text of some nine or ten words"
    rows = [(7, a, 1), (7, b, 2), (3, a.upper(), 3), (7, a, 4), (None, a, 5), (None, a, 6), (9, "", 7), (9, "", 8), (9, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = near_dedup.one_of_each(spark, docs)
    assert got.columns == docs.columns and sorted(r.n for r in got.collect()) == [2, 3, 5, 6, 7, 8, 9]
    alone = near_dedup.one_of_each(spark, docs.filter("n in (1, 3, 9)"))
    assert sorted(r.n for r in alone.collect()) == [3, 9]
    ties = spark.createDataFrame([(1, a + " x", 1), (1, a + " X", 2), (1, a.upper() + " x", 3)] * 2, "doc_id long, text string, n int")
    (one,) = near_dedup.one_of_each(spark, ties.repartition(3)).collect()
    assert [one.n] == [r.n for r in near_dedup.one_of_each(spark, ties.orderBy("n").coalesce(1)).collect()]
