"""Trained operators: held-out accuracy, sound probabilities, odd rows."""

import math
import random
from collections import Counter

import numpy as np
from trailmark.llm import cotraining, html_extract, language_id, queries
from trailmark.session import table


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op3_language_id(spark, sf).collect()
    lang = {r.doc_id: r.lang for r in table(spark, sf, "documents").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got) and np.mean([r.rejected for r in got]) < 0.01


def test_kneser_ney_is_a_distribution():
    """For a context the probabilities of all characters sum to one, seen and unseen contexts alike."""
    rng = random.Random(2)
    model = language_id.Model({x: [" ".join("".join(rng.choice(a) for _ in range(rng.randint(1, 6))) for _ in range(300))] for x, a in (("u", "abcde"), ("v", "cdefg"))})
    for context in ("abc", "ab ", "ggg", "zzz"):
        texts = [context + c for c in "abcdefg"]
        total = np.zeros(2)
        for t in texts:
            codes, first, _ = language_id.characters([t])
            total += np.exp(model.log_probabilities(codes, first)[len(t) - 1])
        space = np.exp(model.log_probabilities(*language_id.characters([context + " "])[:2])[-1]) if not context.endswith(" ") else 0
        unknown = np.exp(model.log_probabilities(*language_id.characters([context + "z"])[:2])[len(context)])
        assert np.all(total + space + unknown < 1.02)
        if context in ("abc", "ab "):
            assert (total + space + unknown)[0] > 0.97


def plain_kneser_ney(texts, order=4):
    """log p of each character of a text by the recursion itself, over dictionaries of strings."""
    grams = [Counter() for _ in range(order + 1)]
    for t in texts:
        t = " " * (order - 1) + t
        for i in range(order - 1, len(t)):
            grams[order][t[i - order + 1 : i + 1]] += 1
    for n in range(order, 1, -1):
        grams[n - 1] = Counter(g[1:] for g in grams[n])
    discount, total, types = [0.0], [None], [None]
    for n in range(1, order + 1):
        n1, n2 = (sum(c == k for c in grams[n].values()) for k in (1, 2))
        discount.append(min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5)
        sums, kinds = Counter(), Counter()
        for g, c in grams[n].items():
            sums[g[:-1]] += c
            kinds[g[:-1]] += 1
        total.append(sums)
        types.append(kinds)

    def p(g, floor):
        n = len(g)
        if not n:
            return floor
        c = g[:-1]
        if not total[n][c]:
            return p(g[1:], floor)
        return max(grams[n][g] - discount[n], 0) / total[n][c] * (grams[n][g] > 0) + discount[n] * types[n][c] / total[n][c] * p(g[1:], floor)

    return lambda t, floor: [math.log(p((" " * (order - 1) + t)[i : i + order], floor)) for i in range(len(t))]


def test_against_plain_kneser_ney():
    rng = random.Random(12)
    text = lambda a: " ".join("".join(rng.choice(a) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 30))) + " "
    samples = {x: [text(a) for _ in range(20)] for x, a in (("u", "abcde"), ("v", "cdefgh"))}
    model = language_id.Model(samples)
    tests = [text("abcdefghi") for _ in range(30)]
    h, n, _ = model.cross_entropies(tests)
    for j, x in enumerate(model.languages):
        plain = plain_kneser_ney(samples[x])
        want = [-np.mean(plain(t, math.exp(model.floor[j]))) for t in tests]
        assert np.allclose(h[:, j], want, atol=1e-4)
    assert [len(t) for t in tests] == n.tolist()


def test_neighbours_do_not_matter(spark):
    """A text alone, after another one, and in batches of any size gives the same."""
    docs = [r for r in table(spark, "/root/testdata/sf0.001", "documents").collect() if r.text]
    model = language_id.Model({x: [r.text for r in docs if r.lang == x] for x in {r.lang for r in docs}})
    words = sorted({w for r in docs for w in r.text.split()[:3]})[:300]
    alone = [model.cross_entropies([w])[0][0] for w in words]
    for shift in (1, 7):
        for w, v, h in zip(words, words[shift:], alone, strict=False):
            assert np.allclose(model.cross_entropies([v, w])[0][1], h, atol=1e-6)
    for size in (2, 31, 300):
        got = np.concatenate([model.cross_entropies(words[a : a + size])[0] for a in range(0, len(words), size)])
        assert np.allclose(got, alone, atol=1e-6)
    long = " ".join(r.text for r in docs) * 3
    assert np.allclose(model.cross_entropies(["x y", long, "z"])[0][1], model.cross_entropies([long])[0][0], atol=1e-6)


def test_many_languages_and_long_texts_are_learned(spark):
    rng = random.Random(9)
    letters = [chr(0x4E00 + i) for i in range(300)]
    rows = [(7 * i + j, " ".join(letters[i] for _ in range(6)), f"x{i}", None) for i in range(300) for j in range(7)]
    rows += [(10_000 + j, " ".join(rng.choice(["lang", "text", "only"]) for _ in range(9000)), "long", None) for j in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.fit(spark, docs)
    assert len(model.languages) == 301
    got = language_id.identify(spark, docs, model).collect()
    assert all(r.lang_pred == r.lang for r in got)


def test_language_odd_rows(spark, odd, none):
    model = language_id.fit(spark, odd)
    got = language_id.identify(spark, odd, model).collect()
    assert len(got) == 10
    assert all(r.lang_pred == "und" and r.rejected and r.score == 0 for r in got if not any(c.isalpha() for c in r.text or ""))
    assert language_id.fit(spark, none) is None
    assert {r.lang_pred for r in language_id.identify(spark, odd, None).collect()} == {"und"}
    assert language_id.identify(spark, none, model).count() == 0


def kept_shares(spark, model, docs, labels):
    got = cotraining.classify(spark, docs, model).join(labels, "doc_id").select("quality", "kept", "content_score", "metadata_score", "quality_score").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    return np.mean(good), np.mean(bad), got


def auc(got, name):
    z, y = np.array([r[name] for r in got]), np.array([r.quality for r in got])
    rank = np.argsort(np.argsort(z + np.arange(len(z)) * 1e-12))
    return (rank[y == 1].mean() - (y == 1).sum() / 2) / (y == 0).sum()


def test_quality(spark):
    """Fitted on the labels of three quarters of the ids, measured on the others: no row of the measure has trained, calibrated or set the cutoff."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = cotraining.fit(spark, docs, labels.filter("doc_id % 4 <> 0"), labelled=1500, pool=1000)
    good, bad, got = kept_shares(spark, model, docs, labels.filter("doc_id % 4 = 0"))
    assert good > 0.98 and bad < 0.4
    assert auc(got, "quality_score") > 0.95
    assert {(v, k) for v, who, *rest in model.added for k in [who] if all(x > 0 for x in rest)} == {(i, who) for i in range(cotraining.ROUNDS) for who in ("content", "metadata")}


def test_views_teach_each_other(spark):
    """Sources tell the class of half of the rows, words that of the other half; unlabelled rows have both. Each view alone misses half of them."""
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(1600):
        good, by_source = i % 2 == 0, i % 4 < 2
        told = i >= 400  # rows without a label have both signs
        word = ("fine" if good else "junk") if told or not by_source else "same"
        source = ("press" if good else "spam") if told or by_source else f"s{i % 7}"
        rows.append((i, " ".join(rng.choice([word, word, f"w{rng.randrange(50)}"]) for _ in range(30)), source, "en", 100))
        if not told:
            marks.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    model = cotraining.fit(spark, docs, spark.createDataFrame(marks, "doc_id long, quality int"), pool=900)
    assert all(n > 50 and w > 20 for _, _, good, bad, w in model.added for n in (good, bad)), model.added
    got = {r.doc_id: r for r in cotraining.classify(spark, docs, model).collect()}
    for name in ("content_score", "metadata_score", "quality_score"):
        assert np.mean([(got[i][name] > 0.5) == (i % 2 == 0) for i in range(400, 1600)]) > 0.95


def test_certified_cutoff():
    from math import comb

    tail = lambda k, n, p: sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    for n in (100, 459, 460, 1000, 3000):
        scores = np.random.default_rng(n).random(n)
        cut = cotraining.certified(scores)
        k = int((scores < cut).sum())
        if n < 460:
            assert cut == 0
        else:
            assert tail(k, n, cotraining.FALSE_REJECTION) <= cotraining.DELTA < tail(k + 1, n, cotraining.FALSE_REJECTION)


def test_quality_cutoff_keeps_its_promise(spark):
    """With the production sample, over all labelled rows (those of the sample among them)."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    good, bad, _ = kept_shares(spark, cotraining.fit(spark, docs, labels), docs, labels)
    print("kept", good, bad)
    assert good > 0.995 and bad < 0.145


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, quality int")
    assert cotraining.fit(spark, odd, labels) is None  # too few labels
    got = {r.doc_id: r.kept for r in cotraining.classify(spark, odd.drop("label"), None).collect()}
    assert not got[1] and not got[2] and not got[3] and got[4]
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "!!! ### ") * (i % 7 + 1), None, None) for i in range(60)], "doc_id long, text string, source string, lang string")
    model = cotraining.fit(spark, docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"))
    got = {r.doc_id: r.quality_score for r in cotraining.classify(spark, docs, model).collect()}
    assert np.mean([got[i] for i in range(41, 60, 2)]) > np.mean([got[i] for i in range(40, 60, 2)])
    assert cotraining.classify(spark, odd, model).count() == 10 and cotraining.classify(spark, none, model).count() == 0


def test_extraction_of_made_pages():
    rng = random.Random(77)
    model = html_extract.model()
    pages = [html_extract.made_page(rng) for _ in range(150)]
    trees = [html_extract.parse(p) for p in pages]
    want = [html_extract.main_text(t, html_extract.truth(t)) for t in trees]
    got = html_extract.extract(pages, model)
    assert np.mean([a == b for a, b in zip(got, want, strict=True)]) > 0.9


def test_decoding_is_consistent():
    rng = random.Random(8)
    tree = html_extract.parse(html_extract.made_page(rng))
    odds = np.random.default_rng(1).normal(size=len(tree.tag)) * 3
    open_ = html_extract.decode(tree, odds)
    assert all(open_[tree.parent[i]] or not open_[i] for i in range(1, len(open_)))


def test_pages(spark):
    page = '<html><body><nav><ul><li><a href=x>menu</a></ul></nav><article><h1>A &amp; B</h1><p>One  two<br>three <b>bo</b>ld.<p>Next&#33;</article><footer>&copy; x</footer>'
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", page), (1, "u", page), (4, "u", "<article><p>" + "word " * 100_000), (5, "u", "<" * 2000), (6, "u", "<div>" * 3000 + "deep")]
    got = html_extract.main_texts(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 8
    by = {r.page_id: r for r in got}
    assert by[1].text == by[None].text == "A & B One two three bold. Next!" and by[1].n_chars == 31
    assert by[2].text == by[3].text == "" and by[4].n_chars == 499_999


def test_quality_learns_from_every_row(spark):
    """All 5,000 labelled rows count, few of them with a word that tells the class, at the end of long texts; a fifth of all 5,000 others is taught."""
    from pyspark.sql import functions as F

    end = F.when(F.col("id") % 100 > 1, "").otherwise(F.concat(F.repeat(F.lit(" plain words here"), 1000), F.when(F.col("id") % 2 == 0, " zqz").otherwise(" xkx")))
    rows = spark.range(10_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("plain words here"), end).alias("text"), F.lit("s").alias("source"))
    model = cotraining.fit(spark, rows, rows.filter("doc_id < 5000").selectExpr("doc_id", "1 - doc_id % 2 AS quality"))
    assert model.prior == 0.5 and all(abs(good + bad - 1000) < 2 for step, _, good, bad, _ in model.added if step == 0)
    gram = lambda w: model.odds[cotraining._trigrams(np.frombuffer(w, np.uint8))[0]]
    assert gram(b"zqz") > 1e-4 and gram(b"xkx") < -1e-4


def test_language_counts_every_row(spark):
    """The counts are those of all texts, whole, of a language: 2,000 rows and one of 30,000 characters."""
    rng = random.Random(4)
    texts = {x: [" ".join("".join(rng.choice(a) for _ in range(rng.randint(1, 6))) for _ in range(3)) for _ in range(2000)] for x, a in (("u", "abcdeÀ"), ("v", "cdefg\U00010400"))}
    texts["u"].append("qrst " * 6000)
    docs = spark.createDataFrame([(i, t, x) for x in texts for i, t in enumerate(texts[x])], "doc_id long, text string, lang string")
    got, want = language_id.fit(spark, docs), language_id.Model(texts)
    assert got.languages == want.languages and np.isfinite(got.limit).all() and (got.mean > 0).all()
    for name in ("keys", "logp", "contexts", "backoff"):
        assert all(np.array_equal(a, b) for a, b in zip(getattr(got, name), getattr(want, name), strict=True)), name
