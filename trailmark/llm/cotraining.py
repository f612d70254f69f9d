"""A quality classifier by co-training on two views of a document.

The content view is Fisher's discriminant over the mean log odds of a text's hashed byte trigrams and statistics of its words, lines
and characters; the metadata view is naive Bayes over source, language, stated size and the domain of the URL, as far as the table
has them, and knows nothing of the text. Both start from all labelled rows. In each round either view ranks all rows without a
label that it has not taught yet, and its first ones of either class, in the proportions of the labels, join the other view's
training rows. A taught row weighs as much as the teacher's precision on labelled rows of the same rank is known to exceed the
class's prior, so a view that tells little teaches with little weight. The odds of trigrams are those of labelled rows throughout.

Every row, labelled or not, belongs to one of `FOLDS` folds by a hash of its text, and while fitting it is scored by models of the other
folds. So all labelled rows train, calibrate (Platt scaling of each view and of the sum of their log-odds beyond the prior)
and set the cutoff, and no row is judged by a model that has seen it; documents are scored by the models of all folds. The
cutoff is the highest score for which the exact binomial bound says, with confidence 1 - DELTA, that at most a share FALSE_REJECTION
of good documents lies below; without enough labels for that nothing is rejected.

Texts are read twice, once the labelled ones for the trigrams, once all for their features, which are written as a row of some 200 bytes.
What models, ranks and cutoffs need of these are sums (of products by class, of slots, of rows in fine bins of the score), whose
size does not depend on the number of rows; nothing else reaches the driver.
"""

from __future__ import annotations

import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import texthash as th
from trailmark.session import materialize, release

FOLDS = 4
TRIGRAMS = 1 << 14
SOURCES = 256
SIZES = 64
META_SLOTS = 3 * SOURCES + SIZES
#: Rounds of teaching, and the share of all rows without a label that a view teaches in each.
ROUNDS, NEW = 3, 0.2
#: The weight of a taught row whose teacher is not known to do better than chance; labelled rows have 1.
LEAST = 0.01
FALSE_REJECTION, DELTA = 0.005, 0.1
#: Texts' worth of each trigram that either class has beforehand, the ridge of the discriminant, bins of a score near 0.
SMOOTH, RIDGE, BINS = 0.01, 0.02, 256
PUNCTUATION = [ord(c) for c in string.punctuation]
STATS = len(PUNCTUATION) + 14
#: Shares in a text are taken as if it had so many more bytes that tell nothing, so that a few words weigh little.
SHRINK = 60
META = ("source", "lang", "n_chars", "url")
BLOCK = 1 << 20


def _trigrams(buf: np.ndarray) -> np.ndarray:
    """The bucket of the three bytes from each byte on, the first two beyond the end excepted."""
    if len(buf) < 3:
        return np.zeros(0, np.int32)
    b = buf.astype(np.uint32)
    return (((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int32)


def _spans(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last trigram (exclusive) of each text."""
    return offs[:-1], np.maximum(offs[1:] - 2, offs[:-1])


def _histogram(buf: np.ndarray) -> np.ndarray:
    """How often each byte occurs, counted a block at a time."""
    return sum((np.bincount(buf[a : a + BLOCK], minlength=256) for a in range(0, len(buf), BLOCK)), np.zeros(256, np.int64))


def statistics(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Statistics of each text's words, lines and characters."""
    size = np.diff(offs) + SHRINK
    bytes_ = np.stack([_histogram(buf[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]) if len(offs) > 1 else np.zeros((0, 256))
    share = lambda some: bytes_[:, some].sum(1) / size
    starts, ends, first = th.word_spans(buf, offs)
    words = th.word_hashes(buf, starts, ends)
    count = np.maximum(np.diff(first), 1)
    spans = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
    distinct = np.array([len(np.unique(words[a:b])) for a, b in spans], float)
    pairs = th.fold(words, 2)
    apart = np.array([len(np.unique(pairs[a : max(a, b - 1)])) for a, b in spans], float)
    twice = np.concatenate([[False], words[1:] == words[:-1]]) if len(words) else np.zeros(0, bool)
    same = np.array([twice[a + 1 : b].sum() for a, b in spans], float)
    lines, beyond = share([10]), share(list(range(128, 256)))
    signs = np.log1p(100 * bytes_[:, PUNCTUATION] / size[:, None])
    return np.concatenate([signs, np.stack([
        np.log1p(np.diff(first)), same / (count + 5), np.log1p(same), (apart + 1) / (count + 5), distinct / np.sqrt(count), np.minimum((size - SHRINK) / count, 40) / 10,
        share(list(range(65, 91))), share(list(range(48, 58))), share(list(b"#*$%&|<>")), share([33]), np.log1p(lines * size), lines * 50, beyond, beyond * (lines * 50),
    ], 1)], 1)


class View:
    """One view's model for each fold of the rows, learned from all others, and last the one learned from all."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights, self.shift = weights, (1.0, 0.0)

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return self.shift[0] * z + self.shift[1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _bins(z: np.ndarray) -> np.ndarray:
    """The bin of a score, of a width of 1 / BINS near 0 and of that share of the score far from it."""
    return np.rint(BINS * np.arcsinh(np.clip(z, -1e6, 1e6))).astype(np.int64)


def _lower(b) -> np.ndarray:
    return np.sinh((np.asarray(b) - 0.5) / BINS)


def platt(z: np.ndarray, n1: np.ndarray, n0: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """(a, b) with sigmoid(a * z + b) fitted to n1 good and n0 bad rows of each score, targets smoothed as Platt does, by Newton steps; a is never negative."""
    g1, g0 = float(n1.sum()), float(n0.sum())
    n, t = n1 + n0, n1 * (g1 + 1) / (g1 + 2) + n0 / (g0 + 2)
    a, b = 0.0, float(np.log((g1 + 1) / (g0 + 1)))
    for _ in range(steps):
        p = _sigmoid(a * z + b)
        g = np.array([((n * p - t) * z).sum() + 1e-3 * a, (n * p - t).sum()])
        s = n * p * (1 - p)
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    return (a, b) if a > 0 else (0.0, float(np.log((g1 + 1) / (g0 + 1))))


def _domain(url: str | None) -> str | None:
    """The host of a URL, or what stands before its first slash."""
    return None if url is None else url.split("://", 1)[-1].split("/", 1)[0].lower()


def _slots(meta: dict[str, list]) -> np.ndarray:
    """Four slots a row: of the source, the language, the domain and the power of two below the stated size; null is a value."""
    n = len(meta["source"])
    slot = lambda k, x: zlib.crc32(f"{k}{x}".encode("utf-8", "replace")) % SOURCES
    known: dict[tuple, int] = {}
    cols = np.empty((n, 4), np.int16)
    for j, (name, values) in enumerate((("source", meta["source"]), ("lang", meta["lang"]), ("url", map(_domain, meta["url"])))):
        for i, x in enumerate(values):
            key = (name, x)
            if key not in known:
                known[key] = j * SOURCES + slot(name, x)
            cols[i, j] = known[key]
    cols[:, 3] = [3 * SOURCES + (SIZES - 1 if x is None else min(SIZES - 2, max(0, int(x)).bit_length())) for x in meta["n_chars"]]
    return cols


def _lift(n: float, k: float, prior: float) -> float:
    """How far the precision of n rows, k of them right, is above the prior, as a share of what is left, by Wilson's lower bound at 90 %."""
    n, z = max(n, 1), 1.2816
    low = (k + z * z / 2 - z * (k * (n - k) / n + z * z / 4) ** 0.5) / (n + z * z)
    return (low - prior) / (1 - prior)


def _rank(n: int, share: float, delta: float) -> int:
    """The most k with P(X < k) <= delta for n trials of probability `share`."""
    k = np.arange(1, int(n * share) + 3)
    logs = n * np.log1p(-share) + np.concatenate([[0.0], np.cumsum(np.log(np.maximum(n - k + 1, 1e-300) / k * (share / (1 - share))))])
    return int(np.searchsorted(np.cumsum(np.exp(logs)), delta, "right"))


def certified(good: np.ndarray, share: float = FALSE_REJECTION, delta: float = DELTA) -> float:
    """The highest cutoff below which, by the scores of good rows, at most `share` of good documents lie, with confidence 1 - delta.

    If k of n scores lie below it and P(X <= k) <= delta for n trials of probability `share`, that many or more would be a rare chance.
    """
    k = _rank(len(good), share, delta) if len(good) else 0
    return float(np.sort(good)[k - 1]) if k else 0.0


def _odds(counts: np.ndarray, smooth: float) -> np.ndarray:
    """Log odds of each slot from (fold, class, slot) counts: for each fold those of all others, and last of all."""
    total = counts.sum(0)
    rest = np.concatenate([total - counts, total[None]]) + smooth
    p = np.log(rest / rest.sum(2, keepdims=True))
    return p[:, 1] - p[:, 0]


def _discriminant(moments: np.ndarray) -> np.ndarray:
    """Weights and a constant (last) of Fisher's discriminant, as `_odds`; `moments` are sums of x x' (x ends with a 1) by (fold, class)."""
    total = moments.sum(0)
    out = []
    for m in [*(total - moments), total]:
        n = np.maximum(m[:, -1, -1], 1e-9)
        mean = m[:, :-1, -1] / n[:, None]
        within = sum(m[k, :-1, :-1] - n[k] * np.outer(mean[k], mean[k]) for k in (0, 1)) / n.sum()
        gap = mean[1] - mean[0]
        scale = np.sqrt(np.maximum(np.diag(within), 0) + gap * gap * n[0] * n[1] / n.sum() ** 2 + 1e-9)
        s = within / np.outer(scale, scale) + (RIDGE + 5 / n.sum()) * np.eye(len(gap))
        w = np.linalg.solve(s, gap / scale) / scale
        out.append(np.append(w, np.log(n[1] / n[0]) - w @ mean.mean(0)))
    return np.array(out)


class Cut:
    """Which free rows a view teaches: those above the bin `high` and a share of it, and those below the bin `low` and a share of it."""

    def __init__(self, free: np.ndarray, first: int, good: int, bad: int) -> None:
        """`free`: how many rows lie in each bin, from the bin `first` on."""
        down, up = np.cumsum(free[::-1]), np.cumsum(free)
        i, j = (min(int(np.searchsorted(c, n)), len(free) - 1) for c, n in ((down, good), (up, bad)))
        self.high, self.low = first + len(free) - 1 - i, first + j
        part = lambda c, at, n, b: 1.0 if c[at] <= n else (n - (c[at - 1] if at else 0)) / free[b - first]
        self.shares = part(down, i, good, self.high), part(up, j, bad, self.low)
        self.weights = 1.0, 1.0

    def __call__(self, b: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        good = (b > self.high) | ((b == self.high) & (u < self.shares[0]))
        return good, ~good & ((b < self.low) | ((b == self.low) & (u >= 1 - self.shares[1])))


class Rows:
    """The features of a batch of written rows, with what the views have taught each other about them so far."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        of = lambda name, dtype: np.frombuffer(b"".join(batch[name].to_pylist()), dtype).reshape(batch.num_rows, -1)
        self.x, self.slots = of("x", np.float32).astype(float), of("slots", np.int16)
        self.fold, self.mixed = batch["fold"].to_numpy(), batch["mixed"].to_numpy().astype(np.uint64)
        self.y = batch["quality"].cast(pa.float64()).to_numpy(zero_copy_only=False)
        self.known, self.weight = np.stack([self.y, self.y]), np.ones((2, len(self.y)))

    def raw(self, views: list[View]) -> list[np.ndarray]:
        w, odds = (v.weights[self.fold] for v in views)
        return [(self.x * w[:, :-1]).sum(1) + w[:, -1], np.take_along_axis(odds, self.slots.astype(np.int64), 1).sum(1)]

    def learn(self, rounds: list[tuple[list[View], list[Cut]]]) -> Rows:
        for step, (views, cuts) in enumerate(rounds):
            free = np.isnan(self.known)
            for v, (z, cut) in enumerate(zip(self.raw(views), cuts, strict=True)):
                u = th.mix(self.mixed + np.uint64(2 * step + v)) / 2.0**64
                for good, rows in zip((1, 0), cut(_bins(z), u), strict=True):
                    rows &= free[1 - v]
                    self.known[1 - v, rows], self.weight[1 - v, rows] = good, cut.weights[1 - good]
        return self


def _summed(rows: DataFrame, size: int, one) -> np.ndarray:
    """The sum of `one(batch)`, vectors of `size` numbers, over all batches; each task adds its own, blocks of the sums are added by key."""
    block = 1 << 13

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            total += one(batch)
        parts = [total[a : a + block] for a in range(0, size, block)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "sums"])

    def add(frame):
        return frame.iloc[:1].assign(sums=[sum(map(np.frombuffer, frame["sums"])).tobytes()])

    got = rows.mapInArrow(run, "part int, sums binary").groupBy("part").applyInPandas(add, "part int, sums binary").toArrow()
    out = np.zeros(size)
    for part, sums in zip(got["part"].to_pylist(), got["sums"].to_pylist(), strict=True):
        out[part * block :][:block] = np.frombuffer(sums)
    return out


class Classifier:
    """Two calibrated views and their combination; of a view's models only that of all rows scores documents."""

    def __init__(self, odds: np.ndarray, prior: float) -> None:
        self.odds, self.prior, self.cutoff, self.shift = odds, prior, 0.0, (1.0, 0.0)
        #: (round, teacher, good rows, bad rows, weight of all) of what the views have taught each other
        self.added: list[tuple[int, str, int, int, float]] = []
        self.views: list[View] = []

    def sum(self, raw: list[np.ndarray]) -> np.ndarray:
        prior = np.log(self.prior / (1 - self.prior))
        return sum((v.calibrated(z) - prior for v, z in zip(self.views, raw, strict=True)), prior)

    def probability(self, z: np.ndarray) -> np.ndarray:
        return _sigmoid(self.shift[0] * z + self.shift[1])

    def score(self, column: pa.Array, meta: dict[str, list]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(score, content view, metadata view, has a word) of each text."""
        buf, offs = th.text_buffers(column)
        content = statistics(buf, offs)
        w = self.views[0].weights[-1]
        raw = [grams(buf, offs, self.odds) * w[0] + content @ w[1:-1] + w[-1], self.views[1].weights[-1][_slots(meta)].sum(1)]
        return self.probability(self.sum(raw)), *(_sigmoid(v.calibrated(z)) for v, z in zip(self.views, raw, strict=True)), content[:, len(PUNCTUATION)] > 0


def grams(buf: np.ndarray, offs: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """The mean odds of each text's trigrams; long texts a block at a time."""
    if len(buf) <= 4 * BLOCK:
        a, b = _spans(offs)
        sums = np.concatenate([[0.0], np.cumsum(odds[_trigrams(buf)])])
        top = len(sums) - 1
        return np.where(b > a, (sums[np.minimum(b, top)] - sums[np.minimum(a, top)]) / (b - a + SHRINK), 0.0)
    out = np.zeros(len(offs) - 1)
    for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        if b - a > 2:
            out[i] = sum(float(odds[_trigrams(buf[c : min(b, c + BLOCK + 2)])].sum()) for c in range(a, b - 2, BLOCK)) / (b - a - 2 + SHRINK)
    return out


def _gram_shares(batch: pa.RecordBatch) -> np.ndarray:
    """By (fold, class): the trigrams' shares in each text in units of 2**-30, summed, and last the number of texts."""
    out = np.zeros((2 * FOLDS, TRIGRAMS + 1))
    for part in th.slices(batch, "text", most=1 << 20):
        buf, offs = th.text_buffers(part["text"])
        group = (2 * part["fold"].to_numpy() + part["quality"].to_numpy()).astype(np.int64)
        out[:, TRIGRAMS] += np.bincount(group, minlength=2 * FOLDS)
        for i, (a, b) in enumerate(zip(*map(np.ndarray.tolist, _spans(offs)), strict=True)):
            for c in range(a, b, BLOCK):
                n = np.bincount(_trigrams(buf[c : min(b, c + BLOCK) + 2]), minlength=TRIGRAMS)
                out[group[i], :TRIGRAMS] += n * round((1 << 30) / (b - a + SHRINK))
    return out.reshape(-1)


def _metadata(docs: DataFrame) -> dict[str, Column]:
    """The columns of META as strings and a long, null where the table has none."""
    kinds = {c: "long" if c == "n_chars" else "string" for c in META}
    return {c: F.expr(f"try_cast(`{c}` AS {k})") if c in docs.columns else F.lit(None).cast(k) for c, k in kinds.items()}


def _features(rows: DataFrame, odds: np.ndarray) -> DataFrame:
    """doc_id, mixed, fold, and x (odds of the trigrams without the row's fold, statistics) and slots as bytes."""
    shared = rows.sparkSession.sparkContext.broadcast(odds)

    def run(batches):
        for batch in batches:
            for part in th.slices(batch, "text", most=2 << 20):
                buf, offs = th.text_buffers(part["text"])
                fold, x = part["fold"].to_numpy(), np.empty((part.num_rows, STATS + 1), np.float32)
                x[:, 1:] = statistics(buf, offs)
                for f in np.unique(fold).tolist():
                    some = pa.array(np.flatnonzero(fold == f))
                    x[fold == f, 0] = grams(*th.text_buffers(part["text"].take(some)), shared.value[f])
                slots = _slots({c: part[c].to_pylist() for c in META})
                cells = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (x, slots)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["mixed"], part["fold"], *cells], names=["doc_id", "mixed", "fold", "x", "slots"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, mixed long, fold int, x binary, slots binary")


def _histograms(rows: DataFrame, scores) -> dict[int, tuple[int, np.ndarray]]:
    """For each view: (the first bin, rows in each bin, by 0 bad, 1 good, 2 free for the other view); `scores` gives (view, class, score) arrays of a batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v, k, z = map(np.concatenate, zip(*scores(batch), strict=True))
                keys, n = np.unique(np.stack([v, k.astype(np.int64), _bins(z)]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in keys), pa.array(n, pa.int64())], names=["v", "k", "b", "n"])

    got = rows.mapInArrow(run, "v long, k long, b long, n long").groupBy("v", "k", "b").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    v, k, b, n = (np.array(got[c], np.int64) for c in ("v", "k", "b", "n"))
    out = {}
    for view in np.unique(v).tolist():
        at = v == view
        first = int(b[at].min())
        out[view] = first, np.zeros((3, int(b[at].max()) - first + 1))
        out[view][1][k[at], b[at] - first] = n[at]
    return out


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, labelled: int | None = None, pool: int | None = None) -> Classifier | None:
    """A classifier from all rows of `docs` with a label, whole texts, and all rows without one as the pool; None without both classes.

    Of several labels of a document the best counts; null texts count as empty, rows with a null doc_id are left out. For trials of
    how it does with fewer rows, `labelled` takes that many labels and `pool` about that many other rows, by hashes of doc_id.
    """
    mark = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") > 0).cast("int")).alias("quality"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mixed = F.xxhash64(F.col("doc_id").cast("string"), F.lit(5))
    if labelled is not None:
        mark = mark.orderBy(mixed, "doc_id").limit(labelled)
    rows = docs.withColumns(_metadata(docs)).filter("doc_id is not null").select(
        "doc_id", mixed.alias("mixed"), F.pmod(F.xxhash64(text, F.lit(6)), F.lit(FOLDS)).cast("int").alias("fold"), text.alias("text"), *META
    )
    # Joined by a shuffle at any size: labels grow with the documents, so they are no table to broadcast.
    mark = mark.hint("shuffle_hash")
    shares = _summed(rows.select("doc_id", "fold", "text").join(mark, "doc_id"), 2 * FOLDS * (TRIGRAMS + 1), _gram_shares).reshape(FOLDS, 2, -1)
    n = shares[:, :, -1].sum(0)
    if n.min() == 0 or n.sum() < 20:
        return None
    odds = _odds(shares[:, :, :-1] / (1 << 30), SMOOTH)
    model = Classifier(odds[-1], float(np.clip(n[1] / n.sum(), 1e-3, 1 - 1e-3)))
    met = _features(rows, odds).join(mark, "doc_id", "left").select("mixed", "fold", "quality", "x", "slots")
    if pool is not None:
        met = met.filter(F.col("quality").isNotNull() | (F.pmod(F.xxhash64("mixed"), F.lit(1 << 30)) < int(min(1.0, pool / max(1, docs.count())) * (1 << 30))))
    stored = materialize(spark, met, "features")
    width, rounds, share = STATS + 2, [], {}
    for step in range(ROUNDS + 1):
        before = list(rounds)

        def sums(batch):
            r = Rows(batch).learn(before)
            out, slots = np.zeros((2 * FOLDS, width, width)), np.zeros((2 * FOLDS, META_SLOTS))
            x = np.concatenate([r.x, np.ones((len(r.y), 1))], 1)
            for g in range(2 * FOLDS):
                at = (r.fold == g // 2) & (r.known[0] == g % 2)
                out[g] = (x[at] * r.weight[0, at, None]).T @ x[at]
                at = (r.fold == g // 2) & (r.known[1] == g % 2)
                slots[g] = np.bincount(r.slots[at].reshape(-1), np.repeat(r.weight[1, at], 4), META_SLOTS)
            return np.concatenate([out.reshape(-1), slots.reshape(-1)])

        total = _summed(stored, 2 * FOLDS * (width * width + META_SLOTS), sums)
        moments, slots = total[: 2 * FOLDS * width * width].reshape(FOLDS, 2, width, width), total[2 * FOLDS * width * width :].reshape(FOLDS, 2, META_SLOTS)
        model.views = views = [View(_discriminant(moments)), View(_odds(slots, 1.0))]

        def scores(batch):
            r = Rows(batch).learn(before)
            for v, z in enumerate(r.raw(views)):
                k = np.where(np.isnan(r.y), np.where(np.isnan(r.known[1 - v]), 2, 3), r.y)
                use = k < 3
                yield np.full(use.sum(), v), k[use], z[use]

        bins = _histograms(stored, scores)
        cuts = []
        for v, (first, (bad, good, free)) in bins.items():
            views[v].shift = platt(np.sinh((first + np.arange(len(good))) / BINS), good, bad)
            some = min(free.sum(), NEW * share.setdefault(v, free.sum()))
            cuts.append(cut := Cut(free, first, round(some * model.prior), round(some) - round(some * model.prior)))
            taught = [round(some * model.prior), round(some) - round(some * model.prior)]
            # What labelled rows of the same rank are, by models that have not seen them, tells how much to trust these.
            trust = []
            for right, wrong, k, prior in ((good[::-1], bad[::-1], taught[0], model.prior), (bad, good, taught[1], 1 - model.prior)):
                want = max(1.0, (good.sum() + bad.sum()) * k / max(1, free.sum()))
                both = np.cumsum(right + wrong)
                used = np.clip((want - (both - right - wrong)) / np.maximum(right + wrong, 1), 0, 1)
                trust.append(max(LEAST, _lift(float((used * (right + wrong)).sum()), float((used * right).sum()), prior)))
            cut.weights = tuple(trust)
            if step < ROUNDS:
                model.added.append((step, ("content", "metadata")[v], *taught, taught[0] * trust[0] + taught[1] * trust[1]))
        rounds.append((views, cuts))

    def together(batch):
        r = Rows(batch)
        use = ~np.isnan(r.y)
        yield np.zeros(use.sum(), np.int64), r.y[use].astype(np.int64), model.sum(r.raw(model.views))[use]

    first, (bad, good, _) = _histograms(stored, together)[0]
    model.shift = platt(np.sinh((first + np.arange(len(good))) / BINS), good, bad)
    k = _rank(int(good.sum()), FALSE_REJECTION, DELTA)
    if k:
        model.cutoff = float(model.probability(_lower(first + np.searchsorted(np.cumsum(good), k))))
    release(spark, stored)
    for v in model.views:
        v.weights = v.weights[-1:]
    return model


def classify(spark: SparkSession, docs: DataFrame, model: Classifier | None) -> DataFrame:
    """`docs` (text, and of source, lang, n_chars and url what there is, and any other columns) with quality_score, content_score,
    metadata_score and kept.

    kept: the score reaches the cutoff and the text has a word; null and empty texts are not kept. Nulls in the metadata are
    values of their own. Without a model every text with a word is kept, with scores of 1. Columns of these four names are replaced.
    """
    names = ["quality_score", "content_score", "metadata_score", "kept"]
    docs = docs.drop(*names)
    shared = spark.sparkContext.broadcast(model)
    width = len(docs.columns)
    t = docs.columns.index("text")
    rows = docs.select("*", *[c.alias(f"_meta_{k}") for k, c in _metadata(docs).items()])

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in th.slices(batch, "text", most=2 << 20):
                column = part.column(t)
                if m is None:
                    buf, offs = th.text_buffers(column)
                    some = np.diff(th.word_spans(buf, offs)[2]) > 0
                    score = content = meta = np.ones(part.num_rows)
                    kept = some
                else:
                    score, content, meta, some = m.score(column, {c: part.column(width + i).to_pylist() for i, c in enumerate(META)})
                    kept = some & (score >= m.cutoff)
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *(pa.array(np.round(x, 6)) for x in (score, content, meta)), pa.array(kept)], names=[*part.schema.names[:width], *names])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names[:3]), T.StructField("kept", T.BooleanType())])
    return rows.mapInArrow(run, schema)
