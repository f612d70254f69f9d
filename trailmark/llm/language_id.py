"""Language identification with interpolated Kneser-Ney character models.

Texts are lower-cased; everything but letters and marks becomes a single space. For each language an interpolated
Kneser-Ney model of order `ORDER` is estimated (raw counts at the highest order, continuation counts below, one discount
an order). The models share sorted arrays of 64-bit n-gram hashes: beside each hash stands a row with every language's full
interpolated log probability, and beside each context hash every language's log back-off weight. A character costs one
binary search, and more only where its longest n-gram is new. The language with the lowest cross-entropy per character wins.

Every text begins as if spaces came before it, so that nothing depends on the rows that happen to lie beside it.

The n-grams of all rows with a language are counted, whole texts, by two halves of the rows (by a hash of the text). The score is the
winner's posterior with a temperature fitted on all these rows, each scored by a model of the other half; a text is
rejected if its cross-entropy, shrunk towards its language's mean by `PRIOR` characters, exceeds that mean by more than `SLACK` times
what all but a share `ODD` of the language's texts do (and by more than `LEAST` nats a character).
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import texthash as th
from trailmark.session import materialize, release

ORDER = 4
#: Temperatures to choose from, and bins of one nat in which excesses are counted.
TEMPERATURES, BINS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0), 1000
UNKNOWN = "und"
PRIOR, SLACK, ODD, LEAST = 20, 1.5, 0.01, 0.6
_SALT = [np.uint64(0x9E3779B97F4A7C15 * (n + 1) & th.MASK) for n in range(ORDER + 2)]
_STEP = 0xD1342543DE82EF95
_kinds: np.ndarray | None = None


def _kind() -> np.ndarray:
    """By code point: 2 for letters, 1 for marks, 0 for others."""
    global _kinds
    if _kinds is None:
        category = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
        _kinds = np.array([2 if c == "L" else 1 if c == "M" else 0 for c in category], np.uint8)
    return _kinds


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts after folding, first position of each and their number, letters in each)."""
    raw = np.frombuffer("\n".join([*(t.lower() for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t.lower()) + 1 for t in texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    kind = _kind()[raw]
    word = kind > 0
    letters = np.concatenate([[0], np.cumsum(kind == 2)])
    keep = word.copy()
    keep[1:] |= word[:-1]  # one space after each word
    kept = np.concatenate([[0], np.cumsum(keep)])
    codes = np.where(word, raw, 32)[keep].astype(np.uint64)
    firsts = np.concatenate([[0], ends])
    return codes, kept[firsts], letters[ends] - letters[firsts[:-1]]


def _rolling(codes: np.ndarray, order: int, first: np.ndarray) -> list[np.ndarray]:
    """h[n]: a hash of the n characters that end at each position, n from 0; before a text's start (`first`: where texts begin, and
    the end of the last one) come spaces."""
    out, acc, power = [np.zeros(len(codes), np.uint64)], np.zeros(len(codes), np.uint64), 1
    for n in range(order):
        shifted = np.full(len(codes), 32, np.uint64)
        shifted[n:] = codes[: len(codes) - n] if n else codes
        for d in range(n):
            at = first[:-1] + d
            shifted[at[at < first[1:]]] = 32
        acc = acc + th.mix(shifted + np.uint64(77)) * np.uint64(power)
        power = power * _STEP & th.MASK
        out.append(acc ^ _SALT[n])
    return out


def _contexts(h: list[np.ndarray], n: int, first: np.ndarray) -> np.ndarray:
    """The hash of the n - 1 characters before each position."""
    out = np.empty(len(h[0]), np.uint64)
    if len(out):
        out[1:] = h[n - 1][:-1]
        out[np.append(first[:-1][first[:-1] < first[1:]], 0)] = _rolling(np.full(1, 32, np.uint64), n - 1, np.array([0, 1]))[n - 1][0]
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def _hashed(grams: np.ndarray) -> np.ndarray:
    """The hash, as `_rolling` has it, of each row's characters."""
    n = grams.shape[1]
    acc, power = np.zeros(len(grams), np.uint64), 1
    for d in range(n):
        acc = acc + th.mix(grams[:, n - 1 - d].astype(np.uint64) + np.uint64(77)) * np.uint64(power)
        power = power * _STEP & th.MASK
    return acc ^ _SALT[n - 1] if n else acc


def count_grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of all texts, a row of code points each, and how often they occur; before each text come spaces."""
    codes, first, _ = characters(texts)
    padded = np.insert(codes, np.repeat(first[:-1], order - 1), 32)
    place = np.arange(len(codes)) + (order - 1) * np.repeat(np.arange(1, len(texts) + 1), np.diff(first))
    present = np.zeros(0x110000, bool)
    present[padded.astype(np.int64)] = True
    alphabet = np.flatnonzero(present)
    bits = max(1, int(len(alphabet) - 1).bit_length())
    if bits * order > 64:  # more characters than a packed number can tell
        return np.unique(np.stack([padded[place - d] for d in range(order - 1, -1, -1)], 1), axis=0, return_counts=True)
    small = np.zeros(0x110000, np.uint64)
    small[alphabet] = np.arange(len(alphabet), dtype=np.uint64)
    small = small[padded.astype(np.int64)]
    keys = np.zeros(len(place), np.uint64)
    for d in range(order - 1, -1, -1):
        keys = keys << np.uint64(bits) | small[place - d]
    keys, counts = np.unique(keys, return_counts=True)
    shifts = np.arange(order - 1, -1, -1).astype(np.uint64) * np.uint64(bits)
    return alphabet[(keys[:, None] >> shifts & np.uint64((1 << bits) - 1)).astype(np.int64)].astype(np.uint64), counts


class Model:
    """The languages' models in shared sorted arrays, of sample texts or of `count_grams` of each language's texts."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER) -> None:
        self._build({lang: count_grams(texts, order) for lang, texts in samples.items()}, order)

    @classmethod
    def of_counts(cls, counted: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Model:
        model = cls.__new__(cls)
        model._build(counted, order)
        return model

    def _build(self, counted: dict[str, tuple[np.ndarray, np.ndarray]], order: int) -> None:
        self.order, self.languages = order, sorted(counted)
        n_lang = len(self.languages)
        grams: list[list] = [[] for _ in range(order + 1)]  # by order: for each language (hashes, counts, contexts, suffixes)
        for lang in self.languages:
            chars, counts = counted[lang]
            keys, pick = np.unique(_hashed(chars), return_index=True)
            chars, counts = chars[pick], counts[pick]
            for n in range(order, 0, -1):
                suffix = _hashed(chars[:, 1:])
                grams[n].append((keys, counts.astype(float), _hashed(chars[:, :-1]), suffix))
                if n > 1:  # continuation counts: the distinct n-grams that end in each (n - 1)-gram
                    keys, pick, counts = np.unique(suffix, return_index=True, return_counts=True)
                    chars = chars[pick, 1:]
        self.keys, self.logp, self.contexts, self.backoff = [np.zeros(0, np.uint64)], [np.zeros((0, n_lang), np.float32)], [np.zeros(0, np.uint64)], [np.zeros((0, n_lang), np.float32)]
        below = np.full((0, n_lang), 0.0)
        self.floor = np.empty(n_lang, np.float32)
        for n in range(1, order + 1):
            keys = np.unique(np.concatenate([g[0] for g in grams[n]]))
            seen = np.unique(np.concatenate([g[2] for g in grams[n]]))
            context, suffix = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
            for g in grams[n]:
                at = np.searchsorted(keys, g[0])
                context[at], suffix[at] = g[2], g[3]
            p, gamma = np.zeros((len(keys), n_lang)), np.ones((len(seen), n_lang))
            lower = below[np.searchsorted(self.keys[n - 1], suffix)] if n > 1 else None
            for j, (k, c, ctx, _) in enumerate(grams[n]):
                at, where = np.searchsorted(keys, k), np.searchsorted(seen, ctx)
                total, types = np.bincount(where, c, len(seen)), np.bincount(where, minlength=len(seen))
                n1, n2 = float((c == 1).sum()), float((c == 2).sum())
                discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5
                known = total > 0
                gamma[known, j] = discount * types[known] / total[known]
                p[at, j] = np.maximum(c - discount, 0) / total[where]
                if n == 1:
                    self.floor[j] = np.log(1.0 / (len(keys) + 1))
            g_of = gamma[np.searchsorted(seen, context)]
            p += g_of * (lower if n > 1 else np.exp(self.floor)[None, :])
            below = p
            self.keys.append(keys)
            self.logp.append(np.log(np.maximum(p, 1e-30)).astype(np.float32))
            self.contexts.append(seen)
            self.backoff.append(np.log(np.maximum(gamma, 1e-30)).astype(np.float32))
        self.temperature, self.mean, self.limit = 1.0, np.zeros(n_lang), np.full(n_lang, np.inf)

    def log_probabilities(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each character's log probability in each language; `first` has where the texts begin, and the end."""
        h = _rolling(codes, self.order, first)
        out = np.zeros((len(codes), len(self.languages)), np.float32)
        left = np.arange(len(codes))
        for n in range(self.order, 0, -1):
            at, hit = _find(self.keys[n], h[n][left])
            if hit.all():
                out[left] += self.logp[n][at]
                return out
            out[left[hit]] += self.logp[n][at[hit]]
            left = left[~hit]
            at, hit = _find(self.contexts[n], _contexts(h, n, first)[left])
            out[left[hit]] += self.backoff[n][at[hit]]
        out[left] += self.floor
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nats a character in each language, characters, letters) of each text."""
        codes, first, letters = characters(texts)
        sums = np.zeros((len(texts), len(self.languages)))
        block = max(1 << 14, (1 << 21) // max(1, len(self.languages)))
        for a in range(0, len(codes), block):
            lead = min(a, self.order)
            inside = first[(first > a - lead) & (first < min(len(codes), a + block))] - (a - lead)
            part = codes[a - lead : a + block]
            lp = self.log_probabilities(part, np.concatenate([[0], inside, [len(part)]]))[lead:]
            i, j = np.searchsorted(first, a, "right") - 1, np.searchsorted(first, min(len(codes), a + block), "left")
            cuts = np.clip(first[i:j], a, None) - a
            rows = np.flatnonzero(np.diff(np.append(cuts, len(lp))) > 0)
            if len(rows):
                sums[i + rows] += np.add.reduceat(lp, cuts[rows], axis=0, dtype=np.float64)
        n = np.diff(first)
        return -sums / np.maximum(n, 1)[:, None], n, letters

    def _excess(self, h: np.ndarray, n: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Nats a character above the language's mean, shrunk as if that mean had been seen over PRIOR more characters."""
        return (h - self.mean[j]) * n / (n + PRIOR)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text; `und`, 0 and True without a letter."""
        h, n, letters = self.cross_entropies(texts)
        best = h.argmin(1)
        z = -h * np.minimum(n, 200)[:, None] * self.temperature
        z -= z.max(1, keepdims=True)
        score = 1 / np.exp(z).sum(1)
        none = letters == 0
        own = h[np.arange(len(h)), best]
        rejected = none | (self._excess(own, n, best) > self.limit[best])
        return [UNKNOWN if x else self.languages[i] for x, i in zip(none, best, strict=True)], np.where(none, 0.0, score), rejected


def _strings(grams: np.ndarray) -> pa.Array:
    """Rows of code points as strings."""
    size = (1 + (grams >= 0x80).astype(np.int32) + (grams >= 0x800) + (grams >= 0x10000)).sum(1)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(grams), pa.py_buffer(offsets), pa.py_buffer(grams.astype("<u4").tobytes().decode("utf-32-le").encode()))


def counts(rows: DataFrame) -> DataFrame:
    """lang, half, gram, n: how often each n-gram occurs in the texts of `rows` (lang, half, text) of a language and a half."""

    def run(batches):
        for batch in batches:
            for part in th.slices(batch.select(["lang", "half", "text"]), "text", most=4 << 20):
                groups: dict[tuple[str, int], list[str]] = {}
                for lang, half, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    groups.setdefault((lang, half), []).append(text)
                for (lang, half), texts in groups.items():
                    grams, n = count_grams(texts)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), half, np.int32)), _strings(grams), pa.array(n.astype(np.int64))], names=["lang", "half", "gram", "n"])

    return rows.mapInArrow(run, "lang string, half int, gram string, n long").groupBy("lang", "half", "gram").agg(F.sum("n").alias("n"))


def _losses(rows: DataFrame, halves: list[Model]) -> DataFrame:
    """lang, own (nats a character in it), chars and the loss at each temperature of every row, by the model of the other half, where that
    has the language."""
    shared = rows.sparkSession.sparkContext.broadcast(halves)

    def run(batches):
        for batch in batches:
            for part in th.slices(batch.select(["lang", "half", "text"]), "text", most=2 << 20):
                lang, half, text = (c.to_pylist() for c in part.columns)
                for k, model in enumerate(shared.value):
                    index = {x: j for j, x in enumerate(model.languages)}
                    at = [i for i, x in enumerate(lang) if half[i] != k and x in index]
                    if at:
                        h, n, _ = model.cross_entropies([text[i] for i in at])
                        truth = np.array([index[lang[i]] for i in at])
                        own, loss = h[np.arange(len(at)), truth], []
                        for t in TEMPERATURES:
                            z = -h * np.minimum(n, 200)[:, None] * t
                            z -= z.max(1, keepdims=True)
                            loss.append(np.log(np.exp(z).sum(1)) - z[np.arange(len(at)), truth])
                        yield pa.RecordBatch.from_arrays([pa.array([lang[i] for i in at], pa.string()), pa.array(own), pa.array(n.astype(np.int64)), *map(pa.array, loss)], names=["lang", "own", "chars", *(f"loss{i}" for i in range(len(loss)))])

    return rows.mapInArrow(run, "lang string, own double, chars long" + "".join(f", loss{i} double" for i in range(len(TEMPERATURES))))


def fit(spark: SparkSession, docs: DataFrame) -> Model | None:
    """A model from all rows of `docs` (text, lang) with a language and a letter, whole texts; None without any.

    Null and `und` are no languages. The driver holds the n-grams' counts, as many as there are different ones in each language, not
    the rows. Each row calibrates by the model of the other half; a language that only one half has is never rejected.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).withColumn("half", F.pmod(F.xxhash64("text", F.lit(17)), F.lit(2)).cast("int"))
    rows = rows.filter(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").rlike(r"\p{L}"))
    got = counts(rows).toArrow()
    if not got.num_rows:
        return None
    chars = np.frombuffer("".join(got["gram"].to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
    n, half, lang = got["n"].to_numpy(), got["half"].to_numpy(), got["lang"].combine_chunks().dictionary_encode()
    names, of = lang.dictionary.to_pylist(), lang.indices.to_numpy()
    order = np.lexsort((half, of))
    bounds = np.searchsorted(2 * of[order] + half[order], np.arange(2 * len(names) + 1))
    parts = [{x: (chars[at], n[at]) for j, x in enumerate(names) if len(at := order[bounds[2 * j + k] : bounds[2 * j + k + 1]])} for k in (0, 1)]
    whole = {x: order[bounds[2 * j] : bounds[2 * j + 2]] for j, x in enumerate(names)}
    model = Model.of_counts({x: _added(chars[at], n[at]) for x, at in whole.items()})
    if not all(parts):
        return model
    losses = materialize(spark, _losses(rows, [Model.of_counts(p) for p in parts]), "losses")
    sums = losses.groupBy("lang").agg(F.sum(F.col("own") * F.col("chars")).alias("own"), F.sum("chars").alias("chars"), *(F.sum(f"loss{i}").alias(f"loss{i}") for i in range(len(TEMPERATURES)))).toArrow().sort_by("lang")
    if sums.num_rows:
        model.temperature = TEMPERATURES[int(np.argmin([np.sum(sums[f"loss{i}"].to_numpy()) for i in range(len(TEMPERATURES))]))]
        mean = {x: a / b for x, a, b in zip(*(sums[c].to_pylist() for c in ("lang", "own", "chars")), strict=True)}
        model.mean = np.array([mean.get(x, 0.0) for x in model.languages])
        means = spark.createDataFrame(list(mean.items()), "lang string, mean double")
        over = F.ceil((F.col("own") - F.col("mean")) * F.col("chars") / (F.col("chars") + PRIOR) * BINS)
        bins: dict[str, list[tuple[int, int]]] = {}
        for r in losses.join(F.broadcast(means), "lang").groupBy("lang", over.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect():
            bins.setdefault(r["lang"], []).append((r["bin"], r["n"]))
        for x, some in bins.items():
            some.sort()
            upto = np.cumsum([k for _, k in some])
            at = int(np.searchsorted(upto, upto[-1] - 1 - int(ODD * upto[-1]), "right"))
            model.limit[model.languages.index(x)] = max(LEAST, SLACK * some[at][0] / BINS)
    release(spark, losses)
    return model


def _added(chars: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of both halves with the sums of their counts."""
    _, first, where = np.unique(_hashed(chars), return_index=True, return_inverse=True)
    return chars[first], np.bincount(where, n)


def identify(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` (text and any other columns) with lang_pred, score and rejected.

    Null, empty and letterless texts get `und`, score 0 and rejected; so does every text without a model. Whole texts count.
    A column of these three names in the input is replaced. Ties go to the first language in sorted order.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in th.slices(batch.set_column(at, "text", batch.column(at).cast(pa.string())), most=2 << 20):
                texts = [t or "" for t in part.column(at).to_pylist()]
                langs, score, rejected = m.predict(texts) if m else ([UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(np.round(score, 6)), pa.array(rejected)], names=[*part.schema.names, "lang_pred", "score", "rejected"])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return docs.mapInArrow(run, schema)
