"""Phrase collocations by Toivonen's sampling method.

A sample of the documents proposes phrases: all words, and all phrases of up to `most` words, that are frequent in it. A full pass then counts,
exactly and over all documents, the proposed phrases and their negative border: phrases that are not proposed but whose two
parts without the last and without the first word are. Words have no parts, so the first pass counts them all. If no phrase of the border
turns out frequent, no frequent phrase is missing. Otherwise phrases that contain it may be frequent too: an expansion pass proposes
all phrases that are frequent so far, adds the border of the proposal, the border of that, and so on until it is closed, and counts what
was not counted before. So the result does not depend on the sample; a bad one costs time.

Proposals are kept as bit maps, one for each length, indexed by a hash of the phrase. Their size follows the number of proposed phrases up to
`BITS`; a phrase that is taken for a proposed one only because of its bit is counted for nothing, but its count is exact. So the
broadcast is bounded, however many phrases there are, while all counts stay in shuffled tables. A task counts the phrases of some
megabytes of text with array sorts. What is left is nearly distinct, so it is shuffled as it is, a key of language and phrase and a count, and
added up behind the shuffle only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.llm import texthash as th
from trailmark.session import materialize, release

LEAST, MOST, SHOWN = 10, 3, 2000
#: One of so many documents is in the sample; a phrase is proposed if the sample has it so often.
SAMPLE, PROPOSED = 8, 2
#: Largest bit map: 2 ** BITS bits, 16 MB. Text bytes whose phrases a task counts at a time.
BITS, CHUNK = 27, 4 << 20
SALTS = 64
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_SPLIT = _BREAK.copy()
_SPLIT[[0x20, 0x09]] = True


@dataclass(frozen=True)
class Proposal:
    """Bit maps of proposed phrases by length: maps[k - 1] has a bit for each phrase of k words."""

    maps: tuple[np.ndarray, ...]

    def has(self, k: int, hashes: np.ndarray) -> np.ndarray:
        bits = self.maps[k - 1]
        at = hashes >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
        return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _next(longer: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with a word more at the end."""
    return th.mix(longer * np.uint64(0x9E3779B97F4A7C15) + word)


def _keys(named: pa.Array, words: pa.Array, ids: list[np.ndarray]) -> pa.Array:
    """Phrases of the words of these numbers, the first one with its language before it."""
    parts = [named.take(pa.array(ids[0])), *(words.take(pa.array(i)) for i in ids[1:])]
    return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if len(parts) > 1 else parts[0]


def _vocabulary(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    lengths = ends - starts
    offs = np.concatenate([[0], np.cumsum(lengths)])
    raw = th.LOWER[buf[np.repeat(starts - offs[:-1], lengths) + np.arange(offs[-1])]]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offs.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())])


def chunk_counts(langs: pa.Array, column: pa.Array, most: int, passes: list[Proposal] | None):
    """(key, c) tables of the phrases in some texts: language, tab, phrase, and its count; without a phrase the number of words.

    `passes` are the proposals so far: what the last one lets in and no earlier one did is counted, words in the first pass only. A
    proposal lets a phrase in if it has both of its parts; one after the first, that makes an expansion pass, also if it lets them in itself
    and they have not been counted yet. Without `passes` all phrases are counted.
    """
    buf, offs = th.text_buffers(column)
    starts, ends, first = th.word_spans(buf, offs, _SPLIT)
    if not len(starts):
        return
    names, code = np.unique(np.array(langs.to_pylist(), dtype=object), return_inverse=True)
    row = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(first))
    h = th.mix(th.word_hashes(buf, starts, ends) ^ _salts(names)[code[row]])
    _, example, word = np.unique(h, return_index=True, return_inverse=True)
    words = _vocabulary(buf, starts[example], ends[example])
    language = pa.array([f"{n}\t" for n in names.tolist()], pa.large_string())
    named = pc.binary_join_element_wise(language.take(pa.array(code[row[example]])), words, pa.scalar("", pa.large_string()))

    def table(keys: pa.Array, n: np.ndarray):
        return pa.RecordBatch.from_arrays([keys.cast(pa.string()), pa.array(n.astype(np.int64))], names=["key", "c"])

    if not passes or len(passes) == 1:
        yield table(language, np.bincount(code[row], minlength=len(names)))
        yield table(named, np.bincount(word, minlength=len(example)))
    breaks = np.searchsorted(np.flatnonzero(_BREAK[buf]), starts)
    joined = (row[1:] == row[:-1]) & (breaks[1:] == breaks[:-1])
    del breaks, row, starts, ends
    # Where the phrases of k - 1 words begin, their hashes and numbers, the words of each number, and which passes have let them in.
    place, hashes, number, spelled = np.arange(len(h)), h, word, None
    let_in = [np.ones(len(h), bool)] * len(passes or [None])
    for k in range(2, most + 1):
        after = np.flatnonzero((place[1:] == place[:-1] + 1) & joined[place[1:] + k - 3])
        nowhere = np.zeros(len(place), bool)
        parts = let_in
        if passes:
            before = [np.logical_or.reduce([nowhere, *let_in[:i]]) for i in range(len(passes))]
            parts = [x & (p.has(k - 1, hashes) | ~old) if i and k > 2 else x & p.has(k - 1, hashes) for i, (p, x, old) in enumerate(zip(passes, let_in, before, strict=True))]
        let_in = [x[after] & x[after + 1] for x in parts]
        place, hashes = place[after], _next(hashes[after], h[place[after] + k - 1])
        both = number[after].astype(np.int64) << 32 | word[place + k - 1]
        counted = let_in[-1] & ~np.logical_or.reduce([np.zeros(len(after), bool), *let_in[:-1]])
        distinct, n = np.unique(both[counted], return_counts=True)
        for a in range(0, len(distinct), 1 << 18):
            yield table(_keys(named, words, _spelled(distinct[a : a + (1 << 18)], spelled)), n[a : a + (1 << 18)])
        if k < most:
            some = np.flatnonzero(np.logical_or.reduce(let_in))
            distinct, number = np.unique(both[some], return_inverse=True)
            spelled = _spelled(distinct, spelled)
            place, hashes, let_in = place[some], hashes[some], [x[some] for x in let_in]


def _spelled(both: np.ndarray, stems: list[np.ndarray] | None) -> list[np.ndarray]:
    """The word numbers of phrases given as (number of the phrase without its last word, last word)."""
    head, last = both >> 32, both & 0xFFFFFFFF
    return [*(s[head] for s in stems), last] if stems is not None else [head, last]


def _salts(names: np.ndarray) -> np.ndarray:
    """A number for each language; mixed twice, so that a word of one language is never another one of the language of that name."""
    buf, offs = th.text_buffers(pa.array(names.tolist(), pa.string()))
    return th.mix(th.word_hashes(buf, offs[:-1], offs[1:]) + np.uint64(0xA0761D6478BD642F))


def _counted(docs: DataFrame, most: int, passes: list[Proposal] | None, least: int) -> DataFrame:
    """k, lang, phrase, c of the phrases that occur `least` times in `docs` (lang, text), and the words of each language (k = 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(passes)

    def run(batches):
        langs, texts, held = [], [], 0
        for batch in batches:
            for part in th.slices(batch, "text", most=CHUNK):
                langs.append(part.column(0))
                texts.append(part.column(1).cast(pa.large_string()))
                held += texts[-1].nbytes
                if held >= CHUNK:
                    yield from chunk_counts(pa.concat_arrays(langs), pa.concat_arrays(texts), most, shared.value)
                    langs, texts, held = [], [], 0
        if langs:
            yield from chunk_counts(pa.concat_arrays(langs), pa.concat_arrays(texts), most, shared.value)

    counts = docs.mapInArrow(run, "key string, c long").repartition("key").groupBy("key").agg(F.sum("c").alias("c")).filter(F.col("key").endswith("\t") | (F.col("c") >= least))
    phrase = F.substring_index("key", "\t", -1)  # words hold no tab
    k = F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " ")))
    return counts.select(k.alias("k"), F.expr("substring(key, 1, length(key) - length(substring_index(key, '\t', -1)) - 1)").alias("lang"), phrase.alias("phrase"), "c")


def _hashes(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """The hashes that chunk_counts has for these phrases."""
    buf, offs = th.text_buffers(phrases)
    starts, ends, first = th.word_spans(buf, offs, _SPLIT)
    names, code = np.unique(np.array(langs.to_pylist(), dtype=object), return_inverse=True)
    h = th.mix(th.word_hashes(buf, starts, ends) ^ np.repeat(_salts(names)[code], np.diff(first)))
    out = h[first[:-1]]
    for i in range(1, int(np.diff(first).max(initial=1))):
        more = np.flatnonzero(np.diff(first) > i)
        out[more] = _next(out[more], h[first[:-1][more] + i])
    return out


def _proposal(spark: SparkSession, phrases: DataFrame, most: int) -> Proposal:
    """The bit maps of the phrases (k, lang, phrase) of less than `most` words; cells of 64 bits are put together by Spark."""
    found = {r["k"]: r["n"] for r in phrases.filter(f"k BETWEEN 1 AND {most - 1}").groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    bits = {k: min(BITS, max(16, (32 * found.get(k, 0)).bit_length())) for k in range(1, most)}

    def run(batches):
        for batch in batches:
            h = _hashes(batch.column(1), batch.column(2))
            k = np.asarray(batch.column(0)).astype(np.int64)
            at = h >> np.array([64 - bits.get(x, 16) for x in range(most + 1)], np.uint64)[k]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["k", "cell", "bits"],
            )

    some = phrases.filter(f"k BETWEEN 1 AND {most - 1}").select("k", "lang", "phrase")
    cells = some.mapInArrow(run, "k int, cell long, bits long").groupBy("k", "cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    kind, cell, value = (cells[c].to_numpy() for c in ("k", "cell", "bits"))
    maps = []
    for k in range(1, most):
        words = np.zeros(1 << (bits[k] - 6), np.int64)
        words[cell[kind == k]] = value[kind == k]
        maps.append(words.view(np.uint8))
    return Proposal(tuple(maps))


def _outside(rows: DataFrame, passes: list[Proposal], most: int) -> DataFrame:
    """The rows whose phrases (k, lang, phrase) no proposal has: what the border brought up."""
    shared = rows.sparkSession.sparkContext.broadcast(passes)

    def run(batches):
        for batch in batches:
            k, h = np.asarray(batch.column(0)), _hashes(batch.column(1), batch.column(2))
            new = np.ones(len(k), bool)
            for p in shared.value:
                for x in range(1, most):
                    new[k == x] &= ~p.has(x, h[k == x])
            yield batch.filter(pa.array(new))

    return rows.filter(f"k BETWEEN 1 AND {most - 1}").select("k", "lang", "phrase").mapInArrow(run, "k int, lang string, phrase string")


def frequent_phrases(spark: SparkSession, docs: DataFrame, least: int = LEAST, most: int = MOST, sample: int = SAMPLE, proposed: int = PROPOSED) -> DataFrame:
    """k, lang, phrase, c: every phrase of up to `most` words with c >= `least` occurrences in the texts of a language, and the number of words (k = 0, phrase '').

    The table is complete and exact for any sample; `sample` and `proposed` only decide how much each pass counts.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    part = docs.filter(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0) if sample > 1 else docs
    tried = materialize(spark, _counted(part, most - 1, None, proposed), "sampled")  # only phrases with a word to spare are part of others
    passes = [_proposal(spark, tried, most)]
    release(spark, tried)
    found = materialize(spark, _counted(docs, most, passes, least), "counted")
    if _outside(found, passes, most).isEmpty():
        return found
    passes.append(_proposal(spark, found, most))
    return found.unionByName(materialize(spark, _counted(docs, most, passes, least), "expanded"))


def _decimal(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def scored(counts: DataFrame, most: int = MOST) -> DataFrame:
    """lang, phrase, k, a, l, r, score of the phrases of two words or more in `counts` (k, lang, phrase, c): their lowest-scoring cuts.

    A cut after the first words has l = f(first part) and r = f(rest) and scores floor(10**6 * a * a / (l * r)), in decimals of 38
    digits, which is exact up to 10**16 occurrences; of equal scores the smallest cut counts. Phrases that stand in a longer one
    with at least half of their occurrences are dropped.
    """
    words = F.split("phrase", " ")
    phrases = counts.filter("k > 1").withColumnRenamed("c", "a")
    cuts = phrases.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "phrase", "k", "a", "cut", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("left"), F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"),
    )
    known = counts.filter(f"k BETWEEN 1 AND {most - 1}")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("c").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("phrase").alias("right"), F.col("c").alias("r")), ["lang", "right"])
    cuts = cuts.withColumn("la", _decimal("a")).withColumn("ll", _decimal("l")).withColumn("lr", _decimal("r"))
    value = F.expr("(CAST(1000000 AS DECIMAL(7,0)) * CAST(la * la AS DECIMAL(31,0))) div CAST(ll * lr AS DECIMAL(38,0))")
    best = cuts.withColumn("score", value).groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    inner = F.expr(f"flatten(transform(sequence(2, {most - 1}), n -> CASE WHEN k > n THEN transform(sequence(1, k - n + 1), i -> array_join(slice(split(phrase, ' '), i, n), ' ')) ELSE array() END))")
    if most > 2:
        longer = phrases.filter("k > 2").select("lang", F.col("a").alias("f"), F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
        best = best.join(longer, ["lang", "phrase"], "left").filter("f IS NULL OR 100 * f < 50 * a")
    return best.select("lang", "phrase", "k", "a", "b.l", "b.r", "b.score")


def collocations(spark: SparkSession, docs: DataFrame, least: int = LEAST, most: int = MOST, shown: int = SHOWN) -> DataFrame:
    """The first `shown` phrases of each language of `docs` (lang, text) by score, a and phrase: lang, rank, phrase, a, l, r, n, score.

    Texts are split at `.,;:!?` and line ends into pieces and those at spaces and tabs into words, A-Z in lower case; a null language is `und`,
    a null text empty. f counts the contiguous occurrences in pieces, overlaps included, n all words of the language. Repeated
    rows count each; a text of any length is taken whole; other columns are ignored; an empty table gives no row.
    """
    counts = frequent_phrases(spark, docs, least, most)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    rows = scored(counts, most).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for keys in (["lang", "salt"], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= shown)
    total = counts.filter("k = 0").groupBy("lang").agg(F.sum("c").alias("n"))
    return rows.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql() -> str:
    """DuckDB SQL with the rows of `collocations` for the table documents."""
    return f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_extract_all(text, '[^.,;:!?\\x0A-\\x0D]+')) AS piece FROM d),
ws AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM ws GROUP BY lang),
grams AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS phrase FROM ws, range(1, 4) t(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::BIGINT AS c, string_split(phrase, ' ') AS w FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
parts AS MATERIALIZED (SELECT lang, phrase, k, c AS a, unnest(range(1, k)) AS cut, w FROM f WHERE k > 1),
sides AS MATERIALIZED (SELECT lang, phrase, k, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail FROM parts),
cuts AS (SELECT s.lang, s.phrase, s.k, s.a, s.cut, l.c AS l, r.c AS r, (1000000::HUGEINT * s.a * s.a) // (l.c::HUGEINT * r.c) AS score
  FROM sides s JOIN f l ON l.lang = s.lang AND l.phrase = s.head JOIN f r ON r.lang = s.lang AND r.phrase = s.tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, phrase, max(c) AS c FROM (SELECT lang, c, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM f WHERE k = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE c IS NULL OR 100 * c < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, phrase, a, l, r, score::BIGINT AS score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
JOIN total USING (lang) WHERE rank <= {SHOWN}"""
