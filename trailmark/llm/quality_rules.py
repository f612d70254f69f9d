"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Every rule compares an integer statistic of the text with a multiple of another one. Its cutoffs form a fixed sequence
from lenient to strict. On the labelled holdout, for each stratum (language), rule and cutoff, the exact binomial tail
P(X <= rejected good documents; n good documents, alpha) tests the hypothesis that more than alpha of the good
documents are rejected. A sequence is certified as far as all its tests so far have p <= delta / (strata * rules): fixed
sequence testing within, Bonferroni between the sequences, so with probability 1 - delta no certified cutoff
rejects more than alpha of its stratum's good documents. alpha is the total allowance divided by the number of rules, so
the rules together keep it too. Of the certified cutoffs the one with the best balance of rejected bad against rejected
good documents is used, or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
TOTAL_RISK = 0.05
DELTA = 0.1
GOOD_WEIGHT = 10

# Fixed values: (rule, left side, right side, cutoffs from lenient to strict); rejected if left > cutoff * right.
RULES = (
    ("repeat_words", "100 * n_repeat_words", "n_words", (19, 15, 12, 10, 8, 5, 3, 1)),
    ("symbols", "100 * n_symbols", "n_words", (100, 80, 60, 40, 20, 10, 5, 2)),
    ("dup_lines", "100 * n_dup_lines", "n_lines", (90, 80, 60, 50, 40, 30, 20, 10)),
    ("upper_case", "100 * n_upper", "word_chars", (90, 80, 70, 60, 50, 40, 30, 20)),
    ("exclamation", "100 * n_exclaim", "n_words", (100, 80, 60, 40, 20, 10, 5, 2)),
    ("long_words", "word_chars", "n_words", (40, 30, 20, 15, 12, 10, 9, 8)),
    ("short_words", "-10 * word_chars", "n_words", (-10, -12, -15, -18, -20, -23, -26, -30)),
)


def _n_repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside a 5-word window that the text has twice or more, from the column `words`.

    Windows are hashed and, only where a text repeats one, sorted with their positions; equal neighbours are repeated
    windows, and every one adds the words up to the next, five at most. Each step takes whole arrays as arguments: a lambda
    that refers to another array would compute it again for each element.
    """
    n = F.greatest(F.size("_h") - 4, F.lit(0))
    shifted = [F.slice("_h", i, n).alias(f"a{i}") for i in range(1, 6)]
    df = df.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_w", F.transform(F.arrays_zip(*shifted), lambda z: F.xxhash64(*[z[f"a{i}"] for i in range(1, 6)])))
    again = F.size(F.array_distinct("_w")) < F.size("_w")
    df = df.withColumn("_s", F.when(again, F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    m = F.size("_s") - 1
    df = df.withColumn("_e", F.when(F.col("_s").isNotNull(), F.zip_with(F.slice("_s", 1, m), F.slice("_s", 2, m), lambda a, b: a["h"] == b["h"])))
    no = F.array(F.lit(False))
    df = df.withColumn("_p", F.zip_with("_s", F.zip_with(F.concat(no, "_e"), F.concat("_e", no), lambda a, b: a | b), lambda s, f: F.when(f, s["i"])))
    df = df.withColumn("_p", F.array_sort(F.filter("_p", lambda i: i.isNotNull())))
    following = F.concat(F.slice("_p", 2, F.size("_p") - 1), F.array(F.element_at("_p", -1) + 5))
    df = df.withColumn("_g", F.when(F.col("_p").isNotNull(), F.zip_with("_p", following, lambda p, q: F.least(F.lit(5), q - p))))
    total = F.aggregate("_g", F.lit(0).cast("long"), lambda a, g: a + g)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("_h", "_w", "_s", "_e", "_p", "_g")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the integer statistics of each row's whole text; a null text has no words and no lines."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("null")).alias("stratum"), text.alias("text"))
    df = df.withColumn("words", F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    df = _n_repeat_words(df)

    def count(pattern: str) -> Column:
        return (F.length("text") - F.length(F.regexp_replace("text", pattern, ""))).cast("long")

    blank = count(r"[\x20\x09-\x0D]+")
    return df.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - blank).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("lines").cast("long").alias("n_lines"),
        count("[A-Z]+").alias("n_upper"),
        count("!+").alias("n_exclaim"),
    )


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def binomial_tail(k: str, n: str, alpha: float) -> Column:
    """P(X <= k) for n trials of probability alpha, exact; 1 where k >= n * alpha, which is above any level of interest."""
    log_choose = f"CASE WHEN {k} > 0 THEN aggregate(sequence(1L, {k}), 0D, (a, i) -> a + ln(({n} - {k} + i) / i)) ELSE 0D END"
    series = (
        f"CASE WHEN {k} > 0 THEN aggregate(reverse(sequence(1L, {k})), struct(1D AS t, 1D AS s), "
        f"(a, j) -> struct(a.t * j * {1 - alpha!r}D / (({n} - j + 1) * {alpha!r}D) AS t, a.s + a.t * j * {1 - alpha!r}D / (({n} - j + 1) * {alpha!r}D) AS s)).s ELSE 1D END"
    )
    return F.expr(f"CASE WHEN {n} = 0 OR {k} >= {n} * {alpha!r}D THEN 1D ELSE exp({log_choose} + {k} * ln({alpha!r}D) + ({n} - {k}) * ln({1 - alpha!r}D)) * {series} END")


def cutoffs(stats: DataFrame, labels: DataFrame, total_risk: float = TOTAL_RISK, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff of the certified and chosen cutoffs; a row for each stratum and rule at most.

    The tests take documents for independent trials: rows that repeat a document (its id and its statistics) count once.
    """
    alpha = total_risk / len(RULES)
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality").cast("long")).alias("good")).filter("good is not null")
    hits = [
        F.sum(F.expr(f"CASE WHEN {left} > {c} * {right} AND good {sign} THEN 1L ELSE 0L END")).alias(f"{rule}_{i}_{name}")
        for rule, left, right, cs in RULES
        for i, c in enumerate(cs)
        for name, sign in (("good", ">= 1"), ("bad", "< 1"))
    ]
    counted = (
        stats.filter(f"NOT ({BASE_FAILED})").join(marks, "doc_id").distinct().groupBy("stratum").agg(F.sum(F.expr("CASE WHEN good >= 1 THEN 1L ELSE 0L END")).alias("n"), *hits)
    )
    tests = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(c).cast("long").alias("cutoff"), F.col(f"{rule}_{i}_good").alias("good"), F.col(f"{rule}_{i}_bad").alias("bad"))
        for rule, _, _, cs in RULES
        for i, c in enumerate(cs)
    ])
    cells = counted.select("stratum", "n", F.explode(tests).alias("t")).select("stratum", "n", "t.*").withColumn("p", binomial_tail("good", "n", alpha))
    strata = counted.agg(F.count(F.lit(1)).alias("strata"))
    return (
        cells.join(F.broadcast(strata))
        .withColumn("passed", F.col("p") <= delta / (F.col("strata") * len(RULES)))
        .groupBy("stratum", "rule")
        .agg(
            F.min(F.when(~F.col("passed"), F.col("step"))).alias("failed"),
            F.collect_list(F.struct((F.col("bad") - GOOD_WEIGHT * F.col("good")).alias("gain"), (-F.col("step")).alias("step"), "cutoff")).alias("all"),
        )
        .select("stratum", "rule", F.array_max(F.expr("filter(all, x -> (failed is null or -x.step < failed) and x.gain > 0)")).alias("best"))
        .filter("best is not null")
        .select("stratum", "rule", F.col("best.cutoff").alias("cutoff"))
    )


def quality_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame, total_risk: float = TOTAL_RISK, delta: float = DELTA) -> DataFrame:
    """A row for each row of `docs` (doc_id, text, lang, ...) with the statistics, base_failed, kept and failed_rules.

    base_failed: under 10 words, or over a fifth of the words in repeated 5-word windows. kept: neither that nor a rule of
    the document's language with a certified cutoff. `labels` (doc_id, quality): 1 is good, 0 is bad, null is no label;
    of several labels the largest counts. Null texts count as empty (base_failed), a null language is a stratum of its own,
    a null doc_id has no label; repeated rows stay. A stratum with too few labels to certify anything loses nothing by rules.
    """
    stats = materialize(spark, statistics(docs), "quality")
    chosen = cutoffs(stats, labels, total_risk, delta).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("at"))
    failed = F.array(*[F.expr(f"CASE WHEN {left} > at['{rule}'] * {right} THEN '{rule}' END") for rule, left, right, _ in RULES])
    # A stratum is there only if a rule is certified, which takes hundreds of labels (790 good ones with the defaults): a small table.
    return (
        stats.join(F.broadcast(chosen), "stratum", "left")
        .withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("failed_rules", F.array_join(F.when(F.col("at").isNotNull(), failed).otherwise(F.array().cast("array<string>")), ","))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("failed_rules") == "")).alias("kept"), "failed_rules")
    )


def oracle_sql(total_risk: float = TOTAL_RISK, delta: float = DELTA) -> str:
    """The same rows over tables `documents` and `labels`, for DuckDB."""
    alpha = total_risk / len(RULES)
    rules = " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, {r} AS rank, {i} AS step, {c} AS cutoff" for r, (rule, _, _, cs) in enumerate(RULES) for i, c in enumerate(cs)
    )
    sides = " ".join(f"WHEN rule = '{rule}' THEN {left} > cutoff * {right}" for rule, left, right, _ in RULES)
    count = lambda p: f"length(t) - length(regexp_replace(t, '{p}', '', 'g'))"
    return f"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, 'null') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
g AS (SELECT doc_id, i, words[i:i+4] AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM c WHERE n > 1) GROUP BY doc_id),
s AS (SELECT w.doc_id, stratum, len(words) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
  {count("[#*$%&|<>]")} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  len(lines) AS n_lines, {count("[A-Z]+")} AS n_upper, {count("!+")} AS n_exclaim FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, {BASE_FAILED} AS base_failed FROM s),
rules AS ({rules}),
m AS (SELECT doc_id, max(quality) AS good FROM labels GROUP BY doc_id HAVING max(quality) IS NOT NULL),
held AS (SELECT DISTINCT b.*, good FROM b JOIN m USING (doc_id) WHERE NOT base_failed),
n AS (SELECT stratum, count(*) FILTER (good >= 1) AS n FROM held GROUP BY stratum),
cells AS (SELECT stratum, rule, step, cutoff, count(*) FILTER (hit AND good >= 1) AS good, count(*) FILTER (hit AND good < 1) AS bad
  FROM (SELECT held.*, rule, step, cutoff, CASE {sides} END AS hit FROM held CROSS JOIN rules) GROUP BY ALL),
p AS (SELECT cells.*, CASE WHEN n = 0 OR cells.good >= n * {alpha!r} THEN 1 ELSE
  list_sum(list_transform(range(0, cells.good + 1), lambda i: exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - lgamma(n - i + 1) + i * ln({alpha!r}) + (n - i) * ln({1 - alpha!r})))) END
  <= {delta!r} / ((SELECT count(*) FROM n) * {len(RULES)}) AS passed FROM cells JOIN n USING (stratum)),
f AS (SELECT stratum, rule, coalesce(min(step) FILTER (NOT passed), 1000) AS failed FROM p GROUP BY ALL),
chosen AS (SELECT stratum, rule, arg_max(cutoff, (bad - {GOOD_WEIGHT} * good) * 100 - step) AS cutoff FROM p JOIN f USING (stratum, rule)
  WHERE step < failed AND bad > {GOOD_WEIGHT} * good GROUP BY ALL),
rejected AS (SELECT doc_id, string_agg(rule, ',' ORDER BY rank) AS failed_rules FROM (SELECT b.*, chosen.rule, chosen.cutoff, (SELECT min(rank) FROM rules WHERE rules.rule = chosen.rule) AS rank
  FROM b JOIN chosen USING (stratum)) WHERE CASE {sides} END GROUP BY doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules IS NULL AS kept, coalesce(failed_rules, '') AS failed_rules
FROM b LEFT JOIN rejected USING (doc_id)
"""
