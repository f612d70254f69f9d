"""License scans by diagonal voting, in DataFrame and SQL functions only.

The rolling word k-gram hashes of every document are held against those of the templates in the pass that reads it, and where
they agree the words themselves are taken along: a row for each document is written, with its few places. These are joined to the
k-gram positions of the templates by their words, so that no vote rests on a hash. A match at document word i and template word j
votes for diagonal i - j; votes are counted per document, template and diagonal before the shuffle ends. A phrase stands
wherever its diagonal has all votes. A longer notice is accepted where a diagonal has enough of its k-grams, or neighbouring
diagonals (words put in or left out) merged have, if their span is not much longer than the template.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.session import materialize

# Phrases with their labels, and longer notices with theirs (words after lower-casing, punctuation apart).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-notice"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
)
PHRASE_K, NOTICE_K = 2, 4
NEAR = 4
COVERED = 0.7
#: Words of the text before lower-casing; the class is that of the contract with A-Z added.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _grams(words: str, k: int):
    """The hashes of all windows of k words of an array of word hashes; shifted copies are zipped, so no lambda reads another array."""
    n = F.greatest(F.size(words) - (k - 1), F.lit(0))
    return F.transform(F.arrays_zip(*[F.slice(words, i + 1, n).alias(f"a{i}") for i in range(k)]), lambda z: F.xxhash64(*[z[f"a{i}"] for i in range(k)]))


def templates(spark: SparkSession) -> DataFrame:
    """template, label, phrase, k, n_grams, at, gram (its words), hash: a row for each k-gram position; a fixed table of some hundred rows."""
    rows = ", ".join(f"({i}, '{text}', '{label}', {i < len(PHRASES)}, {PHRASE_K if i < len(PHRASES) else NOTICE_K})" for i, (text, label) in enumerate(PHRASES + NOTICES))
    one = spark.sql(f"SELECT *, split(text, ' ') AS words FROM VALUES {rows} AS t(template, text, label, phrase, k)").withColumn("n_grams", F.size("words") - F.col("k") + 1)
    placed = one.select("template", "label", "phrase", "k", "n_grams", "words", F.explode(F.expr("sequence(0, n_grams - 1)")).alias("at"))
    hashed = [placed.filter(F.col("k") == k).withColumn("h", F.transform(F.slice("words", F.col("at") + 1, k), lambda w: F.xxhash64(w))).withColumn("hash", _grams("h", k)[0]) for k in (PHRASE_K, NOTICE_K)]
    return hashed[0].unionByName(hashed[1]).select("template", "label", "phrase", "k", "n_grams", "at", F.array_join(F.slice("words", F.col("at") + 1, F.col("k")), " ").alias("gram"), "hash")


def _places(k: int, known: list[int]):
    """Where the k-gram hashes of column h are among those known."""
    return F.filter(F.transform(_grams("h", k), lambda g, i: F.when(g.isin(*known), i)), lambda i: i.isNotNull())


def _taken(places: str, k: int):
    """(place, k, gram) with the words at each place, A-Z in lower case."""
    words = lambda i: F.translate(F.array_join(F.slice("words", i + 1, k), " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(places, lambda i: F.struct(i.alias("place"), F.lit(k).alias("k"), words(i).alias("gram")))


def license_scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A row for each row of `docs` (doc_id, text, ...): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of the phrases, first_word and last_word are the smallest and largest start (null if none);
    labels has the phrases' and the accepted notices' labels, distinct and sorted; score is 1 with a phrase, else the largest
    share of a notice's k-grams in an accepted span, else 0. Null and empty texts have no words, no place and no label.
    Repeated rows stay, each with its own text's values, whatever their doc_id. Other columns are ignored.
    """
    fixed = templates(spark)
    known: dict[int, list[int]] = {PHRASE_K: [], NOTICE_K: []}
    for r in fixed.select("k", "hash").distinct().collect():
        known[r["k"]].append(r["hash"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = docs.select("doc_id", F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("words")).withColumn("h", F.transform("words", lambda w: F.xxhash64(F.lower(w))))
    placed = hashed.select("doc_id", "words", _places(PHRASE_K, known[PHRASE_K]).alias("p"), _places(NOTICE_K, known[NOTICE_K]).alias("q"))
    rows = placed.select("doc_id", F.size("words").cast("long").alias("n_words"), F.concat(_taken("p", PHRASE_K), _taken("q", NOTICE_K)).alias("hits"))
    rows = materialize(spark, rows.withColumn("uid", F.monotonically_increasing_id()), "hits")
    votes = (
        rows.filter(F.size("hits") > 0).select("uid", F.inline("hits"))
        .join(F.broadcast(fixed), ["k", "gram"])
        .groupBy("uid", "template", "label", "phrase", "n_grams", (F.col("place") - F.col("at")).alias("diagonal"))
        .agg(F.collect_set("at").alias("ats"), F.min("place").alias("low"), F.max("place").alias("high"))
    )
    votes = materialize(spark, votes, "votes")
    base = votes.filter(F.col("phrase") & (F.size("ats") == F.col("n_grams"))).select("uid", "label", F.col("diagonal").alias("start"), F.lit(1.0).alias("share"), "phrase")
    notices = votes.filter(~F.col("phrase"))
    alone = notices.withColumn("share", F.size("ats") / F.col("n_grams")).filter(F.col("share") >= COVERED).select("uid", "label", F.col("low").alias("start"), "share", F.lit(False).alias("phrase"))
    order = "PARTITION BY uid, template ORDER BY diagonal"
    runs = (
        notices.withColumn("fresh", F.expr(f"CASE WHEN diagonal - lag(diagonal) OVER ({order}) <= {NEAR} THEN 0 ELSE 1 END"))
        .withColumn("run", F.expr(f"sum(fresh) OVER ({order})"))
        .groupBy("uid", "template", "label", "n_grams", "run")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("hit"), F.min("low").alias("low"), F.max("high").alias("high"))
        .withColumn("share", F.col("hit") / F.col("n_grams"))
        .filter((F.col("share") >= COVERED) & (F.col("high") - F.col("low") <= 1.5 * (F.col("n_grams") + NOTICE_K)))
        .select("uid", "label", F.col("low").alias("start"), "share", F.lit(False).alias("phrase"))
    )
    found = (
        base.unionByName(alone).unionByName(runs)
        .groupBy("uid")
        .agg(
            F.count(F.when(F.col("phrase"), 1)).alias("n_base"),
            F.min(F.when(F.col("phrase"), F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(F.col("phrase"), F.col("start"))).cast("long").alias("last_word"),
            F.array_join(F.sort_array(F.collect_set(F.when(F.col("phrase"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
            F.max("share").alias("score"),
        )
    )
    return (
        rows.select("doc_id", "uid", "n_words")
        .join(found, "uid", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
            F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"),
        )
    )


def oracle_sql() -> str:
    """The same rows over table `documents`, for DuckDB."""
    rows = ", ".join(f"({i}, '{text}', '{label}', {i < len(PHRASES)}, {PHRASE_K if i < len(PHRASES) else NOTICE_K})" for i, (text, label) in enumerate(PHRASES + NOTICES))
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
t AS (SELECT *, string_split(body, ' ') AS words FROM (VALUES {rows}) AS v(template, body, label, phrase, k)),
tg AS (SELECT template, label, phrase, k, len(words) - k + 1 AS n_grams, j - 1 AS pos, words[j:j+k-1] AS gram FROM (SELECT *, unnest(range(1, len(words) - k + 2)) AS j FROM t)),
dg AS (SELECT doc_id, kk AS k, i - 1 AS word, words[i:i+kk-1] AS gram FROM (SELECT *, unnest(range(1, len(words) - kk + 2)) AS i FROM d CROSS JOIN (VALUES ({PHRASE_K}), ({NOTICE_K})) AS x(kk))),
votes AS (SELECT doc_id, template, label, phrase, n_grams, word - pos AS diagonal, list(DISTINCT pos) AS ats, min(word) AS low, max(word) AS high FROM dg JOIN tg USING (k, gram) GROUP BY ALL),
base AS (SELECT doc_id, label, diagonal AS start, 1.0::DOUBLE AS share, phrase FROM votes WHERE phrase AND len(ats) = n_grams),
fresh AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {NEAR} THEN 0 ELSE 1 END AS fresh FROM votes WHERE NOT phrase),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM fresh),
spans AS (SELECT doc_id, template, label, n_grams, run, len(list_distinct(flatten(list(ats)))) AS hit, min(low) AS low, max(high) AS high FROM run GROUP BY ALL),
found AS (SELECT * FROM base UNION ALL SELECT doc_id, label, low, len(ats) / n_grams, false FROM votes WHERE NOT phrase AND len(ats) / n_grams >= {COVERED} UNION ALL SELECT doc_id, label, low, hit / n_grams, false FROM spans WHERE hit / n_grams >= {COVERED} AND high - low <= 1.5 * (n_grams + {NOTICE_K})),
f AS (SELECT doc_id, count(*) FILTER (phrase) AS n_base, min(start) FILTER (phrase) AS first_word, max(start) FILTER (phrase) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM found GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 6) AS score
FROM d LEFT JOIN f USING (doc_id)
"""
