"""Operators that SQL expresses, against their SQL; and their odd rows."""

import pytest
from compare import difference
from trailmark.llm import licenses, quality_rules, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert difference(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf) == ""


def test_licenses(spark, odd, none):
    text = "Released under the MIT License. See the GNU General\nPublic-License; mit license! Licensed under the Apache License, Version 2.0. mit licenses"
    docs = spark.createDataFrame([(1, text), (1, text), (2, "MIT"), (3, "mit licensé"), (4, "Redistribution and use in source and, if you like, binary forms, with or without modification, are permitted provided that the following conditions are met")], "doc_id long, text string")
    rows = licenses.license_scan(spark, docs).collect()
    assert len(rows) == 5
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_base, by[1].first_word, by[1].base_labels, by[1].labels, by[1].score) == (4, 3, "apache,gpl,mit", "apache,apache-2.0,gpl,mit", 1.0)
    assert by[2].n_base == by[3].n_base == 0 and by[2].first_word is None and by[4].labels == "bsd" and 0.7 <= by[4].score < 1
    got = licenses.license_scan(spark, odd).collect()
    assert len(got) == 10 and all(r.n_base == 0 for r in got)
    assert licenses.license_scan(spark, none).count() == 0


def test_quality_rules(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark, odd, labels).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept and got[4].n_words == 60_000
    assert got[8].n_symbols == 3 and got[5].kept
    assert quality_rules.quality_rules(spark, none, labels).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e x a b c d e\n\nq\nq\nz"), (2, "a a a a a a")], "doc_id long, text string").selectExpr("*", "cast(null as string) lang")
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark, docs, labels).collect()}
    assert (got[1].n_repeat_words, got[1].n_dup_lines) == (10, 1) and got[2].n_repeat_words == 6


def test_binomial_tail(spark):
    from math import comb

    for k, n, a in [(0, 100, 0.05), (2, 100, 0.05), (4, 90, 0.05), (30, 5000, 0.0072)]:
        got = spark.range(1).selectExpr(f"{k}L k", f"{n}L n").select(quality_rules.binomial_tail("k", "n", a)).collect()[0][0]
        want = sum(comb(n, i) * a**i * (1 - a) ** (n - i) for i in range(k + 1))
        assert abs(got - want) < 1e-9 * want + 1e-12


def test_certified_rules_keep_the_risk(spark):
    """Good documents that a rule may reject are few; bad ones that it may catch are caught."""
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(i, words + (" ***" * 90 if i % 10 == 0 else "") + f" n{i}", "en") for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 0 if i % 10 == 0 or i % 1000 == 5 else 1) for i in range(20_000)], "doc_id long, quality int")
    got = quality_rules.quality_rules(spark, docs, labels)
    wrong = got.filter("doc_id % 10 <> 0 and not kept").count()
    assert wrong == 0 and got.filter("doc_id % 10 = 0 and kept").count() == 0


def test_a_notice_after_its_own_beginnings(spark):
    """Repeated first words make one long chain of diagonals; the verbatim notice has every vote on its own diagonal and stays."""
    text = "licensed under cc by " * 4 + "licensed under cc by nc 4 0"
    kelvin = "licensed under the Apache License, version 2.0 and the M\u0130T license and the apac\u212ae license"
    got = {r.doc_id: r for r in licenses.license_scan(spark, spark.createDataFrame([(1, text), (2, kelvin), (2, kelvin)], "doc_id long, text string")).collect()}
    assert got[1].labels == "cc-by-nc-4.0" and got[1].score == 1 and got[2].labels == "apache,apache-2.0" and got[2].n_base == 1


def test_repeated_rows_are_one_trial(spark):
    """500 good documents are too few to certify anything, however often their rows are repeated."""
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(i, words + (" ***" * 90 if i % 10 == 0 else "") + f" n{i}", None if i % 2 else "") for i in range(1000) for _ in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 0 if i % 10 == 0 else 1) for i in range(1000)], "doc_id long, quality int")
    stats = quality_rules.statistics(docs)
    assert {r.stratum for r in stats.select("stratum").distinct().collect()} == {"=", "null"}
    assert quality_rules.cutoffs(stats, labels).count() == 0 and quality_rules.quality_rules(spark, docs, labels).filter("kept").count() == 3600  # a tenth fails the base rule
