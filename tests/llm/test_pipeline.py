"""The pipeline against its parts, stage by stage, by brute force where there is one."""

import corpus_pipeline
from test_near_dedup import brute
from test_packing import check
from trailmark.session import materialize, table


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = materialize(spark, stage(spark, docs, sf), "stage")
        assert docs.columns == columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        kept[name] = ids
        if name == "near-duplicates":
            want = brute([(r.doc_id, r.text) for r in before.collect()], 5, 80)
            assert ids == {d for d, (_, c) in want.items() if c == d}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(pieces, rows)
    assert len(kept["quality classifier"]) > 700 and len(kept["language id"]) > 0.99 * len(kept["quality classifier"])
    whole = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in whole.select("doc_id").distinct().collect()} == kept["decontamination"]


def test_odd_and_empty_tables(spark, odd, none, tmp_path):
    bench = spark.createDataFrame([(1, "the same text of some words that comes twice in here"), (None, None)], "item_id long, text string")
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, None), (6, None, 1)], "doc_id long, quality int, toxic int")
    for name, docs, want in (("odd", odd, {None, 4, 7}), ("none", none, set())):
        sf = str(tmp_path / name)
        docs.write.parquet(f"{sf}/documents.parquet")
        bench.write.parquet(f"{sf}/benchmark.parquet")
        (labels if name == "odd" else labels.limit(0)).write.parquet(f"{sf}/labels.parquet")
        assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == want
