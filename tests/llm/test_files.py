"""Shards and WARC files: exact round trips."""

import io
import time

import pytest
from pyspark.sql import functions as F
from trailmark.llm import sharding, warc
from trailmark.session import table


def same(a, b):
    key = lambda df: sorted(map(str, df.collect()))
    return key(a) == key(b.select(*a.columns))


def test_store(spark, tmp_path, odd, none):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    store = sharding.ShardStore(spark, str(tmp_path / "store"), target=400_000, fan_in=8)
    for i in range(3):
        assert store.append(docs.filter(F.col("doc_id") % 3 == i)) == i + 1
    small = store.manifest().count()
    assert store.compact() == 4
    shards = store.manifest().collect()
    assert len(shards) < small / 3 and all(s.bytes <= 500_000 or s.rows < 5 for s in shards) and sum(s.rows for s in shards) == docs.count()
    assert same(docs, store.read()) and same(docs.filter("doc_id % 3 = 0"), store.read(1))  # older versions can still be read
    store.append(odd.select(*docs.columns))
    assert same(docs.unionByName(odd.select(*docs.columns)), store.read())
    version = store.append(none.select(*docs.columns))
    store.vacuum()
    assert store.versions() == [version] and same(docs.unionByName(odd.select(*docs.columns)), store.read())
    with pytest.raises(sharding.Conflict):
        store._commit(spark.createDataFrame([], sharding._DELTA), version)
    with pytest.raises(ValueError):
        store.manifest(1)


def test_shard_query(spark, odd, none):
    assert sharding.shard(spark, odd).count() == 10 and sharding.shard(spark, odd.limit(1)).count() == 1
    empty = sharding.shard(spark, none)
    assert empty.count() == 0 and empty.columns == sharding.shard(spark, odd.limit(1)).columns


def test_settled_store(spark, tmp_path, monkeypatch):
    """Compaction goes on until no two shards of up to half the target are left, across tiers too; versions beyond a snapshot agree."""
    monkeypatch.setattr(sharding, "SNAPSHOT", 2)
    docs = table(spark, "/root/testdata/sf0.01", "documents").repartition(2)
    target = 300_000
    store = sharding.ShardStore(spark, str(tmp_path / "store"), target, 4)
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(20))
    for some in ((0, 8), (8, 14), (14, 20)):
        store.append(docs.filter((turn >= some[0]) & (turn < some[1])))
    assert store.versions() == [1, 2, 3] and store.manifest().agg(F.sum("rows")).first()[0] == docs.count() and store.manifest(2).count() < store.manifest().count()
    version = store.settle()
    assert store.versions() == list(range(1, version + 1)) and store.compact() == store.compact(True) == version
    assert same(docs.filter((turn >= 0) & (turn < 8)), store.read(1))  # settling leaves older versions to their readers
    store.vacuum(2)
    assert store.versions() == [version - 1, version]
    shards = store.manifest().collect()
    assert sum(s.bytes * 2 <= target for s in shards) <= 1 and all(s.bytes <= 1.5 * target or s.rows < 5 for s in shards)
    tiny = docs.filter("doc_id < 3")
    store.append(tiny)
    store.append(docs.filter("doc_id >= 3 AND doc_id < 60").coalesce(1))
    assert store.settle() >= version + 3
    assert sum(s.bytes * 2 <= target for s in store.manifest().collect()) <= 1
    assert same(docs.unionByName(docs.filter("doc_id < 60")), store.read())


def test_store_race(spark, tmp_path, monkeypatch):
    """A writer between its write and its commit loses nothing to another one that compacts, commits and cleans up meanwhile."""
    rows = spark.range(400).selectExpr("id AS doc_id", "repeat('word ', 20) AS text")
    a, b = (sharding.ShardStore(spark, str(tmp_path / "store"), target=20_000, fan_in=4) for _ in range(2))
    a.append(rows.filter("doc_id < 100"))
    commit = sharding.ShardStore._commit

    def late(self, changes, version, part=None, dropped=None):
        if self is a:
            monkeypatch.setattr(sharding.ShardStore, "_commit", commit)
            b.append(rows.filter("doc_id >= 100 AND doc_id < 200"))
            b.settle()
            b.vacuum()
        return commit(self, changes, version, part, dropped)

    monkeypatch.setattr(sharding.ShardStore, "_commit", late)
    a.append(rows.filter("doc_id >= 200 AND doc_id < 300"))
    assert same(rows.filter("doc_id < 300"), b.read())
    # A compaction whose shards another one has merged meanwhile is planned anew; one beside an arrival is kept.
    monkeypatch.setattr(sharding.ShardStore, "_commit", late)
    a.compact()
    assert same(rows.filter("doc_id < 300"), a.read().select("doc_id", "text").distinct())
    assert a.manifest().agg(F.sum("rows")).first()[0] == 400 and not list((tmp_path / "store" / "claims").glob("[ac]*"))
    version = a.settle()
    a.vacuum()
    assert a.versions() == [version] and a.read().count() == 400
    # Files of a commit that are gone are an error for readers and writers, never fewer rows.
    part = a.manifest().first()["part"]
    a._delete(a._part(part))
    with pytest.raises(sharding.Missing):
        a.read()
    with pytest.raises(sharding.Missing):
        a._commit(spark.createDataFrame([], sharding._DELTA), version + 1, "a00000099nothing")
    # The remains of a job that died stay while its claim may be of use.
    rows.selectExpr("doc_id", "text", "0L AS _slot").write.partitionBy("_slot").parquet(a._part("a00000100dead"))
    a._claim("a00000100dead")
    a.vacuum()
    assert "a00000100dead" in a._parts()
    monkeypatch.setattr(sharding, "CLAIM_S", -1)
    a.vacuum()
    assert "a00000100dead" not in a._parts()


def test_slots_follow_partitions(spark, tmp_path):
    """One large partition beside small ones does not make the shards of the small ones tiny; a row above the target is a shard."""
    small = spark.range(0, 400, 1, 8).selectExpr("id AS doc_id", "repeat('word ', 20) AS text")
    large = spark.range(1000, 7000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 20) AS text")
    store = sharding.ShardStore(spark, str(tmp_path / "store"), target=200_000, fan_in=8)
    store.append(small.unionByName(large))
    sizes = [r["bytes"] for r in store.manifest().collect()]
    assert min(sizes) > 25_000 / 8 and max(sizes) < 2 * 25_000 and sum(r["rows"] for r in store.manifest().collect()) == 6400
    store.append(spark.range(1).selectExpr("-1L AS doc_id", "repeat('long ', 100000) AS text"))
    store.settle()
    assert store.read().count() == 6401 and store.read().filter("doc_id = -1 AND shard_bytes > 500000").count() == 1


def test_store_columns(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "store"))
    assert store.read().count() == 0 and store.settle() == 0
    store.append(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, more long"))
    store.append(spark.createDataFrame([(2, "b")], "doc_id int, text string"))
    assert sorted((r.doc_id, r.text, r.more) for r in store.read().collect()) == [(1, "a", 2), (2, "b", None)]
    with pytest.raises(ValueError, match="other"):
        store.append(spark.createDataFrame([(2, "b", 1)], "doc_id long, text string, other long"))


def test_warc_round_trip(spark, tmp_path):
    pages = table(spark, "/root/testdata/sf0.001", "pages").unionByName(spark.createDataFrame([(None, None, None), (7, "u\r\nX: y", ""), (8, "v", "é\r\n\r\nWARC/1.1")], "page_id long, url string, html string"))
    responses = warc.responses(pages)
    warc.write(responses, str(tmp_path / "w"))
    again = warc.read(spark, str(tmp_path / "w"))
    names = [n for n in warc.NAMES if n not in ("page_id", "target_uri")]
    assert same(responses.select(*names), again)
    derived = warc.derive(again).drop("page_id")
    assert derived.count() == 2 * pages.count()
    same_ids = warc.page_derivatives(pages.filter("page_id is not null and page_id <> 7")).select("refers_to").distinct()
    assert same_ids.join(responses.select(F.col("record_id").alias("refers_to")), "refers_to", "left_anti").count() == 0
    assert same(warc.derive(responses), warc.page_derivatives(pages))


def test_warc_contents():
    source = warc.response(1, "http://x/", '<title>T &amp; U</title><script>no</script><p>Hello <b>wor</b>ld&eacute;<!-- x --></p><a href="/y">link</a>')
    meta, text = warc.derivatives(source)
    assert text[-1].decode() == "Hello worldé\nlink" and text[3] == meta[3] == source[2] and text[1] == "conversion"
    fields = dict(x.split(": ", 1) for x in meta[-1].decode().strip().split("\r\n"))
    assert fields["title"] == "T & U" and fields["outlink"] == "/y" and fields["source-digest"] == source[8] and fields["http-content-type"].startswith("text/html")
    assert f"WARC-Refers-To: {source[2]}" in text[9] and f"WARC-Source-Payload-Digest: {source[8]}" in text[9]


def test_markup_left_open_is_read_in_one_pass():
    """A megabyte of a tag that never ends takes well under a second, and its text is kept or dropped as for a short one."""
    for piece in ("<a ", "<div ", "<title>", "<script", "<!--", "</script ", "<a href='", "<p x=\"", "<style>", "<", "<!"):
        page = piece * ((1 << 20) // len(piece))
        began = time.perf_counter()
        text, links = warc.plain_text(page), warc.outlinks(page)
        warc._visible("<title>x</title>" + page)
        assert time.perf_counter() - began < 1, piece
        assert links == [] and (text == "" or piece in page)
    assert warc.plain_text("a<!-- b > c") == "a" and warc.plain_text("x <b>y</b> <i z") == "x y <i z"
    assert warc._visible("<script>1</script>a<title>T</title><title>U</title><noscript>n") == ("\na\n\n\n", "T")
    assert warc.outlinks('<a href=x><A class="q" HREF = "y&amp;z">t</a><a name=u><a href=\'\'>') == ["x", "y&z", ""]


def test_malformed_files(spark, tmp_path, none):
    good = warc.response(1, "u", "<p>text</p>")
    whole = {"headers": good[9], "block": good[-1]}
    plain = whole["headers"].encode() + b"\r\n" + whole["block"] + b"\r\n\r\n"
    files = {
        "a.warc": b"WARC/1.1\r\nWARC-Type: response\r\n\r\nsome block\r\n\r\n" + plain,
        "b.warc": plain + plain[:-40],
        "c.warc.gz": warc.member(whole) * 3 + warc.member(whole)[:-30],
        "d.warc": b"what is this\r\n" + plain,
        "e.warc": b"",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = warc.read(spark, str(tmp_path)).collect()
    assert sorted((r.warc_type, r.content_type.split(":")[0] if r.warc_type == "malformed" else "") for r in rows) == [
        ("malformed", "cut short"), ("malformed", "damaged gzip"), ("malformed", "no Content-Length"), ("malformed", "no record"), *[("response", "")] * 6,
    ]
    assert warc.derive(warc.read(spark, str(tmp_path))).count() == 12
    assert warc.page_derivatives(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    many = warc.member({"headers": good[9], "block": b""}).replace(b"", b"") * 20_000
    began = time.perf_counter()
    assert sum(1 for _ in warc.parse(io.BytesIO(many))) == 20_000 and time.perf_counter() - began < 5


def test_long_pages_and_extra_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>" + "word " * 300_000, "x"), (1, "u", "<p>" + "word " * 300_000, "x"), (None, None, None, None)], "page_id long, url string, html string, headers string")
    got = warc.page_derivatives(pages).filter("warc_type = 'conversion'").collect()
    assert sorted(len(r.block) for r in got) == [0, 1_499_999, 1_499_999]
