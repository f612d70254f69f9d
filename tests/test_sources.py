"""Result tables, imports, the frame store, streams and the command surface."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from trailmark import api
from trailmark.plans.cells import cells
from trailmark.sources import framestore, tables
from trailmark.streaming import poses as streaming

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_csv_round_trip(spark, tmp_path):
    data = [(f, b, p, float(f + b), float(f * 2), 0.5) for f in range(30) for b in range(2) for p in ("nose", "tail")]
    poses = spark.createDataFrame(data, "frame long, body long, part string, x double, y double, likelihood double")
    tables.write_csv(poses, str(tmp_path / "t"))
    assert rows(tables.read_csv(spark, str(tmp_path / "t"))) == rows(poses)
    api.convert_tracks(spark, str(tmp_path / "t"), str(tmp_path / "u"))
    assert rows(tables.sniff(spark, str(tmp_path / "u"))) == rows(poses)
    with pytest.raises(ValueError):
        tables.check([("Body1", "nose", "x")])


def test_import(spark, tmp_path):
    text = "scorer,m,m,m,m,m,m,m,m,m\nindividuals,a,a,a,b,b,b,b,b,b\nbodyparts,n,n,n,n,n,n,t,t,t\ncoords,x,y,likelihood,x,y,likelihood,x,y,likelihood\n0,1,2,.5,3,4,.6,9,9,.9\n2,5,6,.7,7,8,.8,9,9,.9\n"
    (tmp_path / "f.csv").write_text(text)
    got = rows(tables.import_csv(spark, str(tmp_path / "f.csv")))
    assert got == [(0, 0, "n", 1.0, 2.0, 0.5), (0, 1, "n", 3.0, 4.0, 0.6), (1, 0, "n", 0.0, 0.0, 0.0), (1, 1, "n", 0.0, 0.0, 0.0), (2, 0, "n", 5.0, 6.0, 0.7), (2, 1, "n", 7.0, 8.0, 0.8)]


def test_frame_store(spark, tmp_path):
    c = cells(spark, SF).groupBy("frame", "part", "x", "y").agg(F.max("p").alias("p"), F.max("ox").alias("ox"), F.max("oy").alias("oy")).filter("p > 0.01")
    path = str(tmp_path / "s.tmfs")
    framestore.write(c, path, 24, 32)
    back = framestore.read(spark, path)
    near = lambda df: sorted((r.frame, r.part, r.x, r.y, float(np.float32(r.p)), r.ox, r.oy) for r in df.collect())
    assert near(back) == near(c)
    assert near(back.filter("frame >= 10 AND frame < 20 AND p > 0.3")) == near(c.filter("frame >= 10 AND frame < 20 AND p > 0.3"))
    framestore.unpack(framestore.pack(path), str(tmp_path / "t.tmfs"))
    assert framestore.read(spark, str(tmp_path / "t.tmfs")).count() == c.count()
    dense = spark.createDataFrame([(0, "a", x, y, 0.5) for x in range(8) for y in range(6)], "frame long, part string, x long, y long, p double")
    framestore.write(dense, path, 6, 8)
    assert framestore.read(spark, path).count() == 48
    with pytest.raises(ValueError):
        (tmp_path / "bad").write_bytes(b"nothing")
        framestore.read_header(str(tmp_path / "bad"))


def test_store_header_and_trailer(spark, tmp_path):
    """Crop box, skeleton, names, blocks without cells, a store behind a video, chunks, and the exact bytes of a small store."""
    import struct
    import zlib

    path, video = str(tmp_path / "s.store"), str(tmp_path / "v.mp4")
    c = spark.createDataFrame([(0, "b", 1, 2, 0.5, 0.25, -1.0), (700, "a", 0, 0, 0.75, 0.0, 0.0)], "frame long, part string, x long, y long, p double, ox double, oy double")
    framestore.write(c, path, 6, 8, 4.0, frames=1300, fps=25.0, video=(100, 200), crop=(3, 5), skeleton=[(0, 1)])
    h = framestore.read_header(path)
    assert (h.frames, h.height, h.width, h.stride, h.parts, h.fps, h.video_height, h.video_width, h.crop, h.skeleton) == (1300, 6, 8, 4.0, ["a", "b"], 25.0, 100, 200, (3, 5), [(0, 1)])
    (tmp_path / "v.mp4").write_bytes(b"some video" * 1000)
    framestore.append_to(path, video)
    for p in (path, video):
        assert rows(framestore.read(spark, p)) == rows(c)
    chunks = list(framestore.unpacked(framestore.pack(path), 400))
    assert [b.num_rows for b in chunks] == [1, 1, 0, 0] and next(framestore.unpacked(framestore.pack(path))).num_rows == 2
    with pytest.raises(ValueError, match="crop"):
        framestore.write(c, path, 60, 80, 4.0, video=(100, 200), crop=(3, 5))
        framestore.read_header(path)
    framestore.write(c.filter("frame = 0"), path, 6, 8, 4.0)
    data = (tmp_path / "s.store").read_bytes()
    body = zlib.compress(struct.pack("<QIIfff", 1, 2, 1, 0.5, -1.0, 0.25), 6)
    want = b"DLFSDLFH" + struct.pack("<QIIIddIIII", 1, 1, 6, 8, 30.0, 4.0, 24, 32, 2**32 - 1, 2**32 - 1) + b"DBPN" + b"\x01\x00b" + b"FLUP" + struct.pack("<Q", 0) + b"FDAT" + struct.pack("<BQ", 3, len(body)) + body
    assert data == want + b"DLFE" + struct.pack("<Q", len(want))


def test_tracking_a_store(spark, tmp_path):
    """Both predictors from a store of a map larger than the test view's, in video pixels with offsets."""
    path = str(tmp_path / "s.store")
    data = [(f, part, 40 + f + 8 * i + k, 50 + 6 * i, 0.9 - 0.1 * i, 2.0, -1.0) for f in range(12) for i in range(2) for k, part in enumerate("ab")]
    c = spark.createDataFrame(data, "frame long, part string, x long, y long, p double, ox double, oy double")
    framestore.write(c, path, 80, 100, 4.0)
    best = {(r.frame, r.part, r.body): (r.x, r.y) for r in api.track_store(spark, path, 2, "ArgMax").collect()}
    assert best == {(f, part, i): ((40 + f + 8 * i + k) * 4 + 2 + 2, (50 + 6 * i) * 4 + 2 - 1) for f in range(12) for i in range(2) for k, part in enumerate("ab")}
    assert api.track(spark, framestore.read(spark, path), 1, "ArgMax").count() == 24
    got = {}
    for r in api.track_store(spark, path, 2, "Segmented", downscaling=2.0).collect():
        got.setdefault((r.frame, r.part), {})[r.body] = (r.x, r.y)
    bodies = {b: i for b, (x, y) in got[0, "a"].items() for i in range(2) if y == pytest.approx(2 * ((50 + 6 * i) * 4 + 1))}
    assert sorted(bodies.values()) == [0, 1]
    for (f, part), found in got.items():
        for b, (x, y) in found.items():
            i = bodies[b]
            assert (x, y) == (pytest.approx(2 * ((40 + f + 8 * i + "ab".index(part)) * 4 + 4), abs=1e-3), pytest.approx(2 * ((50 + 6 * i) * 4 + 1), abs=1e-3))


def test_api_surface(spark, tmp_path):
    c = cells(spark, SF)
    with pytest.raises(ValueError, match="no pass"):
        api.run_passes(c, ["Nothing"])
    with pytest.raises(ValueError, match="no setting"):
        api.run_passes(c, [["TopCells", {"much": 3}]])
    got = api.run_passes(c, [["Threshold", {"threshold": 0.2}], ["TopCells", {"most": 5}], ["ClusterFrames", {"individuals": 2}], "Centroids"])
    assert set(got.columns) == {"frame", "part", "ind", "x", "y", "p"} and got.count() > 0
    assert api.pairs(["t"], ["a", "b"]) == [("t", "a"), ("t", "b")] and api.predictors()["Segmented"]["settings"]["segment_size"] == 200
    with pytest.raises(ValueError):
        api.pairs(["a", "b"], ["c", "d", "e"])

    class Still:
        """Every point stays at the origin."""

        several, settings, calls = False, {}, []

        def open(self):
            self.calls.append("open")

        def close(self):
            self.calls.append("close")

        def __call__(self, spark, cells, individuals, settings, meta):
            return cells.select("frame", "part").distinct().selectExpr("*", "0L body", "0D x", "0D y", "1D likelihood")

    still = Still()
    api.register("Still", still)
    try:
        assert api.track(spark, c, 1, "Still").count() > 0 and still.calls == ["open", "close"]
        with pytest.raises(ValueError, match="one individual"):
            api.track(spark, c, 2, "Still")
        with pytest.raises(ValueError, match="already"):
            api.register("Still", still)
    finally:
        del api.PREDICTORS["Still"]
    name = api.export_maps(c.groupBy("frame", "part", "x", "y").agg(F.max("p").alias("p")), str(tmp_path), "video", 24, 32, parts=["view"], threshold=0.2)
    assert name.endswith("video_maps.store") and {r.part for r in framestore.read(spark, name).select("part").distinct().collect()} == {"view"}


def test_streams(spark, tmp_path):
    from trailmark.operators import frames

    c = cells(spark, SF)
    c.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(c.schema).parquet(str(tmp_path / "in"))
    q = streaming.batch_poses(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 1)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == frames.argmax_pose(c).count()
    q = streaming.store(stream, str(tmp_path / "all"), str(tmp_path / "cp2"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "all")).count() == c.count()


def test_online_tracking(spark, tmp_path):
    path = [(t, "a", 3 + t, 5, 0.9) for t in range(12)] + [(t, "a", 20, 20, 0.2) for t in range(12)]
    for k in range(3):
        spark.createDataFrame([r for r in path if r[0] // 4 == k], "frame long, part string, x long, y long, p double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("frame long, part string, x long, y long, p double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.online(stream, 1, 2.0).writeStream.format("memory").queryName("online").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.frame: (r.x, r.y) for r in spark.table("online").collect()}
    assert got == {t: (3.5 + t, 5.5) for t in range(11)}


def test_commands(spark):
    c = cells(spark, SF)
    poses = api.track(spark, c, 1, "ArgMax")
    assert set(poses.columns) == {"frame", "part", "body", "x", "y", "likelihood"} and api.annotate(poses).count() <= poses.count()
    with pytest.raises(ValueError):
        api.track(spark, c, 1, "Nothing")
    with pytest.raises(ValueError):
        api.Settings(segment_size=-1)
    with pytest.raises(TypeError):
        api.track(spark, c, 1, "ArgMax", unknown=1)


def test_tracked_poses(spark):
    """Two individuals on parallel paths, two parts each: complete, and identities do not change."""
    rng = np.random.default_rng(3)
    data = []
    for t in range(40):
        for body in range(2):
            for part, dx in (("head", 0), ("tail", 4)):
                data.append((t, part, 4 + dx + t // 2, 4 + 12 * body, float(rng.uniform(0.7, 0.95)), 0.0, 0.0, len(data)))
    c = spark.createDataFrame(data, "frame long, part string, x long, y long, p double, ox double, oy double, event_id long")
    got = api.track(spark, c, 2, segment_size=10).toPandas()
    assert len(got) == 40 * 4
    for _, g in got.groupby(["body", "part"]):
        assert g["y"].nunique() == 1
    assert (got.groupby(["body", "frame"])["y"].nunique() == 1).all()


def test_workspace_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from trailmark import session

    kept = session.materialize(spark, spark.range(3), "kept")
    assert session.workspace(spark) in kept._trailmark_path and kept.count() == 3
    session.release(spark, kept)
    remote = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        session.workspace(remote)


def test_windows_sessions_and_repeats(spark, tmp_path):
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    schema = "event_id long, ts timestamp, part string, p double"
    data = [(i, at(m), "a", 0.5) for i, m in enumerate((0, 10, 20, 100, 110, 400))] + [(0, at(0), "a", 0.5), (99, at(5000), "z", 0.5)]
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(make, name, mode="append"):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert sorted(r.cells for r in run(lambda s: streaming.sessions(s), "sessions") if r.part == "a") == [1, 2, 4]
    assert sorted(r.cells for r in run(lambda s: streaming.windowed(s, length="2 hours"), "tumbling") if r.part == "a") == [1, 6]
    assert sum(r.cells for r in run(lambda s: streaming.windowed(s, length="2 hours", slide="1 hour"), "sliding") if r.part == "a") == 14
    assert len(run(lambda s: streaming.once(s), "once")) == 7
    spark.range(4).selectExpr("id frame").write.parquet(str(tmp_path / "f"))
    assert streaming.complete(spark, str(tmp_path / "f"), 4).count() == 4
    with pytest.raises(ValueError, match="of 9"):
        streaming.complete(spark, str(tmp_path / "f"), 9)


def test_state(spark, tmp_path):
    from trailmark.sources import state

    path = str(tmp_path / "state")
    cells_ = spark.createDataFrame([(0, "a", 0, 3, 2, 0.5), (0, "a", 0, 1, 2, 0.25), (1, "a", 0, 5, 5, 1.0)], "frame long, part string, ind long, x long, y long, p double")
    flags = spark.createDataFrame([(1, "a", 0, True, True), (2, "b", 1, True, False)], "frame long, part string, ind long, ignore_clustering boolean, disable_occluded boolean")
    with pytest.raises(ValueError):
        state.load(spark, path)
    first = state.records(cells_, cells_.filter("frame = 0"), flags)
    assert state.save(spark, first, path) == 1
    assert sorted((r.frame, r.ignore_clustering, len(r.src), len(r.orig)) for r in state.load(spark, path).collect()) == [(0, False, 2, 2), (1, True, 1, 0), (2, True, 0, 0)]
    assert rows(state.cells_of(state.load(spark, path)).select(*cells_.columns)) == rows(cells_)
    changed = state.records(cells_.filter("frame = 0 AND x = 3"), cells_.filter("frame = 0"), flags.limit(0))
    assert state.save(spark, changed, path) == 2
    (tmp_path / "state" / ".tmp-broken").mkdir()  # a save that broke off
    assert sorted((r.frame, len(r.src)) for r in state.load(spark, path).collect()) == [(0, 1), (1, 1), (2, 0)]
    assert sorted((r.frame, len(r.src)) for r in state.load(spark, path, 1).collect()) == [(0, 2), (1, 1), (2, 0)]
    meta = {"fps": 30.0, "parts": ["a", "b"], "crop": None, "more": {"far": float("inf")}}
    assert state.decode_metadata(state.encode_metadata(meta)) == meta
    with pytest.raises(TypeError, match="more"):
        state.encode_metadata({"more": object()})


def test_import_instances(spark):
    frames = spark.createDataFrame([(0, 0, 0, 0, 2), (1, 0, 2, 2, 4), (2, 1, 0, 4, 5), (3, 0, 3, 5, 5)], "frame_id long, video long, frame_idx long, instances_from long, instances_to long")
    instances = spark.createDataFrame(
        [(0, 5, 0, 1.0, 0, 2), (1, 5, 1, 0.9, 0, 2), (2, 5, 0, 1.0, 2, 4), (3, 6, 1, 0.9, 2, 4), (4, 5, 0, 1.0, 4, 6)], "position long, track long, kind long, score double, points_from long, points_to long"
    )
    points = spark.createDataFrame(
        [(k, i, float(10 * k + i), 1.0, not (k == 1 and i >= 2), None if k == 0 else 0.75) for k in range(2) for i in range(6)], "kind long, position long, x double, y double, visible boolean, score double"
    )
    got = rows(tables.import_instances(frames, instances, points, ["n", "t"]))
    assert [r for r in got if r[3:] != (0.0, 0.0, 0.0)] == [(0, 0, "n", 10.0, 1.0, 0.75), (0, 0, "t", 11.0, 1.0, 0.75), (2, 0, "n", 2.0, 1.0, 1.0), (2, 0, "t", 3.0, 1.0, 1.0)]
    assert len(got) == 8  # the second track has no visible point


def test_store_sink(spark, tmp_path):
    """The store as a sink: any order of frames, empty frames, what is refused, and nothing left by a job that fails."""
    import os

    fields = "frame long, part string, x long, y long, p double, ox double, oy double"
    data = [(f, part, (f * 7 + k) % 8, f % 6, 0.25 + k / 4, 0.5 * k, -1.0) for f in range(0, 2000, 3) for k, part in enumerate("ab")]
    c = spark.createDataFrame(data, fields)
    spark.dataSource.register(framestore.FrameStore)
    path, whole = str(tmp_path / "s.store"), str(tmp_path / "t.store")
    options = framestore.Layout(6, 8, ["a", "b"], 4.0, frames=2100).options()
    put = lambda df, mode="overwrite", **more: df.write.format("framestore").mode(mode).options(**{**options, **more}).save(path)
    framestore.write(c, whole, 6, 8, 4.0, frames=2100)
    want = (tmp_path / "t.store").read_bytes()
    for together in (c.repartition(5, "frame").sortWithinPartitions("frame"), c.repartitionByRange(3, "frame").sortWithinPartitions(F.desc("frame")), c.coalesce(1).sortWithinPartitions("frame")):
        put(together)
        assert (tmp_path / "s.store").read_bytes() == want and sorted(os.listdir(tmp_path)) == ["s.store", "t.store"]
    assert rows(framestore.read(spark, path)) == sorted(data)
    put(c.drop("ox", "oy").filter("frame < 0"))
    assert framestore.read(spark, path).count() == 0 and framestore.read_header(path).frames == 2100
    put(c.filter("p < 0"), frames="0")
    assert framestore.read_header(path).frames == 0
    before = (tmp_path / "s.store").read_bytes()
    good = c.coalesce(1).sortWithinPartitions("frame")
    bad = spark.createDataFrame([(7, "c", 0, 0, 0.5, 0.0, 0.0)], fields)
    for df, more, message in (
        (c.coalesce(1).sortWithinPartitions("part"), {}, "not together"),
        (good, {"frames": "1000"}, "does not have"),
        (good.union(bad), {}, "no part"),
        (good.union(bad.withColumn("part", F.lit(None).cast("string"))), {}, "no part"),
        (good.union(bad.withColumns({"part": F.lit("a"), "y": F.lit(6)})), {}, "beyond"),
        (good.union(bad.withColumn("frame", F.lit(None).cast("long"))), {}, "does not have"),
        (good.drop("part"), {}, "without"),
    ):
        with pytest.raises(Exception, match=message):
            put(df, **more)
        assert (tmp_path / "s.store").read_bytes() == before and sorted(os.listdir(tmp_path)) == ["s.store", "t.store"]
    with pytest.raises(Exception, match="appended"):
        put(good, "append")
    with pytest.raises(Exception, match="option parts"):
        good.write.format("framestore").mode("overwrite").options(height=6, width=8).save(path)


def test_stores_as_text(spark, tmp_path):
    fields = "frame long, part string, x long, y long, p double, ox double, oy double"
    one, two = ([(f, "a", f % 8, f % 6, 0.5, 0.0, 0.0) for f in frames] for frames in ((0, 5, 700), (1,)))
    for name, data in (("one", one), ("two", two)):
        framestore.write(spark.createDataFrame(data, fields), str(tmp_path / name), 6, 8)
    texts = framestore.packed(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.text for r in texts.collect()} == {n: framestore.pack(str(tmp_path / n)) for n in ("one", "two")}
    got = framestore.packed_cells(texts.union(spark.createDataFrame([("none", None)], "path string, text string")), 100)
    assert sorted((r.path.rsplit("/", 1)[1], *r[1:]) for r in got.collect()) == [("one", *r) for r in one] + [("two", *r) for r in two]
