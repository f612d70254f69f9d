"""What the solver holds in the end, as planes and as a frame store."""

import pytest
from pyspark.sql import functions as F
from test_videos import CELLS, walk
from trailmark import api
from trailmark.operators import tracking
from trailmark.sources import framestore


def key(df, *more):
    return sorted((*(r[c] for c in more), r.frame, r.part, r.body, r.plane, r.x, r.y, round(r.p, 7), round(r.ox, 9), round(r.oy, 9)) for r in df.collect())


def test_planes_of_poses(spark):
    """The best score of a track is its pose, every body has the source's cells, and pieces of chains hold the same."""
    cells = spark.createDataFrame(walk(30, 7), CELLS)
    run = tracking.prepared(spark, cells, 2, segment_size=10)
    planes = run.planes().collect()
    best: dict = {}
    for r in planes:
        if r.plane == "Frame":
            at = (r.frame, r.part, r.body)
            best[at] = max(best.get(at, (0,)), (r.p, r.x + 0.5 + r.ox, r.y + 0.5 + r.oy))
    sure = [r for r in run.result().collect() if r.likelihood > 0]
    assert len(sure) > 60
    for r in sure:
        p, x, y = best[r.frame, r.part, r.body]
        assert p == pytest.approx(r.likelihood) and (x, y) == pytest.approx((r.x, r.y))
    source = sorted((r.frame, r.part, r.x, r.y, r.p) for r in planes if r.plane == "Source" and r.body == 1)
    assert source == sorted((r.frame, r.part, r.x, r.y, r.p) for r in run.cells.filter("p > 0").collect())
    assert {r.plane for r in planes} == set(tracking.PLANES)
    cut = tracking.prepared(spark, cells, 2, segment_size=10, chain_frames=3)
    assert key(cut.planes()) == key(run.planes())


def test_planes_of_videos(spark):
    one, two = (spark.createDataFrame(walk(15, seed), CELLS) for seed in (3, 4))
    both = one.withColumn("video", F.lit("u")).union(two.withColumn("video", F.lit("v")))
    got = key(tracking.prepared(spark, both, 2, segment_size=10, by=("video",)).planes(), "video")
    assert [r[1:] for r in got if r[0] == "v"] == key(tracking.prepared(spark, two, 2, segment_size=10).planes())


def test_states_through_a_store(spark, tmp_path):
    run = tracking.prepared(spark, spark.createDataFrame(walk(12, 5), CELLS), 2, segment_size=10)
    high, wide = (int(run.cells.agg(F.max(c)).first()[0]) + 3 for c in "yx")
    path = str(tmp_path / "s.store")
    names = api.export_states(run, path, high, wide, 4.0, frame_count=14)
    h = framestore.read_header(path)
    assert h.parts == names == [f"{p}_{b}_{k}" for p in run.parts for b in range(2) for k in tracking.PLANES] and (h.height, h.width, h.frames) == (high + 2, wide + 2, 14)
    near = lambda rows: sorted((f, p, x, y, round(v, 5)) for f, p, x, y, v in rows)
    planes = run.planes().collect()
    assert near((r.frame, r.part, r.x, r.y, r.p) for r in framestore.read(spark, path).collect()) == near((r.frame, f"{r.part}_{r.body}_{r.plane}", r.x + 1, r.y + 1, r.p) for r in planes)
    assert api.export_states(run, path, high, wide, planes="Frame") == [f"{p}_{b}" for p in run.parts for b in range(2)]
    assert near((r.frame, r.part, r.x, r.y, r.p) for r in framestore.read(spark, path).collect()) == near((r.frame, f"{r.part}_{r.body}", r.x, r.y, r.p) for r in planes if r.plane == "Frame")
    with pytest.raises(ValueError, match="planes"):
        api.export_states(run, path, high, wide, planes="Occluded/Edge")
