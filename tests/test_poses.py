"""Operators that SQL does not express, by brute force: undo and redo, segmentation, clustering, missing points in frame scores."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from trailmark import registry
from trailmark.operators import edits, frames, motion, scoring, segments, tracking
from trailmark.plans.cells import cells

SF = "/root/testdata/sf0.001"


def test_undo_and_redo(spark):
    rng = random.Random(4)
    log, want = [], {}
    for video in ("a", "b"):
        done, undone = [], []
        for version in range(60):
            action = rng.choice(["edit", "edit", "undo", "redo"])
            log.append((video, version, action))
            if action == "edit":
                done, undone = [*done, version], []
            elif action == "undo" and done:
                undone.append(done.pop())
            elif action == "redo" and undone:
                done.append(undone.pop())
        want[video] = done
    got = edits.replay(spark.createDataFrame(log, "video string, version long, action string"), ("video",)).collect()
    assert {v: sorted(r.version for r in got if r.video == v) for v in "ab"} == want
    assert edits.replay(spark.createDataFrame([], "version long, action string")).count() == 0


def plain_endpoints(score, fallback, size):
    """The rule by one frame after the other: list of (start, end, fix)."""
    n, fixed, marked = len(score), set(), set()
    for f in sorted(range(n), key=lambda f: (-score[f], -f)):
        if f in marked or score[f] == -np.inf:
            continue
        around = range(max(0, int(f - size / 2)), min(n, int(f + size / 2)))
        fixed -= set(around)
        marked |= set(around)
        fixed.add(f)
    if not fixed:
        fixed = {max(range(n), key=lambda f: (fallback[f], -f))}
    cuts = sorted({0, n, *fixed})
    return [(s, min(b, s + size), s if s in fixed else -1) for a, b in zip(cuts[:-1], cuts[1:], strict=True) for s in range(a, b, size)]


def test_endpoint_segments_query(spark):
    from trailmark.plans import queries

    scores = {r.frame: r for r in queries.scores(cells(spark, SF)).collect()}
    n = max(scores) + 1
    score = [scores[f].score if f in scores and scores[f].score is not None else -np.inf for f in range(n)]
    fallback = [scores[f].fallback if f in scores else -np.inf for f in range(n)]
    got = registry.QUERIES["endpoint_segments"](spark, SF).orderBy("seg_id").collect()
    assert [(r.start, r.end, r.fix) for r in got] == plain_endpoints(score, fallback, 20)
    rng = np.random.default_rng(3)
    for _ in range(50):
        s = rng.choice([-np.inf, 1.0, 2.0, 3.0, 4.0], 70)
        assert [r[:3] for r in segments.endpoint_segments(s, rng.random(70), 14)] == plain_endpoints(s, rng.random(70) if np.isfinite(s).any() else s, 14)


def test_midpoint_segments():
    assert segments.midpoint_segments(np.array([1.0, 5.0, 2.0, -np.inf, -np.inf, 3.0]), 2) == [(0, 2, 1, 5.0), (2, 3, 2, 2.0), (3, 4, -1, -np.inf), (4, 6, 5, 3.0)]
    with pytest.raises(ValueError):
        segments.midpoint_segments(np.full(3, -np.inf))
    rng = np.random.default_rng(5)
    for _ in range(30):
        s = rng.random(100)
        got = segments.midpoint_segments(s, 20)
        assert [a for a, *_ in got] == [0, *(b for _, b, *_ in got)][:-1] and got[-1][1] == 100 and all(a <= f < b for a, b, f, _ in got)


def test_segments_of_several_videos(spark):
    rng = np.random.default_rng(7)
    data = [(v, f, float(rng.random()), 0.0) for v in ("a", "b") for f in range(50)]
    df = spark.createDataFrame(data, "video string, frame long, score double, fallback double")
    got = segments.segments_of(df, 10, by=("video",))
    for v in "ab":
        own = np.array([r[2] for r in data if r[0] == v])
        assert [(r.start, r.end, r.fix) for r in got.filter(F.col("video") == v).orderBy("seg_id").collect()] == plain_endpoints(own, own, 10)
    levels = segments.run_levels(got, ("video",))
    assert levels.count() == got.count()
    flagged = scoring.neighbours(df, F.col("score") > 0.5, ("video",)).filter("video = 'b' AND frame = 0").first()
    assert flagged.before is None and flagged.after == min(r[1] for r in data if r[0] == "b" and r[1] > 0 and r[2] > 0.5)


def plain_clusters(x, y, p, k, attempts=10):
    """Complete linkage by looking at all pairs of clusters for each merge, with weak clusters taken out."""
    n = len(p)
    if n < k:
        return None
    cost = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 - np.log(p)[:, None] - np.log(p)
    groups = [[i] for i in range(n)]
    while len(groups) > k:
        a, b = min(((a, b) for b in range(len(groups)) for a in range(b)), key=lambda ab: max(cost[i, j] for i in groups[ab[0]] for j in groups[ab[1]]))
        groups[a] += groups.pop(b)
    groups = sorted(map(sorted, groups))
    peaks = [max(p[g]) for g in groups]
    weak = [c for c in range(k) if peaks[c] < 0.10 * (sum(peaks) - peaks[c]) / (k - 1)]
    labels = np.empty(n, int)
    for c, g in enumerate(groups):
        labels[g] = c
    if not weak or not attempts:
        return labels
    keep = ~np.isin(labels, weak)
    again = plain_clusters(x[keep], y[keep], p[keep], k, attempts - 1)
    if again is None:
        return labels
    centres = [(x[keep][again == c].mean(), y[keep][again == c].mean()) for c in range(k)]
    labels[keep] = again
    labels[~keep] = [int(np.argmin([(a - cx) ** 2 + (b - cy) ** 2 for cx, cy in centres])) for a, b in zip(x[~keep], y[~keep], strict=True)]
    return labels


def test_cluster_query(spark):
    got = {}
    for r in registry.QUERIES["cluster_complete"](spark, SF).collect():
        got.setdefault((r.frame, r.part), set()).add((r.event_id, r.ind))
    kept = {}
    for r in cells(spark, SF).filter("p > 0.001").collect():
        kept.setdefault((r.frame, r.part), []).append(r)
    assert got.keys() == kept.keys()
    for key, rows in kept.items():
        rows.sort(key=lambda r: (r.y, r.x, r.event_id))
        labels = plain_clusters(*(np.array([float(getattr(r, c)) for r in rows]) for c in "xyp"), 2)
        want = {(r.event_id, i) for r in rows for i in range(2)} if labels is None else {(r.event_id, int(c)) for r, c in zip(rows, labels, strict=True)}
        assert got[key] == want or got[key] == {(e, 1 - c) for e, c in want}, key


def test_clusters_in_pixels_and_flagged_frames(spark):
    """Two faint cells a cell apart: in cells their probabilities decide, in pixels the distance does. A flagged frame keeps all for all."""
    c = spark.createDataFrame([(f, "a", x, 0, p, f == 1) for f in range(2) for x, p in ((0, 0.9), (1, 1e-5), (2, 1e-5), (3, 0.9))], "frame long, part string, x long, y long, p double, ignore_clustering boolean")
    by = lambda df: {f: sorted((r.x, r.ind) for r in df.collect() if r.frame == f) for f in range(2)}
    fine = by(tracking.cluster(c, 2, stride=8.0))
    assert fine[0] == [(0, 0), (1, 0), (2, 1), (3, 1)] and fine[1] == [(x, i) for x in range(4) for i in range(2)]


def test_missing_points_cost_the_diagonal(spark):
    data = [(0, p, i, 10.0 * i + x, 5.0, 0.5) for p, x in (("a", 0), ("b", 3)) for i in range(2)] + [(1, "a", 0, 0.0, 5.0, 0.5), (1, "a", 1, 10.0, 5.0, 0.5), (1, "b", 0, 3.0, 5.0, 0.5)]
    points = spark.createDataFrame(data, "frame long, part string, ind long, x double, y double, p double")
    skeleton = spark.createDataFrame([("a", "b", 3.0, 1.0)], "part_a string, part_b string, avg double, std double")
    got = {r.frame: r for r in scoring.frame_scores(points, 2, 2, 1.0, skeleton, 50.0).collect()}
    assert got[0].is_valid and got[0].fallback == pytest.approx(2 * 10 * 0.25)
    # one pair of part a; the second a is 7 from the only b instead of 3, and the missing b costs 50 / (2 individuals * 1 limb)
    assert not got[1].is_valid and got[1].fallback == pytest.approx(10 * 0.25 - 4 / 2 - 50 / 2)


def test_offsets_and_maps_of_any_size(spark):
    far = spark.createDataFrame([(0, "a", 40, 30, 0.9, 3.0, -2.0)], "frame long, part string, x long, y long, p double, ox double, oy double")
    for mode in ("OFFSET_DOMINATION", "OFFSET_COMBINATION", "OFFSET_SUMMATION", "IGNORE_OFFSETS", "UPSCALE"):
        assert frames.sparsify(far, mode).count() > 0
    assert frames.sparsify(far, width=40, height=40).count() == 0
    r = frames.argmax_pose(far.drop("oy")).first()
    assert (r.x, r.y) == (40 * 8 + 4 + 3, 30 * 8 + 4)


def test_manual_skeleton_reaches_the_tracker(spark):
    data = [(t, p, 10 + t + d + 9 * i, 5 + 6 * i, 0.9) for t in range(8) for i in range(2) for p, d in (("a", 0), ("b", 4))]
    c = spark.createDataFrame(data, "frame long, part string, x long, y long, p double").withColumn("event_id", F.monotonically_increasing_id())
    limbs = spark.createDataFrame([("b", "a", 4.0)], "part_a string, part_b string, length double")
    got = tracking.track(spark, c, 2, limb_lengths=limbs).collect()
    at = {(r.frame, r.part, r.body): (r.x, r.y) for r in got}
    assert all(at[t, "b", i][0] - at[t, "a", i][0] == pytest.approx(4) and at[t, "b", i][1] == at[t, "a", i][1] for t in range(8) for i in range(2))
    assert motion.manual_skeleton(limbs).first().std == 1.0


def test_default_spread():
    assert edits.default_spread() == 20 and edits.default_spread(0.5) == 5 and edits.default_spread(3.0) == 15 and edits.default_spread(3.0, 40.0) == 40


def test_symmetric_and_bounds(spark):
    from trailmark.functions import math as fm
    from trailmark.operators import kernels

    w = np.arange(16.0).reshape(4, 4)
    got = kernels.symmetric(w, 7.0)
    assert (got == got.T).all() and (np.diag(got) == 7).all() and got[0, 3] == w[3, 0] and got[2, 1] == w[2, 1]
    # no four points of a unit square are further apart than its corners, and the bound falls with their number
    assert fm.separation_bound(4) == 1 and all(fm.separation_bound(n) >= fm.separation_bound(n + 1) for n in range(2, 40))
    dx = np.array([0.0, 3.0])
    assert np.allclose(fm.log_gaussian_table(dx, dx, 3.0), [0, -1])
    back = frames.to_cells(frames.to_video(spark.createDataFrame([(3, 5)], "x long, y long"), 4.0), 4.0).first()
    assert (back.x, back.y) == (3, 5)
    share = scoring.bound_normalised(spark.createDataFrame([(0, 10.0)], "frame long, score double"), 0.5, 40, 10, 2).first().share
    assert share == pytest.approx(10 / (0.5 * 20 * 2))


def test_places_of_one_side_only(spark):
    """A place that the right side has goes, however often the left side has it."""
    left = spark.createDataFrame([(0, "a", 1, 1), (0, "a", 1, 1), (0, "a", 2, 1), (0, "a", 2, 1), (0, "a", None, 1)], "frame long, part string, x long, y long")
    right = spark.createDataFrame([(0, "a", 1, 1), (0, "a", 3, 1)], left.schema)
    assert sorted(frames.only_left(left, right).collect(), key=str) == sorted([(0, "a", 2, 1), (0, "a", None, 1)], key=str)


def test_max_product_of_crowded_places(spark):
    """Against all pairs, with missing values; and many cells on few places."""
    rng = random.Random(6)
    rows = [(f, "a", i, rng.choice([None, *range(5)]), rng.choice([None, 0.5, 2.25, 7.0]), rng.choice([None, 0.0, rng.random()])) for f in (0, 1, 3, 4) for i in range(40)]
    got = motion.max_product(spark.createDataFrame(rows, "frame long, part string, ind long, x long, y double, p double"), 4.0).collect()
    want = {}
    for f, _, i, x, y, _ in rows:
        if f in (1, 4):
            scores = [np.log(r[5]) - ((x - r[3]) ** 2 + (y - r[4]) ** 2) / 32 for r in rows if r[0] == f - 1 and r[5] and None not in (x, y, r[3], r[4])]
            want[f, i] = max(scores, default=None)
    assert len(got) == len(want) and all((r.best is None) == (want[r.frame, r.ind] is None) and (r.best is None or abs(r.best - want[r.frame, r.ind]) < 1e-9) for r in got)
    # All pairs would be 4 * 10^10 here.
    crowd = spark.range(400_000).selectExpr("id div 200000 AS frame", "'a' AS part", "id % 200000 AS ind", "id % 4 AS x", "id div 4 % 3 AS y", "0.5D AS p")
    met = motion.max_product(crowd, 4.0).agg(F.count("best").alias("n"), F.min("best").alias("low"), F.max("best").alias("high")).first()
    assert met.n == 200_000 and met.low == met.high == np.log(0.5)
