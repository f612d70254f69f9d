"""Chains cut into pieces, several videos in one table, stitching by component, clusters of peaks."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from trailmark import api
from trailmark.operators import kernels, tracking

CELLS = "frame long, part string, x long, y long, p double"


def walk(frames, seed, parts=("a", "b"), n=2, at=0):
    """Two individuals on their ways, with noise and gaps."""
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(frames):
        for i in range(n):
            for k, part in enumerate(parts):
                if rng.random() < 0.1:
                    continue
                x, y = 5 + 18 * i + int(3 * np.sin(f / 5 + i)) + at, 6 + 4 * k + int(2 * np.cos(f / 7))
                rows += [(f, part, int(x + rng.integers(-1, 2)), int(y + rng.integers(-1, 2)), float(0.3 + 0.6 * rng.random())) for _ in range(3)]
    return rows


def poses(df, *by):
    return {tuple(r[c] for c in (*by, "frame", "part", "body")): (r.x, r.y, r.likelihood) for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    wrong = [(k, a[k], b[k]) for k in a if not np.allclose(a[k], b[k], atol=1e-9)]
    assert not wrong, f"{len(wrong)} of {len(a)}, first {wrong[0]}"


@pytest.mark.parametrize(("individuals", "chain_frames"), [(1, 7), (1, 40), (2, 3)])
def test_pieces_of_a_chain_give_its_poses(spark, individuals, chain_frames):
    """With one individual no frame has a score of its own, so the whole video is one chain; a gap of frames makes an empty piece."""
    rows = [r for r in walk(60, 3, n=individuals) if not 20 <= r[0] < 36]
    cells = spark.createDataFrame(rows, CELLS)
    sizes = []
    whole = poses(tracking.track(spark, cells, individuals, segment_size=10))
    solver = tracking.Solver

    class Counting(solver):
        pass

    for name in ("onward", "back"):
        setattr(Counting, name, lambda self, c, s, real=getattr(solver, name): sizes.append(c["frame"].nunique()) or real(self, c, s))
    pieces = poses(tracking.track(spark, cells, individuals, segment_size=10, chain_frames=chain_frames))
    same(pieces, whole)
    assert len({k[0] for k in whole}) == 44


def test_several_videos_are_tracked_as_if_alone(spark):
    films = {"one": walk(30, 1), "two": walk(45, 2, at=3), None: walk(12, 5)}
    rows = [(v, *r) for v, some in films.items() for r in some]
    cells = spark.createDataFrame(rows, f"video string, {CELLS}").repartition(5)
    got = poses(tracking.track(spark, cells, 2, segment_size=10, by=("video",), chain_frames=6), "video")
    for v, some in films.items():
        alone = poses(tracking.track(spark, spark.createDataFrame(some, CELLS), 2, segment_size=10))
        same({k[1:]: x for k, x in got.items() if k[0] == v}, alone)
    assert {k[0] for k in got} == set(films)
    through = api.track(spark, cells.withColumns({"ox": F.lit(0.0), "oy": F.lit(0.0)}), 2, meta=api.Meta(stride=8.0, by=("video",)), segment_size=10)
    assert through.columns[0] == "video" and through.select("video").distinct().count() == 3
    with pytest.raises(ValueError, match="one video"):
        api.track(spark, cells, 2, "ArgMax", meta=api.Meta(by=("video",)))


def folded(table, scores, bodies, n, assign):
    """The plain fold: outward from the best chain, border by border."""
    order = sorted(table, key=lambda a: min(f for f, *_ in table[a]))
    at = order.index(max(order, key=lambda a: (scores[a], -a)))
    out = {}
    for comp in set(bodies.values()):
        parts = [p for p, c in bodies.items() if c == comp]
        body = {order[at]: np.arange(n)}
        matrix = lambda a, b: sum(np.array([[np.hypot(*np.subtract(last[p, i], first[p, j])) for j in range(n)] for i in range(n)]) for p in parts) if (last := ends[a][1]) and (first := ends[b][0]) else None  # noqa: B023, E731
        ends = {a: tuple({(p, i): xy for f, p, i, xy in rows if f == g} for g in (min(r[0] for r in rows), max(r[0] for r in rows))) for a, rows in table.items()}
        for k in range(at, len(order) - 1):
            body[order[k + 1]] = np.arange(n)
            for p, c in assign(matrix(order[k], order[k + 1])):
                body[order[k + 1]][c] = body[order[k]][p]
        for k in range(at, 0, -1):
            body[order[k - 1]] = np.arange(n)
            for p, c in assign(matrix(order[k - 1], order[k])):
                body[order[k - 1]][p] = body[order[k]][c]
        out |= {(a, p, i): int(b[i]) for a, b in body.items() for p in parts for i in range(n)}
    return out


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_stitching_equals_the_fold(spark, span):
    """Three individuals, two components that change over on their own, eleven chains, two videos."""
    rng = np.random.default_rng(6)
    n, bodies = 3, {"head": 0, "neck": 0, "tail": 1}
    tables, scores, rows = {}, {}, []
    for video in (0, 1):
        base = video << tracking.STEP_BITS
        tables[video] = {}
        for c in range(11):
            swap = {0: rng.permutation(n), 1: rng.permutation(n)}
            own = [(base + 10 * c + f, p, i, (float(20 * swap[bodies[p]][i] + rng.normal()), float(3 * len(p)))) for f in (0, 4, 9) for p in bodies for i in range(n)]
            tables[video][base + c] = own
            scores[base + c] = float(rng.integers(0, 3))
            rows += [(base + c, f, p, i, *xy, 0.9) for f, p, i, xy in own]
    table = spark.createDataFrame(rows, "anchor long, frame long, part string, ind long, x double, y double, p double")
    segs = spark.createDataFrame([(a, s) for a, s in scores.items()], "seg_id long, score double")
    parts = spark.createDataFrame([(v, p, c) for v in (0, 1) for p, c in bodies.items()], "video long, part string, component long")
    got = {(r.anchor, r.part, r.ind): r.body for r in tracking.stitch(table, segs, parts, n, span=span).collect()}
    want = {k: b for video in (0, 1) for k, b in folded(tables[video], scores, bodies, n, kernels.greedy).items()}
    assert got == want
    assert any(got[a, "head", i] != got[a, "tail", i] for a, _, i in got)  # the components do change over apart from each other


def test_components_of_limbs(spark):
    limbs = spark.createDataFrame([(0, "a", "b"), (0, "b", "c"), (1, None, None)], "video long, part_a string, part_b string")
    got = {(r.video, r.part): r.component for r in tracking.components(limbs, ["a", "b", "c", "d"]).collect()}
    assert got[0, "a"] == got[0, "b"] == got[0, "c"] != got[0, "d"] and len({got[1, p] for p in "abcd"}) == 4


def plain_peaks(cells):
    best = {}
    for x, y, p in cells:
        best[x, y] = max(p, best.get((x, y), -1.0))
    def peak(x, y):
        for dx, dy in itertools.product((-1, 0, 1), repeat=2):
            q = best.get((x + dx, y + dy)) if (dx, dy) != (0, 0) else None
            if q is not None and (q > best[x, y] or (q == best[x, y] and not (dx >= 0 and dy >= 0))):
                return False
        return True
    return [peak(x, y) for x, y, _ in cells]


def test_peaks_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(50):
        cells = [(int(rng.integers(0, 7)), int(rng.integers(0, 6)), float(rng.integers(1, 5)) / 5) for _ in range(int(rng.integers(1, 30)))]
        x, y, p = np.array(cells).T
        assert kernels.peaks_of(x, y, p).tolist() == plain_peaks(cells)
        n = 2
        got = tracking.cluster_peaks(x, y, p, n)
        at = np.flatnonzero(plain_peaks(cells))
        labels = kernels.cluster_cells(x[at], y[at], p[at], n) if len(at) >= n else None
        if labels is None:
            assert got is None
            continue
        centres = [(x[at][labels == i].mean(), y[at][labels == i].mean()) for i in range(n)]
        assert got.tolist() == [min(range(n), key=lambda i: (a - centres[i][0]) ** 2 + (b - centres[i][1]) ** 2) for a, b in zip(x, y, strict=True)]  # noqa: B023


def test_clusters_of_peaks(spark):
    """Two hills whose slopes go to the nearer top; a map with fewer peaks than individuals stays whole for everyone."""
    hill = lambda cx, cy: [(cx + dx, cy + dy, 0.9 - 0.2 * max(abs(dx), abs(dy))) for dx in (-2, -1, 0, 1, 2) for dy in (-2, -1, 0, 1, 2)]
    rows = [(0, "a", x, y, p) for x, y, p in hill(5, 5) + hill(20, 5)] + [(1, "a", x, y, p) for x, y, p in hill(5, 5)]
    got = tracking.cluster(spark.createDataFrame(rows, CELLS), 2, nodes="PEAKS").toPandas()
    first = got[got["frame"] == 0]
    assert len(first) == 50 and (first.groupby("ind")["x"].agg(lambda s: s.max() - s.min()) == 4).all()
    assert len(got[got["frame"] == 1]) == 50 and set(got[got["frame"] == 1]["ind"]) == {0, 1}
    with pytest.raises(ValueError, match="nodes"):
        tracking.cluster(spark.createDataFrame(rows, CELLS), 2, nodes="SOME")


def test_unsorted_pandas_groups_do_not_matter():
    """State rows of a frame read back are the same tracks."""
    from trailmark.operators import viterbi

    states = {("a", 0): viterbi.start(np.array([[1.5, 2.5], [3.5, 2.5]]), np.array([0.5, 0.25]), viterbi.Settings()), ("a", 1): viterbi.start(*viterbi.NOTHING, viterbi.Settings())}
    back = tracking._unpacked(pd.DataFrame(tracking._packed(states), columns=tracking._STATE_COLUMNS).sample(frac=1, random_state=1))
    assert back.keys() == states.keys() and np.array_equal(back["a", 0].seen, states["a", 0].seen) and back["a", 1].out == 0.0 and len(back["a", 1].hidden) == 0
