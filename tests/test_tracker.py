"""The registered tracker against a brute-force one on a small table of events, with more than 20 cells a map and more than 20 frames."""

import datetime

import numpy as np
import pandas as pd
import pytest
from trailmark import registry
from trailmark.operators import kernels, tracking, viterbi

PARTS, FRAMES, N = ["click", "view"], 24, 2
MOST, THRESHOLD = 100, 0.001


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    rows = []
    for f in range(FRAMES):
        for part in PARTS:
            for _ in range(int(rng.integers(30, 125))):
                ts = datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=6 * f, minutes=int(rng.integers(1, 350)))
                rows.append((len(rows), ts, int(rng.integers(0, 32)), part, float(rng.random() * 90), f'{{"k": {rng.integers(0, 24)}}}'))
    sf = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{sf}/events.parquet")
    cells = pd.DataFrame([(i, (ts - datetime.datetime(2024, 1, 1)).days * 4 + ts.hour // 6, part, u % 32, int(props[6:-1]) % 24, v / (v + 50)) for i, ts, u, part, v, props in rows], columns=["event_id", "frame", "part", "x", "y", "p"])
    return sf, cells


def median(values, centre=None, offset=0.0):
    """The median from bins of 2 of the values, or their median deviation about a centre, interpolated over the bins' means."""
    values = np.asarray(values)
    bins = np.trunc((values - offset) / 2)
    hist = [(b, (bins == b).sum(), values[bins == b].mean()) for b in np.unique(bins)]
    if centre is not None:
        hist = sorted((abs(centre - m), b, c) for b, c, m in hist)
        v, c = [0.0] + [h[0] for h in hist], [0] + [h[2] for h in hist]
    else:
        v, c = [h[2] for h in hist], [h[1] for h in hist]
    return np.interp(0.5, np.cumsum(c) / np.sum(c), v)


def brute_force(cells):
    """One chain of segments, as no two fix frames are 100 frames apart: (frame, part, body) -> (x, y, likelihood)."""
    kept = {}
    for (f, part), g in cells[cells["p"] > THRESHOLD].groupby(["frame", "part"]):
        kept[f, part] = g.sort_values(["p", "y", "x", "event_id"], ascending=[False, True, True, True]).head(MOST).sort_values(["y", "x", "event_id"])
    labels = {k: kernels.cluster_cells(g["x"].to_numpy(float), g["y"].to_numpy(float), g["p"].to_numpy(), N) for k, g in kept.items()}
    split = {(*k, i): g[labels[k] == i] for k, g in kept.items() for i in range(N)}
    points = {k: (*(np.average(g[["x", "y"]].to_numpy(float), axis=0, weights=g["p"])), g["p"].max()) for k, g in split.items()}
    apart = lambda a, b: np.hypot(points[a][0] - points[b][0], points[a][1] - points[b][1])
    near = lambda f, part, g, other: [min(apart((f, part, i), (g, other, j)) for j in range(N)) for i in range(N)]
    moves = [m for f in range(1, FRAMES) for part in PARTS for m in near(f, part, f - 1, part) if m >= 1]
    sigma = median(moves, offset=1.0) / 0.6744897502 * 3
    a, b = PARTS
    lengths = [m for f in range(1, FRAMES) for x, y in ((a, b), (b, a)) for m in near(f - 1, x, f, y)]
    avg = median(lengths)
    std = median(lengths, avg) / 0.6744897502
    scores = []
    for f in range(FRAMES):
        gaps = {part: apart((f, part, 0), (f, part, 1)) for part in PARTS}
        off = [min(abs(apart((f, x, i), (f, y, j)) - avg) for j in range(N)) for x, y in ((a, b), (b, a)) for i in range(N)]
        fallback = sum(gaps[part] * points[f, part, 0][2] * points[f, part, 1][2] for part in PARTS) - sum(off) / N
        bad = min(gaps.values()) <= 1e-9 or max(gaps.values()) < sigma or max(off) / std > 3
        scores.append((not bad, fallback, f))
    fix = max(scores)[2]
    centres = pd.DataFrame([(part, i, points[fix, part, i][0] + 0.5, points[fix, part, i][1] + 0.5, points[fix, part, i][2]) for part in PARTS for i in range(N)], columns=["part", "ind", "x", "y", "p"])
    body = tracking.fix_assignment(centres, pd.DataFrame([(a, b, avg, std)], columns=["part_a", "part_b", "avg", "std"]), N)
    arrays = lambda g: (g[["x", "y"]].to_numpy(float) + 0.5, g["p"].to_numpy())
    frames = {f: {part: arrays(kept[f, part]) for part in PARTS} for f in range(FRAMES)}
    first = {(part, body[part, i]): arrays(split[fix, part, i]) for part in PARTS for i in range(N)}
    solved = viterbi.solve(frames, fix, first, PARTS, N, viterbi.Settings(sigma=sigma, links={a: {b: (avg, std)}, b: {a: (avg, std)}}))
    return {(f, part, i): viterbi.pose(t) for f, tracks in solved.items() for (part, i), t in tracks.items()}


def test_registered_tracker_against_brute_force(spark, events):
    sf, cells = events
    got = {(r.frame, r.part, r.body): (r.x, r.y, r.likelihood) for r in registry.QUERIES["track_individuals"](spark, sf).collect()}
    want = brute_force(cells)
    assert got.keys() == want.keys()
    wrong = [(k, got[k], want[k]) for k in want if not np.allclose(got[k], want[k], atol=1e-6)]
    assert not wrong, f"{len(wrong)} of {len(want)}, first {wrong[0]}"
