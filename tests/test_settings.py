"""The settings of api.track reach the tracker: sparsification, relaxed maximum, assignment and outlier limit."""

import pytest
from trailmark import api
from trailmark.operators import frames, scoring, tracking

SCHEMA = "frame long, part string, x long, y long, p double, ox double, oy double, event_id long"


@pytest.mark.parametrize(
    ("mode", "want"),
    [
        ("OFFSET_DOMINATION", [(3.25, 0.8)]),
        ("OFFSET_COMBINATION", [(3.125, 0.6)]),
        ("OFFSET_SUMMATION", [(3.25, 0.8)]),
        ("IGNORE_OFFSETS", [(3 + 0.5 - 1e-6, 0.8), (3 - 0.5 + 1e-6, 0.4)]),
    ],
)
def test_sparse_cells(spark, mode, want):
    c = spark.createDataFrame([(0, "a", 3, 5, 0.8, 2.0, 0.0, 0), (0, "a", 3, 5, 0.4, 0.0, 0.0, 1)] if mode != "IGNORE_OFFSETS" else [(0, "a", 3, 5, 0.8, 2.0, 0.0, 0), (0, "a", 3, 5, 0.4, -2.0, 0.0, 1)], SCHEMA)
    got = sorted(((r.x, r.p) for r in tracking.sparse_cells(c, mode, 0.001).collect()), reverse=True)
    assert got == [pytest.approx(w) for w in want]


def test_upscaled_cells(spark):
    c = spark.createDataFrame([(0, "a", 0, 5, 0.8, -4.0, 0.0, 0)], SCHEMA)
    got = {(r.x, r.y): r.p for r in tracking.sparse_cells(c, "UPSCALE", 0.001).collect()}
    assert max(got, key=got.get) == (0, 44) and min(x for x, _ in got) == 0


def test_settings_reach_the_tracker(spark, monkeypatch):
    """One individual moves by a cell a frame; in frame 5 a likelier cell lies three further on."""
    data = [(t, "a", 2 + t, 5, 0.8 if t != 5 else 0.55, 2.0, 0.0, t) for t in range(8)] + [(5, "a", 10, 5, 0.6, 2.0, 0.0, 8)]
    c = spark.createDataFrame(data, SCHEMA)
    assert {r.frame: r.x for r in api.track(spark, c, 1).collect()} == pytest.approx({t: t + 2.75 for t in range(8)})
    seen = []
    for module, name in ((frames, "sparsify"), (scoring, "frame_scores"), (tracking, "solve_segments")):
        monkeypatch.setattr(module, name, lambda *a, real=getattr(module, name): seen.append(a) or real(*a))
    got = api.track(spark, c, 1, sparsification_mode="OFFSET_SUMMATION", relaxed_maximum_radius=3.5, assignment_algorithm="greedy", outlier_threshold=2.0)
    assert {r.frame: r.x for r in got.collect()} == pytest.approx({t: 10.75 if t == 5 else t + 2.75 for t in range(8)})
    assert seen[0][1] == "OFFSET_SUMMATION" and seen[1][-1] == 2.0 and seen[2][-2:] == ("greedy", 3.5)
