"""Kernels against brute force."""

import itertools

import numpy as np
import pytest
from trailmark.operators import kernels, segments, viterbi


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, m = rng.integers(1, 6, 2)
        c = rng.normal(size=(n, m)).round(rng.integers(0, 4))
        got = kernels.hungarian(c)
        small, wide = (c, False) if n <= m else (c.T, True)
        best = min(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
        assert len(got) == min(n, m) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        assert np.isclose(sum(c[i, j] for i, j in got), best)
        assert len(kernels.greedy(c)) == min(n, m)
    assert kernels.greedy(np.array([[1.0, 0.1], [0.2, 5.0]])) == [(0, 1), (1, 0)]


def naive(d, linkage):
    """Agglomeration by definition: closest pair of clusters each time."""
    n = len(d)
    groups = [[i] for i in range(n)]
    out = []

    def apart(a, b):
        x = d[np.ix_(a, b)]
        if linkage == "single":
            return x.min()
        if linkage == "complete":
            return x.max()
        return x.mean()

    while len(groups) > 1:
        i, j = min(itertools.combinations(range(len(groups)), 2), key=lambda q: apart(groups[q[0]], groups[q[1]]))
        out.append(apart(groups[i], groups[j]))
        groups[i] = groups[i] + groups[j]
        del groups[j]
    return out


@pytest.mark.parametrize("linkage", ["single", "complete", "average"])
def test_agglomeration_against_the_definition(linkage):
    rng = np.random.default_rng(0)
    for _ in range(40):
        n = int(rng.integers(2, 20))
        d = rng.random((n, n))
        d = np.triu(d, 1) + np.triu(d, 1).T
        merges = kernels.agglomerate(d, linkage)
        assert np.allclose([m[2] for m in merges], naive(d, linkage))
        for k in range(1, n + 1):
            assert len(set(kernels.cut(n, merges, k))) == k


@pytest.mark.parametrize("linkage", ["weighted", "ward"])
def test_other_linkages_merge_everything_in_order(linkage):
    rng = np.random.default_rng(1)
    x = rng.random((15, 2))
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    merges = kernels.agglomerate(d, linkage)
    assert len(merges) == 14 and all(a[2] <= b[2] + 1e-12 for a, b in itertools.pairwise(merges))
    if linkage == "ward":
        i, j = np.unravel_index(np.where(d > 0, d, 9).argmin(), d.shape)
        assert np.isclose(merges[0][2], d[i, j])


def test_graphs():
    w = np.full((5, 5), np.inf)
    for i, j, v in ((0, 1, 1.0), (1, 2, 2.0), (0, 2, 9.0), (3, 4, 1.0)):
        w[i, j] = w[j, i] = v
    assert sorted(kernels.minimum_spanning_tree(w)) == [(0, 1), (1, 2), (3, 4)]
    assert kernels.components_of(5, [(0, 1), (1, 2), (3, 4)]).tolist() == [0, 0, 0, 1, 1]
    assert kernels.shortest_paths({"a": {"b": 1.0, "c": 5.0}, "b": {"c": 1.0}}, "a") == {"a": 0.0, "b": 1.0, "c": 2.0}


def test_cells_of_two_places_are_split():
    x = np.array([1.0, 1, 2, 20, 21, 20])
    y = np.array([1.0, 2, 1, 15, 15, 16])
    p = np.array([0.5, 0.4, 0.3, 0.6, 0.4, 0.2])
    assert kernels.cluster_cells(x, y, p, 2).tolist() == [0, 0, 0, 1, 1, 1]
    assert kernels.cluster_cells(x[:1], y[:1], p[:1], 2) is None


def test_segments():
    s = np.array([1.0, 5, 2, -np.inf, 4, 3, 0, 9, 1, 1])
    got = segments.endpoint_segments(s, s, 4)
    assert got[0][0] == 0 and got[-1][1] == 10 and all(a[1] == b[0] for a, b in itertools.pairwise(got))
    assert all(e - b <= 4 for b, e, *_ in got) and all(f in (-1, b) for b, _, f, _ in got)
    assert {f for _, _, f, _ in got if f >= 0} == {1, 4, 9}  # 9 lies half a size after 7 and erases it
    none = segments.endpoint_segments(np.full(6, -np.inf), np.arange(6.0), 4)
    assert [x[2] for x in none] == [-1, -1, 5]


def test_crossing_tracks_keep_their_identity():
    """Two individuals on straight paths that cross: each goes on in its direction of neighbouring cells, one hidden at the crossing."""
    cfg = viterbi.Settings(sigma=2.0)
    frames = {}
    for t in range(11):
        pts = {(float(t * 2), 0.0), (float(t * 2), 8.0)}
        xy = np.array(sorted(pts))
        frames[t] = {"a": (xy + 0.5, np.full(len(xy), 0.9))}
    first = {("a", 0): (np.array([[0.5, 0.5]]), np.array([0.9])), ("a", 1): (np.array([[0.5, 8.5]]), np.array([0.9]))}
    solved = viterbi.solve(frames, 0, first, ["a"], 2, cfg)
    for t in range(11):
        assert viterbi.pose(solved[t]["a", 0])[:2] == (t * 2 + 0.5, 0.5) and viterbi.pose(solved[t]["a", 1])[:2] == (t * 2 + 0.5, 8.5)


def test_lost_part_is_hidden_where_it_was():
    cfg = viterbi.Settings(sigma=2.0)
    at = np.array([[4.5, 4.5]])
    frames = {t: {"a": (at, np.array([0.9]))} for t in (0, 1, 2, 5, 6)} | {3: {}, 4: {}}
    solved = viterbi.solve(frames, 0, {("a", 0): (at, np.array([0.9]))}, ["a"], 1, cfg)
    assert viterbi.pose(solved[3]["a", 0]) == (4.5, 4.5, 0.0) and viterbi.pose(solved[5]["a", 0])[2] > 0.5


def test_viterbi_path_of_one_individual_is_the_best_path():
    """Visible states only: the solver's path has the largest product of probabilities and steps of all paths."""
    rng = np.random.default_rng(4)
    cfg = viterbi.Settings(sigma=3.0, obscured=1e-300)
    for _ in range(20):
        frames = {t: {"a": (rng.integers(0, 20, (3, 2)).astype(float), rng.random(3))} for t in range(5)}
        solved = viterbi.solve(frames, 0, {("a", 0): frames[0]["a"]}, ["a"], 1, cfg)
        best, path = -np.inf, None
        for choice in itertools.product(range(3), repeat=5):
            pts = [frames[t]["a"][0][i] for t, i in enumerate(choice)]
            s = sum(np.log(frames[t]["a"][1][i]) for t, i in enumerate(choice)) - sum(((a - b) ** 2).sum() / 18 for a, b in itertools.pairwise(pts))
            if s > best:
                best, path = s, pts
        assert viterbi.pose(solved[4]["a", 0])[:2] == tuple(path[4])
