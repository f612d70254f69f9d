"""The max-product solver of a segment: visible, occluded and enter states for each part and individual, in numpy.

A track's state in a frame is a set of visible cells, a set of occluded cells (where it may be hidden) and the state of not
having entered; scores are logarithms, largest 0. A step takes the best predecessor of each state by movement, adds a
share of the best limb-length support from linked parts of the same individual, and then lets the individuals of a part
compete: a cell stays possible only for the one that scores highest there.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

NEG = -np.inf


@dataclass(frozen=True)
class Settings:
    """Defaults of the solver (probabilities, not logarithms)."""

    sigma: float = 3.0
    obscured: float = 1e-8
    enter: float = 1e-12
    leave: float = 0.9999
    survivors: int = 50
    occluded_step: float = 0.5
    skeleton_weight: float = 0.1
    scale: float = 1.0
    links: dict = field(default_factory=dict)  # part -> {part: (mean, std)}


def _ln(p):
    with np.errstate(divide="ignore"):
        return np.log(np.asarray(p, float))


@dataclass
class Track:
    """Scores of one part of one individual in one frame."""

    seen: np.ndarray  # (n, 2)
    seen_score: np.ndarray
    hidden: np.ndarray
    hidden_score: np.ndarray
    out: float

    def best(self) -> tuple[str, int]:
        """The best state: hidden only if strictly better than seen, out only if strictly better than both."""
        s = self.seen_score.max() if len(self.seen_score) else NEG
        h = self.hidden_score.max() if len(self.hidden_score) else NEG
        if self.out > max(s, h):
            return "out", 0
        return ("hidden", int(self.hidden_score.argmax())) if h > s else ("seen", int(self.seen_score.argmax()) if len(self.seen_score) else 0)

    def only_best(self) -> Track:
        kind, i = self.best()
        none = np.zeros((0, 2))
        if kind == "out":
            return Track(none, np.zeros(0), none, np.zeros(0), self.out)
        if kind == "seen" and len(self.seen):
            return Track(self.seen[i : i + 1], self.seen_score[i : i + 1], none, np.zeros(0), NEG)
        if kind == "hidden":
            return Track(none, np.zeros(0), self.hidden[i : i + 1], self.hidden_score[i : i + 1], NEG)
        return Track(none, np.zeros(0), none, np.zeros(0), NEG)


def _places(xy: np.ndarray) -> np.ndarray:
    """The integer cell of each place, as one number."""
    cell = np.floor(xy).astype(np.int64)
    return (cell[:, 1] << 32) + cell[:, 0]


def _union(a: np.ndarray, pa: np.ndarray, b: np.ndarray, pb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Full outer join of two cell sets on their integer cells, with the larger score; each cell stands where it first came."""
    if not len(b):
        return a, pa
    xy, score = np.concatenate([a, b]), np.concatenate([pa, pb])
    _, first, which = np.unique(_places(xy), return_index=True, return_inverse=True)
    best = np.full(len(first), NEG)
    np.maximum.at(best, which, score)
    order = np.argsort(first)
    return xy[first[order]], best[order]


def _survivors(xy: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(score) <= k:
        return xy, score
    keep = np.sort(np.lexsort((xy[:, 0], xy[:, 1], -score))[:k])
    return xy[keep], score[keep]


def start(xy: np.ndarray, p: np.ndarray, cfg: Settings) -> Track:
    """The track in a fix frame: its cells, and the same cells hidden; not entered if there is none."""
    if not len(p) or not (p > 0).any():
        return Track(np.zeros((0, 2)), np.zeros(0), np.zeros((0, 2)), np.zeros(0), 0.0)
    seen = _ln(p)
    hxy, hidden = _survivors(xy, seen + np.log(cfg.obscured), cfg.survivors)
    top = max(seen.max(), hidden.max())
    return Track(xy, seen - top, hxy, hidden - top, NEG)


def _reach(cur: np.ndarray, prior: list[tuple[np.ndarray, np.ndarray]], step) -> np.ndarray:
    """The best of predecessor score plus step for each current place."""
    best = np.full(len(cur), NEG)
    for xy, score in prior:
        some = score > NEG  # the others lead nowhere
        if some.any() and len(cur):
            xy, score = xy[some], score[some]
            d = np.sqrt((cur[:, :1] - xy[:, 0]) ** 2 + (cur[:, 1:] - xy[:, 1]) ** 2)
            best = np.maximum(best, (step(d) + score).max(1))
    return best


def _moves(cur: np.ndarray, prior: Track, cfg: Settings, hidden: bool) -> np.ndarray:
    got = _reach(cur, [(prior.seen, prior.seen_score), (prior.hidden, prior.hidden_score)], lambda d: -((d * cfg.scale) ** 2) / (2 * cfg.sigma**2))
    if np.isfinite(prior.out):
        got = np.maximum(got, prior.out + np.log(cfg.leave))
    return got + (np.log(cfg.occluded_step) if hidden else 0.0)


def _limbs(cur: np.ndarray, prior: dict, part, ind: int, cfg: Settings) -> np.ndarray:
    """Mean support of the linked parts of the same individual; links without any finite support do not count."""
    total, n = np.zeros(len(cur)), 0
    for other, (mean, std) in cfg.links.get(part, {}).items():
        t = prior.get((other, ind))
        if t is None:
            continue
        s = _reach(cur, [(t.seen, t.seen_score), (t.hidden, t.hidden_score)], lambda d, m=mean, v=std: -((d * cfg.scale - m) ** 2) / (2 * v * v))
        if np.isfinite(s).any():
            total, n = total + s, n + 1
    return total / n if n else np.zeros(len(cur))


def _normal(t: Track) -> Track:
    top = max([t.out, *(a.max() for a in (t.seen_score, t.hidden_score) if len(a))])
    if np.isfinite(top):
        t.seen_score, t.hidden_score, t.out = t.seen_score - top, t.hidden_score - top, t.out - top
    return t


def forward(prior: dict, part, inds: int, xy: np.ndarray, p: np.ndarray, cfg: Settings, no_hidden: bool = False) -> dict:
    """The tracks (part, ind) of the next frame, whose cells are xy with p; `prior` has all tracks of the frame before."""
    some = len(p) > 0 and bool((p > 0).any())
    xy, p = (xy, p) if some else (np.zeros((0, 2)), np.zeros(0))
    base = _ln(p)
    made = []
    for i in range(inds):
        before = prior[part, i]
        hxy, h = _union(xy, base + np.log(cfg.obscured), before.hidden, before.hidden_score)
        if no_hidden and some:
            h = np.full(len(h), NEG)
        seen = base + _moves(xy, before, cfg, False) + cfg.skeleton_weight * _limbs(xy, prior, part, i, cfg)
        hidden = h + _moves(hxy, before, cfg, True) + cfg.skeleton_weight * _limbs(hxy, prior, part, i, cfg)
        out = np.log(cfg.enter) + (before.out + np.log(1 - cfg.leave))
        made.append(Track(xy, seen, hxy, hidden, out))
    # Visible cells are the same for all; hidden ones are matched by their integer cells.
    top_seen = np.max([t.seen_score for t in made], 0) if len(xy) else np.zeros(0)
    sizes = [len(t.hidden) for t in made]
    _, keys = np.unique(_places(np.concatenate([t.hidden for t in made])), return_inverse=True)
    top_hidden = np.full(int(keys.max()) + 1 if len(keys) else 0, NEG)
    np.maximum.at(top_hidden, keys, np.concatenate([t.hidden_score for t in made]))
    keys = np.split(keys, np.cumsum(sizes)[:-1])
    result = {}
    for i, (ks, t) in enumerate(zip(keys, made, strict=True)):
        best_seen = int(t.seen_score.argmax()) if len(t.seen_score) else -1
        best_hidden = int(t.hidden_score.argmax()) if len(t.hidden_score) else -1
        t.seen_score = np.where(t.seen_score < top_seen, NEG, t.seen_score)
        t.hidden_score = np.where(t.hidden_score < top_hidden[ks], NEG, t.hidden_score)
        if not np.isfinite(t.seen_score).any() and not np.isfinite(t.hidden_score).any():
            # Beaten everywhere: it is hidden at its best place (or seen there), which nobody else may take any more.
            if not no_hidden and best_hidden >= 0:
                t.hidden_score[best_hidden] = 0.0
                top_hidden[ks[best_hidden]] = 0.0
            elif best_seen >= 0:
                t.seen_score[best_seen] = 0.0
                top_seen[best_seen] = 0.0
        t = _normal(t)
        t.hidden, t.hidden_score = _survivors(t.hidden, t.hidden_score, cfg.survivors)
        result[part, i] = t
    return result


def backtrace(later: dict, current: dict, part, ind: int, cfg: Settings) -> Track:
    """A frame's track again, reached from the single best state of the frame after it."""
    t = current[part, ind]
    best = {k: v.only_best() for k, v in later.items()}
    seen = t.seen_score + _moves(t.seen, best[part, ind], cfg, False) + cfg.skeleton_weight * _limbs(t.seen, best, part, ind, cfg)
    hidden = t.hidden_score + _moves(t.hidden, best[part, ind], cfg, True) + cfg.skeleton_weight * _limbs(t.hidden, best, part, ind, cfg)
    after = best[part, ind]
    out = t.out + after.out + np.log(1 - cfg.leave) if np.isfinite(after.out) else t.out
    return _normal(Track(t.seen, seen, t.hidden, hidden, out))


NOTHING = (np.zeros((0, 2)), np.zeros(0))


def advance(before: dict, maps: list[dict], parts: list, inds: int, cfg: Settings) -> list[dict]:
    """The tracks of frames that follow each other, given those of the frame before; maps: part -> (xy, p) of each."""
    out = []
    for m in maps:
        before = {k: t for part in parts for k, t in forward(before, part, inds, *m.get(part, NOTHING), cfg).items()}
        out.append(before)
    return out


def retreat(later: dict | None, states: list[dict], parts: list, inds: int, cfg: Settings) -> list[dict]:
    """The tracks of frames that follow each other, reached from the tracks of the frame after them, if there is one."""
    out = []
    for s in reversed(states):
        later = s if later is None else {(p, i): backtrace(later, s, p, i, cfg) for p in parts for i in range(inds)}
        out.append(later)
    return out[::-1]


def solve(frames: dict[int, dict], fix: int, fixed: dict, parts: list, inds: int, cfg: Settings) -> dict[int, dict]:
    """Tracks of all frames of a chain: outwards from the fix frame and back to it.

    frames: frame -> part -> (xy, p); fixed: (part, ind) -> (xy, p) of the fix frame.
    """
    states = {fix: {key: start(*fixed.get(key, NOTHING), cfg) for key in ((p, i) for p in parts for i in range(inds))}}
    for direction in (1, -1):
        order = sorted((f for f in frames if (f - fix) * direction > 0), reverse=direction < 0)
        if order:
            way = [states[fix], *advance(states[fix], [frames[f] for f in order], parts, inds, cfg)]
            states.update(zip([fix, *order], retreat(None, way, parts, inds, cfg), strict=True))
    return states


def pose(t: Track, cells: tuple[np.ndarray, np.ndarray] | None = None, radius: float = 0.0) -> tuple[float, float, float]:
    """x, y, likelihood: the best visible cell; a better hidden one gives its place with likelihood 0; (-1, -1, 0) without either.

    With a radius, a visible one moves to the likeliest of the frame's cells (xy, p) within it and keeps its own likelihood.
    """
    s = t.seen_score.max() if len(t.seen_score) else NEG
    h = t.hidden_score.max() if len(t.hidden_score) else NEG
    if not np.isfinite(max(s, h)):
        return -1.0, -1.0, 0.0
    if h > s:
        return (*t.hidden[int(t.hidden_score.argmax())].tolist(), 0.0)
    at = t.seen[int(t.seen_score.argmax())]
    if radius > 0 and cells is not None:
        xy, p = cells
        near = np.flatnonzero(((xy - at) ** 2).sum(1) <= radius * radius)
        if len(near):
            at = xy[near[np.lexsort((xy[near, 0], xy[near, 1], -p[near]))[0]]]
    return (*at.tolist(), float(np.exp(s)))
