"""Identity-preserving tracking as one dataflow: cluster, motion, skeleton, scores, segments, solver, alignment, poses.

Plain statistics are DataFrame expressions; clustering is a grouped map over (frame, part), the solver one over segments. Only
parameters of fixed size (sigma, skeleton) and one row a segment reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.operators import frames, kernels, motion, scoring, segments, viterbi
from trailmark.operators.scoring import STEP_BITS, video_of
from trailmark.session import spread


def cluster_peaks(x: np.ndarray, y: np.ndarray, p: np.ndarray, n: int, linkage: str = "complete", stride: float = 1.0) -> np.ndarray | None:
    """The individual of each cell by clusters of the peaks: every cell goes to the nearest centre of a cluster's peaks, the first of
    equally near ones; None where there are too few peaks or they can't be split."""
    at = np.flatnonzero(kernels.peaks_of(x, y, p))
    if n == 1:
        return np.zeros(len(x), int)
    labels = kernels.cluster_cells(x[at], y[at], p[at], n, linkage, scale=stride * stride) if len(at) >= n else None
    if labels is None:
        return None
    away = [(x - x[at][labels == i].mean()) ** 2 + (y - y[at][labels == i].mean()) ** 2 for i in range(n)]
    return np.argmin(away, axis=0)


def cluster(cells: DataFrame, n: int, linkage: str = "complete", stride: float = 1.0, nodes: str = "ALL") -> DataFrame:
    """The cells of each frame and part split among n individuals (column ind); where that fails everyone has all of them.

    With nodes="PEAKS" only the peaks of a map are clustered, and the other cells go to the nearest cluster (`cluster_peaks`).

    Distances are in pixels, of which a cell has `stride`. A table may have a flag ignore_clustering: such frames keep all cells for everyone.
    """
    if nodes not in ("ALL", "PEAKS"):
        raise ValueError(f"nodes: {nodes!r}")
    for c, default in (("event_id", F.lit(0).cast("long")), ("ignore_clustering", F.lit(False))):
        if c not in cells.columns:
            cells = cells.withColumn(c, default)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x", "event_id"], kind="stable")
        labels = None
        if not pdf.pop("ignore_clustering").any():
            xyp = [pdf[c].to_numpy(float) for c in ("x", "y", "p")]
            labels = cluster_peaks(*xyp, n, linkage, stride) if nodes == "PEAKS" else kernels.cluster_cells(*xyp, n, linkage, scale=stride * stride)
        if labels is None:
            return pd.concat([pdf.assign(ind=i) for i in range(n)])
        return pdf.assign(ind=labels)

    keep = cells.select("frame", "part", "x", "y", "p", "event_id", "ignore_clustering")
    kind = keep.schema["x"].dataType.simpleString()
    return spread(keep, "frame", "part").groupBy("frame", "part").applyInPandas(run, f"frame long, part string, x {kind}, y {kind}, p double, event_id long, ind long")


def fix_assignment(points: pd.DataFrame, skeleton: pd.DataFrame, n: int, algorithm: str = "hungarian") -> dict[tuple[str, int], int]:
    """Which body each (part, individual) of a fix frame belongs to; points: part, ind, x, y, p; skeleton: part_a, part_b, avg.

    The reference part (most links, then best separated) names the bodies; part by part, the cheapest first, individuals are
    assigned by their squared deviations from the mean limb lengths along the shortest way through the skeleton.
    """
    parts = sorted(points["part"].unique())
    at = {(r.part, int(r.ind)): (r.x, r.y, r.p) for r in points.itertuples()}
    out = {(p, i): i for p in parts for i in range(n)}
    edges = [(r.part_a, r.part_b, r.avg) for r in skeleton.itertuples() if r.part_a in parts and r.part_b in parts]
    if not edges:
        return out
    degree = {p: sum(p in e[:2] for e in edges) for p in parts}

    def apart(p: str) -> float:
        q = [at[p, i] for i in range(n) if (p, i) in at]
        return min((np.hypot(a[0] - b[0], a[1] - b[1]) * a[2] * b[2] for k, a in enumerate(q) for b in q[:k]), default=0.0)

    ranked = sorted(((degree[p], apart(p), p) for p in parts), reverse=True)
    reference = next((p for _, s, p in ranked if s > 0), ranked[0][2])
    graphs: list[dict] = [{} for _ in range(n)]
    for body, g in enumerate(graphs):
        for a, b, avg in edges:
            for i in range(n):
                for j in range(n):
                    if (a, i) in at and (b, j) in at and not (a == reference and i != body) and not (b == reference and j != body):
                        w = (avg - np.hypot(at[a, i][0] - at[b, j][0], at[a, i][1] - at[b, j][1])) ** 2
                        g.setdefault((a, i), {})[b, j] = w
                        g.setdefault((b, j), {})[a, i] = w
    left = [p for p in parts if p != reference]
    while left:
        costs = {}
        ways = [kernels.shortest_paths(g, (reference, body)) for body, g in enumerate(graphs)]
        for p in left:
            costs[p] = np.array([[min((ways[b].get(q, np.inf) + w for q, w in graphs[b].get((p, i), {}).items()), default=1e12) for i in range(n)] for b in range(n)])
            costs[p] = np.minimum(costs[p], 1e12)
        p = min(left, key=lambda q: (costs[q].min(1).sum(), q))
        for body, i in kernels.ASSIGN[algorithm](costs[p]):
            out[p, i] = body
            for other, g in enumerate(graphs):
                if other != body:
                    for q in g.pop((p, i), {}):
                        g.get(q, {}).pop((p, i), None)
        for i in range(n):
            body = out[p, i]
            graphs[body].setdefault((reference, body), {})[p, i] = 0.0
            graphs[body].setdefault((p, i), {})[reference, body] = 0.0
        left.remove(p)
    return out


#: A chain of segments reaches so many frames from its fix frame in one task at most; longer ones are solved piece by piece.
CHAIN_FRAMES = 10_000
#: Chains whose orders are composed by one task.
SPAN = 1_000
_STATE = "part string, ind long, seen_x array<double>, seen_y array<double>, seen array<double>, hidden_x array<double>, hidden_y array<double>, hidden array<double>, out double"
_STATE_COLUMNS = [c.split()[0] for c in _STATE.split(", ")]
_POSE = "anchor long, seg_id long, frame long, part string, ind long, x double, y double, p double"
_POSE_COLUMNS = [c.split()[0] for c in _POSE.split(", ")]
#: What is exported of a track in a frame (fixed values of the format).
PLANES = ("Source", "Frame", "Occluded/Edge")


def _packed(states: dict) -> list[tuple]:
    """Rows of _STATE for the tracks of a frame."""
    return [(p, i, *(a.astype(float) for a in (t.seen[:, 0], t.seen[:, 1], t.seen_score, t.hidden[:, 0], t.hidden[:, 1], t.hidden_score)), float(t.out)) for (p, i), t in sorted(states.items())]


def _unpacked(pdf: pd.DataFrame) -> dict:
    pair = lambda a, b: np.stack([np.asarray(a, float), np.asarray(b, float)], 1)
    return {(r.part, int(r.ind)): viterbi.Track(pair(r.seen_x, r.seen_y), np.asarray(r.seen, float), pair(r.hidden_x, r.hidden_y), np.asarray(r.hidden, float), float(r.out)) for r in pdf.itertuples()}


class Solver:
    """Poses within chains of segments: a solved segment and the unsolved ones that start from it. Groups are chains, or pieces of them."""

    def __init__(self, parts: list[str], n: int, cfg: viterbi.Settings, algorithm: str = "hungarian", radius: float = 0.0, states: bool = False) -> None:
        """With `states`, each pose has the scores of its track in that frame beside it."""
        self.parts, self.n, self.cfg, self.algorithm, self.radius, self.states = parts, n, cfg, algorithm, radius, states
        self.columns = [*_POSE_COLUMNS, *(_STATE_COLUMNS[2:] if states else [])]
        self.schema = f"{_POSE}, {_STATE.split(', ', 2)[2]}" if states else _POSE

    def settings(self, limbs: pd.DataFrame) -> tuple[viterbi.Settings, pd.DataFrame]:
        """The solver's settings and the skeleton of a chain's video; limbs: sigma, part_a, part_b, avg, std."""
        skeleton = limbs[limbs["part_a"].notna()][["part_a", "part_b", "avg", "std"]].sort_values(["part_a", "part_b"])
        links: dict = {}
        for r in skeleton.itertuples():
            links.setdefault(r.part_a, {})[r.part_b] = (r.avg, r.std)
            links.setdefault(r.part_b, {})[r.part_a] = (r.avg, r.std)
        return viterbi.Settings(**{**self.cfg.__dict__, "sigma": float(limbs["sigma"].iloc[0]), "links": links}), skeleton

    def fixed(self, own: pd.DataFrame, cfg: viterbi.Settings, skeleton: pd.DataFrame) -> dict:
        """(part, ind) -> (xy, p) of a fix frame, its clusters put together to bodies."""
        if len(own):
            own = own.copy()
            centres = own.assign(wx=own["x"] * own["p"], wy=own["y"] * own["p"]).groupby(["part", "ind"], sort=True).agg(wx=("wx", "sum"), wy=("wy", "sum"), w=("p", "sum"), x=("x", "mean"), y=("y", "mean"), p=("p", "max")).reset_index()
            for c in ("x", "y"):
                centres[c] = np.where(centres["w"] > 0, centres[f"w{c}"] / centres["w"].where(centres["w"] > 0, 1), centres[c]) + 0.5
            body = fix_assignment(centres.assign(x=centres["x"] * cfg.scale, y=centres["y"] * cfg.scale), skeleton, self.n, self.algorithm)
            own["ind"] = [body[p, int(i)] for p, i in zip(own["part"], own["ind"], strict=True)]
        return {(part, int(i)): (g[["x", "y"]].to_numpy(float) + 0.5, g["p"].to_numpy(float)) for (part, i), g in own.groupby(["part", "ind"], sort=True)}

    @staticmethod
    def maps(cells: pd.DataFrame) -> dict:
        """frame -> part -> (xy, p)."""
        out: dict = {}
        for (f, part), g in cells.groupby(["frame", "part"], sort=True):
            out.setdefault(int(f), {})[part] = (g[["x", "y"]].to_numpy(float) + 0.5, g["p"].to_numpy(float))
        return out

    def poses(self, anchor: int, solved: dict, near, seg) -> pd.DataFrame:
        beside = lambda key, t: _packed({key: t})[0][2:] if self.states else ()
        rows = [(anchor, seg.get(f, anchor), f, *key, *viterbi.pose(t, near(f, *key), self.radius), *beside(key, t)) for f, tracks in sorted(solved.items()) for key, t in sorted(tracks.items())]
        return pd.DataFrame(rows, columns=self.columns)

    def chain(self, cells: pd.DataFrame, limbs: pd.DataFrame) -> pd.DataFrame:
        """A whole chain: its cells, and with a column ind those of its fix frame."""
        if not len(cells):
            return pd.DataFrame(columns=self.columns)
        cfg, skeleton = self.settings(limbs)
        own, whole = cells[cells["ind"].notna()], cells[cells["ind"].isna()]
        fix, anchor = int(cells["anchor_fix"].iloc[0]), int(cells["anchor"].iloc[0])
        first, maps = self.fixed(own, cfg, skeleton), self.maps(whole)
        solved = viterbi.solve(maps, fix, first, self.parts, self.n, cfg)
        return self.poses(anchor, solved, lambda f, part, i: first.get((part, i)) if f == fix else maps[f].get(part), whole.groupby("frame")["seg_id"].first())

    def begin(self, cells: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        """The tracks in a fix frame."""
        cfg, skeleton = self.settings(side)
        first = self.fixed(cells, cfg, skeleton)
        states = {(p, i): viterbi.start(*first.get((p, i), viterbi.NOTHING), cfg) for p in self.parts for i in range(self.n)}
        return pd.DataFrame(_packed(states), columns=_STATE_COLUMNS).assign(anchor=side["anchor"].iloc[0], role="before")

    def onward(self, cells: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        """The tracks in the last frame of a piece from those before its first one."""
        cfg, _ = self.settings(side[side["role"] == "limb"])
        before, maps = _unpacked(side[side["role"] == "before"]), self.maps(cells)
        order = sorted(maps, key=lambda f: abs(f - int(side["anchor_fix"].iloc[0])))
        states = viterbi.advance(before, [maps[f] for f in order], self.parts, self.n, cfg)
        return pd.DataFrame(_packed(states[-1] if states else before), columns=_STATE_COLUMNS).assign(anchor=side["anchor"].iloc[0], role="before")

    def back(self, cells: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        """A piece's poses, and the tracks that the piece before it is reached from (role later): those of this one's first frame.

        The tracks before the piece are also reached from there (role fix), which counts where they are those of the fix frame.
        """
        cfg, _ = self.settings(side[side["role"] == "limb"])
        anchor = int(side["anchor"].iloc[0])
        before, after, maps = _unpacked(side[side["role"] == "before"]), side[side["role"] == "later"], self.maps(cells)
        order = sorted(maps, key=lambda f: abs(f - int(side["anchor_fix"].iloc[0])))
        later = _unpacked(after) if len(after) else None
        states = viterbi.retreat(later, viterbi.advance(before, [maps[f] for f in order], self.parts, self.n, cfg), self.parts, self.n, cfg)
        later = states[0] if states else later
        (fix,) = viterbi.retreat(later, [before], self.parts, self.n, cfg)
        out = [self.poses(anchor, dict(zip(order, states, strict=True)), lambda f, part, i: maps[f].get(part), cells.groupby("frame")["seg_id"].first()).assign(role="pose")]
        out += [pd.DataFrame(_packed(s), columns=_STATE_COLUMNS).assign(anchor=anchor, role=role) for s, role in ((later, "later"), (fix, "fix")) if s is not None]
        rows = pd.concat(out).reindex(columns=[*_POSE_COLUMNS, *_STATE_COLUMNS[2:], "role"])
        lists = _STATE_COLUMNS[2:-1]
        rows[lists] = rows[lists].astype(object).where(rows[lists].notna(), None)
        return rows

    def end(self, cells: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        """The poses in a fix frame from its tracks."""
        cfg, skeleton = self.settings(side[side["role"] == "limb"])
        first, fix = self.fixed(cells, cfg, skeleton), int(side["anchor_fix"].iloc[0])
        return self.poses(int(side["anchor"].iloc[0]), {fix: _unpacked(side[side["role"] == "before"])}, lambda f, part, i: first.get((part, i)), {})


def solve_segments(cells: DataFrame, clustered: DataFrame, segs: DataFrame, parts: list[str], n: int, cfg: viterbi.Settings, limbs: DataFrame, chain_frames: int = CHAIN_FRAMES, intermediate=None, algorithm: str = "hungarian", radius: float = 0.0, states: bool = False) -> DataFrame:
    """Poses within each chain of segments; identities agree within a chain only, `stitch` makes chains agree.

    segs: video, seg_id, start, end, fix, score; limbs: video, sigma, part_a, part_b, avg, std, a row for each limb and one at least for each video.

    A chain that reaches at most `chain_frames` frames from its fix frame is a group of its own. A longer one is cut into pieces of so many frames:
    outwards, each piece hands the tracks of its last frame on to the next one, through a written table; back
    again, each piece is solved from the tracks before it and those of the first frame of the piece after it. The poses
    are those of the whole chain solved at once. All chains go a piece further at a time, so there are four steps for each piece of the longest.
    """
    from trailmark.session import materialize

    spark = cells.sparkSession
    keep = intermediate or (lambda df, name: materialize(spark, df, name))
    levels = segments.run_levels(segs, ("video",))
    chains = segs.join(levels.select("seg_id", "anchor"), "seg_id")
    anchor_fix = segs.select(F.col("seg_id").alias("anchor"), F.col("fix").alias("anchor_fix"))
    chains = chains.join(anchor_fix, "anchor").select("seg_id", "start", "end", "anchor", "anchor_fix", "video")
    reach = F.greatest(F.max("end") - 1 - F.first("anchor_fix"), F.first("anchor_fix") - F.min("start"))
    ends = keep(chains.groupBy("anchor").agg(F.first("anchor_fix").alias("anchor_fix"), F.first("video").alias("video"), reach.alias("reach")), "chains")
    chains = chains.join(ends.select("anchor", "reach"), "anchor").drop("video")
    longest = ends.agg(F.max("reach")).first()[0] or 0
    solver = Solver(parts, n, cfg, algorithm, radius, states)
    side = keep(ends.join(limbs, "video").select("anchor", "anchor_fix", "reach", "sigma", "part_a", "part_b", "avg", "std", F.lit("limb").alias("role")), "limbs")
    shared = ["anchor", "anchor_fix", "reach", "seg_id", "frame", "part"]
    placed = segments.frame_to_segment(cells.select("frame", "part", "x", "y", "p"), chains).select(*shared, F.lit(None).cast("long").alias("ind"), *(F.col(c).cast("double").alias(c) for c in ("x", "y", "p")))
    fixes = segments.frame_to_segment(clustered.select("frame", "part", "ind", "x", "y", "p"), chains).filter("frame = anchor_fix").select(*shared, "ind", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "p")))

    def grouped(left: DataFrame, right: DataFrame, run, schema: str) -> DataFrame:
        return spread(left, "anchor").groupBy("anchor").cogroup(spread(right, "anchor").groupBy("anchor")).applyInPandas(lambda a, b: run(a, b), schema)

    short = F.col("reach") <= chain_frames
    poses = grouped(placed.unionByName(fixes).filter(short), side.filter(short), solver.chain, solver.schema)
    pieces = -(-longest // chain_frames)
    if pieces <= 1:
        return poses
    far = F.abs(F.col("frame") - F.col("anchor_fix"))
    away = placed.filter(~short & (far > 0)).withColumn("way", F.when(F.col("frame") > F.col("anchor_fix"), 1).otherwise(-1)).withColumn("piece", F.expr(f"(abs(frame - anchor_fix) - 1) div {chain_frames}"))
    away = keep(away.repartition("anchor", "way", "piece"), "pieces")
    side, fixes = side.filter(~short), keep(fixes.filter(~short), "fixes")
    state = f"{_STATE}, anchor long, role string"
    with_fix = lambda s: s.join(ends.select("anchor", "anchor_fix"), "anchor").unionByName(side, allowMissingColumns=True)
    start = keep(grouped(fixes, side, solver.begin, state), "border")
    found = [poses]
    for way in (1, -1):
        of = lambda j: away.filter((F.col("way") == way) & (F.col("piece") == j))  # noqa: B023, E731
        before = [start]
        for j in range(pieces - 1):
            before.append(keep(grouped(of(j), with_fix(before[j]), solver.onward, state), "border"))
        later = None
        for j in range(pieces - 1, -1, -1):
            borders = before[j] if later is None else before[j].unionByName(later)
            got = keep(grouped(of(j), with_fix(borders), solver.back, f"{_POSE}, {_STATE.split(', ', 2)[2]}, role string"), "piece")
            found.append(got.filter("role = 'pose'").select(*solver.columns))
            later = got.filter("role = 'later'").select(*_STATE_COLUMNS, "anchor", "role")
        start = got.filter("role = 'fix'").select(*_STATE_COLUMNS, "anchor", F.lit("before").alias("role"))
    found.append(grouped(fixes, with_fix(start), solver.end, solver.schema))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def components(limbs: DataFrame, parts: list[str]) -> DataFrame:
    """video, part, component: the parts of each video that its limbs connect; a part without a limb is a component of its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = {p: i for i, p in enumerate(parts)}
        some = pdf[pdf["part_a"].notna()]
        labels = kernels.components_of(len(parts), [(at[a], at[b]) for a, b in zip(some["part_a"], some["part_b"], strict=True) if a in at and b in at])
        return pd.DataFrame({"video": pdf["video"].iloc[0], "part": parts, "component": labels})

    return limbs.select("video", "part_a", "part_b").groupBy("video").applyInPandas(run, "video long, part string, component long")


def stitch(poses: DataFrame, segs: DataFrame, bodies: DataFrame, n: int, algorithm: str = "greedy", span: int = SPAN) -> DataFrame:
    """anchor, part, ind, body: identities of every chain of a video made to agree with those of its best-scoring one.

    At each border the individuals of the two chains are assigned by the distances of their poses, summed over the parts of a
    component of the skeleton (`bodies`: video, part, component), so that components may change over on their own. All borders are
    assigned at once. An assignment is a permutation, so the order of a chain is the product of those from the first chain up
    to it: products within blocks of `span` chains first, then over the blocks, as a prefix sum. Seen from the best chain, each
    order is multiplied with the inverse of that one's.
    """
    ends = poses.groupBy("anchor").agg(F.min("frame").alias("first"), F.max("frame").alias("last")).withColumn("video", video_of("first"))
    w = Window.partitionBy("video").orderBy("first")
    ends = ends.withColumn("place", F.row_number().over(w) - 1).withColumn("next", F.lead("anchor").over(w)).withColumn("next_first", F.lead("first").over(w))
    borders = ends.filter("next IS NOT NULL")
    a = poses.join(borders.select("anchor", "next", "video", F.col("last").alias("frame")), ["anchor", "frame"]).select("video", "next", "part", "ind", "x", "y")
    b = poses.join(borders.select(F.col("next").alias("anchor"), F.col("next_first").alias("frame")), ["anchor", "frame"]).select(F.col("anchor").alias("next"), "part", F.col("ind").alias("cur"), F.col("x").alias("px"), F.col("y").alias("py"))
    cost = a.join(b, ["next", "part"]).join(bodies, ["video", "part"]).groupBy("next", "component", "ind", "cur").agg(F.sum(motion.distance("x", "y", "px", "py")).alias("cost"))
    kinds = bodies.select("video", "component").distinct()
    all_borders = ends.select("video", "anchor", "place").join(kinds, "video")
    met = all_borders.join(cost.withColumnRenamed("next", "anchor"), ["anchor", "component"], "left")

    def assigned(pdf: pd.DataFrame) -> pd.DataFrame:
        r, some = pdf.iloc[0], pdf[pdf["cost"].notna()]
        link = np.arange(n)
        if r["place"] > 0:
            m = np.full((n, n), 1e9 if len(some) else 0.0)
            m[some["ind"].to_numpy(int), some["cur"].to_numpy(int)] = some["cost"].to_numpy()
            for p, c in kernels.ASSIGN[algorithm](m):
                link[c] = p
        return pd.DataFrame([(int(r["video"]), int(r["component"]), int(r["anchor"]), int(r["place"]), link)], columns=["video", "component", "anchor", "place", "link"])

    links = met.groupBy("anchor", "component").applyInPandas(assigned, "video long, component long, anchor long, place long, link array<long>")

    def products(order: str, own: bool):
        """Products of the permutations `link` of a group in order: of all up to each one, itself included or not."""

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order)
            total, out = np.arange(n), []
            for link in pdf["link"]:
                before, total = total, total[np.asarray(link, int)]
                out.append(total if own else before)
            return pdf.assign(upto=out).drop(columns="link")

        return run

    block = F.expr(f"place div {span}").alias("block")
    inside = links.select("video", "component", "anchor", "place", block, "link").groupBy("video", "component", "block").applyInPandas(products("place", True), "video long, component long, anchor long, place long, block long, upto array<long>")
    totals = inside.groupBy("video", "component", "block").agg(F.max_by("upto", "place").alias("link"))
    bases = totals.groupBy("video", "component").applyInPandas(products("block", False), "video long, component long, block long, upto array<long>").withColumnRenamed("upto", "base")
    orders = inside.join(bases, ["video", "component", "block"]).select("video", "component", "anchor", F.expr("transform(upto, i -> base[CAST(i AS INT)])").alias("to_first"))
    chosen = ends.select("video", F.col("anchor").alias("seg_id")).join(segs.select("seg_id", "score"), "seg_id").groupBy("video").agg(F.max_by("seg_id", F.struct("score", -F.col("seg_id"))).alias("anchor"))
    best = orders.join(chosen, ["video", "anchor"]).select("video", "component", F.col("to_first").alias("best"))
    body = orders.join(best, ["video", "component"]).select("video", "component", "anchor", F.posexplode(F.expr("transform(to_first, i -> array_position(best, i) - 1)")).alias("ind", "body"))
    return body.join(bodies, ["video", "component"]).select("anchor", "part", F.col("ind").cast("long").alias("ind"), F.col("body").cast("long").alias("body"))


def sparse_cells(cells: DataFrame, mode: str, threshold: float, stride: float = frames.STRIDE, width: int | None = None, height: int | None = None) -> DataFrame:
    """The cells sparsified by mode, placed as the tracker takes them: half a cell before their centre. Without offsets these are 0.

    With the size of the map (in cells), what lies beyond its edge is dropped; it has no negative places anyway.
    """
    df = frames.sparsify(cells, mode, threshold, stride, 2, 1.0, width, height)
    if mode == "UPSCALE":
        for c, size in (("x", width), ("y", height)):
            df = df.filter((F.col(c) >= 0) & (F.lit(True) if size is None else F.col(c) < size * stride))
    half = 0.0 if mode == "UPSCALE" else 0.5
    # Rows of one place and p are alike from here on, so that nothing depends on their event.
    return df.select("frame", "part", (F.col("x") - half).cast("double").alias("x"), (F.col("y") - half).cast("double").alias("y"), "p", F.lit(0).cast("long").alias("event_id"))


@dataclass
class Run:
    """A video's (or several videos') tables between clustering and poses, all written, so that a part of them can be solved again."""

    cells: DataFrame
    clustered: DataFrame
    segs: DataFrame
    plan: DataFrame  # video, sigma and the limbs
    parts: list[str]
    n: int
    solve: Callable[..., DataFrame]  # cells, clustered, segs -> poses within chains
    recluster: Callable[[DataFrame], DataFrame]
    accept: Callable[[DataFrame], DataFrame]  # cells as they come -> the cells that are tracked
    finish: Callable[..., DataFrame]  # units and keys of the result
    keep: Callable[[DataFrame, str], DataFrame]
    found: DataFrame | None = None

    def poses(self) -> DataFrame:
        """anchor, seg_id, frame, part, ind, x, y, p within chains; solved once."""
        if self.found is None:
            self.found = self.keep(self.solve(self.cells, self.clustered, self.segs), "poses")
        return self.found

    def result(self) -> DataFrame:
        """The poses with the individuals of all chains in agreement."""
        order = stitch(self.poses(), self.segs, components(self.plan, self.parts), self.n)
        return self.finish(self.poses().join(order, ["anchor", "part", "ind"]).select("frame", "part", "body", "x", "y", F.col("p").alias("likelihood")))

    def planes(self) -> DataFrame:
        """[by,] frame, part, body, plane, x, y, p, ox, oy: what the solver holds of each track in the end, in cells of the tracked table.

        Source has the cells that are tracked (those of all bodies), Frame the scores of the cells and Occluded/Edge those of hidden places,
        each scaled by the solver; places without a score have no row. ox and oy say how far a place lies from its cell's centre, in cells.
        """
        order = self.keep(stitch(self.poses(), self.segs, components(self.plan, self.parts), self.n), "order")
        tracks = self.keep(self.solve(self.cells, self.clustered, self.segs, states=True).join(order, ["anchor", "part", "ind"]), "tracks")
        scores = lambda plane, c: tracks.select("frame", "part", "body", F.lit(plane).alias("plane"), F.explode(F.arrays_zip(f"{c}_x", f"{c}_y", c)).alias("v")).select("frame", "part", "body", "plane", F.col(f"v.{c}_x").alias("x"), F.col(f"v.{c}_y").alias("y"), F.exp(f"v.{c}").alias("p"))
        source = tracks.select("frame", "part", "body", F.lit(PLANES[0]).alias("plane")).join(self.cells.select("frame", "part", F.col("x") + 0.5, F.col("y") + 0.5, "p").toDF("frame", "part", "x", "y", "p"), ["frame", "part"])
        every = source.union(scores(PLANES[1], "seen")).union(scores(PLANES[2], "hidden")).filter("p > 0")
        cell = {c: F.floor(c) for c in "xy"}
        every = every.select("frame", "part", "body", "plane", *(v.alias(c) for c, v in cell.items()), "p", *((F.col(c) - v - 0.5).alias(f"o{c}") for c, v in cell.items()))
        return self.finish(every, scaled=False)

    def rerun(self, changes: DataFrame) -> Run:
        """This run with the cells of some frames and parts replaced by `changes` (frame, part, x, y, p), as a user's edits leave them.

        A frame and part of which all rows have a null p has no cell any more. Segments, fix frames, sigma and limbs stay as they
        are. Only chains that hold a changed frame are solved again, from the cells of their own frames; the stored
        poses stand for the others, and all chains are stitched anew. The result is that of solving every chain with the changed cells.
        Frames beyond the segments are an error, parts that the run does not have too. No change gives the same poses.
        """
        keys = self.keep(changes.select("frame", "part").distinct(), "changed")
        chains = self.keep(self.segs.join(segments.run_levels(self.segs, ("video",)).select("seg_id", "anchor"), "seg_id"), "chains")
        placed = segments.frame_to_segment(keys, chains)
        if not keys.filter(~F.col("part").isin(self.parts)).isEmpty() or placed.count() != keys.count():
            raise ValueError("changes of a part or frame that the run does not have")
        touched = self.keep(placed.select("anchor").distinct(), "touched")
        fresh = self.keep(self.accept(changes.filter("p IS NOT NULL")), "fresh")
        cells = self.keep(self.cells.join(keys, ["frame", "part"], "left_anti").unionByName(fresh.select(*self.cells.columns)), "cells")
        clustered = self.keep(self.clustered.join(keys, ["frame", "part"], "left_anti").unionByName(self.recluster(fresh).select(*self.clustered.columns)), "clustered")
        again = chains.join(touched, "anchor", "left_semi").drop("anchor")
        solved = self.solve(cells, clustered, self.keep(again, "again"))
        poses = self.poses().join(touched, "anchor", "left_anti").unionByName(solved)
        return replace(self, cells=cells, clustered=clustered, found=self.keep(poses, "poses"))


def track(spark: SparkSession, cells: DataFrame, n: int, *settings, **named) -> DataFrame:
    """The poses of `prepared` with the same arguments: [by,] frame, part, body, x, y, likelihood for n individuals."""
    return prepared(spark, cells, n, *settings, **named).result()


def prepared(
    spark: SparkSession, cells: DataFrame, n: int, segment_size: int = 200, threshold: float = 0.001, max_cells: int = 100, use_skeleton: bool = True, cfg: viterbi.Settings | None = None, intermediate=None,
    sparsification: str | None = None, relaxed_radius: float = 0.0, algorithm: str = "hungarian", outlier: float = 3.0, map_stride: float = frames.STRIDE, width: int | None = None, height: int | None = None,
    pixels: bool = False, downscaling: float = 1.0, skeleton_edges: DataFrame | None = None, limb_lengths: DataFrame | None = None, by: tuple[str, ...] = (), chain_frames: int = CHAIN_FRAMES,
    linkage: str = "complete", nodes: str = "ALL",
) -> Run:
    """Everything up to the segments, ready to be solved for n individuals; frames without any cell of a part are hidden or not entered.

    Without a mode of sparsification the cells are taken as they are. A cell is `map_stride` pixels wide; with `pixels` all distances
    (clusters, motion, limbs, scores, moves) are in pixels and the poses are in video pixels, that is times `downscaling` where the
    video has been made smaller; else both are in cells. UPSCALE tracks pixels (so the relaxed radius is in pixels).
    `skeleton_edges` (part_a, part_b) are the limbs, all pairs of parts by default; `limb_lengths` (part_a, part_b, length) replaces
    the fit. `width` and `height` are those of the map in cells, as far as known. `by` names the columns of the video's key, where the table has several: each is tracked
    as if it were alone, with statistics of its own; the parts are those of the whole table. Frames are from 0 to 2**40 - 1.
    `intermediate` writes and rereads a table that is used more than once (session.materialize by default).
    """
    from trailmark.session import materialize

    keep = intermediate or (lambda df, name: materialize(spark, df, name))
    videos = None
    if by:
        named = cells.select(*by).distinct()
        videos = keep(named.withColumn("_video", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by)).cast("long") - 1), "videos")
        same = [cells[c].eqNullSafe(videos[c]) for c in by]
        on = same[0]
        for s in same[1:]:
            on = on & s
        numbered = cells.join(videos, on).select(*[cells[c] for c in cells.columns if c not in (*by, "frame")], (cells["frame"] + F.shiftleft(videos["_video"], STEP_BITS)).alias("frame"))
        cells = numbered
    video = video_of()

    def accept(some: DataFrame) -> DataFrame:
        chosen = sparse_cells(some, sparsification, threshold, map_stride, width, height) if sparsification else frames.above(some, threshold)
        if "event_id" not in chosen.columns:
            chosen = chosen.withColumn("event_id", F.lit(0).cast("long"))
        return frames.top_k(chosen, max_cells).select("frame", "part", "x", "y", "p", "event_id")

    fine = map_stride if sparsification == "UPSCALE" else 1.0  # places of the table in a cell
    stride = map_stride / fine if pixels else 1.0  # units of length in a place of the table
    sparse = keep(accept(cells), "cells")
    recluster = lambda some: cluster(some, n, linkage, stride, nodes)
    clustered = keep(recluster(sparse), "clustered")
    centres = frames.weighted_centroid(clustered, ("frame", "part", "ind"))
    points = keep(centres.withColumns({c: F.col(c) * stride for c in ("x", "y")}) if stride != 1 else centres, "points")
    parts = sorted(r["part"] for r in points.select("part").distinct().collect())
    # What a video's statistics say, a row a video: sigma, and the diagonal of the map in units of length.
    size = lambda known, c: F.lit(float(known)) if known is not None else (F.coalesce(F.max(c), F.lit(0)) + 1) / fine
    extent = sparse.groupBy(video.alias("video")).agg(size(width, "x").alias("w"), size(height, "y").alias("h"))
    sigma = motion.motion_sigma(points, video=video)
    params = keep(extent.join(sigma, "video", "left").select("video", F.coalesce("sigma", F.lit(1.0)).alias("sigma"), (F.sqrt(F.col("w") ** 2 + F.col("h") ** 2) * fine * stride).alias("diagonal")), "params")
    limbs = None
    if limb_lengths is not None:
        limbs = params.select("video").crossJoin(F.broadcast(motion.manual_skeleton(limb_lengths)))  # a body plan's limbs
    elif use_skeleton:
        limbs = motion.fit_skeleton(points, motion.all_edges(points) if skeleton_edges is None else motion.undirected(skeleton_edges), video=video)
    limbs = keep(limbs, "skeleton") if limbs is not None else None
    limbs = None if limbs is None or limbs.isEmpty() else limbs
    scores = scoring.frame_scores(points, len(parts), n, params, limbs, 0.0, outlier)
    base = F.shiftleft("video", STEP_BITS)
    own = segments.segments_of(scores.select(video.alias("video"), (F.col("frame") - F.shiftleft(video, STEP_BITS)).alias("frame"), "score", "fallback"), segment_size, by=("video",))
    segs = keep(own.select("video", *((F.col(c) + base).alias(c) for c in ("seg_id", "start", "end")), F.when(F.col("fix") >= 0, F.col("fix") + base).otherwise(-1).alias("fix"), "score"), "segments")
    solver = viterbi.Settings(**{**(cfg or viterbi.Settings()).__dict__, "scale": stride})
    kinds = "part_a string, part_b string, avg double, std double"
    plan = params.select("video", "sigma").join(limbs if limbs is not None else spark.createDataFrame([], f"video long, {kinds}"), "video", "left")
    plan = keep(plan, "plan")
    unit = map_stride / fine * downscaling if pixels else 1 / fine

    def finish(placed: DataFrame, scaled: bool = True) -> DataFrame:
        placed = placed if unit == 1 or not scaled else placed.withColumns({c: F.when(F.col(c) >= 0, F.col(c) * unit).otherwise(F.col(c)) for c in ("x", "y")})
        if videos is None:
            return placed
        return placed.withColumn("_video", video).join(videos, "_video").select(*by, (F.col("frame") - F.shiftleft("_video", STEP_BITS)).alias("frame"), *(c for c in placed.columns if c not in (*by, "frame")))

    solve = lambda c, k, g, states=False: solve_segments(c, k, g, parts, n, solver, plan, chain_frames, keep, algorithm, relaxed_radius, *([True] if states else []))
    return Run(sparse, clustered, segs, plan, parts, n, solve, recluster, accept, finish, keep)
