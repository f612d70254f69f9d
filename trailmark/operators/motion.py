"""Histograms of movement and limb length, and what is read off them.

Statistics are per frame pair, equi-joined on the previous frame; histograms are aggregates by bin, so what comes out is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.session import materialize

MAD_SCALE = 0.6744897502


def distance(ax: str, ay: str, bx: str, by: str) -> Column:
    return F.sqrt((F.col(ax) - F.col(bx)) ** 2 + (F.col(ay) - F.col(by)) ** 2)


def previous(points: DataFrame, *keep: str) -> DataFrame:
    """The points with their frame moved on by one, and px, py, pp for the coordinates."""
    return points.select((F.col("frame") + 1).alias("frame"), *keep, F.col("x").alias("px"), F.col("y").alias("py"), F.col("p").alias("pp"))


def nearest_move(points: DataFrame) -> DataFrame:
    """frame, part, ind, moved: the smallest distance to a point of the same part in the previous frame."""
    return points.join(previous(points, "part"), ["frame", "part"]).groupBy("frame", "part", "ind").agg(F.min(distance("x", "y", "px", "py")).alias("moved"))


def histogram(df: DataFrame, value: str, size: float, offset: float, by: tuple[str, ...] = ()) -> DataFrame:
    """bin (its lower edge), freq and mean of the values, by group; a value's bin is trunc((value - offset) / size)."""
    k = ((F.col(value) - offset) / size).cast("long")
    return df.groupBy(*by, (k * size + offset).alias("bin")).agg(F.count(F.lit(1)).alias("freq"), F.avg(value).alias("mean"))


def _interpolate(points: DataFrame, q: float, by: tuple[str, ...]) -> DataFrame:
    """Value at share q of points (f, v) sorted by f, linear between neighbours, clamped at the ends."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    df = points.withColumn("_f0", F.lag("f").over(w.orderBy("f", "v"))).withColumn("_v0", F.lag("v").over(w.orderBy("f", "v")))
    value = F.when(F.col("_f0").isNull(), F.col("v")).otherwise(F.col("_v0") + (q - F.col("_f0")) / (F.col("f") - F.col("_f0")) * (F.col("v") - F.col("_v0")))
    return df.filter((F.col("f") >= q) & (F.col("_f0").isNull() | (F.col("_f0") < q))).groupBy(*by).agg(F.min(value).alias("value"))


def quantile(hist: DataFrame, q: float, by: tuple[str, ...] = ()) -> DataFrame:
    """The q-quantile of a histogram: bin means interpolated over the cumulative frequency."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    shares = hist.withColumn("f", F.sum("freq").over(w.orderBy("bin")) / F.sum("freq").over(w)).withColumn("v", F.col("mean"))
    return _interpolate(shares, q, by)


def deviation(hist: DataFrame, centres: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The median absolute deviation of a histogram about `centres` (by, value), interpolated from (0, 0)."""
    d = (hist.join(centres, list(by)) if by else hist.crossJoin(F.broadcast(centres))).withColumn("v", F.abs(F.col("value") - F.col("mean"))).drop("value")
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    shares = d.select(*by, (F.sum("freq").over(w.orderBy("v", "bin")) / F.sum("freq").over(w)).alias("f"), "v")
    zero = (shares.select(*by).distinct() if by else shares.limit(1).select()).select(*by, F.lit(0.0).alias("f"), F.lit(0.0).alias("v"))
    return _interpolate(shares.unionByName(zero), 0.5, by)


def mode(hist: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The bin with the most values, the lower of equal ones."""
    return hist.groupBy(*by).agg(F.max_by("bin", F.struct("freq", -F.col("bin"))).alias("bin"))


def moments(hist: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean and standard deviation from the bins."""
    n, s = F.sum("freq"), F.sum(F.col("freq") * F.col("mean"))
    return hist.groupBy(*by).agg((s / n).alias("avg"), F.sqrt(F.greatest(F.sum(F.col("freq") * F.col("mean") ** 2) / n - (s / n) ** 2, F.lit(0.0))).alias("std"))


def std_about(hist: DataFrame, centres: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """std: the root of the mean squared difference of the bins' means from given centres (by, value)."""
    d = hist.join(centres, list(by)) if by else hist.crossJoin(F.broadcast(centres))
    return d.groupBy(*by).agg(F.sqrt(F.sum(F.col("freq") * (F.col("mean") - F.col("value")) ** 2) / F.sum("freq")).alias("std"))


def bin_of(hist: DataFrame, values: DataFrame, value: str, size: float, offset: float, by: tuple[str, ...] = ()) -> DataFrame:
    """`values` with the bin that each falls into, its freq and mean; an empty bin has freq 0 and the value itself as its mean."""
    placed = values.withColumn("bin", ((F.col(value) - offset) / size).cast("long") * size + offset)
    got = placed.join(hist.select(*by, "bin", "freq", "mean"), [*by, "bin"], "left")
    return got.withColumns({"freq": F.coalesce("freq", F.lit(0)), "mean": F.coalesce("mean", F.col(value).cast("double"))})


def motion_sigma(points: DataFrame, size: float = 2.0, ignore_below: float = 1.0, factor: float = 3.0, video: Column | None = None) -> DataFrame:
    """sigma: the scaled median of the nearest moves of at least `ignore_below`; 1 if it would be below 0.1. A row for each `video`, of the frame."""
    moves, by = nearest_move(points).filter(F.col("moved") >= ignore_below), ()
    if video is not None:
        moves, by = moves.withColumn("video", video), ("video",)
    s = F.col("value") / MAD_SCALE * factor
    return quantile(histogram(moves, "moved", size, ignore_below, by), 0.5, by).select(*by, F.when(s < 0.1, 1.0).otherwise(s).alias("sigma"))


def limb_lengths(points: DataFrame, edges: DataFrame, video: Column | None = None) -> DataFrame:
    """[video,] part_a, part_b, length: for each edge and each individual of either part, the nearest of the other part in the next frame."""
    both = edges.select("part_a", "part_b", F.col("part_a").alias("part"), F.col("part_b").alias("other")).union(edges.select("part_a", "part_b", F.col("part_b").alias("part"), F.col("part_a").alias("other")))
    before = previous(points, "part", "ind").join(F.broadcast(both), "part")
    now = points.select("frame", F.col("part").alias("other"), "x", "y")
    near = before.join(now, ["frame", "other"]).groupBy("part_a", "part_b", "frame", "part", "ind").agg(F.min(distance("x", "y", "px", "py")).alias("length"))
    return near.select(*([] if video is None else [video.alias("video")]), "part_a", "part_b", "length")


def all_edges(points: DataFrame) -> DataFrame:
    """Every pair of parts, once; there are as many rows as the body plan has edges."""
    parts = points.select("part").distinct()
    return parts.select(F.col("part").alias("part_a")).join(parts.select(F.col("part").alias("part_b")), F.col("part_a") < F.col("part_b"))


def undirected(edges: DataFrame) -> DataFrame:
    """Edges with the smaller name first, once each, without loops."""
    return edges.filter("part_a <> part_b").select(F.least("part_a", "part_b").alias("part_a"), F.greatest("part_a", "part_b").alias("part_b")).distinct()


def manual_skeleton(weights: DataFrame) -> DataFrame:
    """part_a, part_b, avg, std for limb lengths (part_a, part_b, length) given by a user instead of fitted: the deviation is 1."""
    named = weights.filter("part_a <> part_b").select(F.least("part_a", "part_b").alias("part_a"), F.greatest("part_a", "part_b").alias("part_b"), F.col("length").cast("double").alias("avg"))
    return named.groupBy("part_a", "part_b").agg(F.max("avg").alias("avg")).withColumn("std", F.lit(1.0))


def skeleton_components(edges: DataFrame) -> DataFrame:
    """part, component (its smallest part) for the parts of a body plan's edges; a plan has a few dozen edges, one group."""

    def run(pdf):
        import pandas as pd

        from trailmark.operators.kernels import components_of

        parts = sorted({*pdf["part_a"], *pdf["part_b"]})
        labels = components_of(len(parts), [(parts.index(a), parts.index(b)) for a, b in zip(pdf["part_a"], pdf["part_b"], strict=True)])
        first = {label: part for label, part in reversed(list(zip(labels.tolist(), parts, strict=True)))}
        return pd.DataFrame({"part": parts, "component": [first[x] for x in labels.tolist()]})

    return edges.groupBy(F.lit(0).alias("_one")).applyInPandas(run, "part string, component string")


def max_product(points: DataFrame, sigma: float) -> DataFrame:
    """frame, part, ind, best: the best of the previous frame's points' log probability plus the log of the Gaussian move from there.

    Of points at one place the likeliest counts, and the move is one along x followed by one along y: the work grows with the places
    of a map and its sides, not with the pairs of points. Missing coordinates and probabilities give no score, but keep the row.
    """
    group = ["frame", "part"]
    along = lambda at, came: (F.col(at) - F.col(came)) ** 2 / (2 * sigma * sigma)
    places = points.select(*group, "x", "y").distinct()
    before = previous(points, "part").groupBy(*group, "px", "py").agg(F.max("pp").alias("pp"))
    logs = before.select(*group, "px", "py", F.when(F.col("pp") > 0, F.log("pp")).alias("s"))
    rows = places.select(*group, "x").distinct().join(logs, group).groupBy(*group, "x", "py").agg(F.max(F.col("s") - along("x", "px")).alias("s"))
    rows = rows.select(*group, F.col("x").alias("_x"), "py", "s")
    moved = places.join(rows, group).filter(F.col("x").eqNullSafe(F.col("_x"))).groupBy(*group, "x", "y").agg(F.max(F.col("s") - along("y", "py")).alias("best"))
    moved = moved.select(*group, F.col("x").alias("_x"), F.col("y").alias("_y"), "best")
    met = points.join(moved, group).filter(F.col("x").eqNullSafe(F.col("_x")) & F.col("y").eqNullSafe(F.col("_y")))
    return met.groupBy(*group, "ind").agg(F.max("best").alias("best"))


def fit_skeleton(points: DataFrame, edges: DataFrame, size: float = 2.0, video: Column | None = None) -> DataFrame:
    """[video,] part_a, part_b, avg, std: median limb length and its scaled median deviation (1 if below 0.1)."""
    by = (*(() if video is None else ("video",)), "part_a", "part_b")
    # A few rows for each edge, read twice below: written once, so that the pairs are not formed again.
    hist = materialize(points.sparkSession, histogram(limb_lengths(points, edges, video), "length", size, 0.0, by), "limbs")
    centre = quantile(hist, 0.5, by)
    s = F.col("value") / MAD_SCALE
    spread = deviation(hist, centre, by).select(*by, F.when(s < 0.1, 1.0).otherwise(s).alias("std"))
    return centre.withColumnRenamed("value", "avg").join(spread, list(by))
