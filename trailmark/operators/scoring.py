"""Frame scores, the best frame, and quality checks of finished poses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators.motion import distance, previous


#: Places of frames for each video: frame numbers of a table of several videos are video * 2**STEP_BITS + frame, so no step joins two videos.
STEP_BITS = 40


def video_of(frame: str = "frame") -> Column:
    """The number of a frame's video."""
    return F.shiftright(frame, STEP_BITS)


def part_separation(points: DataFrame) -> DataFrame:
    """frame, part, min_dist, conf: over the pairs of individuals, the smallest distance and the mean product of p."""
    a, b = points.select("frame", "part", "ind", "x", "y", "p"), points.select("frame", "part", F.col("ind").alias("other"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("p").alias("pp"))
    pairs = a.join(b, ["frame", "part"]).filter("ind < other")
    return pairs.groupBy("frame", "part").agg(F.min(distance("x", "y", "px", "py")).alias("min_dist"), F.avg(F.col("p") * F.col("pp")).alias("conf"))


def frame_scores(points: DataFrame, parts: int, individuals: int, sigma: DataFrame | float, skeleton: DataFrame | None = None, diagonal: float = 0.0, outlier: float = 3.0) -> DataFrame:
    """frame, fallback, score, is_valid: the spread of the individuals weighted by confidence, less limb deviations.

    score is null (minus infinity) if a point is missing, individuals coincide, overlap (largest separation below sigma, only
    with a skeleton), or a limb is further than `outlier` standard deviations from its mean length. Limb deviations are shares of
    1 / (individuals * degree of the part); a limb of a missing point, and one to a part without any, counts the map's `diagonal`.
    With several videos `sigma` is a table (video, sigma, diagonal) and the skeleton has a column video, too; a frame's video is `video_of`.
    """
    video = video_of() if isinstance(sigma, DataFrame) and "video" in sigma.columns else None
    separation = part_separation(points).groupBy("frame").agg(
        F.sum(F.col("min_dist") * F.col("conf")).alias("geometric"), F.count(F.lit(1)).alias("paired"), F.min("min_dist").alias("closest"), F.max("min_dist").alias("widest")
    )
    found = points.groupBy("frame").agg(F.count(F.lit(1)).alias("points"))
    df = found.join(separation, "frame", "left")
    by = [] if video is None else ["video"]
    small = F.broadcast if video is None else lambda d: d  # the tables of one body plan; those of many videos may be large
    if video is not None:
        df = df.withColumn("video", video).join(sigma.select("video", F.col("sigma").alias("_sigma"), F.col("diagonal").alias("_diagonal")), "video", "left")
        points = points.withColumn("video", video)
    else:
        df = df.withColumn("_diagonal", F.lit(float(diagonal)))
        df = df.crossJoin(F.broadcast(sigma.select(F.col("sigma").alias("_sigma")))) if isinstance(sigma, DataFrame) else df.withColumn("_sigma", F.lit(float(sigma)))
    bad = (F.col("points") < parts * individuals) | (F.coalesce("paired", F.lit(0)) < parts) | (F.coalesce("closest", F.lit(0.0)) <= 1e-9)
    limbs = F.lit(0.0)
    if skeleton is not None:
        far = sigma.select("video", F.col("diagonal").alias("_far")) if video is not None else None
        edges = skeleton.select(*by, F.col("part_a").alias("part"), F.col("part_b").alias("other"), "avg", "std").union(skeleton.select(*by, F.col("part_b"), F.col("part_a"), "avg", "std"))
        edges = edges.join(far, "video") if far is not None else edges.withColumn("_far", F.lit(float(diagonal)))
        degree = edges.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("degree"))
        own = points.select(*by, "frame", "part", "ind", "x", "y").join(small(edges.join(degree, [*by, "part"])), [*by, "part"])
        other = points.select("frame", F.col("part").alias("other"), F.col("x").alias("px"), F.col("y").alias("py"))
        near = own.join(other, ["frame", "other"], "left").groupBy("frame", "part", "ind", "other", "std", "degree", "_far").agg(F.min(F.abs(distance("x", "y", "px", "py") - F.col("avg"))).alias("m"))
        per = near.groupBy("frame").agg(
            F.sum(F.coalesce("m", "_far") / (individuals * F.col("degree"))).alias("limbs"),
            F.max(F.when(F.col("m").isNull() | (F.col("m") / F.col("std") > outlier), 1).otherwise(0)).alias("outlying"),
        )
        # Each individual of a linked part has its limbs' shares, 1 / individuals together; those of missing ones cost the diagonal.
        linked = points.select(*by, "frame", "part", "ind").distinct().join(small(degree), [*by, "part"]).groupBy("frame").agg(F.count(F.lit(1)).alias("_here"))
        df = df.join(per, "frame", "left").join(linked, "frame", "left")
        total = degree.groupBy(*by).agg(F.count(F.lit(1)).alias("_linked"))
        df = df.join(total, by, "left") if by else df.join(F.broadcast(total))
        limbs = F.coalesce("limbs", F.lit(0.0)) + (F.coalesce("_linked", F.lit(0)) * individuals - F.coalesce("_here", F.lit(0))) * F.col("_diagonal") / F.lit(individuals)
        bad = bad | (F.coalesce("outlying", F.lit(0)) > 0) | (F.col("_linked").isNotNull() & (F.coalesce("widest", F.lit(0.0)) < F.coalesce("_sigma", F.lit(1.0))))
    fallback = F.coalesce("geometric", F.lit(0.0)) - limbs
    return df.select("frame", fallback.alias("fallback"), F.when(~bad, fallback).alias("score"), (~bad).alias("is_valid"))


def best_frame(scores: DataFrame, override: int | None = None) -> DataFrame:
    """frame: the one with the best score, else the best fallback; the first of equal ones; or the one that is asked for."""
    if override is not None:
        return scores.filter(F.col("frame") == override).select("frame")
    return scores.agg(F.max_by("frame", F.struct(F.col("is_valid"), F.coalesce("score", "fallback"), -F.col("frame"))).alias("frame"))


def bound_normalised(scores: DataFrame, bound: float, width: int, height: int, parts: int) -> DataFrame:
    """Scores as a share of the largest separation that the individuals could have."""
    return scores.withColumn("share", F.col("score") / (bound * (width * height) ** 0.5 * parts))


def jumps(poses: DataFrame, sigma: float, cutoff: float = 0.1) -> DataFrame:
    """frame, jump: the largest move from the frame before in units of sigma, of points that are likely in both frames."""
    w = Window.partitionBy("part", "ind").orderBy("frame")
    lag = lambda c: F.lag(c).over(w)
    df = poses.withColumn("_f", lag("frame")).withColumn("px", lag("x")).withColumn("py", lag("y")).withColumn("pp", lag("p"))
    moved = df.filter((F.col("_f") == F.col("frame") - 1) & (F.col("p") > cutoff) & (F.col("pp") > cutoff))
    return moved.groupBy("frame").agg(F.max(distance("x", "y", "px", "py") / sigma).alias("jump"))


def entropy_of_transitions(points: DataFrame, sigma: float) -> DataFrame:
    """frame, entropy: for each point of the frame before, the normalised Shannon entropy of where it may have gone (of those
    of its part); the largest of the frame, averaged with the one before."""
    pairs = points.join(previous(points, "part", F.col("ind").alias("other")), ["frame", "part"])
    weight = F.exp(-(distance("x", "y", "px", "py") ** 2) / (2.0 * sigma * sigma)) * F.col("p")
    w = Window.partitionBy("frame", "part", "other")
    q = pairs.withColumn("_w", weight).withColumn("q", F.col("_w") / F.sum("_w").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    term = F.when(F.col("q") > 0, -F.col("q") * F.log2("q")).otherwise(0.0)
    rows = q.filter("n > 1").groupBy("frame", "part", "other").agg((F.sum(term) / F.log2(F.max("n"))).alias("h"))
    frames = rows.groupBy("frame").agg(F.max("h").alias("h"))
    before = frames.select((F.col("frame") + 1).alias("frame"), F.col("h").alias("b"))
    return frames.join(before, "frame", "left").select("frame", ((F.col("h") + F.coalesce("b", "h")) / 2).alias("entropy"))


def flagged(scores: DataFrame, column: str, threshold: float) -> DataFrame:
    return scores.filter(F.col(column) > threshold)


def _nearest(good: Column, ahead: bool, by: tuple[str, ...]) -> Column:
    w = Window.partitionBy(*(by or (F.lit(0),))).orderBy("frame")
    return F.first(F.when(good, F.col("frame")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)) if ahead else F.last(F.when(good, F.col("frame")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))


def neighbours(scores: DataFrame, flag: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """frame, before, after: the nearest flagged frames on either side; `by` is the key of the video where the table has several."""
    return scores.select(*by, "frame", _nearest(flag, False, by).alias("before"), _nearest(flag, True, by).alias("after"))
