"""Cutting a video into segments around its best frames, and lookups of frames in segments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def endpoint_segments(scores: np.ndarray, fallback: np.ndarray, size: int = 200) -> list[tuple[int, int, int, float]]:
    """(start, end, fix or -1, score) of the segments: frames are visited by falling score (larger index first among equals), each
    marks size / 2 frames on either side and becomes a fix frame; the video is cut there, and long pieces every `size` frames."""
    n = len(scores)
    fix = np.full(n, False)
    marked = np.full(n, False)
    half = size / 2
    for f in np.argsort(scores, kind="stable")[::-1]:
        if marked[f] or not np.isfinite(scores[f]):
            continue
        a, b = max(0, int(f - half)), min(n, int(f + half))
        fix[a:b] = False
        marked[a:b] = True
        fix[f] = True
    if n and not fix.any():
        fix[int(np.argmax(fallback))] = True
    cuts = sorted({0, n, *np.flatnonzero(fix).tolist()})
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        for s in range(a, b, size):
            own = s if fix[s] else -1
            out.append((s, min(b, s + size), own, float(scores[s]) if own >= 0 else -np.inf))
    return out


def midpoint_segments(scores: np.ndarray, size: int = 200) -> list[tuple[int, int, int, float]]:
    """(start, end, fix or -1, score) of segments about their fix frames: by falling score (larger index first among equals), a frame
    takes what is free from size / 2 frames before it to size / 2 after it; frames without a score get segments without a fix frame.
    Without any score there is none, which is an error where there are frames."""
    n = len(scores)
    taken, out = np.full(n, False), []
    for f in np.argsort(scores, kind="stable")[::-1]:
        if taken[f]:
            continue
        if not np.isfinite(scores[f]) and not out:
            raise ValueError("no frame has a score")
        a, b = max(0, int(f - size / 2)), min(n, int(f + size / 2))
        free = np.flatnonzero(~taken[a:b])
        taken[a:b] = True
        fix = int(f) if np.isfinite(scores[f]) else -1
        out.append((a + int(free[0]), a + int(free[-1]) + 1, fix, float(scores[f]) if fix >= 0 else -np.inf))
    return sorted(out)


def segments_of(scores: DataFrame, size: int = 200, frames: int | None = None, by: tuple[str, ...] = (), method: str = "endpoint") -> DataFrame:
    """seg_id, start, end, fix, score from frame scores (frame, score, fallback) by endpoint_segments or midpoint_segments.

    Greedy suppression is sequential, over one number a frame of a video: a video is a group of its own (key `by`), not the driver.
    """
    last = frames

    def run(pdf):
        import pandas as pd

        n = int(last if last is not None else pdf["frame"].max() + 1) if len(pdf) else 0
        score, back = np.full(n, -np.inf), np.full(n, -np.inf)
        at = pdf["frame"].to_numpy()
        score[at] = pdf["score"].fillna(-np.inf).to_numpy()
        back[at] = pdf["fallback"].fillna(-np.inf).to_numpy()
        rows = endpoint_segments(score, back, size) if method == "endpoint" else midpoint_segments(score, size)
        out = pd.DataFrame([(i, *r[:3], None if not np.isfinite(r[3]) else r[3]) for i, r in enumerate(rows)], columns=["seg_id", "start", "end", "fix", "score"])
        for c in by:
            out.insert(0, c, pdf[c].iloc[0])
        return out

    kinds = "".join(f"{c} {scores.schema[c].dataType.simpleString()}, " for c in reversed(by))
    return scores.groupBy(*(by or (F.lit(0).alias("_video"),))).applyInPandas(run, f"{kinds}seg_id long, start long, end long, fix long, score double")


def frame_to_segment(frames: DataFrame, segments: DataFrame, span: int = 256) -> DataFrame:
    """Each frame with its segment: an equi-join on blocks of `span` frames and a range condition, so no side need be small."""
    blocks = segments.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / span), F.floor((F.col("end") - 1) / span))))
    return frames.withColumn("_b", F.floor(F.col("frame") / span)).join(blocks, "_b").filter("frame >= start AND frame < end").drop("_b")


def time_split(frames: DataFrame, seconds: float, fps: float) -> DataFrame:
    """Each frame with the number of its piece of int(seconds * fps) frames and its place in it."""
    n = int(seconds * fps)
    return frames.withColumn("piece", F.floor(F.col("frame") / n)).withColumn("place", F.col("frame") % n)


def cut_split(frames: DataFrame, cuts: list[int]) -> DataFrame:
    """Each frame with the number of the piece between explicit cuts; 0 is added, repeated cuts count once."""
    edges = sorted({0, *cuts})
    piece = F.aggregate(F.array(*[F.lit(c) for c in edges]), F.lit(-1), lambda a, c: a + F.when(F.col("frame") >= c, 1).otherwise(0))
    return frames.withColumn("piece", piece)


def run_levels(segments: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """seg_id, level, before, anchor: the distance in segments to the nearest solved one (fix >= 0), whether it lies before, and
    which it is; of two as near, the later one."""
    w = Window.partitionBy(*(by or (F.lit(0),))).orderBy("seg_id")
    good = F.when(F.col("fix") >= 0, F.col("seg_id"))
    df = segments.withColumn("_l", F.last(good, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_r", F.first(good, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    dl, dr = F.col("seg_id") - F.col("_l"), F.col("_r") - F.col("seg_id")
    earlier = dl < F.coalesce(dr, F.lit(1 << 40))
    return df.select(*by, "seg_id", F.coalesce(F.least(dl, dr), F.lit(0)).alias("level"), F.coalesce(earlier & (dl > 0), F.lit(False)).alias("before"), F.when(earlier, F.col("_l")).otherwise(F.coalesce("_r", "_l")).alias("anchor"))


def run_ids(df: DataFrame, by: tuple[str, ...], order: str, value: str) -> DataFrame:
    """A number for each run of equal neighbouring values."""
    w = Window.partitionBy(*by).orderBy(order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return df.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def as_of(left: DataFrame, right: DataFrame, key: str, by: tuple[str, ...], value: str, ahead: bool = False) -> DataFrame:
    """The nearest row of `right` at or below (or at or above) each key of `left`, by group: one union and one window, no range join."""
    both = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_k", F.lit(None).cast(right.schema[key].dataType)).withColumn("_side", F.lit(1)).unionByName(
        right.select(*by, key, F.col(value).alias("_v"), F.col(key).alias("_k")).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    order = [F.desc(key), F.col("_side"), F.desc("_v")] if ahead else [F.col(key), F.col("_side"), F.col("_v")]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("found", F.last("_v", ignorenulls=True).over(w)).withColumn("found_at", F.last("_k", ignorenulls=True).over(w)).filter("_side = 1").drop("_v", "_k", "_side")
