"""Edits by a user: overlays, mixes, peaks near a click, identity swaps, and the undo log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.math import gaussian
from trailmark.operators.frames import GROUP, distinct_cells, find_peaks


def overlay(base: DataFrame, edits: DataFrame, key: tuple[str, ...] = ("frame", "part", "ind")) -> DataFrame:
    """The edited rows in place of the base's with the same key."""
    return base.join(edits.select(*key).distinct(), list(key), "left_anti").unionByName(edits.select(*base.columns))


def current(log: DataFrame, key: tuple[str, ...] = ("frame", "part", "ind")) -> DataFrame:
    """The last edit of each key in a log (version, ..., undone) that has not been undone."""
    w = Window.partitionBy(*key).orderBy(F.desc("version"))
    return log.filter("NOT undone").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def replay(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The edits of a log (version, action, ...) that stand: action 'undo' takes back the last one that does, 'redo' brings the last
    one taken back again, and any other is an edit, after which nothing can be redone. Undo and redo with nothing to do are ignored.

    The stack is sequential, over the edits that a user has made to a video (key `by`): a group of its own.
    """

    def run(pdf):
        done, undone = [], []
        pdf = pdf.sort_values("version", kind="stable").reset_index(drop=True)
        for i, action in enumerate(pdf["action"]):
            if action == "undo":
                undone += [done.pop()] if done else []
            elif action == "redo":
                done += [undone.pop()] if undone else []
            else:
                done.append(i)
                undone = []
        return pdf.iloc[done]

    return log.groupBy(*(by or (F.lit(0).alias("_one"),))).applyInPandas(run, log.schema)


def point_edit(points: DataFrame, stride: float) -> tuple[DataFrame, DataFrame]:
    """(cells, flags) of poses (frame, part, ind, x, y, p) set by a user in video pixels: a single cell with its offset, none where p is
    0; the flags keep the frame out of clustering and its parts from being hidden."""
    fx, fy = F.col("x") / stride, F.col("y") / stride
    cells = points.filter("p > 0").select(
        "frame", "part", "ind", F.floor(fx).cast("long").alias("x"), F.floor(fy).cast("long").alias("y"), F.col("p").cast("double").alias("p"),
        ((fx - F.floor(fx) - 0.5) * stride).alias("ox"), ((fy - F.floor(fy) - 0.5) * stride).alias("oy"),
    )
    return cells, points.select("frame", "part", "ind", F.lit(True).alias("ignore_clustering"), F.lit(True).alias("disable_occluded"))


def default_spread(sigma: float | None = None, longest_limb: float | None = None) -> float:
    """The spread of a Gaussian edit in video pixels: the longest limb, else five sigma, five at least; 20 without either."""
    if longest_limb is not None:
        return max(5.0, longest_limb)
    return 20.0 if sigma is None else max(5.0, 5.0 * sigma)


def gaussian_cells(centres: DataFrame, spread: float, radius: int, strength: float) -> DataFrame:
    """Cells of a Gaussian about each centre (frame, part, x, y)."""
    d = F.array(*[F.lit(i) for i in range(-radius, radius + 1)])
    df = centres.select(*GROUP, F.col("x").alias("cx"), F.col("y").alias("cy"), F.explode(d).alias("dx")).select("*", F.explode(d).alias("dy"))
    return df.select(*GROUP, (F.col("cx") + F.col("dx")).alias("x"), (F.col("cy") + F.col("dy")).alias("y"), gaussian(F.col("dx"), F.col("dy"), spread, strength).alias("g"))


def mix(source: DataFrame, centres: DataFrame, spread: float = 2.0, radius: int = 3, strength: float = 0.667, keep: str = "gaussian", cap: int = 75) -> DataFrame:
    """The Gaussian of an edit added to the source cells, which are scaled to 1 - strength; divided by its maximum, the `cap` likeliest.

    keep: 'gaussian' has cells of the Gaussian only, 'source' cells of the source only.
    """
    cells = distinct_cells(source)
    w = Window.partitionBy(*GROUP)
    scaled = cells.withColumn("p", F.when(F.max("p").over(w) > 0, F.col("p") * (1 - strength) / F.max("p").over(w)).otherwise(F.lit(0.0)))
    g = gaussian_cells(centres, spread, radius, strength)
    key = [*GROUP, "x", "y"]
    both = g.join(scaled, key, "left") if keep == "gaussian" else scaled.join(g, key, "left")
    summed = both.select(*key, (F.coalesce("p", F.lit(0.0)) + F.coalesce("g", F.lit(0.0))).alias("p"))
    top = summed.withColumn("_n", F.row_number().over(w.orderBy(F.desc("p"), "y", "x"))).filter(F.col("_n") <= cap).drop("_n")
    return top.withColumn("p", F.col("p") / F.max("p").over(w))


def nearest_peak(cells: DataFrame, clicks: DataFrame, least: float = 0.05, selected: float = 0.95, other: float = 0.05) -> DataFrame:
    """Every cell belongs to its nearest peak of at least `least`; cells of the peak nearest to the click are scaled by `selected`, the
    others by `other`. A frame and part has a handful of peaks, so the pairs stay within its cells times those."""
    peaks = find_peaks(cells).filter(F.col("p") >= least).select(*GROUP, F.col("x").alias("px"), F.col("y").alias("py"))
    d = (F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2
    owner = distinct_cells(cells).join(peaks, list(GROUP)).groupBy(*GROUP, "x", "y", "p").agg(F.min_by(F.struct("px", "py"), F.struct(d, "py", "px")).alias("o"))
    click = clicks.select(*GROUP, F.col("x").alias("ux"), F.col("y").alias("uy"))
    to = (F.col("ux") - F.col("px")) ** 2 + (F.col("uy") - F.col("py")) ** 2
    chosen = click.join(peaks, list(GROUP)).groupBy(*GROUP).agg(F.min_by(F.struct("px", "py"), F.struct(to, "py", "px")).alias("c"))
    return owner.join(chosen, list(GROUP)).select(*GROUP, "x", "y", (F.col("p") * F.when(F.col("o") == F.col("c"), selected).otherwise(other)).alias("p"))


def swap_identities(poses: DataFrame, start: int, order: list[int]) -> DataFrame:
    """From frame `start` on, individual i becomes order[i]."""
    new = F.element_at(F.array(*[F.lit(i) for i in order]), (F.col("ind") + 1).cast("int"))
    return poses.withColumn("ind", F.when(F.col("frame") >= start, new).otherwise(F.col("ind")))


def touched_segments(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """The segments that a re-run has to solve again: those with an edited frame."""
    from trailmark.operators.segments import frame_to_segment

    return segments.join(frame_to_segment(edits.select("frame").distinct(), segments).select("seg_id").distinct(), "seg_id", "left_semi")


def render_plan(poses: DataFrame, cutoff: float = 0.1, hidden: bool = False) -> DataFrame:
    """What a renderer would draw: status 'filled' above the cutoff, 'hollow' below it if hidden tracks are shown; missing points not at all."""
    status = F.when(F.col("p") > cutoff, "filled").when(F.lit(hidden), "hollow")
    return poses.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumn("status", status).filter("status IS NOT NULL")
