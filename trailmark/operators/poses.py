"""Operators on whole tables of cells and poses: selection, slices, pivots, counts, planes of the solver's states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators.frames import GROUP, distinct_cells


def part_selection(cells: DataFrame, parts: list[str]) -> DataFrame:
    """The rows of some parts, with `place`, the part's index in the new order."""
    place = F.array_position(F.array(*[F.lit(p) for p in parts]), F.col("part")) - 1 if parts else F.lit(-1)
    return cells.withColumn("place", place.cast("int")).filter("place >= 0")


def pose_slice(poses: DataFrame, start: int = 0, stop: int | None = None, step: int = 1, parts: list[str] | None = None) -> DataFrame:
    """Every `step`-th frame from `start` up to, not with, `stop`; of some parts, if they are named."""
    keep = (F.col("frame") >= start) & ((F.col("frame") - start) % step == 0)
    keep = keep if stop is None else keep & (F.col("frame") < stop)
    return poses.filter(keep if parts is None else keep & F.col("part").isin(parts))


def pose_pivot(poses: DataFrame, parts: list[str], value: str = "x") -> DataFrame:
    """A row for each frame with a column `<part>_<value>` for each part; the largest of several values."""
    wide = poses.groupBy("frame").pivot("part", parts).agg(F.max(value))
    return wide.withColumnsRenamed({p: f"{p}_{value}" for p in parts})


def rollup_parts(poses: DataFrame) -> DataFrame:
    """part, ind, n, p (mean): of each individual of a part, of each part, and of all."""
    return poses.rollup("part", "ind").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p"))


def frame_count(cells: DataFrame) -> DataFrame:
    """frames (the last frame's number and one), with_cells, parts."""
    return cells.agg((F.max("frame") + 1).alias("frames"), F.countDistinct("frame").alias("with_cells"), F.countDistinct("part").alias("parts"))


def frame_extract(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """The cells of the wanted frames (ord, frame), as often as they are wanted; a list by a user, so it is broadcast."""
    return cells.join(F.broadcast(wanted), "frame").select("ord", *cells.columns)


def top_frame(cells: DataFrame) -> DataFrame:
    """part, frame, x, y, p: each part's likeliest cell over all frames; the first frame, then the upper, then the left of equal ones."""
    best = F.max_by(F.struct("frame", "x", "y", "p"), F.struct("p", -F.col("frame"), -F.col("y"), -F.col("x"))).alias("v")
    return cells.groupBy("part").agg(best).select("part", "v.*")


def with_prior(points: DataFrame, off: int = -1, by: tuple[str, ...] = ("part", "ind")) -> DataFrame:
    """An ordered pass: each row with the x, y and p (px, py, pp) of the same point `off` frames away, null where there is none."""
    other = points.select((F.col("frame") - off).alias("frame"), *by, F.col("x").alias("px"), F.col("y").alias("py"), F.col("p").alias("pp"))
    return points.join(other, ["frame", *by], "left")


def ordered_places(cells: DataFrame) -> DataFrame:
    """frame, part, n, places: the distinct places of each map, (y, x) in lexicographic order."""
    return distinct_cells(cells).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("y", "x"))).alias("places"))


def common_indices(left: DataFrame, right: DataFrame) -> DataFrame:
    """frame, part, x, y, left_index, right_index of the places that both sides have; a place's index is its rank by y, then x."""
    w = Window.partitionBy(*GROUP).orderBy("y", "x")
    ranked = lambda df, name: df.select(*GROUP, "x", "y").distinct().withColumn(name, F.row_number().over(w) - 1)
    return ranked(left, "left_index").join(ranked(right, "right_index"), [*GROUP, "x", "y"])


def colour_index(rows: DataFrame, parts: list[str], colours: int) -> DataFrame:
    """`rows` with `colour`, an index into a map of so many colours that is shared out evenly among the parts, and `shape`, that goes
    round with the individual."""
    place = F.array_position(F.array(*[F.lit(p) for p in parts]), F.col("part")) - 1
    return rows.withColumns({"colour": F.pmod(F.floor(place * colours / len(parts)).cast("int"), F.lit(colours)), "shape": F.pmod(F.col("ind"), F.lit(4)).cast("int")})


def decoded(maps: DataFrame, stride: float, deviation: float = 1.0, gain: float = 1.0, shift: float = 0.0) -> DataFrame:
    """A network's raw outputs (logit, lx, ly at cells x, y) as cells: p by the logistic function of gain * logit + shift, and the
    location refinements times `deviation` as offsets in pixels, held within a stride of the cell's centre."""
    p = 1 / (1 + F.exp(-(F.col("logit") * gain + shift)))
    held = lambda c: F.greatest(F.least(F.col(c) * deviation, F.lit(stride)), F.lit(-stride))
    return maps.withColumns({"p": p, "ox": held("lx"), "oy": held("ly")}).drop("logit", "lx", "ly")


def clipped(c: Column, gain: float = 1.0) -> Column:
    """A value scaled and held within 0 and 1."""
    return F.greatest(F.least(c * gain, F.lit(1.0)), F.lit(0.0))


def state_planes(cells: DataFrame, cut: float, obscured: float = 1e-8) -> DataFrame:
    """frame, part, plane, x, y, p: all cells as SOURCE, those above the cut as FRAME, the others as OCCLUDED with the probability of
    being hidden there."""
    plane = lambda df, name: df.select("frame", "part", F.lit(name).alias("plane"), "x", "y", "p")
    hidden = cells.filter(F.col("p") <= cut).withColumn("p", F.col("p") * obscured)
    return plane(cells, "SOURCE").union(plane(cells.filter(F.col("p") > cut), "FRAME")).union(plane(hidden, "OCCLUDED"))
