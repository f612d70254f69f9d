"""Operators on the cells of one frame and part: thresholds, sparsification, top-k, centroids, peaks, alignment, normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.math import clamp_into_cell, gaussian

#: Video pixels a cell where a caller names no other stride.
STRIDE = 8.0
GROUP = ("frame", "part")
NEG = float("-inf")


def _order(cells: DataFrame):
    """The likeliest first, then the upper, then the left one; an event_id, where there is one, decides between equal places."""
    return [F.desc("p"), "y", "x", *(c for c in ("event_id",) if c in cells.columns)]


def with_offsets(cells: DataFrame) -> DataFrame:
    """`cells` with ox and oy, 0 where the table has none."""
    return cells.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) if c in cells.columns else F.lit(0.0) for c in ("ox", "oy")})


def above(cells: DataFrame, threshold: float) -> DataFrame:
    """Cells with p strictly above the threshold."""
    return cells.filter(F.col("p") > threshold)


def top_k(cells: DataFrame, k: int, by: tuple[str, ...] = GROUP) -> DataFrame:
    """The k likeliest cells of each group, with their rank from 0; ties go to the upper, then the left cell."""
    w = Window.partitionBy(*by).orderBy(*_order(cells))
    return cells.withColumn("ind", F.row_number().over(w) - 1).filter(F.col("ind") < k)


def to_video(df: DataFrame, stride: float = STRIDE) -> DataFrame:
    """Cell to video coordinates: the centre of the cell."""
    return df.withColumn("x", F.col("x") * stride + 0.5 * stride).withColumn("y", F.col("y") * stride + 0.5 * stride)


def to_cells(df: DataFrame, stride: float = STRIDE) -> DataFrame:
    return df.withColumn("x", F.floor(F.col("x") / stride).cast("long")).withColumn("y", F.floor(F.col("y") / stride).cast("long"))


def argmax_pose(cells: DataFrame, n: int = 1, stride: float = STRIDE) -> DataFrame:
    """frame, part, ind, x, y, likelihood: the n likeliest points of each frame and part, in video coordinates with their offsets."""
    top = to_video(top_k(with_offsets(cells), n), stride)
    return top.select("frame", "part", F.col("ind").cast("int").alias("ind"), (F.col("x") + F.col("ox")).alias("x"), (F.col("y") + F.col("oy")).alias("y"), F.col("p").alias("likelihood"))


# -- sparsification ----------------------------------------------------------------------------------------------------


def _recell(cells: DataFrame, stride: float) -> DataFrame:
    """The cell that a detection falls into with its offset, and the offset there."""
    fx, fy = F.col("x") + 0.5 + F.col("ox") / stride, F.col("y") + 0.5 + F.col("oy") / stride
    return cells.select(*GROUP, "p", *(c for c in ("event_id",) if c in cells.columns), F.floor(fx).cast("long").alias("x"), F.floor(fy).cast("long").alias("y"), (fx - F.floor(fx) - 0.5).alias("ox"), (fy - F.floor(fy) - 0.5).alias("oy"))


def _placed(df: DataFrame, width: int | None, height: int | None) -> DataFrame:
    for c, size in (("x", width), ("y", height)):
        df = df if size is None else df.filter((F.col(c) >= 0) & (F.col(c) < size))
    return df.select(*GROUP, F.col("x").alias("cell_x"), F.col("y").alias("cell_y"), clamp_into_cell(F.col("x") + 0.5 + F.col("ox"), F.col("x")).alias("x"), clamp_into_cell(F.col("y") + 0.5 + F.col("oy"), F.col("y")).alias("y"), "p")


def sparsify(cells: DataFrame, mode: str = "OFFSET_DOMINATION", threshold: float = 0.001, stride: float = STRIDE, spread: int = 2, sigma: float = 1.0, width: int | None = None, height: int | None = None) -> DataFrame:
    """One cell for each place, by mode: OFFSET_DOMINATION keeps the likeliest detection, OFFSET_COMBINATION averages,
    OFFSET_SUMMATION adds and rescales to the former maximum, UPSCALE splats Gaussians on pixels, IGNORE_OFFSETS clips raw offsets. With the size of the map (in cells), what its offset has moved
    beyond the edge is dropped after merging."""
    df = with_offsets(above(cells, threshold))
    if mode == "IGNORE_OFFSETS":
        return _placed(df, width, height)
    if mode == "UPSCALE":
        d = F.array(*[F.lit(i) for i in range(-spread, spread + 1)])
        px, py = F.floor((F.col("x") + 0.5) * stride + F.col("ox")).cast("long"), F.floor((F.col("y") + 0.5) * stride + F.col("oy")).cast("long")
        spread_out = df.select(*GROUP, "p", px.alias("cx"), py.alias("cy"), F.explode(d).alias("dx")).select("*", F.explode(d).alias("dy"))
        splat = spread_out.select(*GROUP, (F.col("cx") + F.col("dx")).alias("x"), (F.col("cy") + F.col("dy")).alias("y"), (F.col("p") * gaussian(F.col("dx"), F.col("dy"), sigma)).alias("p"))
        return splat.groupBy(*GROUP, "x", "y").agg(F.max("p").alias("p")).filter(F.col("p") > threshold)
    moved = _recell(df, stride)
    key = (*GROUP, "x", "y")
    tie = [-F.col("event_id")] if "event_id" in moved.columns else [F.col("ox"), F.col("oy")]
    best = [F.max_by(c, F.struct("p", *tie)).alias(c) for c in ("ox", "oy")]
    if mode == "OFFSET_DOMINATION":
        return _placed(moved.groupBy(*key).agg(*best, F.max("p").alias("p")), width, height)
    if mode == "OFFSET_COMBINATION":
        return _placed(moved.groupBy(*key).agg(F.avg("ox").alias("ox"), F.avg("oy").alias("oy"), F.avg("p").alias("p")), width, height)
    if mode == "OFFSET_SUMMATION":
        summed = moved.groupBy(*key).agg(*best, F.sum("p").alias("s"), F.max("p").alias("m"))
        w = Window.partitionBy(*GROUP)
        return _placed(summed.withColumn("p", F.col("s") * F.max("m").over(w) / F.max("s").over(w)), width, height)
    raise ValueError(f"no such mode: {mode}")


# -- reductions --------------------------------------------------------------------------------------------------------


def weighted_centroid(cells: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """The probability-weighted mean place and the largest p; equal weights where all p are 0."""
    total = F.sum("p")
    mean = lambda c: F.when(total > 0, F.sum(F.col(c) * F.col("p")) / total).otherwise(F.avg(c))
    return cells.groupBy(*by).agg(mean("x").alias("x"), mean("y").alias("y"), F.max("p").alias("p"))


def relaxed_maximum(states: DataFrame, original: DataFrame, radius: float) -> DataFrame:
    """For the likeliest state of each group, the largest original p within `radius` of it, and where."""
    top = top_k(states, 1).select(*GROUP, F.col("x").alias("mx"), F.col("y").alias("my"))
    near = original.join(top, list(GROUP)).filter((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2 <= radius * radius)
    return top_k(near, 1).select(*GROUP, "x", "y", "p")


def distinct_cells(cells: DataFrame) -> DataFrame:
    """One row for each place, with the largest p."""
    return cells.groupBy(*GROUP, "x", "y").agg(F.max("p").alias("p"))


def find_peaks(cells: DataFrame) -> DataFrame:
    """Places without a larger p among their eight neighbours; equal neighbours are allowed to the right, below and below right only."""
    d = distinct_cells(cells)
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)])
    around = d.select(*GROUP, (F.col("x")).alias("nx"), F.col("y").alias("ny"), F.col("p").alias("np"), F.explode(steps).alias("s"))
    # A neighbour at (nx, ny) speaks against the place from which it is reached by (dx, dy).
    against = around.select(*GROUP, (F.col("nx") - F.col("s.dx")).alias("x"), (F.col("ny") - F.col("s.dy")).alias("y"), "np", F.expr("s.dx >= 0 AND s.dy >= 0").alias("may_equal"))
    beaten = d.join(against, [*GROUP, "x", "y"]).filter((F.col("np") > F.col("p")) | ((F.col("np") == F.col("p")) & ~F.col("may_equal")))
    return d.join(beaten.select(*GROUP, "x", "y").distinct(), [*GROUP, "x", "y"], "left_anti")


# -- two sides ---------------------------------------------------------------------------------------------------------


def align(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer join on the place: left_p and right_p, null where a side has no cell (ln 0)."""
    a, b = distinct_cells(left).withColumnRenamed("p", "left_p"), distinct_cells(right).withColumnRenamed("p", "right_p")
    return a.join(b, [*GROUP, "x", "y"], "full_outer")


def align_all(sides: list[DataFrame]) -> DataFrame:
    """Full outer join of any number of sides (frame, part, x, y, p) on the integer cell of their places: frame, part, x, y (the cell),
    and for side i its likeliest p{i} there and where that is (x{i}, y{i}; of equal ones the upper, then the left), null where it has none.

    One union and one aggregation, whatever the number of sides.
    """
    labelled = [s.select(*GROUP, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "p", F.lit(i).alias("side")) for i, s in enumerate(sides)]
    every = labelled[0]
    for s in labelled[1:]:
        every = every.unionByName(s)
    best = lambda i: F.max(F.when(F.col("side") == i, F.struct("p", (-F.col("y")).alias("y"), (-F.col("x")).alias("x")))).alias(f"s{i}")
    cells = every.groupBy(*GROUP, F.floor("x").alias("cx"), F.floor("y").alias("cy")).agg(*[best(i) for i in range(len(sides))])
    own = [c for i in range(len(sides)) for c in (F.col(f"s{i}.p").alias(f"p{i}"), (-F.col(f"s{i}.x")).alias(f"x{i}"), (-F.col(f"s{i}.y")).alias(f"y{i}"))]
    return cells.select(*GROUP, F.col("cx").alias("x"), F.col("cy").alias("y"), *own)


def places(cells: DataFrame) -> DataFrame:
    return cells.select(*GROUP, "x", "y")


def common_places(left: DataFrame, right: DataFrame) -> DataFrame:
    return places(left).intersect(places(right))


def all_places(left: DataFrame, right: DataFrame) -> DataFrame:
    return places(left).union(places(right)).distinct()


def only_left(left: DataFrame, right: DataFrame) -> DataFrame:
    return places(left).subtract(places(right))


def lookup(cells: DataFrame, wanted: DataFrame, default: float = 0.0) -> DataFrame:
    """p at the wanted places, `default` where there is no cell."""
    return wanted.join(distinct_cells(cells), [*GROUP, "x", "y"], "left").withColumn("p", F.coalesce("p", F.lit(default)))


def anti_collision(cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """p is 0 where another individual has chosen the place."""
    taken = chosen.select(*GROUP, "x", "y").distinct().withColumn("taken", F.lit(True))
    return cells.join(taken, [*GROUP, "x", "y"], "left").withColumn("p", F.when(F.col("taken"), F.lit(0.0)).otherwise(F.col("p"))).drop("taken")


# -- normalisation -----------------------------------------------------------------------------------------------------


def normalise(cells: DataFrame, by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """p over the group's sum."""
    return cells.withColumn("p", F.when(F.sum("p").over(Window.partitionBy(*by)) > 0, F.col("p") / F.sum("p").over(Window.partitionBy(*by))).otherwise(F.lit(0.0)))


def log_max_norm(cells: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """ln p less the group's largest; null for ln 0."""
    score = F.when(F.col("p") > 0, F.log("p"))
    return cells.withColumn("score", score).withColumn("score", F.col("score") - F.max("score").over(Window.partitionBy(*by)))


def log_sum_norm(cells: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """ln p less the logarithm of the group's sum, by log-sum-exp; null for ln 0."""
    w = Window.partitionBy(*by)
    df = cells.withColumn("score", F.when(F.col("p") > 0, F.log("p"))).withColumn("_m", F.max("score").over(w))
    return df.withColumn("score", F.col("score") - (F.col("_m") + F.log(F.sum(F.exp(F.col("score") - F.col("_m"))).over(w)))).drop("_m")


def range_norm(cells: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """p over the group's maximum, and as a byte."""
    w = Window.partitionBy(*by)
    scaled = F.when(F.max("p").over(w) > 0, F.col("p") / F.max("p").over(w)).otherwise(F.lit(0.0))
    return cells.withColumn("scaled", scaled).withColumn("byte", F.floor(F.col("scaled") * 255).cast("int"))


def display_log(cells: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """ln p from the group's smallest finite value (0) to its largest (1); 0 for p = 0."""
    w = Window.partitionBy(*by)
    s = F.when(F.col("p") > 0, F.log("p"))
    df = cells.withColumn("_s", s).withColumn("_lo", F.min("_s").over(w)).withColumn("_hi", F.max("_s").over(w))
    return df.withColumn("shown", F.when(F.col("_s").isNull(), 0.0).when(F.col("_hi") > F.col("_lo"), (F.col("_s") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1.0)).drop("_s", "_lo", "_hi")


def offset_field(cells: DataFrame, displacement: float, stride: float = STRIDE) -> DataFrame:
    """Cells whose offset is longer than `displacement` strides."""
    return cells.withColumn("length", F.sqrt(F.col("ox") ** 2 + F.col("oy") ** 2) / stride).filter(F.col("length") > displacement)


def dense_rows(cells: DataFrame, width: int) -> DataFrame:
    """frame, part, y, probs, off_x, off_y: dense rows of the map with the offset planes, zero where there is no cell."""
    best = F.max_by(F.struct("p", "ox", "oy"), F.struct("p", "ox", "oy")).alias("v")
    placed = with_offsets(cells).groupBy(*GROUP, "x", "y").agg(best)
    filled = placed.groupBy(*GROUP, "y").agg(F.map_from_entries(F.collect_list(F.struct(F.col("x").cast("long"), "v"))).alias("at"))
    row = lambda c: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at("at", i.cast("long"))[c], F.lit(0.0)))
    return filled.select(*GROUP, "y", row("p").alias("probs"), row("ox").alias("off_x"), row("oy").alias("off_y"))


def local_refine(cells: DataFrame, radius: int = 1) -> DataFrame:
    """Peaks with the centre of mass of their neighbourhood as an offset."""
    d = distinct_cells(cells)
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1)])
    wanted = find_peaks(cells).select(*GROUP, F.col("x").alias("px"), F.col("y").alias("py"), F.col("p").alias("peak"), F.explode(steps).alias("s"))
    near = wanted.withColumn("x", F.col("px") + F.col("s.dx")).withColumn("y", F.col("py") + F.col("s.dy")).join(d, [*GROUP, "x", "y"])
    total = F.sum("p")
    return near.groupBy(*GROUP, "px", "py", "peak").agg(
        F.when(total > 0, F.sum(F.col("p") * F.col("s.dx")) / total).otherwise(0.0).alias("dx"), F.when(total > 0, F.sum(F.col("p") * F.col("s.dy")) / total).otherwise(0.0).alias("dy")
    )
