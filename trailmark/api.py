"""The command surface: track, annotate, convert, split and tweak as functions on DataFrames, with checked settings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators import edits, frames, scoring, segments, tracking
from trailmark.sources import framestore, tables


@dataclass(frozen=True)
class Meta:
    """What is known of a video's maps: pixels a cell, size in cells, and how much smaller than the video the tracked pixels are."""

    stride: float = frames.STRIDE
    width: int | None = None
    height: int | None = None
    downscaling: float = 1.0
    by: tuple[str, ...] = ()  # the columns of the video's key, where a table has several


@dataclass(frozen=True)
class Settings:
    """Defaults of the segmented tracker; unknown names and values out of range are refused."""

    threshold: float = 0.001
    max_cells_per_frame: int = 100
    sparsification_mode: str = "OFFSET_DOMINATION"
    segment_size: int = 200
    relaxed_maximum_radius: float = 0.0
    assignment_algorithm: str = "hungarian"
    outlier_threshold: float = 3.0

    def __post_init__(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            if not isinstance(v, {"float": (int, float), "int": int, "str": str}[str(f.type)]) or isinstance(v, int | float) and v < 0:
                raise ValueError(f"{f.name}: {v!r}")
        if self.sparsification_mode not in ("OFFSET_DOMINATION", "OFFSET_COMBINATION", "OFFSET_SUMMATION", "UPSCALE", "IGNORE_OFFSETS"):
            raise ValueError(f"sparsification_mode: {self.sparsification_mode!r}")
        if self.assignment_algorithm not in ("hungarian", "greedy"):
            raise ValueError(f"assignment_algorithm: {self.assignment_algorithm!r}")


class Predictor(Protocol):
    """A plugin: cells in, poses (frame, part, body, x, y, likelihood) out, in cells without `meta` and in video pixels with it.

    A class may do more than a function: `open` is called before and `close` after, `settings` names what it takes with the defaults,
    and `several` tells whether it can follow more than one individual.
    """

    def __call__(self, spark: SparkSession, cells: DataFrame, individuals: int, settings: Settings, meta: Meta | None) -> DataFrame: ...


def arg_max(spark: SparkSession, cells: DataFrame, individuals: int, settings: Settings, meta: Meta | None = None) -> DataFrame:
    """The likeliest cells, always in video pixels."""
    if meta and meta.by:
        raise ValueError("ArgMax takes one video")
    return frames.argmax_pose(cells, individuals, (meta or Meta()).stride).withColumnRenamed("ind", "body")


def segmented(spark: SparkSession, cells: DataFrame, individuals: int, settings: Settings, meta: Meta | None = None) -> DataFrame:
    m = meta or Meta()
    return tracking.track(
        spark, cells, individuals, settings.segment_size, settings.threshold, settings.max_cells_per_frame,
        sparsification=settings.sparsification_mode, relaxed_radius=settings.relaxed_maximum_radius, algorithm=settings.assignment_algorithm, outlier=settings.outlier_threshold,
        map_stride=m.stride, width=m.width, height=m.height, pixels=meta is not None, downscaling=m.downscaling, by=m.by,
    )


PREDICTORS: dict[str, Callable[..., DataFrame]] = {"ArgMax": arg_max, "Segmented": segmented}


def predictors() -> dict[str, dict[str, Any]]:
    """The registered predictors with what they take (settings with defaults) and whether they follow several individuals."""
    defaults = {f.name: f.default for f in fields(Settings)}
    return {k: {"settings": getattr(p, "settings", {} if p is arg_max else defaults), "several": getattr(p, "several", True), "about": (p.__doc__ or "").strip()} for k, p in PREDICTORS.items()}


def register(name: str, predictor: Callable[..., DataFrame]) -> None:
    """Add a predictor; a name that is taken is refused."""
    if name in PREDICTORS:
        raise ValueError(f"there is a predictor {name!r} already")
    PREDICTORS[name] = predictor


def track(spark: SparkSession, cells: DataFrame, individuals: int = 1, predictor: str = "Segmented", meta: Meta | None = None, **settings) -> DataFrame:
    """Poses by a predictor from the registry."""
    if predictor not in PREDICTORS:
        raise ValueError(f"no predictor {predictor!r}; there are {sorted(PREDICTORS)}")
    run = PREDICTORS[predictor]
    if individuals > 1 and not getattr(run, "several", True):
        raise ValueError(f"{predictor} follows one individual only")
    if hasattr(run, "open"):
        run.open()
    try:
        return run(spark, cells, individuals, Settings(**settings), meta)
    finally:
        if hasattr(run, "close"):
            run.close()


def track_store(spark: SparkSession, path: str, individuals: int = 1, predictor: str = "Segmented", downscaling: float = 1.0, **settings) -> DataFrame:
    """Poses in video pixels from a frame store, whose header has the stride and the size of the maps."""
    h = framestore.read_header(path)
    return track(spark, framestore.read(spark, path), individuals, predictor, Meta(h.stride, h.width, h.height, downscaling), **settings)


#: Frame passes by name: each takes a DataFrame of cells or points and its settings, and gives one.
PASSES: dict[str, Callable[..., DataFrame]] = {
    "Threshold": lambda df, threshold=0.001: frames.above(df, threshold),
    "Sparsify": lambda df, mode="OFFSET_DOMINATION", threshold=0.001, stride=frames.STRIDE, width=None, height=None: tracking.sparse_cells(df, mode, threshold, stride, width, height),
    "TopCells": lambda df, most=100: frames.top_k(df, most).drop("ind"),
    "ClusterFrames": lambda df, individuals=2, linkage="complete", stride=1.0, nodes="ALL": tracking.cluster(df, individuals, linkage, stride, nodes),
    "Centroids": lambda df: frames.weighted_centroid(df, ("frame", "part", "ind")),
    "NormaliseFrames": lambda df: frames.normalise(df),
}


def run_passes(cells: DataFrame, passes: list) -> DataFrame:
    """The cells through passes in order, each given as "Name" or ["Name", {setting: value}]; all are checked before the first one runs."""
    steps = []
    for p in passes:
        name, config = (p, {}) if isinstance(p, str) else (p[0], dict(p[1]) if len(p) > 1 else {})
        if name not in PASSES:
            raise ValueError(f"no pass {name!r}; there are {sorted(PASSES)}")
        known = PASSES[name].__code__.co_varnames[1 : PASSES[name].__code__.co_argcount]
        if unknown := set(config) - set(known):
            raise ValueError(f"{name} has no setting {sorted(unknown)}; it has {sorted(known)}")
        steps.append((PASSES[name], config))
    for step, config in steps:
        cells = step(cells, **config)
    return cells


#: Score engines by name: poses (frame, part, ind, x, y, p) in, a score for each frame out.
SCORES: dict[str, Callable[..., DataFrame]] = {"Jumps": scoring.jumps, "TransitionEntropy": scoring.entropy_of_transitions}


def exported(cells: DataFrame, parts: list[str] | None = None, threshold: float = 1e-7) -> DataFrame:
    """What the exporter writes of the maps: the cells of some parts above the threshold."""
    kept = frames.above(cells, threshold)
    return kept if parts is None else kept.filter(kept["part"].isin(parts))


def export_maps(cells: DataFrame, folder: str, name: str, height: int, width: int, stride: float = frames.STRIDE, parts: list[str] | None = None, threshold: float = 1e-7, suffix: str = "_maps") -> str:
    """Write the maps of a video as a frame store beside others, and give its path."""
    path = f"{folder.rstrip('/')}/{name}{suffix}.store"
    framestore.write(exported(cells, parts, threshold), path, height, width, stride, threshold)
    return path


def export_states(run: tracking.Run, path: str, height: int, width: int, stride: float = frames.STRIDE, planes: str = "all", frame_count: int | None = None) -> list[str]:
    """Write what the solver holds of each track in the end as a frame store of maps of `height` by `width` cells, and give its part names.

    planes "all" has `<part>_<body>_<plane>` for all three planes, on a canvas with a border of a cell on each side, where hidden places
    beyond the map's edge are; "Frame" or "Source" has `<part>_<body>` for that one, without a border. Places beyond the canvas are an error.
    """
    if planes not in ("all", *tracking.PLANES[:2]):
        raise ValueError(f"planes: {planes!r}")
    every = planes == "all"
    found = run.planes() if every else run.planes().filter(F.col("plane") == planes)
    names = [f"{part}_{body}{suffix}" for part in run.parts for body in range(run.n) for suffix in ([f"_{p}" for p in tracking.PLANES] if every else [""])]
    name = F.concat_ws("_", "part", "body", *(["plane"] if every else []))
    cells = found.select("frame", name.alias("part"), *((F.col(c) + int(every)).alias(c) for c in "xy"), "p", *((F.col(c) * stride).alias(c) for c in ("ox", "oy")))
    framestore.write(cells, path, height + 2 * every, width + 2 * every, stride, 0.0, frames=frame_count, parts=names)
    return names


def pairs(*lists: list) -> list[tuple]:
    """Inputs that belong together, as tables to videos: lists of one length, or of one element, which goes with all."""
    n = max(map(len, lists), default=0)
    if any(len(x) not in (1, n) for x in lists):
        raise ValueError(f"lists of {[len(x) for x in lists]} elements can't be paired")
    return list(zip(*[x * n if len(x) == 1 else x for x in lists], strict=True))


def annotate(poses: DataFrame, cutoff: float = 0.1, draw_hidden_tracks: bool = False) -> DataFrame:
    """What would be drawn; pixels are left to a renderer."""
    return edits.render_plan(poses.withColumnRenamed("likelihood", "p"), cutoff, draw_hidden_tracks)


def convert_tracks(spark: SparkSession, path: str, target: str) -> None:
    """Any readable table to a result table."""
    tables.write_csv(tables.sniff(spark, path), target)


def split_videos(frame_table: DataFrame, seconds: float, fps: float) -> DataFrame:
    return segments.time_split(frame_table, seconds, fps)


def tweak(poses: DataFrame, changes: DataFrame) -> DataFrame:
    """Poses with a user's changes laid over."""
    return edits.overlay(poses, changes, ("frame", "part", "body"))
