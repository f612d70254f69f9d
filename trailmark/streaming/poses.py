"""Structured Streaming: poses per micro-batch, stream to store, and an online tracker with state.

Watermarks and windows are Spark's own; the online tracker keeps one small state for each part.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trailmark.operators import frames, viterbi


def batch_poses(stream: DataFrame, path: str, checkpoint: str, n: int = 1):
    """Arg-max poses of every micro-batch appended to Parquet; a frame has to arrive within one batch. Runs over all available data and stops."""

    def put(df: DataFrame, epoch: int) -> None:
        frames.argmax_pose(df, n).write.mode("overwrite").parquet(f"{path}/batch={epoch}")  # the same epoch again overwrites itself

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store(stream: DataFrame, path: str, checkpoint: str):
    """First phase of a two-phase predictor: everything to Parquet; the batch engine runs on it afterwards."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, late: str = "1 hour", length: str = "6 hours", slide: str | None = None) -> DataFrame:
    """Cells and mean probability by part and time window, tumbling or sliding; rows that are later than `late` are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", length, slide), "part").agg(F.count(F.lit(1)).alias("cells"), F.avg("p").alias("p"))


def sessions(stream: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Cells and mean probability by part and session: rows that are less than `gap` apart belong together."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "part").agg(F.count(F.lit(1)).alias("cells"), F.avg("p").alias("p"))


def once(stream: DataFrame, late: str = "1 hour", keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Each event once, however often it is sent within the time that the watermark allows; the state is as large as that time's keys."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def complete(spark, path: str, total: int) -> DataFrame:
    """The poses of batch_poses; an error if they are not of as many frames as the video has."""
    poses = spark.read.parquet(path)
    found = poses.select("frame").distinct().count()
    if found != total:
        raise ValueError(f"poses of {found} frames, of {total}")
    return poses


def online(stream: DataFrame, n: int = 1, sigma: float = 3.0) -> DataFrame:
    """Forward-only tracking: for each part the tracks of the last frame are the state; a frame is solved when a later one comes.

    Cells have to arrive in order of frames; cells of a frame that is already solved are dropped (they are late).
    """
    cfg = viterbi.Settings(sigma=sigma)

    def load(text: str) -> dict:
        return {(k.rsplit("|", 1)[0], int(k.rsplit("|", 1)[1])): viterbi.Track(*(np.array(v).reshape(-1, 2) if i % 2 == 0 else np.array(v, float) for i, v in enumerate(t[:4])), t[4]) for k, t in json.loads(text).items()}

    def dump(tracks: dict) -> str:
        return json.dumps({f"{p}|{i}": [t.seen.tolist(), t.seen_score.tolist(), t.hidden.tolist(), t.hidden_score.tolist(), float(t.out)] for (p, i), t in tracks.items()})

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (part,) = key
        last, text, waiting = state.get if state.exists else (-1, "", "[]")
        tracks = load(text) if text else None
        pending = [tuple(r) for r in json.loads(waiting)]
        for pdf in batches:
            pending += list(zip(pdf["frame"].tolist(), pdf["x"].tolist(), pdf["y"].tolist(), pdf["p"].tolist(), strict=True))
        pending = [r for r in pending if r[0] > last]
        ready = sorted({r[0] for r in pending})[:-1]
        rows = []
        for frame in ready:
            own = sorted((y, x, p) for f, x, y, p in pending if f == frame)
            xy, p = np.array([(x + 0.5, y + 0.5) for y, x, _ in own]), np.array([p for *_, p in own])
            if tracks is None:
                labels = np.argsort(np.argsort(-p, kind="stable"), kind="stable") % n
                tracks = {(part, i): viterbi.start(xy[labels == i], p[labels == i], cfg) for i in range(n)}
            else:
                tracks = viterbi.forward(tracks, part, n, xy, p, cfg)
            rows += [(part, frame, i, *viterbi.pose(tracks[part, i])) for i in range(n)]
            last = frame
        state.update((last, dump(tracks) if tracks else "", json.dumps([r for r in pending if r[0] > last])))
        yield pd.DataFrame(rows, columns=["part", "frame", "ind", "x", "y", "likelihood"])

    return stream.groupBy("part").applyInPandasWithState(
        step, "part string, frame long, ind long, x double, y double, likelihood double", "last long, tracks string, waiting string", "append", GroupStateTimeout.NoTimeout
    )


_TRACK = "seen_x array<double>, seen_y array<double>, seen array<double>, hidden_x array<double>, hidden_y array<double>, hidden array<double>, out double"
_FOUND = "part string, frame long, ind long, x double, y double, likelihood double"


class Tracker(StatefulProcessor):
    """The forward pass of `timed` for one part: its tracks by individual, the cells that wait, and where it stands, each typed.

    A frame is solved when a cell of a later one comes. The last one waits for the timer at the latest time seen; when that has passed,
    a second timer, `idle` ms later, forgets the part.
    """

    def __init__(self, n: int, sigma: float, idle: int) -> None:
        self.n, self.idle, self.cfg = n, idle, viterbi.Settings(sigma=sigma)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracks = handle.getMapState("tracks", "ind long", _TRACK)
        self.waiting = handle.getListState("waiting", "frame long, x long, y long, p double")
        self.standing = handle.getValueState("standing", "frame long, timer long")

    def _load(self, part) -> dict | None:
        pair = lambda a, b: np.stack([np.array(a, float), np.array(b, float)], 1)
        return {(part, k[0]): viterbi.Track(pair(v[0], v[1]), np.array(v[2], float), pair(v[3], v[4]), np.array(v[5], float), v[6]) for k, v in self.tracks.iterator()} or None

    def _save(self, tracks: dict) -> None:
        for (_, i), t in tracks.items():
            self.tracks.updateValue((i,), (*(a.astype(float).tolist() for a in (t.seen[:, 0], t.seen[:, 1], t.seen_score, t.hidden[:, 0], t.hidden[:, 1], t.hidden_score)), float(t.out)))

    def _solved(self, part, cells: list[tuple], ready: list[int]) -> pd.DataFrame:
        tracks, rows = self._load(part), []
        for frame in ready:
            own = sorted((y, x, p) for f, x, y, p in cells if f == frame)
            xy, p = np.array([(x + 0.5, y + 0.5) for y, x, _ in own]), np.array([p for *_, p in own])
            if tracks is None:
                labels = np.argsort(np.argsort(-p, kind="stable"), kind="stable") % self.n
                tracks = {(part, i): viterbi.start(xy[labels == i], p[labels == i], self.cfg) for i in range(self.n)}
            else:
                tracks = viterbi.forward(tracks, part, self.n, xy, p, self.cfg)
            rows += [(part, frame, i, *viterbi.pose(tracks[part, i])) for i in range(self.n)]
        if ready:
            self._save(tracks)
        return pd.DataFrame(rows, columns=["part", "frame", "ind", "x", "y", "likelihood"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        last, timer = self.standing.get() if self.standing.exists() else (-1, -1)
        latest, new = timer, []
        for pdf in rows:
            latest = max(latest, int(pdf["ms"].max()))
            new += zip(*(pdf[c].tolist() for c in ("frame", "x", "y", "p")), strict=True)
        cells = [c for c in [*(tuple(c) for c in self.waiting.get()), *new] if c[0] > last]
        ready = sorted({c[0] for c in cells})[:-1]
        found = self._solved(key[0], cells, ready)
        last = ready[-1] if ready else last
        self.waiting.put([c for c in cells if c[0] > last])
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        # Only late cells: nothing waits, so what the timer does next is forgetting.
        self.handle.registerTimer(latest if len(cells) else latest + self.idle)
        self.standing.update((last, latest))
        yield found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        last, latest = self.standing.get()
        cells = [tuple(c) for c in self.waiting.get()]
        if cells:
            ready = sorted({c[0] for c in cells})
            self.waiting.clear()
            self.standing.update((ready[-1], latest))
            self.handle.registerTimer(latest + self.idle)
            yield self._solved(key[0], cells, ready)
        else:
            for state in (self.tracks, self.waiting, self.standing):
                state.clear()
            yield pd.DataFrame(columns=["part", "frame", "ind", "x", "y", "likelihood"])

    def close(self) -> None:
        pass


def timed(stream: DataFrame, n: int = 1, sigma: float = 3.0, time: str = "ts", late: str = "1 minute", idle: int = 3_600_000) -> DataFrame:
    """Forward-only tracking as `online` does it, with the time of the cells: part, frame, ind, x, y, likelihood.

    Cells (part, frame, x, y, p and a time) that come before the watermark are dropped, those of a solved frame too. A part's last frame is solved
    when the watermark passes its time, and a part without cells for `idle` milliseconds behind it is forgotten: it starts anew. Needs the RocksDB state store.
    """
    cells = stream.withWatermark(time, late).select("part", F.col("frame").cast("long").alias("frame"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("p").cast("double").alias("p"), F.unix_millis(time).alias("ms"), time)
    return cells.groupBy("part").transformWithStateInPandas(Tracker(n, sigma, idle), _FOUND, "append", "EventTime")
