"""Passes over frames in order that carry a state: a step sees a range of frames and what the range before has left.

All groups (videos, parts) take a step at once, so a pass has as many steps as the longest video has ranges. Rows and states go from
step to step through written tables, each range of rows is read once, and no task holds more than one group's rows of one range.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.session import materialize, release, spread

FRAMES = 10_000


class Pass(Protocol):
    """`result` and `state` are the schemas (DDL) of what a step gives besides the keys and of what it carries."""

    result: str
    state: str

    def step(self, rows: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, dict | None]:
        """Rows of one group in order of frames, and the state behind the frames before (None at first); gives the results and the state
        behind these rows. The results must not depend on where the frames are cut."""


def carried(spark: SparkSession, table: DataFrame, run: Pass, by: tuple[str, ...] = ("part",), frames: int = FRAMES, backward: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """The results of a pass over `table` (frame and the keys `by`, and what the pass reads), forward or backward.

    Rows of one frame come in the order of `ties`. Rows without a frame are left out; a null key is a group like others. Groups without
    rows in a range keep their state. An empty table gives an empty result.
    """
    keys = T.StructType([table.schema[k] for k in by])
    result, state = (T.StructType.fromDDL(s) for s in (run.result, run.state))
    carry = [f"_s_{f.name}" for f in state]
    schema = T.StructType([*keys, *result, T.StructField("_carried", T.BooleanType()), *(T.StructField(c, f.dataType) for c, f in zip(carry, state, strict=True))])
    names = [f.name for f in result]
    step: Callable = run.step
    order = ["frame", *ties]

    def one(rows: pd.DataFrame, left: pd.DataFrame) -> pd.DataFrame:
        before = {f.name: left[c].iloc[0] for f, c in zip(state, carry, strict=True)} if len(left) else None
        key = (rows if len(rows) else left)[list(by)].iloc[0]
        found, after = step(rows.sort_values(order, ascending=[not backward] + [True] * len(ties), kind="stable", ignore_index=True), before) if len(rows) else (pd.DataFrame(columns=names), before)
        out = found[names].assign(_carried=False)
        if after is not None:
            out = pd.concat([out, pd.DataFrame([{"_carried": True, **{c: after[f.name] for f, c in zip(state, carry, strict=True)}}])], ignore_index=True)
        return out.assign(**dict(key)).reindex(columns=schema.names)

    ranged = table.filter(F.col("frame").isNotNull()).withColumn("_range", F.floor(F.col("frame") / frames))
    kept = materialize(spark, ranged, "pass")
    first, last = kept.agg(F.min("_range"), F.max("_range")).first()
    if first is None:
        return spark.createDataFrame([], T.StructType([*keys, *result]))
    states = spark.createDataFrame([], schema)
    made = []
    for number in range(last, first - 1, -1) if backward else range(first, last + 1):
        rows = spread(kept.filter(F.col("_range") == number).drop("_range"), *by).groupBy(*by)
        made.append(materialize(spark, rows.cogroup(states.filter("_carried").groupBy(*by)).applyInPandas(one, schema), "pass"))
        states = made[-1]
    release(spark, kept)
    return reduce(DataFrame.union, [m.filter("NOT _carried") for m in made]).select(*by, *names)


class Held:
    """The last sure place: each row (frame, x, y, p) with that of the last row with p >= `cut`, and how many frames ago it was."""

    result = "frame long, x long, y long, p double, age long"
    state = "x long, y long, p double, frame long"

    def __init__(self, cut: float, backward: bool = False) -> None:
        self.cut, self.sign = cut, -1 if backward else 1

    def step(self, rows: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, dict | None]:
        sure = rows[["x", "y", "p", "frame"]].where(rows["p"] >= self.cut).ffill()
        if state is not None:
            sure = sure.fillna(state)
        out = pd.DataFrame({"frame": rows["frame"], **{c: sure[c] for c in "xyp"}, "age": (rows["frame"] - sure["frame"]) * self.sign})
        end = sure.iloc[-1]
        return out.astype({c: "Int64" for c in ("x", "y", "age")}), None if end.isna().any() else {"x": int(end["x"]), "y": int(end["y"]), "p": float(end["p"]), "frame": int(end["frame"])}
