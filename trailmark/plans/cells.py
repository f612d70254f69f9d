"""The sparse probability maps as a table: cells(frame, part, x, y, p, ox, oy, event_id), made from the events table.

A frame is a quarter of a day, a part an event type, a cell's column and row come from the user and the properties, its probability
from the value; ox and oy are sub-cell offsets in pixels at a stride of 8. `SQL` is the same view for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.session import table

WIDTH, HEIGHT, STRIDE = 32, 24, 8.0

SQL = """cells AS (SELECT CAST(date_diff('day', DATE '2024-01-01', ts::DATE) * 4 + hour(ts) // 6 AS BIGINT) AS frame, event_type AS part,
  user_id % 32 AS x, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 24 AS y, value / (value + 50.0::DOUBLE) AS p,
  CAST(event_id % 9 AS DOUBLE) - 4 AS ox, CAST(event_id % 5 AS DOUBLE) - 2 AS oy, event_id FROM events)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) * 4 + F.floor(F.hour("ts") / 6)).cast("long").alias("frame"),
        F.col("event_type").alias("part"),
        (F.col("user_id") % 32).alias("x"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("long") % 24).alias("y"),
        (F.col("value") / (F.col("value") + 50.0)).alias("p"),
        ((F.col("event_id") % 9).cast("double") - 4).alias("ox"),
        ((F.col("event_id") % 5).cast("double") - 2).alias("oy"),
        "event_id",
    )
