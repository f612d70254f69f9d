"""Table functions for SQL, on Arrow batches of a table: `register(spark)`, then

    SELECT frame, part, x, y, max(p) AS p FROM splat(TABLE(cells), 8.0, 2, 1.0) GROUP BY ALL
    SELECT * FROM decode_maps(TABLE(maps), 24, 32)

Both give rows for each batch by itself, so a table keeps its partitions and nothing is shuffled before what follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _number(value) -> float:
    """A constant argument, which comes as an array or as a scalar."""
    v = value[0] if isinstance(value, pa.Array | pa.ChunkedArray) else value
    return float(v.as_py() if isinstance(v, pa.Scalar) else v)


@F.arrow_udtf(returnType="frame long, part string, x long, y long, p double")
class Splat:
    """A Gaussian patch around each cell's place in pixels (columns frame, part, x, y, p, ox, oy; without a p, a row gives nothing).

    Cells meet in pixels: take the largest p of each, as sparsification by UPSCALE does.
    """

    def eval(self, cells: pa.RecordBatch, stride: pa.Array, spread: pa.Array, sigma: pa.Array) -> Iterator[pa.Table]:
        stride, reach, sigma = _number(stride), int(_number(spread)), _number(sigma)
        cells = cells.filter(cells["p"].is_valid())
        column = lambda c: cells[c].cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
        at = lambda c, o: np.floor((column(c) + 0.5) * stride + column(o)).astype(np.int64)
        side = np.arange(-reach, reach + 1)
        dx, dy = (d.ravel() for d in np.meshgrid(side, side))
        weight = np.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma))
        for a in range(0, cells.num_rows, 4096):
            some = slice(a, a + 4096)
            part = cells.slice(a, 4096)
            rows = pa.array(np.repeat(np.arange(part.num_rows), len(dx)))
            place = lambda c, o, d: pa.array((at(c, o)[some, None] + d).ravel())
            p = (column("p")[some, None] * weight).ravel()
            yield pa.table({"frame": part["frame"].cast(pa.int64()).take(rows), "part": part["part"].cast(pa.string()).take(rows), "x": place("x", "ox", dx), "y": place("y", "oy", dy), "p": pa.array(p)})


@F.arrow_udtf(returnType="frame long, part string, x long, y long, p double, ox double, oy double")
class DecodeMaps:
    """The cells of maps as a frame store has them (columns frame, part, data: flags, length, compressed columns); null data has none."""

    def eval(self, maps: pa.RecordBatch, height: pa.Array, width: pa.Array) -> Iterator[pa.Table]:
        from trailmark.sources import framestore

        size = int(_number(height)), int(_number(width))
        for frame, part, data in zip(maps["frame"], maps["part"], maps["data"], strict=True):
            if data.is_valid:
                batch = framestore.batch([(frame.as_py(), part.as_py(), framestore.decode(data.as_py(), 0, *size)[0])])
                if batch.num_rows:
                    yield pa.Table.from_batches([batch])


def register(spark: SparkSession) -> None:
    """Make `splat` and `decode_maps` known to this session's SQL."""
    spark.udtf.register("splat", Splat)
    spark.udtf.register("decode_maps", DecodeMaps)
