"""Passes with carried state, and table functions in SQL."""

import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from trailmark.functions import tables
from trailmark.operators import frames, passes
from trailmark.plans.cells import cells
from trailmark.sources import framestore
from trailmark.streaming import poses as streaming

SF = "/root/testdata/sf0.001"


def smooth():
    """A pass whose value and number of rows depend on all rows before; made here so that workers get it by value."""

    class Smooth:
        result = "frame long, smooth double, n long"
        state = "smooth double, n long"

        def step(self, rows, state):
            value, n = (state["smooth"], state["n"]) if state else (0.0, 0)
            out = []
            for frame, v in zip(rows["frame"], rows["v"], strict=True):
                value, n = 0.7 * value + 0.3 * v, n + 1
                out.append((frame, value, n))
            return pd.DataFrame(out, columns=["frame", "smooth", "n"]), {"smooth": value, "n": n}

    return Smooth()


def test_ranges_give_what_one_gives(spark):
    """Groups of several lengths, one with a gap of whole ranges, one of a null key, rows without a frame; both directions."""
    rng = np.random.default_rng(0)
    data = [(k, f, float(rng.random())) for k, fs in (("a", range(40)), ("b", [0, 1, 33, 34]), (None, range(20, 25)), ("c", [39])) for f in fs] + [("a", None, 1.0)]
    table = spark.createDataFrame(data, "part string, frame long, v double")
    got = lambda **named: {(r.part, r.frame): (r.smooth, r.n) for r in passes.carried(spark, table, smooth(), **named).collect()}
    for backward in (False, True):
        want = {}
        for key in ("a", "b", None, "c"):
            value, n = 0.0, 0
            for f, v in sorted([(f, v) for k, f, v in data if k == key and f is not None], reverse=backward):
                value, n = 0.7 * value + 0.3 * v, n + 1
                want[key, f] = (value, n)
        for size in (7, 10_000):
            assert got(frames=size, backward=backward) == want
    none = passes.carried(spark, table.filter("v > 2"), smooth())
    assert none.columns == ["part", "frame", "smooth", "n"] and none.count() == 0


def test_held_place_backward(spark):
    data = [("a", f, f, 2 * f, p) for f, p in enumerate([0.1, 0.9, 0.2, 0.3, 0.95, 0.1])]
    table = spark.createDataFrame(data, "part string, frame long, x long, y long, p double")
    got = sorted((r.frame, r.x, r.y, r.p, r.age) for r in passes.carried(spark, table, passes.Held(0.9, True), frames=2, backward=True).collect())
    assert got == [(0, 1, 2, 0.9, 1), (1, 1, 2, 0.9, 0), (2, 4, 8, 0.95, 2), (3, 4, 8, 0.95, 1), (4, 4, 8, 0.95, 0), (5, None, None, None, None)]


def test_table_functions(spark):
    tables.register(spark)
    c = frames.above(cells(spark, SF), 0.001)
    near = lambda df: {(r.frame, r.part, r.x, r.y): round(r.p, 9) for r in df.collect()}
    got = spark.sql("SELECT frame, part, x, y, max(p) AS p FROM splat(TABLE(SELECT * FROM {c}), 8.0D, 2, 1.0D) GROUP BY ALL HAVING max(p) > 0.001", c=c)
    assert near(got) == near(frames.sparsify(cells(spark, SF), "UPSCALE"))
    odd = c.limit(1).withColumn("p", F.lit(None).cast("double"))
    assert spark.sql("SELECT * FROM splat(TABLE(SELECT * FROM {odd}), 8.0D, 2, 1.0D)", odd=odd).count() == 0
    some = [np.array([[1, 2, 0.5, 0.25, -1.0], [7, 5, 0.75, 0, 0]]), np.array([[x, y, 0.5, 0, 0] for y in range(6) for x in range(8)], float), np.zeros((0, 5))]
    maps = spark.createDataFrame([(i, "a", bytearray(framestore.encode(m, 6, 8, 6))) for i, m in enumerate(some)] + [(9, "b", None)], "frame long, part string, data binary")
    back = spark.sql("SELECT * FROM decode_maps(TABLE(SELECT * FROM {maps}), 6, 8)", maps=maps).collect()
    assert sorted(map(tuple, back)) == sorted((i, "a", int(x), int(y), p, ox, oy) for i, m in enumerate(some) for x, y, p, ox, oy in m)


def test_timed_tracking(spark, tmp_path):
    """In order it gives what `online` does; the last frame is closed by its timer, late cells change nothing, an idle part starts anew."""
    kind = "frame long, part string, x long, y long, p double, ts timestamp"
    at = lambda seconds: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)
    walk = [(t, "a", 3 + t, 5, 0.9, at(t)) for t in range(9)] + [(t, "a", 20, 20, 0.2, at(t)) for t in range(9)]
    batches = [[r for r in walk if r[0] // 3 == k] for k in range(3)]
    batches += [[(0, "z", 1, 1, 0.5, at(60))], [(4, "a", 9, 9, 0.9, at(4)), (1, "z", 1, 1, 0.5, at(90))], [(1, "z", 2, 1, 0.5, at(2000))], [(2, "z", 2, 1, 0.5, at(9000))], [(0, "a", 7, 7, 0.6, at(9001)), (1, "a", 8, 7, 0.6, at(9002))]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, kind).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    for name in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"):
        spark.conf.set(name, {"spark.sql.shuffle.partitions": "2"}.get(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"))
    try:
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        run = lambda df, name: df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(150)
        run(streaming.timed(stream, 1, 2.0, late="5 seconds", idle=1_000_000), "timed")
        run(streaming.online(stream.filter("ts < '2024-01-01 00:00:30' AND NOT (frame = 4 AND x = 9)"), 1, 2.0), "in_order")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = sorted((r.frame, r.x, r.y, r.likelihood) for r in spark.table("timed").filter("part = 'a'").collect())
    before = sorted((r.frame, r.x, r.y, r.likelihood) for r in spark.table("in_order").collect())
    again = (0, 7.5, 7.5)
    assert [r for r in got if r[:3] != again][:8] == before and len(before) == 8
    assert [r[:3] for r in got] == sorted([*((t, 3.5 + t, 5.5) for t in range(9)), again])
