"""A partial run after edits against solving everything again."""

import pytest
from pyspark.sql import functions as F
from test_videos import CELLS, poses, same, walk
from trailmark.operators import frames, tracking


def test_rerun_equals_solving_all_chains(spark):
    cells = spark.createDataFrame(walk(60, 7), CELLS)
    run = tracking.prepared(spark, cells, 2, segment_size=10)
    before = poses(run.result())
    changes = spark.createDataFrame([(33, "a", 3, 3, 0.9), (33, "a", 25, 9, 0.8), (33, "b", 1, 1, None), (2, "b", 20, 9, 0.7), (2, "b", 5, 9, 0.7)], CELLS)
    solved = []
    whole, run.solve = run.solve, lambda c, k, g: solved.append({r.seg_id for r in g.collect()}) or whole(c, k, g)
    again = run.rerun(changes)
    after = poses(again.result())
    # The same with every chain solved anew.
    edited = again.cells.count()
    full = tracking.replace(again, found=None, solve=whole)
    same(after, poses(full.result()))
    assert edited == run.cells.count() - run.cells.filter("(frame = 33) OR (frame = 2 AND part = 'b')").count() + 4
    chains = {r.anchor for r in run.poses().filter("frame IN (2, 33)").select("anchor").distinct().collect()}
    own = {r.seg_id for r in run.poses().filter(F.col("anchor").isin(list(chains))).select("seg_id").distinct().collect()}
    assert len(solved) == 1 and solved[0] >= own and len(solved[0]) < run.segs.count()
    assert after != before and after[33, "a", 0] != before[33, "a", 0]
    # What was edited is where a track is, and an emptied map has no visible place.
    assert {after[33, "a", i][:2] for i in (0, 1)} <= {(3.5, 3.5), (25.5, 9.5)} | {after[33, "a", i][:2] for i in (0, 1) if after[33, "a", i][2] == 0}
    assert all(after[33, "b", i][2] == 0 for i in (0, 1))


def test_no_changes_and_foreign_ones(spark):
    run = tracking.prepared(spark, spark.createDataFrame(walk(20, 8), CELLS), 2, segment_size=10)
    none = spark.createDataFrame([], CELLS)
    same(poses(run.rerun(none).result()), poses(run.result()))
    for wrong in ((5, "wing", 1, 1, 0.5), (99, "a", 1, 1, 0.5)):
        with pytest.raises(ValueError, match="does not have"):
            run.rerun(spark.createDataFrame([wrong], CELLS))


def test_rerun_of_its_own_cells_changes_nothing(spark):
    cells = spark.createDataFrame(walk(40, 9), CELLS)
    run = tracking.prepared(spark, cells, 2, segment_size=10)
    same(poses(run.rerun(frames.above(cells.filter("frame BETWEEN 10 AND 14"), 0.001)).result()), poses(run.result()))
