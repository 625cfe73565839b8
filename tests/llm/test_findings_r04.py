"""What Spark takes for small by its files is not broadcast where rows are made of it."""

import numpy as np

from loomgraph.llm import common, simhash
from loomgraph.sources.shared import release, settle


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_balls_are_not_broadcast_however_small_their_fingerprints_are(spark):
    rng = np.random.default_rng(4)
    some = rng.integers(-(1 << 63), 1 << 63, 300)
    fps = settle(spark.createDataFrame([(int(x),) for x in np.unique(np.concatenate([some, some[:20] ^ 5]))], "fp long"))
    found = simhash.links(fps)
    assert "Broadcast" not in plan(found) and "SortMergeJoin" in plan(found)
    assert found.count() == 20 and "Broadcast" not in plan(found)
    release(spark)


def test_tables_beyond_the_bounds_are_not_broadcast_by_their_files_size(spark):
    table = settle(spark.range(100).selectExpr("id", "id % 7 as x"))
    for how in ("inner", "left", "left_anti", "left_semi"):
        joined = lambda **bounds: plan(spark.range(50).join(common.small(table, **bounds), "id", how))  # noqa: B023, E731
        assert "BroadcastHashJoin" in joined()
        assert "Broadcast" not in joined(rows=99) and "Broadcast" not in joined(size=100)
    assert spark.range(50).join(common.small(table, rows=99), "id", "left_anti").count() == 0
    release(spark)
