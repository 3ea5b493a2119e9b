"""What a task, a plan or a row may hold."""

import tracemalloc

import numpy as np

from folioscope import queries
from folioscope.operators import index

from .test_queries import SF


def test_stored_windows_are_not_broadcast(spark):
    for name in ("coverage_audit", "coverage_segments", "interval_gaps", "interval_union", "window_status"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, name


def test_gaps_of_two_blocks_are_held_in_slices():
    rng = np.random.default_rng(1)
    a, b = list(rng.normal(size=(400, 64))), list(rng.normal(size=(300, 64)))
    for metric, order in (("euclid", 2), ("manhattan", 1)):
        tracemalloc.start()
        got = index._scores(metric, a, b)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40_000_000  # all at once are 61 MB and as much again of squares
        assert np.allclose(got[[0, 399]], [[-np.linalg.norm(a[i] - y, order) for y in b] for i in (0, 399)])


def test_a_small_file_of_parts_is_hashed_by_all_cores(spark):
    assert queries.QUERIES["hash_embedding"](spark, SF).rdd.getNumPartitions() == 4
