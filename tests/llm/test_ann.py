import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import ann

SCHEMA = "vec_id long, embedding array<double>, key string, raw int, score double"


def brute(rows, k, modulus=10):
    kept = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            kept[i] = v
    out = {}
    for q, a in kept.items():
        if q % modulus == 0:
            near = sorted((float(ann.exact(np.array([a]), np.array([b]))[0]), i) for i, b in kept.items() if i != q and len(a) == len(b))
            out.update({(q, n + 1): (i, d) for n, (d, i) in enumerate(near[:k])})
    return out


def run(spark, rows, k, partitions=4):
    frame = spark.createDataFrame([(i, v, "x", 1, 0.5) for i, v in rows], SCHEMA).repartition(partitions)
    got = ann.nearest(frame, F.col("vec_id") % 10 == 0, k).collect()
    out = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got}
    assert len(out) == len(got)
    return out


def test_equals_brute_force(spark, monkeypatch):
    """Blocks smaller than a table, ties, copies, other dimensions, and rows that take no part."""
    monkeypatch.setattr(ann, "BLOCK", 29)
    rnd = random.Random(5)
    rows = [(k, [rnd.gauss(0, 1) * 3 ** (k % 5) for _ in range(20)]) for k in range(260)]
    rows += [(k, [0.5] * 20) for k in range(300, 345)] + [(k, [float(k % 4), 1.0] + [0.0] * 18) for k in range(400, 440)]
    rows += [(500, None), (501, []), (510, [0.0] * 20), (520, [float("nan")] * 20), (530, [float("inf")] + [1.0] * 19), (540, [None] + [1.0] * 19), (None, [1.0] * 20)]
    rows += [(600, [1.0, 2.0]), (601, [3.0, -4.0]), (610, [-0.0, 2.0]), (620, [7.0]), (-10, [1.0] * 20)]
    assert run(spark, rows, 6) == brute(rows, 6)


def test_repeated_rows_are_one_vector_and_hot_copies_are_whole(spark):
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(1000)] + [(5, [1.0, 2.0, 3.0])] * 40 + [(2000, [1.0, 2.0, 4.0])] * 3
    assert run(spark, rows, 10) == brute(rows, 10)


def test_far_and_tiny_numbers(spark):
    rows = [(k, [s * (k + 1), s, -s * k]) for k, s in enumerate([1e-300, 1e-200, 1e-160, 1e-5, 1.0, 1e5, 1e150, 1e200, 1e307, 5e-324] * 3)]
    got, want = run(spark, rows, 8), brute(rows, 8)
    assert got == want and all(math.isfinite(d) for _, d in got.values())


def test_bounds_hold_and_spare_most_of_the_work():
    rnd = np.random.default_rng(1)
    a, b = rnd.normal(size=(64, 96)), rnd.normal(size=(4000, 96))
    heaps = ann.Heaps(a, 11)
    for at in range(0, 4000, 500):
        heaps.meet(b[at : at + 500], [[j] for j in range(at, at + 500)])
    for i in range(64):
        want = sorted((float(d), j) for j, d in enumerate(ann.exact(np.repeat(a[i : i + 1], 4000, 0), b)))[:11]
        assert sorted((-d, -j) for d, j in heaps.heaps[i]) == want
    assert heaps.computed < 0.1 * 64 * 4000


@pytest.mark.parametrize("dim", [1, 1024, 2500])
def test_integer_products_are_exact(dim):
    rnd = np.random.default_rng(dim)
    a, b = rnd.integers(-127, 128, (5, dim), dtype=np.int8), rnd.integers(-127, 128, (7, dim), dtype=np.int8)
    a[0], b[0] = 127, -127
    assert (ann.products(a, b) == a.astype(np.int64) @ b.T.astype(np.int64)).all()


def test_empty_table_and_single_rows(spark):
    assert run(spark, [], 3) == {}
    assert run(spark, [(10, [1.0])], 3) == {}
    assert run(spark, [(10, [1.0]), (20, [2.0])], 3) == {(10, 1): (20, 1.0), (20, 1): (10, 1.0)}
