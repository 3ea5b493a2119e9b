import math
import random

from pyspark.sql import functions as F

from folioscope.llm import topk


def held(score):
    """Scores past 64 bits stay at the edge."""
    return min(max(score, -(1 << 63)), (1 << 63) - 1)


def brute(rows, k):
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in ints:
        if q % 10 == 0:
            scores = sorted((-held(sum(x * y for x, y in zip(a, b))), i) for i, b in ints if i != q and len(a) == len(b))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def test_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(k, [rnd.gauss(0, 1 + k % 7) for _ in range(24)]) for k in range(300)]
    rows += [(400, [1.0] * 24), (401, [1.0] * 24), (402, [1.0] * 24), (500, None), (501, [None] + [1.0] * 23), (502, [float("nan")] * 24), (503, [float("inf")] * 24), (600, [1.0, 2.0]), (601, [3.0, 4.0]), (610, []), (None, [1.0] * 24), (700, [3e13] * 24)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(4)
    monkeypatch.setattr(topk, "CHUNK", 37)
    got = {}
    for r in topk.top_k(frame, F.col("vec_id") % 10 == 0, 5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = brute(rows, 5)
    for q, best in want.items():
        assert [got.get(q, {})[k + 1] for k in range(len(best))] == best, q
    assert {q for q, b in want.items() if b} == got.keys()
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_repeated_queries_and_candidates(spark):
    """A repeated query is answered once; a repeated candidate counts as often as it stands; ties go to the smaller id."""
    rows = [(0, [1.0, 0.0])] * 2 + [(7, [2.0, 0.0])] * 2 + [(5, [2.0, 0.0]), (9, [1.0, 1.0]), (3, [0.0, 5.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") == 0, 4).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(1, 5), (2, 7), (3, 7), (4, 9)]


def test_queries_of_many_chunks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 16)
    rnd = random.Random(2)
    rows = [(k, [rnd.gauss(0, 1) for _ in range(20)]) for k in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(9)
    got = {}
    for r in topk.top_k(frame, F.col("vec_id") % 10 == 0, 5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for q, best in brute(rows, 5).items():
        assert [got[q][k + 1] for k in range(5)] == best
