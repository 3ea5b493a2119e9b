"""Searches of a vector collection against all pairs, and how little of it they read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import index
from folioscope.operators.collection import METRICS, VectorCollection, fit_centroids
from folioscope.sources import scratch

FORM = "span_id string, document_id string, vector array<double>"
SF = "/root/testdata/sf0.1"


def rows_of(rnd, n, size=6, centers=8):
    spots = [[rnd.gauss(0, 6) for _ in range(size)] for _ in range(centers)]
    return [(f"s{k:04d}", f"d{k % 3}", [x + rnd.gauss(0, 0.5) for x in spots[k % centers]]) for k in range(n)]


def checked(spark, held, rows, queries, k, metric):
    asked = spark.createDataFrame(queries, "query_id string, document_id string, vector array<double>")
    frame = spark.createDataFrame(rows, FORM)
    got = {(r["query_id"], r["rank"]): (r["span_id"], r["score"]) for r in held.search(asked, k).collect()}
    want = {(r["query_id"], r["rank"]): (r["span_id"], r["score"]) for r in index.vector_search(asked, frame, ["document_id"], "span_id", k, metric).collect()}
    assert got == want
    return got


@pytest.mark.parametrize("metric", METRICS)
def test_search_equals_all_pairs(spark, tmp_path, metric):
    """Clusters, copies, a zero vector, more asked than a document holds, a document that is not there."""
    rnd = random.Random(4)
    rows = rows_of(rnd, 150) + [(f"z{k}", "d0", [1.0] * 6) for k in range(30)] + [("zero", "d1", [0.0] * 6), ("one", "tiny", [1.0] * 6)]
    held = VectorCollection(spark, str(tmp_path / "v"), 6, metric, cells=9, sample=100)
    held.recreate()
    held.upsert(spark.createDataFrame(rows[:120], FORM))
    held.upsert(spark.createDataFrame(rows[100:], FORM))
    queries = [(f"q{s}", d, v) for s, d, v in rows[::11]] + [("q0", "d0", [0.0] * 6), ("q1", "d0", [1.0] * 6), ("q2", "tiny", [2.0] * 6), ("q3", "none", [1.0] * 6)]
    assert checked(spark, held, rows, queries, 7, metric)
    assert held.count() == len(rows)
    if metric != "cosine":
        return
    moved = [(s, d, [-x for x in v]) for s, d, v in rows[:20]]
    held.upsert(spark.createDataFrame(moved, FORM))
    checked(spark, held, moved + rows[20:], queries, 7, metric)
    held.vacuum()
    checked(spark, held, moved + rows[20:], queries[:3], 2, metric)
    assert len(held.table.folder.names("reaches")) == len(held.table.folder.names("centroids")) == 1


def test_few_cells_are_read(spark, tmp_path):
    """Vectors of the tables around ten spots, every id divisible by 50 as a query: a tenth of the cells, not a third."""
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    spots = v.select(F.col("vec_id").alias("label"), F.col("embedding").alias("spot"))
    near = v.join(spots, "label").select(F.concat(F.lit("s"), "vec_id").alias("span_id"), F.lit("d").alias("document_id"), F.zip_with("embedding", "spot", lambda x, y: x.cast("double") + 4 * y).alias("vector"), "vec_id")
    held = VectorCollection(spark, str(tmp_path / "v"), 64, "cosine", cells=30)
    held.recreate()
    held.upsert(near.drop("vec_id"))
    asked = near.where("vec_id % 50 = 0").select(F.col("span_id").alias("query_id"), "document_id", "vector")
    best, looked = held.searched(asked, 10)
    want = index.vector_search(asked, near, ["document_id"], "span_id", 10)
    columns = ["query_id", "span_id", "score", "rank"]
    assert sorted(map(tuple, best.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    cells = held.reaches(held.table.snapshot()).count()
    assert looked.count() < asked.count() * cells / 3
    one, _ = held.searched(asked.limit(1), 10)
    text = one._jdf.queryExecution().explainString(one.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [part" in text and one.count() == 10
    files = [f for f in one.inputFiles() if "/part=" in f]
    assert 0 < len({f.split("/part=")[1].split("/")[0] for f in files}) < cells / 3


def test_an_unindexed_collection_and_wrong_sizes(spark, tmp_path):
    held = VectorCollection(spark, str(tmp_path / "v"), 2)
    held.recreate()
    asked = spark.createDataFrame([("q", "d", [1.0, 0.0])], "query_id string, document_id string, vector array<double>")
    assert held.search(asked, 3).count() == 0 and held.count() == 0
    held.upsert(spark.createDataFrame([], FORM))
    held.upsert(spark.createDataFrame([("a", "d", [3.0, 0.0])], FORM))
    assert [tuple(r) for r in held.search(asked, 3).collect()] == [("q", "d", "a", 1.0, 1)]
    with pytest.raises(Exception, match="has not 2 components"):
        held.search(asked.withColumn("vector", F.array(F.lit(1.0))), 3)
    held.recreate()
    assert held.count() == 0 and held.search(asked, 3).count() == 0


def test_centroids_of_equal_points():
    assert fit_centroids("euclid", np.ones((5, 3)), 4).shape == (1, 3)


def test_scopes_delete_what_was_settled_inside(spark):
    with scratch.scope():
        outer = scratch.settled(spark.range(3), "outer")
        with scratch.scope():
            inner = scratch.settled(spark.range(4), "inner")
            paths = inner.inputFiles()
            assert inner.count() == 4
        with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|FAILED_READ"):
            spark.read.schema("id long").parquet(paths[0]).collect()
        assert outer.count() == 3


def test_a_scope_of_many_blocks_is_many_keys(spark):
    """All rows in one scope: each pair of blocks is a row of its own, and the answer is that of one block."""
    rnd = random.Random(1)
    rows = spark.createDataFrame([(f"s{k:03d}", "d", [rnd.gauss(0, 1) for _ in range(5)]) for k in range(120)], FORM)
    asked = rows.select(F.col("span_id").alias("query_id"), "document_id", "vector")
    columns = ["query_id", "span_id", "score"]

    def best(block):
        near = index.nearest(asked, rows, ["document_id"], "query_id", "span_id", 4, block=block)
        return sorted(map(tuple, index.top_k(near, ["query_id"], 4, [F.desc("score"), F.asc("span_id")]).select(columns).collect()))

    assert best(16) == best(1024)
