"""Tasks whose share does not grow with the rows, and what is sent between them."""

from pyspark.sql import functions as F

from folioscope import queries
from folioscope.operators import density, retrieval

from .test_queries import SF


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hits_are_dealt_over_as_many_tasks_as_they_need(spark, monkeypatch):
    want = sorted(map(str, queries.QUERIES["rerank_mock"](spark, SF).collect()))
    monkeypatch.setattr(retrieval, "SHARE", 1_000)
    hits = queries.order_hits(spark, SF)
    n = -(-hits.count() // 1_000)
    mine = queries.QUERIES["rerank_mock"](spark, SF)
    assert n > 4 and f"hashpartitioning(query_id#" in plan_of(mine) and f", {n}), REPARTITION_BY_NUM" in plan_of(mine)
    assert sorted(map(str, mine.collect())) == want


def test_candidates_are_not_dealt_by_their_few_chapters(spark):
    for name in ("rerank_mock", "rerank_noop"):
        assert "hashpartitioning(document_id#" not in "".join(x for x in plan_of(queries.QUERIES[name](spark, SF)).splitlines() if "chapter_id" in x and "hashpartitioning" in x and "chapter_title" not in x), name


def test_nearest_spans_keep_no_text(spark):
    plan = plan_of(queries.QUERIES["nearest_spans"](spark, SF))
    assert "documents.parquet" not in plan and "BroadcastHashJoin" not in plan


def test_core_distances_of_one_block_are_one_pair(spark):
    rows = spark.range(1000).select(F.lit(0).alias("label"), "id", F.array(F.rand(1), F.rand(2)).alias("vector"), F.lit(2).alias("dim"))
    ids = density.core_distances(rows, ["label"], "id", 3)
    assert "core" in ids.columns and density.core_distances.__defaults__[-1] >= 1000  # 16 pairs before, each with 500 vectors
