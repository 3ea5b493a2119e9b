"""Retrieval meets asked documents only, and the same results as beside no others; small scopes of vectors go together."""

import random
import re

from pyspark.sql import functions as F

from folioscope import queries
from folioscope.operators import graph, index
from folioscope.plans import ask

from .test_queries import SF


def docs(spark, n):
    body = lambda d: "".join(f"第{'一二三'[k]}章 标题\n" + "".join(f"高文{d}在第{k}处走进古门{j}，看见魔法的光{'，' * (j % 3)}并记下符文{k * 7 + j}。" for j in range(12)) + "\n" for k in range(3))
    return spark.createDataFrame([(f"d{d}", body(d)) for d in range(n)], "document_id string, text string")


def test_only_asked_documents_are_searched(spark, monkeypatch):
    stored = {}
    keep = ask.settled
    monkeypatch.setattr(ask, "settled", lambda df, name: stored.setdefault(name, keep(df, name)))
    questions = spark.createDataFrame([("q1", "d1", "高文看见了什么魔法？")], "query_id string, document_id string, question string")
    columns = ["query_id", "span_id", "rank", "rerank_score", "fused_score", "chapter_title"]
    found = ask.retrieve(ask.with_graph(ask.build(docs(spark, 4))), questions).select(*columns).collect()
    assert {r["document_id"] for r in stored["spans"].collect()} == {"d0", "d1", "d2", "d3"}  # all are held
    assert {r["document_id"] for r in stored["clusters"].collect()} == {"d0", "d1", "d2", "d3"}
    assert {r["document_id"] for r in stored["postings"].collect()} == {"d1"}
    stored.clear()
    alone = ask.retrieve(ask.with_graph(ask.build(docs(spark, 4).where("document_id = 'd1'"))), questions).select(*columns).collect()
    assert found and sorted(found) == sorted(alone)


def test_small_scopes_share_groups(spark):
    rnd = random.Random(8)
    rows = [(f"s{s}", f"v{s}_{k}", [rnd.gauss(0, 1) for _ in range(4)]) for s in range(60) for k in range(40 if s == 7 else 3)]
    v = spark.createDataFrame(rows, "scope string, id string, vector array<double>")
    got = index.nearest(v.withColumnRenamed("id", "of"), v, ["scope"], "of", "id", 40, block=16, others=True)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5, 6)
    want = sorted((s, a, b, cos(x, y)) for s, a, x in rows for t, b, y in rows if s == t and a != b)
    assert sorted((r["scope"], r["of"], r["id"], round(r["score"], 6)) for r in got.collect()) == want
    sizes = v.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / 16).cast("int").alias("n_q")).withColumn("n_c", F.col("n_q"))
    packed = index._packed(v, sizes, ["scope"], "id", "c", "q", 5).select("group").distinct().count()
    assert packed <= 5 + 9  # 59 small scopes in 5 groups, the large one as 3 times 3 pairs


def test_evaluation_searches_the_graph_as_well(spark, monkeypatch):
    def hits():
        stored = {}
        keep = ask.settled
        with monkeypatch.context() as m:
            m.setattr(ask, "settled", lambda df, name: stored.setdefault(name, keep(df, name)))
            assert queries.QUERIES["eval_run"](spark, SF).count() > 0
        assert "clusters" in stored  # cluster types were made and read by nothing
        found = stored["hits"].select("query_id", "document_id", "span_id", "source", "cluster_id").collect()
        return {r["source"] for r in found}, {r["cluster_id"] for r in found if r["source"] == "graph"}

    sources, clusters = hits()
    assert sources == {"graph", "vector", "bm25"}
    monkeypatch.setattr(graph, "cluster_type", lambda *_: F.lit("location"))
    assert clusters.isdisjoint(hits()[1])


def carrying(df, column):
    """How many exchanges of df's plan carry a column."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    told = df._jdf.queryExecution().explainString(mode)
    return sum(f"{column}#" in text.split("\n\n")[0] for text in re.split(r"\n\(\d+\) Exchange", told)[1:])


def test_vectors_move_once_to_find_centers_and_once_to_score_members(spark, monkeypatch):
    moved = {}
    keep = ask.settled

    def counted(df, name):
        moved[name] = carrying(df, "vector")
        return keep(df, name)

    monkeypatch.setattr(ask, "settled", counted)
    ask.with_graph(ask.build(docs(spark, 4)))
    assert (moved["centers"], moved["members"]) == (1, 1)


def test_vectors_that_ask_for_each_other(spark):
    rnd = random.Random(9)
    rows = [(f"s{s}", f"v{s}_{k}", [rnd.gauss(0, 1) for _ in range(4)]) for s in range(30) for k in range(40 if s == 7 else 1 + s % 5)]
    v = spark.createDataFrame(rows, "scope string, id string, vector array<double>")
    want = index.nearest(v.withColumnRenamed("id", "of"), v, ["scope"], "of", "id", 3, block=16, others=True)
    want = index.top_k(want, ["of"], 3, [F.desc("score"), F.asc("id")]).select("scope", "of", "id", "score").collect()
    got = index.nearest_others(v, ["scope"], "of", "id", 3, block=16)
    got = index.top_k(got, ["of"], 3, [F.desc("score"), F.asc("id")]).select("scope", "of", "id", "score").collect()
    assert got and sorted(got) == sorted(want)
    assert index.nearest_others(v.limit(0), ["scope"], "of", "id", 3).count() == 0
