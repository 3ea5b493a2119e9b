"""Hybrid retrieval for many questions at once: routes, graph, vector and keyword hits, fusion, reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import contains_any, distinct_tokens
from . import index

#: Hits that a task sorts about.
SHARE = 250_000
#: Chapters up to which they travel with the tasks.
FEW = 10_000
HITS = ["query_id", "document_id", "span_id", "source", "score", "cluster_id"]


def route(question: Column) -> Column:
    """The first kind of question one of whose words occurs."""
    text, out = F.lower(question), None
    for kind, words in fixed.QUERY_ROUTES.items():
        out = F.when(contains_any(text, words), kind) if out is None else out.when(contains_any(text, words), kind)
    return out.otherwise("unknown")


def _preferred(query_type: Column, cluster_type: Column) -> Column:
    out = F.lit(False)
    for kind, types in fixed.CLUSTER_TYPE_HINTS.items():
        out = out | ((query_type == kind) & cluster_type.isin(*types))
    return out


def rank_clusters(queries: DataFrame, clusters: DataFrame, k: int = 4) -> DataFrame:
    """(query_id, document_id, cluster_id, cluster_score, ...) of each question's k best clusters."""
    asked = queries.select("query_id", "document_id", route(F.col("question")).alias("query_type"), distinct_tokens(F.col("question")).alias("q_tokens"))
    held = clusters.withColumn("c_tokens", distinct_tokens(F.concat_ws("\n", "cluster_name", "cluster_type", "summary")))
    met = asked.join(held, "document_id")
    coverage = F.size(F.array_intersect("q_tokens", "c_tokens")) / F.greatest(F.lit(1), F.size("q_tokens"))
    score = F.least(F.lit(1.0), coverage + F.when(_preferred(F.col("query_type"), F.col("cluster_type")), 0.25).otherwise(0.0) + F.least(F.lit(0.2), F.col("confidence") * 0.2))
    scored = met.withColumn("cluster_score", score).drop("q_tokens", "c_tokens")
    return index.top_k(scored, ["query_id", "document_id"], k, [F.desc("cluster_score"), F.desc("confidence"), F.desc("cluster_name"), F.asc("cluster_id")], "cluster_rank")


def graph_hits(ranked: DataFrame, edges: DataFrame, per_cluster: int = 12) -> DataFrame:
    """Hits of each chosen cluster: its center, then its members by weight (members as listed where edges lack)."""
    keys = ["query_id", "document_id", "cluster_id"]
    center = ranked.select(*keys, F.col("center_span_id").alias("span_id"), F.least(F.lit(1.0), 0.65 + 0.35 * F.col("cluster_score")).alias("score"))
    supports = edges.where(F.col("edge_type") == "SUPPORTS").select("document_id", F.col("from_id").alias("cluster_id"), F.col("to_id").alias("span_id"), "weight")
    joined = ranked.select(*keys, "cluster_score", "confidence", "member_span_ids").join(supports, ["document_id", "cluster_id"], "left")
    linked = index.top_k(joined.where(F.col("span_id").isNotNull()), keys, per_cluster, [F.desc("weight"), F.asc("span_id")], "n")
    listed = joined.where(F.col("span_id").isNull()).withColumn("span_id", F.explode(F.slice("member_span_ids", 1, per_cluster))).withColumn("weight", F.col("confidence"))
    half = F.least(F.lit(1.0), 0.5 * F.col("cluster_score") + 0.5 * F.col("weight"))
    members = linked.select(*keys, "span_id", half.alias("score")).unionByName(listed.select(*keys, "span_id", half.alias("score")))
    return center.unionByName(members).withColumn("source", F.lit("graph")).select(*HITS)


def plain_hits(scores: DataFrame, source: str, k: int) -> DataFrame:
    """A keyword or vector search's k best as hits."""
    best = index.top_k(scores, ["query_id", "document_id"], k, [F.desc("score"), F.asc("span_id")])
    return best.withColumns({"source": F.lit(source), "cluster_id": F.lit(None).cast("string")}).select(*HITS)


def minmax(hits: DataFrame) -> DataFrame:
    """hits with `normalized`: the score between its source's extremes, 1 where they are equal."""
    by = Window.partitionBy("query_id", "document_id", "source")
    low, high = F.min("score").over(by), F.max("score").over(by)
    return hits.withColumn("normalized", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))


def entity_coverage(question: Column, entities: Column) -> Column:
    """Share of the entities' distinct tokens that the question holds."""
    own = F.array_distinct(F.flatten(F.transform(entities, distinct_tokens)))
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, distinct_tokens(question))) / F.size(own)).otherwise(0.0)


def shares(rows: DataFrame, share: int | None = None) -> Callable[..., DataFrame]:
    """How rows, and others in proportion to them, are dealt out by a key: over so many tasks that one's share does not grow.

    The key is a part of what is joined or grouped by: a document that is a constant would drop out of the plan's keys,
    and all would be dealt once more.
    """
    n = -(-rows.count() // (share or SHARE))
    few = n <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lambda some, *keys: some if few else some.repartition(n, *keys)


def fuse(hits: DataFrame, queries: DataFrame, spans: DataFrame, most: int = 80) -> DataFrame:
    """One candidate a question and span: the best of each source, blended, with bonuses for agreement."""
    keys = ["query_id", "document_id", "span_id"]
    dealt = shares(hits)
    usable = dealt(hits, "span_id").join(spans.select("document_id", "span_id"), ["document_id", "span_id"], "left_semi")
    each = minmax(dealt(usable, "query_id")).groupBy(*keys, "source").agg(F.max("score").alias("score"), F.max("normalized").alias("normalized"), F.collect_set("cluster_id").alias("cs"))
    one = each.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("source", "score", "normalized"))).alias("by_source"),
        F.max("normalized").alias("top"), F.avg("normalized").alias("mean"), F.count(F.lit(1)).alias("n"),
        F.max(F.col("source") == "graph").alias("graph"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cs")))).alias("cluster_ids"),
    )
    full = dealt(one.join(queries.select("query_id", "document_id", "question"), ["query_id", "document_id"]), "span_id").join(spans, ["document_id", "span_id"])
    score = 0.62 * F.col("top") + 0.18 * F.col("mean") + F.least(F.lit(0.3), 0.1 * (F.col("n") - 1)) + F.when(F.col("graph"), 0.08).otherwise(0.0) + 0.12 * entity_coverage(F.col("question"), F.col("entities"))
    fused = full.withColumns({
        "fused_score": F.round(F.least(F.lit(1.0), score), 6),
        "sources": F.transform("by_source", lambda x: x["source"]),
        "source_scores": F.map_from_entries(F.transform("by_source", lambda x: F.struct(x["source"], x["score"]))),
    })
    return index.top_k(dealt(fused.drop("by_source", "top", "mean", "n", "graph"), "query_id"), ["query_id", "document_id"], most, [F.desc("fused_score"), F.asc("span_id")], "union_rank")


def union_report(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidate_count"), F.count_if(F.size("sources") > 1).alias("multi_source_count"))


def rerank_text(title: Column, summary: Column, entities: Column, key_quote: Column) -> Column:
    return F.concat(F.lit("章节："), title, F.lit("\n摘要："), summary, F.lit("\n实体："), F.array_join(entities, ", "), F.lit("\n原文短引："), key_quote)


def rerank(candidates: DataFrame, chapters: DataFrame, kind: str = "mock", k: int = 15, scores: DataFrame | None = None) -> DataFrame:
    """The k best candidates of each question.

    `mock`: 0.65 token overlap of question and text, 0.35 fused score; `noop`: the fused score; `service`: scores
    (query_id, span_id, score) made elsewhere, 0 where absent.
    """
    chapters = chapters.select("document_id", "chapter_id", "chapter_title")
    # a few chapters hold all candidates: they come to them, not the candidates to a chapter's task
    chapters = F.broadcast(chapters) if chapters.limit(FEW + 1).count() <= FEW else chapters
    text = rerank_text(F.coalesce("chapter_title", "chapter_id"), F.col("summary"), F.col("entities"), F.col("key_quote"))
    titled = lambda rows: rows.join(chapters, ["document_id", "chapter_id"], "left").withColumn("rerank_text", text)
    best = lambda rows, score: index.top_k(rows.withColumn("rerank_score", F.round(score, 8)), ["query_id", "document_id"], k, [F.desc("rerank_score"), F.asc("union_rank")])
    if kind == "mock":
        asked = distinct_tokens(F.col("question"))
        overlap = F.size(F.array_intersect(asked, distinct_tokens(F.col("rerank_text")))) / F.greatest(F.lit(1), F.size(asked))
        out = best(titled(candidates), F.least(F.lit(1.0), 0.65 * overlap + 0.35 * F.col("fused_score")))
    elif kind == "noop":
        out = titled(best(candidates, F.col("fused_score")))
    elif kind == "service":
        rows = candidates.join(scores.select("query_id", "span_id", F.col("score").alias("given")), ["query_id", "span_id"], "left")
        out = titled(best(rows, F.coalesce("given", F.lit(0.0))))
    else:
        raise ValueError(f"unknown reranker: {kind}")
    return out.withColumn("text_sha256", F.sha2("rerank_text", 256))


def service_terms(text: Column) -> Column:
    """Words and pairs of letters of a lower-cased text without white space: the terms of the service-level mock."""
    flat = F.regexp_replace(F.lower(text), r"\s+", "")
    pairs = F.when(F.length(flat) > 1, F.transform(F.sequence(F.lit(1), F.length(flat) - 1), lambda i: F.substring(flat, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.regexp_extract_all(flat, F.lit(r"[a-z0-9_]+"), F.lit(0)), pairs))


def parse_rerank_response(raw: Column) -> Column:
    """Array of (index, score) of a rerank service's JSON answer; items without either are left out."""
    items = F.from_json(raw, "struct<results:array<struct<index:int,relevance_score:double,score:double>>>")["results"]
    each = F.transform(items, lambda x: F.struct(x["index"].alias("index"), F.coalesce(x["relevance_score"], x["score"]).alias("score")))
    return F.filter(each, lambda x: x["index"].isNotNull() & x["score"].isNotNull())
