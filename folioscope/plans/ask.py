"""From documents and questions to cited answers: the whole path as one plan for all questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence, extraction, graph, index, qa, retrieval, segment
from ..sources.scratch import settled

RETRIEVAL = {"graph_cluster_top_k": 4, "graph_span_per_cluster": 12, "vector_top_k": 30, "bm25_top_k": 30, "union_max_candidates": 80, "rerank_top_k": 15}
WIDE = {"graph_cluster_top_k": 8, "graph_span_per_cluster": 20, "vector_top_k": 80, "bm25_top_k": 80, "union_max_candidates": 200, "rerank_top_k": 50}
PROFILES = {"pinpoint": RETRIEVAL, "broad": WIDE, "mixed": WIDE}
EVIDENCE = {"pre": 200, "post": 300, "gap": 500, "chars": 50_000, "blocks": 16}


def build(docs: DataFrame, size: int = 1200) -> dict[str, DataFrame]:
    """docs (document_id, text) to chapters, windows, located spans with vectors, clusters and edges.

    The extractor is the deterministic mock; a model's spans can take its place. Chapters and spans are stored, since
    every later branch reads them; spans hold their `vector`, so that no branch joins it to them.
    """
    with_text = segment.chapters(docs, keep_text=True)
    chapters = settled(with_text.drop("text"), "chapters")
    windows = segment.windows(with_text, docs, size=size)
    spans = extraction.locate_spans(extraction.mock_spans(windows, keep_text=True)).where("locator_status = 'located'")
    order = F.struct("span_start_idx", "span_id")
    spans = spans.withColumns({"ord": order, "cluster_type": graph.cluster_type(F.col("span_type"), F.col("summary"), F.col("entities"))})
    spans = settled(spans.withColumn("vector", index.hash_embedding(F.col("summary"), 64)), "spans")
    return {"docs": docs, "chapters": chapters, "windows": windows, "spans": spans}


def with_graph(built: dict[str, DataFrame], use_vectors: bool = True) -> dict[str, DataFrame]:
    """built with members, clusters and edges, with or without the spans' vectors."""
    spans = built["spans"] if use_vectors else built["spans"].drop("vector")
    centers = settled(graph.centers(spans), "centers")
    weights = graph.normalized_weights(use_vectors=use_vectors)
    members = settled(graph.members(graph.member_scores(centers, spans, weights=weights)), "members")
    clusters = settled(graph.clusters(members), "clusters")
    return built | {"members": members, "clusters": clusters, "edges": settled(graph.edges(clusters, members, built["chapters"]), "edges")}


def within(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """rows of the documents that stand in asked: a search sees its own document only."""
    return rows.join(asked.select("document_id").distinct(), "document_id", "left_semi")


def retrieve(built: dict[str, DataFrame], questions: DataFrame, reranker: str = "mock", settings: dict[str, int] = RETRIEVAL) -> DataFrame:
    """questions (query_id, document_id, question) to their reranked spans: three branches, one union.

    Spans, clusters and chapters of documents that no question asks are held, but not searched.
    """
    spans = settled(within(built["spans"], questions), "searched")
    text = index.bm25_text(F.col("summary"), F.col("entities"), F.col("key_quote"))
    posted = settled(index.postings(spans, "span_id", text, ["document_id"]), "postings")
    scores = index.bm25_scores(questions, posted, index.token_weights(posted, spans, ["document_id"], "span_id"), ["document_id"], "span_id")
    hits = retrieval.plain_hits(scores, "bm25", settings["bm25_top_k"])
    asked = questions.withColumn("vector", index.hash_embedding(F.col("question"), 64))
    near = index.vector_search(asked, spans, ["document_id"], "span_id", settings["vector_top_k"])
    hits = hits.unionByName(retrieval.plain_hits(near.drop("rank"), "vector", settings["vector_top_k"]))
    if "clusters" in built:
        ranked = retrieval.rank_clusters(questions, within(built["clusters"], questions), settings["graph_cluster_top_k"])
        hits = retrieval.graph_hits(ranked, within(built["edges"], questions), settings["graph_span_per_cluster"]).unionByName(hits)
    candidates = retrieval.fuse(settled(hits, "hits"), questions, spans.drop("vector"), settings["union_max_candidates"])
    return retrieval.rerank(candidates, within(built["chapters"], questions), reranker, settings["rerank_top_k"])


def collect_evidence(built: dict[str, DataFrame], results: DataFrame, settings: dict[str, int] = EVIDENCE) -> DataFrame:
    """Reranked spans to cited blocks."""
    chapters = within(built["chapters"], results)
    widened = evidence.expand(evidence.seeds(results), chapters, settings["pre"], settings["post"])
    chosen = evidence.choose(evidence.merge(widened, settings["gap"]), settings["chars"], settings["blocks"])
    body = F.substring(F.col("text"), F.col("start_idx") + 1, F.col("end_idx") - F.col("start_idx"))
    texts = chapters.join(within(built["docs"], results), "document_id").select("document_id", "chapter_id", "start_idx", body.alias("text"))
    return evidence.cite(chosen, texts)


def ask(built: dict[str, DataFrame], questions: DataFrame, reranker: str = "mock") -> DataFrame:
    """One validated answer a question, with its pack."""
    packs = evidence.pack(collect_evidence(built, settled(retrieve(built, questions, reranker), "results")))
    answered = packs.withColumn("answer", qa.mock_answer(F.transform("blocks", lambda b: b["citation_id"])))
    return qa.validate(answered).join(questions, ["query_id", "document_id"])
