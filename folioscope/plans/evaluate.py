"""Evaluation of retrieval over a question set, all questions in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation
from ..sources import files
from ..sources.scratch import settled
from . import ask


def run(built: dict[str, DataFrame], questions: DataFrame, document_id: str | None = None, reranker: str = "mock") -> tuple[DataFrame, DataFrame]:
    """(scores, predicted chapters) of a question set read by files.read_questions; each profile its own widths.

    All questions go to one document, or each to that of its column `document_id`. A profile that no question has is
    not run; an unknown one counts as `pinpoint`.
    """
    doc = F.lit(document_id) if document_id is not None else F.col("document_id")
    known = F.coalesce("profile", F.lit("pinpoint"))
    asked = questions.select(F.col("question_id").alias("query_id"), doc.alias("document_id"), "question", F.when(known.isin(*ask.PROFILES), known).otherwise("pinpoint").alias("profile"))
    there = {r["profile"] for r in asked.select("profile").distinct().collect()}
    results = None
    for profile in sorted(there):
        part = ask.retrieve(built, asked.where(F.col("profile") == profile).drop("profile"), reranker, ask.PROFILES[profile])
        results = part if results is None else results.unionByName(part)
    if results is None:
        raise ValueError("no questions")
    rows = results.select(F.col("query_id").alias("question_id"), "chapter_id", F.col("rerank_score").alias("score"), "sources", "span_id", "rank")
    predicted = evaluation.chapter_ranking(settled(rows, "results")).join(ask.within(built["chapters"], asked).select("chapter_id", "chapter_index", "chapter_title"), "chapter_id", "left")
    gold = evaluation.normalize_gold(files.gold_rows(questions))
    scores = evaluation.question_scores(questions.select("question_id", "profile", "query_type", "required_facets"), gold, predicted, files.negative_rows(questions))
    return scores, predicted


def predictions(questions: DataFrame, predicted: DataFrame, scores: DataFrame) -> DataFrame:
    """One row a question: its text, its predicted chapters in order with index and title, and its scores."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "chapter_id", "chapter_index", "chapter_title", "score", "best_span_id", "hit_count", "sources")))
    chapters = predicted.groupBy("question_id").agg(listed.alias("predicted_chapters"))
    out = questions.select("question_id", "question").join(chapters, "question_id", "left").join(scores, "question_id", "left")
    return out.withColumn("predicted_chapters", F.coalesce("predicted_chapters", F.array()))
