"""Question sets made by a model from a corpus of chapters."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import parse_json_object

#: What each profile asks for.
PROFILES = {
    "broad": "Each question spans several chapters, such as a development, a relation or a comparison; list every chapter it rests on.",
    "pinpoint": "Each question can be answered from one or two chapters; list these.",
    "mixed": "About half of the questions span several chapters, the others rest on one or two; set `profile` of each to broad or pinpoint.",
}
FORM = (
    'Answer with one JSON object {"questions": [...]}. A question has question_id (unique), question, profile, query_type, required_facets, '
    "expected_chapters (chapter_id, chapter_index, weight, relevance from 0 to 3, facet, reason) and negative_chapters (chapter_id, chapter_index, reason)."
)


def normalize_profile(profile: str) -> str:
    value = profile.strip().lower()
    if value not in PROFILES:
        raise ValueError(f"profile must be one of: {', '.join(PROFILES)}")
    return value


def source_text(corpus: DataFrame) -> DataFrame:
    """(document_id, catalog, source): a document's chapters as JSON and as text, in order; corpus from files.corpus."""
    shown = F.concat(F.lit("[CHAPTER "), F.col("chapter_index").cast("string"), F.lit("]\nchapter_id: "), "chapter_id", F.lit("\ntitle: "), "chapter_title", F.lit("\ntext:\n"), "text")
    listed = F.array_sort(F.collect_list(F.struct("chapter_index", F.struct("chapter_id", "chapter_index", "chapter_title", "char_count").alias("c"), shown.alias("t"))))
    got = corpus.groupBy("document_id").agg(listed.alias("x"))
    return got.select("document_id", F.to_json(F.transform("x", lambda r: r["c"])).alias("catalog"), F.array_join(F.transform("x", lambda r: r["t"]), "\n\n").alias("source"))


def generation_messages(catalog: str, source: str, count: int, profile: str = "broad") -> list[dict[str, str]]:
    kind = normalize_profile(profile)
    user = f"Write {count} questions that test which chapters are recalled. {PROFILES[kind]}\n\n{FORM}\n\nchapters:\n{catalog}\n\n{source}"
    return [{"role": "system", "content": "You make question sets from whole chapters of a novel and answer with JSON only."}, {"role": "user", "content": user}]


def questions_of(answer: str) -> list[dict]:
    """The questions of a model's answer; none at all, or one id twice, is an error."""
    found = parse_json_object(answer).get("questions")
    if not isinstance(found, list) or not found:
        raise ValueError("the answer holds no questions")
    seen: set[str] = set()
    for q in found:
        name = str(q.get("question_id") or "").strip()
        if not name or not str(q.get("question") or "").strip() or not q.get("expected_chapters"):
            raise ValueError(f"incomplete question: {json.dumps(q, ensure_ascii=False)[:80]}")
        if name in seen:
            raise ValueError(f"duplicate question_id: {name}")
        seen.add(name)
    return found


def generate(corpus: DataFrame, make_client, count: int = 200, profile: str = "broad") -> DataFrame:
    """(document_id, line): one JSON line a question, one model call a document, made on the executors.

    Lines written as text are what files.read_questions reads.
    """
    import pandas as pd

    kind = normalize_profile(profile)

    def run(batches):
        client = make_client()
        for pdf in batches:
            rows = []
            for doc, catalog, source in zip(pdf["document_id"], pdf["catalog"], pdf["source"], strict=True):
                text, _ = client.complete(generation_messages(catalog, source, count, kind))
                rows += [(doc, json.dumps({"profile": kind if kind != "mixed" else "pinpoint"} | q, ensure_ascii=False)) for q in questions_of(text)]
            yield pd.DataFrame(rows, columns=["document_id", "line"])

    return source_text(corpus).mapInPandas(run, "document_id string, line string")
