"""Answers over evidence packs: prompts, the mock answer, citations and their validation, one repair."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATTERN = r"\[E\d{3}\]"


def citations(text: Column) -> Column:
    """Distinct citation ids in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))


def citation_errors(answer: Column, valid: Column) -> Column:
    """What is wrong with an answer's citations; an empty array if nothing is."""
    used = citations(answer)
    unknown = F.array_except(used, valid)
    return F.array_compact(
        F.array(
            F.when(F.size(unknown) > 0, F.concat(F.lit("unknown citations: "), F.array_join(unknown, ", "))),
            F.when((F.size(used) == 0) & (F.size(valid) > 0), "answer contains no citations"),
            F.when(F.size(valid) == 0, "evidence pack contains no citation ids"),
        )
    )


def mock_answer(valid: Column) -> Column:
    """The deterministic answer that cites the first block."""
    first = F.try_element_at(valid, F.lit(1))
    none = "结论：证据不足以确认。\n\n证据：当前 Evidence Pack 没有可引用证据块。\n\n分析：无法在没有证据的情况下回答。\n\n不确定性：缺少可用证据。"
    some = F.concat(
        F.lit("结论：基于当前证据，只能给出谨慎判断 "), first, F.lit("。\n\n证据："), first, F.lit(" 提供了与问题直接相关的原文区间。\n\n分析：该证据可支持一个低风险概括；更细的因果链需要更多证据 "), first,
        F.lit("。\n\n不确定性：若问题要求跨章节演变，当前证据可能仍不完整。"),
    )
    return F.when(first.isNull(), none).otherwise(some)


SYSTEM = (
    "Answer only from the evidence blocks given. Put the id of a block, such as [E001], behind every key statement, and use no id that is not given. "
    "Mark conjecture as such, with the blocks it rests on. If the evidence does not suffice, say so. Answer in Chinese under four headings: 结论、证据、分析、不确定性。"
)
REPAIR = (
    "Mend the citations of an answer and nothing else: take out ids that are not given, put the fitting id behind key statements that lack one, and say that the "
    "evidence does not suffice where no block supports a statement. Keep the four headings: 结论、证据、分析、不确定性。"
)


def shown_blocks(blocks: Column) -> Column:
    each = F.transform(blocks, lambda b: F.concat(b["citation_id"], F.lit("\nchapter: "), b["chapter_title"], F.lit("\nrange: "), b["start_idx"].cast("string"), F.lit("-"), b["end_idx"].cast("string"), F.lit("\ntext:\n"), b["text"]))
    return F.when(F.size(blocks) == 0, "evidence blocks: none").otherwise(F.concat(F.lit("evidence blocks:\n\n"), F.array_join(each, "\n\n")))


def shown_clusters(summaries: Column) -> Column:
    each = F.transform(summaries, lambda c: F.concat(F.lit("- "), c["cluster_id"], F.lit(" ("), c["cluster_type"], F.lit("): "), c["cluster_name"], F.lit(" - "), c["summary"]))
    return F.when(F.coalesce(F.size(summaries), F.lit(0)) <= 0, "clusters: none").otherwise(F.concat(F.lit("clusters:\n"), F.array_join(each, "\n")))


def _messages(system: str, *parts: Column) -> Column:
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", F.concat_ws("\n\n", *parts)))


def answer_messages(question: Column, query_type: Column, summaries: Column, blocks: Column) -> Column:
    """The system and user message of a question: its kind, cluster summaries, evidence blocks."""
    return _messages(SYSTEM, F.concat(F.lit("question: "), question), F.concat(F.lit("kind: "), query_type), shown_clusters(summaries), shown_blocks(blocks))


def repair_messages(question: Column, answer_: Column, errors: Column, blocks: Column) -> Column:
    return _messages(REPAIR, F.concat(F.lit("question: "), question), F.concat(F.lit("errors: "), F.array_join(errors, "; ")), shown_blocks(blocks), F.concat(F.lit("answer:\n"), answer_))


def cluster_summaries(packs: DataFrame, clusters: DataFrame) -> DataFrame:
    """packs (query_id, document_id, cluster_ids) with `cluster_summaries` of the clusters named, in the store's order."""
    wanted = packs.select("query_id", "document_id", F.explode(F.array_distinct("cluster_ids")).alias("cluster_id"))
    found = wanted.join(clusters.select("document_id", "cluster_id", "cluster_name", "cluster_type", "summary"), ["document_id", "cluster_id"])
    listed = found.groupBy("query_id", "document_id").agg(F.array_sort(F.collect_list(F.struct("cluster_type", "cluster_name", "cluster_id", "summary"))).alias("cluster_summaries"))
    empty = F.array().cast("array<struct<cluster_type:string,cluster_name:string,cluster_id:string,summary:string>>")
    return packs.join(listed, ["query_id", "document_id"], "left").withColumn("cluster_summaries", F.coalesce("cluster_summaries", empty))


def validate(answers: DataFrame) -> DataFrame:
    """answers (answer, blocks) with citations, errors and `valid`."""
    ids = F.transform("blocks", lambda b: b["citation_id"])
    rows = answers.withColumns({"citations": citations(F.col("answer")), "errors": citation_errors(F.col("answer"), ids)})
    return rows.withColumn("valid", F.size("errors") == 0)


def answer(packs: DataFrame, make_client: Callable, repairs: int = 1) -> DataFrame:
    """(query_id, answer, attempts) from a chat client: one repair if citations are invalid and blocks exist, kept
    only if it is valid."""
    import re

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in batches:
            rows = []
            for qid, question, shown, ids in zip(pdf["query_id"], pdf["question"], pdf["shown"], pdf["ids"], strict=True):
                ok = lambda t, ids=ids: bool(len(ids)) and (used := set(re.findall(PATTERN, t))) and used <= set(ids)
                asked = lambda system, *parts: [{"role": "system", "content": system}, {"role": "user", "content": "\n\n".join(parts)}]
                text, _ = client.complete(asked(SYSTEM, f"question: {question}", shown))
                attempts = 1
                while not ok(text) and len(ids) and attempts <= repairs:
                    attempts += 1
                    again, _ = client.complete(asked(REPAIR, f"question: {question}", f"valid ids: {', '.join(ids)}", shown, f"answer:\n{text}"))
                    text = again if ok(again) else text
                rows.append((qid, text, attempts))
            yield pd.DataFrame(rows, columns=["query_id", "answer", "attempts"])

    each = packs.select("query_id", "question", shown_blocks(F.col("blocks")).alias("shown"), F.transform("blocks", lambda b: b["citation_id"]).alias("ids"))
    return each.mapInPandas(run, f"query_id {packs.schema['query_id'].dataType.simpleString()}, answer string, attempts int")
