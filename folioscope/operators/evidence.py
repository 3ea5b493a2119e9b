"""Evidence packs: seeds widened inside their chapters, merged, chosen under a budget, cited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import islands

Q = ["query_id", "document_id"]
#: Characters of a piece of a chapter's text.
PIECE = 1024


def priority(score: Column, sources: Column) -> Column:
    return F.round(score + 0.08 * F.greatest(F.lit(0), F.size(F.array_distinct(sources)) - 1), 8)


def seeds(results: DataFrame) -> DataFrame:
    """results with `warning`: what keeps a span from being evidence; null if nothing does."""
    problem = (
        F.when(F.col("span_id").isNull() | (F.col("span_id") == ""), "missing span_id")
        .when(F.col("span_start_idx").isNull() | F.col("span_end_idx").isNull(), "missing coordinates")
        .when((F.col("span_start_idx") < 0) | (F.col("span_start_idx") >= F.col("span_end_idx")), "invalid coordinate range")
    )
    return results.withColumn("warning", problem)


def expand(seeds_: DataFrame, chapters: DataFrame, pre: int = 200, post: int = 300) -> DataFrame:
    """Seeds with context on both sides, clipped to their chapter; `warning` tells those without one."""
    c = chapters.select("document_id", "chapter_id", "chapter_title", F.col("start_idx").alias("c_start"), F.col("end_idx").alias("c_end"))
    rows = seeds_.drop("chapter_title").join(c, ["document_id", "chapter_id"], "left")
    outside = (F.col("span_start_idx") < F.col("c_start")) | (F.col("span_end_idx") > F.col("c_end"))
    warning = F.coalesce("warning", F.when(F.col("c_start").isNull(), "chapter not found").when(outside, "coordinates outside chapter"))
    return rows.withColumns({
        "warning": warning,
        "start_idx": F.greatest("c_start", F.col("span_start_idx") - max(0, pre)),
        "end_idx": F.least("c_end", F.col("span_end_idx") + max(0, post)),
        "priority_score": priority(F.col("rerank_score"), F.col("sources")),
    }).drop("c_start", "c_end")


def merge(expanded: DataFrame, gap: int = 500) -> DataFrame:
    """Intervals of one chapter at most `gap` apart become one; every merged field is a maximum or a union."""
    keys = [*Q, "chapter_id"]
    good = expanded.where(F.col("warning").isNull())
    by = islands(good, keys, "start_idx", "end_idx", max(0, gap), ["span_id"])
    one = by.groupBy(*keys, "chapter_title", "island").agg(
        F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("start_idx", "end_idx", "span_id"))), lambda x: x["span_id"])).alias("source_span_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("retrieval_sources"),
        F.max("rerank_score").alias("rerank_score"), F.max("priority_score").alias("p"),
    )
    return one.withColumn("priority_score", F.greatest("p", priority(F.col("rerank_score"), F.col("retrieval_sources")))).drop("p", "island")


def choose(merged: DataFrame, chars: int = 50_000, blocks: int = 16) -> DataFrame:
    """Intervals by priority, one of each chapter first, while characters and blocks last; the last one is cut.

    Each takes what the ones before it left: its place in the order and a running sum decide, without a loop.
    """
    greedy = [F.desc("priority_score"), F.desc("rerank_score"), F.size("retrieval_sources").desc(), F.asc("chapter_id"), F.asc("start_idx")]
    nth = F.row_number().over(Window.partitionBy(*Q, "chapter_id").orderBy(*greedy))
    order = Window.partitionBy(*Q).orderBy(F.desc("first"), *greedy)
    length = F.col("end_idx") - F.col("start_idx")
    rows = merged.withColumn("first", nth == 1)
    rows = rows.withColumns({"place": F.row_number().over(order), "used": F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    room = chars - F.col("used")
    kept = rows.where((F.col("place") <= blocks) & (room > 0))
    return kept.withColumn("end_idx", (F.col("start_idx") + F.least(length, room)).cast("int")).drop("first", "place", "used")


def cite(chosen: DataFrame, texts: DataFrame) -> DataFrame:
    """Blocks in order of position with their citation ids and texts.

    texts (document_id, chapter_id, text, start_idx) are chapters: a block needs no more of a document than its own.
    Texts are cut into pieces of PIECE characters, so that a block meets the few pieces that it lies in and no row
    carries a whole chapter.
    """
    n = F.row_number().over(Window.partitionBy(*Q).orderBy("start_idx", "end_idx", "chapter_id"))
    chapter = ["document_id", "chapter_id"]
    heads = texts.select(*chapter, F.col("start_idx").alias("base"), F.greatest(F.lit(0), F.ceil(F.length("text") / PIECE) - 1).alias("last"))
    cut = F.when(F.length("text") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).otherwise(F.array("text"))
    pieces = texts.select(*chapter, F.posexplode(cut).alias("piece", "text"))
    rows = chosen.withColumn("n", n).join(heads, chapter)
    start, length = F.col("start_idx") - F.col("base"), F.col("end_idx") - F.col("start_idx")
    inside = lambda at: F.greatest(F.lit(0), F.least(F.coalesce("last", F.lit(0)), F.floor(at / PIECE))).cast("int")
    rows = rows.withColumns({"low": inside(start), "high": F.greatest(inside(start), inside(start + length - 1))})
    each = rows.select(F.struct(*chosen.columns).alias("row"), *Q, "n", "base", "chapter_id", F.explode(F.sequence("low", "high")).alias("piece")).join(pieces, [*chapter, "piece"])
    at = F.col("row.start_idx") - F.col("base") - F.col("piece") * PIECE
    body = F.substring(F.col("text"), F.greatest(at, F.lit(0)) + 1, F.greatest(F.lit(0), F.col("row.end_idx") - F.col("row.start_idx") + F.least(at, F.lit(0))))
    whole = each.groupBy(*Q, "n").agg(F.first("row").alias("row"), F.sort_array(F.collect_list(F.struct("piece", body.alias("body")))).alias("bodies"))
    text = F.when(F.exists("bodies", lambda x: x["body"].isNotNull()), F.array_join(F.transform("bodies", lambda x: x["body"]), ""))
    return whole.select("row.*", F.format_string("[E%03d]", "n").alias("citation_id"), text.alias("block_text"))


def pack(blocks: DataFrame) -> DataFrame:
    """One nested evidence pack a question."""
    block = F.struct("citation_id", "chapter_id", "chapter_title", "start_idx", "end_idx", "source_span_ids", "retrieval_sources", "rerank_score", F.col("block_text").alias("text"))
    listed = blocks.groupBy(*Q).agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    return listed.withColumns({"block_count": F.size("blocks"), "evidence_chars": F.aggregate("blocks", F.lit(0), lambda a, b: a + F.length(b["text"]))})
