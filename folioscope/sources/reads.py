"""Reads of the store: ordered lists, details of a window or a span, reviews, the graph at a glance.

Each takes tables and returns a table for all documents; a filter on an id makes it the read of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import intervals


def documents(rows: DataFrame) -> DataFrame:
    """Newest first."""
    return rows.orderBy(F.desc("created_at"), F.desc("document_id"))


def chapters(rows: DataFrame) -> DataFrame:
    return rows.orderBy("document_id", "chapter_index")


def windows(rows: DataFrame, chapters_: DataFrame) -> DataFrame:
    """Windows with their chapter's index and title, in reading order, numbered from 0 in their document."""
    of = rows.join(chapters_.select("chapter_id", "chapter_index", "chapter_title"), "chapter_id")
    order = Window.partitionBy("document_id").orderBy("chapter_index", "window_index")
    return of.withColumn("global_window_index", F.row_number().over(order) - 1)


def windows_by_status(status: DataFrame, wanted: str = "all", limit: int = 200) -> DataFrame:
    """The first windows of each document that are pending, extracted, or any, with the number of all such."""
    if wanted not in ("all", "pending", "extracted"):
        raise ValueError("status must be all, pending, or extracted")
    kept = status if wanted == "all" else status.where(F.col("status") == wanted)
    by = Window.partitionBy("document_id")
    numbered = kept.withColumns({"total": F.count(F.lit(1)).over(by), "__n": F.row_number().over(by.orderBy("global_index"))})
    return numbered.where(F.col("__n") <= limit).drop("__n")


def spans(rows: DataFrame, located_only: bool = False) -> DataFrame:
    """In the order that breaks every later tie, numbered by `ord` inside the document."""
    kept = rows.where(F.col("locator_status") == "located") if located_only else rows
    return kept.withColumn("ord", F.row_number().over(Window.partitionBy("document_id").orderBy("window_start", "span_id")))


def search_spans(rows: DataFrame, status: str = "all", words: str = "", limit: int = 200) -> DataFrame:
    """Spans of a status whose id, summary or entities hold the words, the most salient of each document."""
    kept = rows if status == "all" else rows.where(F.col("locator_status") == status)
    if words:
        held = lambda c: F.contains(F.lower(c), F.lit(words.lower()))
        kept = kept.where(held(F.col("span_id")) | held(F.col("summary")) | held(F.to_json("entities")))
    order = Window.partitionBy("document_id").orderBy(F.desc("salience_score"), F.asc("span_start_idx"), "span_id")
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def clusters(rows: DataFrame, cluster_id: str | None = None, cluster_type: str | None = None) -> DataFrame:
    kept = rows if cluster_id is None else rows.where(F.col("cluster_id") == cluster_id)
    kept = kept if cluster_type is None else kept.where(F.col("cluster_type") == cluster_type)
    return kept.orderBy("document_id", "cluster_type", "cluster_name", "cluster_id")


def edges(rows: DataFrame, edge_type: str | None = None) -> DataFrame:
    kept = rows if edge_type is None else rows.where(F.col("edge_type") == edge_type)
    return kept.orderBy("document_id", "edge_type", "from_id", "to_id")


def listed(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """(key, name): the rows of each key as an array in order."""
    rest = [c for c in rows.columns if c != key and c not in order]
    packed = F.array_sort(F.collect_list(F.struct(*order, *rest)))
    return rows.groupBy(key).agg(packed.alias(name))


def with_reasons(spans_: DataFrame, failures: DataFrame) -> DataFrame:
    """Spans with the reasons of their failures, oldest first; an empty array where there are none."""
    reasons = failures.where(F.col("span_id").isNotNull()).groupBy("span_id").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("reason", F.lit("")).alias("reason")))).alias("r"))
    got = F.coalesce(F.transform("r", lambda x: x["reason"]), F.array().cast("array<string>"))
    return spans_.join(reasons, "span_id", "left").withColumn("failure_reasons", got).drop("r")


def window_detail(windows_: DataFrame, chapters_: DataFrame, spans_: DataFrame, failures: DataFrame) -> DataFrame:
    """One row a window: its columns, its chapter's, its spans and its failures as arrays, empty where none are."""
    of = windows(windows_, chapters_)
    of = of.join(listed(spans_.select("window_id", "span_index_in_window", "span_id", "summary", "entities", "locator_status"), "window_id", ["span_index_in_window", "span_id"], "spans"), "window_id", "left")
    of = of.join(listed(failures.select("window_id", "id", "span_id", "stage", "reason", "attempts"), "window_id", ["id"], "failures"), "window_id", "left")
    return of.withColumns({c: F.coalesce(c, F.array()) for c in ("spans", "failures")})


def span_detail(spans_: DataFrame, candidates: DataFrame, failures: DataFrame) -> DataFrame:
    """One row a span: its columns, its locator candidates (most confident first) and its failures."""
    ranked = candidates.withColumn("order", -F.col("confidence"))
    of = spans_.join(listed(ranked.select("span_id", "order", "id", "start_idx", "end_idx", "confidence", "strategy"), "span_id", ["order", "id"], "candidates"), "span_id", "left")
    of = of.join(listed(failures.where(F.col("span_id").isNotNull()).select("span_id", "id", "stage", "reason"), "span_id", ["id"], "failures"), "span_id", "left")
    return of.withColumns({c: F.coalesce(c, F.array()) for c in ("candidates", "failures")})


def review(windows_: DataFrame, chapters_: DataFrame, spans_: DataFrame, first: int = 0, last: int | None = None, with_spans_only: bool = False, min_gap: int = 0, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """(windows, summary): coverage audits of the windows first..last (0-based) of each document, widest gaps first.

    The summary is over all that are kept, the list is cut to `limit` a document.
    """
    if first < 0 or (last is not None and last < first):
        raise ValueError("bad window range")
    of = windows(windows_, chapters_)
    of = of.where(F.col("global_window_index") >= first) if last is None else of.where(F.col("global_window_index").between(first, last))
    audits = intervals.coverage_audit(of, spans_).join(of.select("window_id", "document_id", "global_window_index"), "window_id")
    audits = audits.where(F.col("max_gap_chars") >= min_gap)
    if with_spans_only:
        audits = audits.where(F.col("span_count") > 0)
    order = Window.partitionBy("document_id").orderBy(F.desc("max_gap_chars"), F.desc("uncovered_chars"), F.desc("failed_count"), "global_window_index")
    paged = audits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return paged, intervals.coverage_summary(audits)


def preview(span: Column) -> Column:
    shown = ("span_id", "chapter_id", "summary", "span_type", "salience_score", "span_start_idx", "span_end_idx", "key_quote")
    return F.struct(*(span[c].alias(c) for c in shown))


def clusters_with_members(clusters_: DataFrame, spans_: DataFrame) -> DataFrame:
    """Clusters with previews of their members in order; members that are no longer stored are left out."""
    each = clusters_.select("cluster_id", F.posexplode("member_span_ids").alias("place", "span_id"))
    found = each.join(spans_.select("span_id", F.struct(*spans_.columns).alias("s")), "span_id")
    members = found.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("place", preview(F.col("s")).alias("member")))).alias("m"))
    out = clusters_.join(members, "cluster_id", "left")
    return out.withColumns({"member_count": F.size("member_span_ids"), "members": F.coalesce(F.transform("m", lambda x: x["member"]), F.array())}).drop("m")


def graph_summary(clusters_: DataFrame, edges_: DataFrame, limit: int = 40) -> DataFrame:
    """(document_id, cluster_count, edge_count, edge_counts, cluster_ids): a document's graph, its first clusters."""
    c = clusters_.groupBy("document_id").agg(F.count(F.lit(1)).alias("cluster_count"), F.slice(F.array_sort(F.collect_list(F.struct("cluster_type", "cluster_name", "cluster_id"))), 1, limit).alias("first"))
    kinds = edges_.groupBy("document_id", "edge_type").agg(F.count(F.lit(1)).alias("n"))
    e = kinds.groupBy("document_id").agg(F.sum("n").alias("edge_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("edge_type", "n")))).alias("edge_counts"))
    both = c.join(e, "document_id", "full")
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return both.select("document_id", zero("cluster_count"), zero("edge_count"), "edge_counts", F.transform("first", lambda x: x["cluster_id"]).alias("cluster_ids"))
