"""Interval algebra with one gaps-and-islands step: unions, complements, coverage, segments, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import preview, strip


def islands(rows: DataFrame, keys: list[str], start: str, end: str, gap: int | Column = 0, order: list[str] | None = None) -> DataFrame:
    """rows with `island`: intervals of one key whose starts lie at most `gap` behind what came before share a number."""
    by = Window.partitionBy(*keys).orderBy(start, end, *(order or []))
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    return rows.withColumn("__new", new).withColumn("island", F.sum("__new").over(by)).drop("__new")


def union(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Merged intervals (touching ones too) of each key."""
    return islands(rows.where(F.col(start) < F.col(end)), keys, start, end).groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def covered(windows: DataFrame, spans: DataFrame) -> DataFrame:
    """(window_id, start_idx, end_idx): union of the located spans inside each window."""
    located = spans.where((F.col("locator_status") == "located") & F.col("span_start_idx").isNotNull() & F.col("span_end_idx").isNotNull())
    inside = windows.select("window_id", "window_start", "window_end").join(located.select("window_id", "span_start_idx", "span_end_idx"), "window_id")
    clipped = inside.select("window_id", F.greatest("window_start", "span_start_idx").alias("start_idx"), F.least("window_end", "span_end_idx").alias("end_idx"))
    return union(clipped, ["window_id"], "start_idx", "end_idx")


def gaps(windows: DataFrame, merged: DataFrame) -> DataFrame:
    """(window_id, gap_index, start_idx, end_idx): what the merged intervals leave of each window."""
    edges = merged.select("window_id", F.col("start_idx").alias("upto"), F.col("end_idx").alias("after"))
    ends = windows.select("window_id", F.col("window_end").alias("upto"), F.lit(None).cast("int").alias("after"))
    every = edges.unionByName(ends).join(windows.select("window_id", "window_start"), "window_id")
    by = Window.partitionBy("window_id").orderBy("upto", F.col("after").asc_nulls_last())
    cursor = F.coalesce(F.max("after").over(by.rowsBetween(Window.unboundedPreceding, -1)), "window_start")
    found = every.select("window_id", cursor.alias("start_idx"), F.col("upto").alias("end_idx")).where(F.col("start_idx") < F.col("end_idx"))
    number = F.row_number().over(Window.partitionBy("window_id").orderBy("start_idx")) - 1
    return found.select("window_id", number.alias("gap_index"), "start_idx", "end_idx")


def uncovered_text(windows: DataFrame, gaps_: DataFrame) -> DataFrame:
    """(window_id, uncovered_text): the gaps' texts under their coordinates, blank ones left out."""
    each = gaps_.join(windows.select("window_id", "window_start", "text"), "window_id")
    body = strip(F.substring(F.col("text"), F.col("start_idx") - F.col("window_start") + 1, F.col("end_idx") - F.col("start_idx")))
    block = F.format_string("[%d, %d)\n%s", "start_idx", "end_idx", body)
    return each.where(body != "").groupBy("window_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_idx", block.alias("block")))), lambda x: x["block"]), "\n\n").alias("uncovered_text"))


def coverage_audit(windows: DataFrame, spans: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """One row a window: spans, located and failed ones, covered and uncovered characters, largest gap, hints."""
    merged = covered(windows, spans)
    inside = merged.groupBy("window_id").agg(F.sum(F.col("end_idx") - F.col("start_idx")).alias("covered_chars"))
    left = gaps(windows, merged).groupBy("window_id").agg(F.count(F.lit(1)).alias("gap_count"), F.max(F.col("end_idx") - F.col("start_idx")).alias("max_gap_chars"))
    counts = spans.groupBy("window_id").agg(F.count(F.lit(1)).alias("span_count"), F.count_if(F.col("locator_status") == "located").alias("located_count"))
    out = windows.select("window_id", (F.col("window_end") - F.col("window_start")).alias("char_count"))
    for side in (counts, inside, left):
        out = out.join(side, "window_id", "left")
    out = out.na.fill(0)
    if failures is not None:
        bounds = failures.groupBy("window_id").agg(F.max(F.col("reason").contains("outside") | F.col("reason").contains("length")).alias("out_of_bounds"))
        out = out.join(bounds, "window_id", "left")
    else:
        out = out.withColumn("out_of_bounds", F.lit(False))
    failed = F.col("span_count") - F.col("located_count")
    tags = F.array_compact(
        F.array(
            F.when(failed > 0, "locator_failed_likely"),
            F.when(F.coalesce("out_of_bounds", F.lit(False)), "bounds_rejected_likely"),
            F.when((F.col("max_gap_chars") >= 240) & (failed == 0), "needs_manual_review"),
        )
    )
    return out.select(
        "window_id", "char_count", "span_count", "located_count", failed.alias("failed_count"), "gap_count", "covered_chars",
        (F.col("char_count") - F.col("covered_chars")).alias("uncovered_chars"),
        F.when(F.col("char_count") > 0, F.round(F.col("covered_chars") / F.col("char_count"), 4)).otherwise(0.0).alias("coverage_ratio"),
        "max_gap_chars", F.when(F.size(tags) == 0, F.array(F.lit("model_skipped_likely"))).otherwise(tags).alias("hint_tags"),
    )


def coverage_summary(audits: DataFrame) -> DataFrame:
    return audits.agg(F.count(F.lit(1)).alias("windows"), F.sum("span_count").alias("spans"), F.sum("failed_count").alias("failed"), F.sum("covered_chars").alias("covered_chars"), F.sum("uncovered_chars").alias("uncovered_chars"), F.max("max_gap_chars").alias("max_gap_chars"))


def coverage_review(audits: DataFrame, least_gap: int = 0, with_spans: bool | None = None, limit: int = 50) -> DataFrame:
    """The windows most in need of a look."""
    rows = audits.where(F.col("max_gap_chars") >= least_gap)
    if with_spans is not None:
        rows = rows.where((F.col("span_count") > 0) == with_spans)
    return rows.orderBy(F.desc("max_gap_chars"), F.desc("uncovered_chars"), F.desc("failed_count"), "window_id").limit(limit)


def coverage_segments(windows: DataFrame, spans: DataFrame) -> DataFrame:
    """(window_id, start_idx, end_idx, span_ids): elementary segments with the spans that lie over each."""
    located = spans.where((F.col("locator_status") == "located") & F.col("span_start_idx").isNotNull() & F.col("span_end_idx").isNotNull()).select("window_id", "span_id", "span_start_idx", "span_end_idx")
    ends = windows.select("window_id", F.explode(F.array("window_start", "window_end")).alias("at"))
    inner = located.join(windows.select("window_id", "window_start", "window_end"), "window_id").select("window_id", F.explode(F.array(F.greatest("window_start", "span_start_idx"), F.least("window_end", "span_end_idx"))).alias("at"))
    marks = ends.union(inner).distinct()
    cut = marks.select("window_id", F.col("at").alias("start_idx"), F.lead("at").over(Window.partitionBy("window_id").orderBy("at")).alias("end_idx")).where(F.col("end_idx").isNotNull())
    over = cut.join(located, "window_id", "left").groupBy("window_id", "start_idx", "end_idx")
    active = (F.col("span_start_idx") < F.col("end_idx")) & (F.col("span_end_idx") > F.col("start_idx"))
    return over.agg(F.sort_array(F.collect_list(F.when(active, F.col("span_id")))).alias("span_ids"))


def gap_neighbours(gaps_: DataFrame, windows: DataFrame, spans: DataFrame) -> DataFrame:
    """Each gap with the nearest span that ends before it and the nearest that starts behind it (an as-of join).

    Of spans equally near, the greatest id stands on the left, the least on the right. Windows with their `text` give a preview of the gap's as well.
    """
    located = spans.where(F.col("locator_status") == "located").select("window_id", "span_id", "span_start_idx", "span_end_idx")
    near = gaps_.join(located, "window_id", "left").groupBy("window_id", "gap_index", "start_idx", "end_idx")
    left = F.max(F.when(F.col("span_end_idx") <= F.col("start_idx"), F.struct("span_end_idx", "span_id")))
    right = F.min(F.when(F.col("span_start_idx") >= F.col("end_idx"), F.struct("span_start_idx", "span_id")))
    out = near.agg(F.coalesce(left["span_id"], F.lit("")).alias("left_span_id"), F.coalesce(right["span_id"], F.lit("")).alias("right_span_id"))
    if "text" not in windows.columns:
        return out
    body = F.substring(F.col("text"), F.col("start_idx") - F.col("window_start") + 1, F.col("end_idx") - F.col("start_idx"))
    return out.join(windows.select("window_id", "window_start", "text"), "window_id").withColumn("text_preview", preview(body, 240)).drop("text", "window_start")


def absorb_gaps(windows: DataFrame, spans: DataFrame, most: int = 120) -> DataFrame:
    """Located spans with small neighbouring gaps added: each gap reads its neighbours' original bounds.

    A gap of at most `most` characters before the first span goes to it, behind the last one too. Between two it
    goes left if it begins with closing punctuation, right if it ends with an opening mark, right if it is short
    and holds a line break, else left.
    """
    inside = spans.where(F.col("locator_status") == "located").join(windows.select("window_id", "window_start", "window_end", F.col("text").alias("window_text")), "window_id")
    by = Window.partitionBy("window_id").orderBy("span_start_idx", "span_end_idx", "span_id")
    rows = inside.withColumns({"left_end": F.lag("span_end_idx").over(by), "right_start": F.lead("span_start_idx").over(by)})

    def gap(a: Column, b: Column) -> Column:
        return strip(F.substring(F.col("window_text"), a - F.col("window_start") + 1, F.greatest(b - a, F.lit(0))))

    starts = lambda t: F.substring(t, 1, 1).isin(*fixed.CLOSING_MARKS)
    ends = lambda t: F.right(t, F.lit(1)).isin(*fixed.OPENING_MARKS)
    goes_right = lambda t: ~starts(t) & (ends(t) | (t.contains("\n") & (F.length(t) <= 30)))
    s, e = F.col("span_start_idx"), F.col("span_end_idx")
    before, behind = gap(F.coalesce("left_end", "window_start"), s), gap(e, F.coalesce("right_start", "window_end"))
    small_before = (F.length(before) <= most) & (F.coalesce("left_end", "window_start") < s)
    small_behind = (F.length(behind) <= most) & (e < F.coalesce("right_start", "window_end"))
    new_start = F.when(small_before & (F.col("left_end").isNull() | goes_right(before)), F.coalesce("left_end", "window_start")).otherwise(s)
    new_end = F.when(small_behind & (F.col("right_start").isNull() | ~goes_right(behind)), F.coalesce("right_start", "window_end")).otherwise(e)
    return rows.select("window_id", "span_id", new_start.alias("span_start_idx"), new_end.alias("span_end_idx"))
