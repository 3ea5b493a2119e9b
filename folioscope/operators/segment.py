"""Chapters and windows: half-open intervals of code points over a document's normalised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import LINE_END, let, strip


def _doc():
    return Window.partitionBy("document_id")


def _marks(text: Column, patterns: tuple[str, ...]) -> Column:
    """An array of (title, start_idx, real) of the lines that look like headings, found inside the row.

    One expression finds these lines, each with the line end before it; a fold over the few that there are finds their
    places, each behind the one before. Where a text has real chapter headings, only those count.
    """
    space = rf"[\s\x1c-\x1f\x85\p{{Z}}&&[^{LINE_END}]]*"
    lines = F.regexp_extract_all(text, F.lit(rf"(?i)(?:\A|[{LINE_END}]){space}(?:{'|'.join(patterns)})[^{LINE_END}]*"), F.lit(0))
    none = F.array().cast("array<struct<title:string,start_idx:int,real:boolean>>")

    def step(acc: Column, raw: Column) -> Column:
        def seen(at: Column) -> Column:
            title = strip(raw)
            lead = F.length(raw) - F.length(F.regexp_replace(raw, r"\A[\s\x1c-\x1f\x85\p{Z}]+", ""))
            mark = F.struct(title.alias("title"), (at - 1 + lead).cast("int").alias("start_idx"), title.rlike(fixed.REAL_CHAPTER).alias("real"))
            found = F.when(F.length(title) <= 80, F.array_append(acc["found"], mark)).otherwise(acc["found"])
            return F.struct((at + F.length(raw)).alias("after"), found.alias("found"))

        return let(F.position(raw, text, acc["after"]), seen)

    found = F.aggregate(lines, F.struct(F.lit(1).alias("after"), none.alias("found")), step, lambda acc: acc["found"])
    return let(found, lambda ms: F.when(F.exists(ms, lambda m: m["real"]), F.filter(ms, lambda m: m["real"])).otherwise(ms))


def headings(docs: DataFrame, patterns: tuple[str, ...] = fixed.CHAPTER_PATTERNS) -> DataFrame:
    """(document_id, title, start_idx, real) of the lines that look like headings: a narrow plan, without a shuffle."""
    return docs.select("document_id", F.explode(_marks(F.col("text"), patterns)).alias("m")).select("document_id", "m.*")


def chapters(docs: DataFrame, patterns: tuple[str, ...] = fixed.CHAPTER_PATTERNS, max_chapters: int | None = None, keep_text: bool = False) -> DataFrame:
    """(document_id, chapter_id, chapter_index, chapter_title, start_idx, end_idx, char_count, strategy).

    With `keep_text`, the document's whole text stays beside its chapters, so that windows are cut without a join.
    """
    if max_chapters is not None and max_chapters < 1:
        raise ValueError("max_chapters must be greater than zero")
    whole = F.array(F.struct(F.lit("Whole Document").alias("title"), F.lit(0).alias("start_idx"), F.lit(None).cast("boolean").alias("real")))
    marks = docs.select("document_id", "text", F.length("text").alias("total"), _marks(F.col("text"), patterns).alias("found"))
    marks = marks.withColumn("marks", F.when(F.size("found") > 0, F.col("found")).otherwise(whole))
    each = marks.select("document_id", "text", "total", "marks", F.posexplode("marks").alias("at", "m"))
    split = each.select(
        "document_id",
        *(["text"] if keep_text else []),
        F.when(F.col("m.real").isNull(), 0).otherwise(F.col("at") + 1).alias("chapter_index"),
        F.col("m.title").alias("chapter_title"),
        F.col("m.start_idx").alias("start_idx"),
        F.coalesce(F.try_element_at("marks", F.col("at") + 2)["start_idx"], "total").alias("end_idx"),
        F.when(F.col("m.real").isNull(), "whole_document_fallback").when(F.col("m.real"), "real_chapter_patterns").otherwise("configured_patterns").alias("strategy"),
    )
    if max_chapters is not None:
        split = split.where(F.col("chapter_index") <= max_chapters)
    chapter_id = F.concat("document_id", F.lit("_ch"), F.lpad(F.col("chapter_index").cast("string"), 4, "0"))
    return split.withColumns({"chapter_id": chapter_id, "char_count": F.col("end_idx") - F.col("start_idx")})


def chapter_warnings(chapters_: DataFrame, docs: DataFrame) -> DataFrame:
    """(document_id, chapter_id, warnings): what is odd about each chapter."""
    order = _doc().orderBy("chapter_index")
    of = chapters_.join(docs.select("document_id", F.length("text").alias("total")), "document_id").withColumn("previous_end", F.lag("end_idx").over(order)).withColumn("first", F.row_number().over(order) == 1)
    tell = lambda test, *parts: F.when(test, F.concat(*parts))
    cid, count = F.col("chapter_id"), F.col("char_count").cast("string")
    found = F.array(
        tell((F.col("start_idx") < 0) | (F.col("end_idx") > F.col("total")) | (F.col("start_idx") >= F.col("end_idx")), cid, F.lit(": invalid interval")),
        tell(F.col("start_idx") < F.col("previous_end"), cid, F.lit(": overlaps previous chapter")),
        tell(F.col("char_count") != F.col("end_idx") - F.col("start_idx"), cid, F.lit(": char_count mismatch")),
        tell(F.col("char_count") < 200, cid, F.lit(": very short chapter ("), count, F.lit(" chars)")),
        tell(F.col("first") & (F.col("start_idx") > 2000), F.lit("uncovered prefix is large ("), F.col("start_idx").cast("string"), F.lit(" chars)")),
    )
    return of.select("document_id", "chapter_id", F.array_compact(found).alias("warnings"))


def chapter_report(chapters_: DataFrame) -> DataFrame:
    return chapters_.groupBy("document_id").agg(F.count(F.lit(1)).alias("total_chapters"), F.min("char_count").alias("shortest_chapter_chars"), F.max("char_count").alias("longest_chapter_chars"), F.first("strategy").alias("strategy"))


def check_window_config(size: int, overlap: float, least: int, most: int) -> None:
    if size <= 0 or least <= 0 or most <= 0:
        raise ValueError("window sizes must be greater than zero")
    if not 0 <= overlap < 1:
        raise ValueError("overlap_ratio must be in [0, 1)")
    if most < size or least > size:
        raise ValueError("min_chars <= size_chars <= max_chars must hold")


def windows(chapters_: DataFrame, docs: DataFrame, mode: str = "auto", size: int = 1200, overlap: float = 0.2, least: int = 300, most: int = 1600) -> DataFrame:
    """Windows of each chapter: all of it (by_chapter), or overlapping slices of `size` characters (sliding).

    `auto` slides only over the chapter that stands for a whole document. A last slice shorter than `least` is
    merged into the one before it. Texts come with the chapters if those keep them, else from `docs` by a join.
    """
    check_window_config(size, overlap, least, most)
    if mode not in ("auto", "by_chapter", "sliding"):
        raise ValueError(f"unknown window mode: {mode}")
    stride = max(1, round(size * (1 - overlap)))
    length = F.col("char_count")
    slices = F.when(length <= size, 1).otherwise(F.ceil((length - size) / stride) + 1).cast("int")
    tail = length - (slices - 1) * stride
    count = F.when((slices > 1) & (tail < least), slices - 1).otherwise(slices)
    sliding = {"auto": F.col("chapter_index") == 0, "sliding": F.lit(True), "by_chapter": F.lit(False)}[mode]
    cut = chapters_.withColumns({"sliding": sliding, "n": F.when(sliding, count).otherwise(1)}).where(length > 0)
    each = cut.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    start = F.col("start_idx") + F.col("k") * stride
    last = F.col("k") == F.col("n") - 1
    kept = ["text"] if "text" in chapters_.columns else []
    placed = each.select(
        "document_id", "chapter_id", "chapter_index", *kept,
        (F.col("k") + 1).cast("int").alias("window_index"),
        F.when(F.col("sliding"), start).otherwise(F.col("start_idx")).cast("int").alias("window_start"),
        F.when(F.col("sliding") & ~last, start + size).otherwise(F.col("end_idx")).cast("int").alias("window_end"),
    )
    texts = placed if kept else placed.join(docs.select("document_id", "text"), "document_id")
    window_id = F.concat("chapter_id", F.lit("_win"), F.lpad(F.col("window_index").cast("string"), 4, "0"))
    body = F.substring(F.col("text"), F.col("window_start") + 1, F.col("window_end") - F.col("window_start"))
    return texts.select("document_id", "chapter_id", "chapter_index", window_id.alias("window_id"), "window_index", "window_start", "window_end", (F.col("window_end") - F.col("window_start")).alias("char_count"), body.alias("text"))


def window_report(windows_: DataFrame, least: int = 300) -> DataFrame:
    n = F.col("char_count")
    return windows_.groupBy("document_id").agg(F.count(F.lit(1)).alias("total_windows"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.round(F.avg(n), 2).alias("avg_chars"), F.count_if(n < least).alias("short_windows"))


def window_problems(windows_: DataFrame, chapters_: DataFrame, docs: DataFrame, most: int) -> DataFrame:
    """(window_id, problem) of windows that break an invariant; none are expected."""
    of = windows_.alias("w").join(chapters_.alias("c"), "chapter_id").join(docs.select(F.col("document_id").alias("of"), F.col("text").alias("whole")), F.col("w.document_id") == F.col("of"))
    n = F.col("w.window_end") - F.col("w.window_start")
    problem = (
        F.when(n <= 0, "invalid interval")
        .when((F.col("w.window_start") < F.col("c.start_idx")) | (F.col("w.window_end") > F.col("c.end_idx")), "outside chapter")
        .when(F.col("w.text") != F.substring(F.col("whole"), F.col("w.window_start") + 1, n), "text does not match its slice")
        .when(n > most, "longer than allowed")
    )
    return of.select("window_id", problem.alias("problem")).where(F.col("problem").isNotNull())
