"""File sources and sinks: texts of unknown encoding, question sets, corpora, predictions, reports."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import document_id, normalize_text
from .lines import numbered_lines, place

ENCODINGS = ("utf-8-sig", "utf-8", "gb18030")
CHAPTER = "struct<chapter_id:string,chapter_index:int,weight:double,relevance:double,facet:string,reason:string>"
NEGATIVE = "struct<chapter_id:string,chapter_index:int,reason:string>"
QUESTION = f"question_id string, question string, answer string, profile string, query_type string, required_facets array<string>, expected_chapters array<{CHAPTER}>, negative_chapters array<{NEGATIVE}>"
FIELDS = ("question_id", "question", "answer", "profile", "query_type", "required_facets", "expected_chapters", "negative_chapters")


def _decode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts, used = [], []
        for raw in pdf["content"]:
            for name in ENCODINGS:
                try:
                    texts.append(bytes(raw).decode(name))
                    used.append(name)
                    break
                except UnicodeDecodeError:
                    continue
            else:
                raise ValueError(f"none of {', '.join(ENCODINGS)} decodes a file")
        yield pd.DataFrame({"path": pdf["path"], "text": texts, "encoding": used})


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(path, text, encoding): whole files, decoded by the first encoding that fits.

    Files of one byte-order-marked or plain UTF-8 text, else GB18030, which Spark's decode does not know.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return raw.mapInPandas(_decode, "path string, text string, encoding string")


def ingest(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(document_id, path, text, total_chars): normalised documents, one for each distinct content."""
    text = read_texts(spark, path, glob).select("path", normalize_text(F.col("text")).alias("text"))
    rows = text.select(document_id(F.col("text")).alias("document_id"), "path", "text", F.length("text").alias("total_chars"))
    return rows.dropDuplicates(["document_id"])


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A question set from JSON lines: blank lines are skipped; a bad one, told by file and line, or an empty set is an error.

    Facets default to those of the gold chapters, a chapter's relevance to its weight, its facet to `general`;
    further keys are kept as JSON in `metadata`.
    """
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    if lines.isEmpty():
        raise ValueError(f"no questions in {path}")
    parsed = lines.select("file", "line", "value", F.from_json("value", QUESTION).alias("q"), F.from_json("value", "map<string,string>").alias("m"))
    required = F.when(F.col("q.question_id").isNull() | (F.size("q.expected_chapters") < 1), F.lit(True)).otherwise(F.lit(False))
    checked = parsed.withColumn("bad", F.col("q").isNull() | F.coalesce(required, F.lit(True)))
    told = F.raise_error(place("bad question line")).cast("string")
    checked = checked.withColumn("ok", F.when(F.col("bad"), told).otherwise(F.col("q.question_id")))
    blank = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("general"))
    gold = F.transform("q.expected_chapters", lambda c: F.struct(c["chapter_id"].alias("chapter_id"), F.coalesce(c["chapter_index"], F.lit(0)).alias("chapter_index"), F.coalesce(c["weight"], F.lit(0.0)).alias("weight"), F.coalesce(c["relevance"], c["weight"], F.lit(0.0)).alias("relevance"), blank(c["facet"]).alias("facet"), F.coalesce(c["reason"], F.lit("")).alias("reason")))
    out = checked.withColumn("gold", gold).select("ok", "q.*", "m", "gold").drop("expected_chapters").withColumnRenamed("gold", "expected_chapters").drop("question_id").withColumnRenamed("ok", "question_id")
    facets = F.array_distinct(F.transform("expected_chapters", lambda c: c["facet"]))
    asked = F.filter(F.coalesce("required_facets", F.array().cast("array<string>")), lambda f: F.trim(f) != "")
    extra = F.map_filter("m", lambda k, v: ~k.isin(*FIELDS))
    return out.withColumns({"required_facets": F.when(F.size(asked) > 0, asked).otherwise(facets), "metadata": F.to_json(extra)}).drop("m")


def gold_rows(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", F.explode("expected_chapters").alias("c")).select("question_id", "c.*")


def negative_rows(questions: DataFrame) -> DataFrame:
    each = questions.select("question_id", F.explode(F.coalesce("negative_chapters", F.array().cast(f"array<{NEGATIVE}>"))).alias("c"))
    return each.select("question_id", F.coalesce("c.chapter_id", F.lit("")).alias("chapter_id"), F.coalesce("c.chapter_index", F.lit(0)).alias("chapter_index"))


def corpus(docs: DataFrame, chapters: DataFrame, first: int, last: int) -> DataFrame:
    """Chapters first to last (inclusive) with their texts."""
    if first < 1 or last < first:
        raise ValueError("a chapter range starts at 1 and does not run backwards")
    body = F.substring(F.col("text"), F.col("start_idx") + 1, F.col("end_idx") - F.col("start_idx"))
    return chapters.where(F.col("chapter_index").between(first, last)).join(docs.select("document_id", "text"), "document_id").select(*chapters.columns, body.alias("text"))


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_predictions(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """Predictions back from JSON lines, blank lines aside, in a given or the found schema; none at all is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if lines.isEmpty():
        raise ValueError(f"no predictions in {path}")
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(form) if form else reader).json(path)


def reports(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    """(path, name, kind, modified, bytes) of JSON reports, newest first; the kind is the name's last part."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    name = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    kind = F.coalesce(F.nullif(F.regexp_extract(name, r"_([a-z]+)_report$", 1), F.lit("")), F.lit("report"))
    return files.select("path", name.alias("name"), kind.alias("kind"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")).orderBy(F.desc("modified"), "name").limit(limit)


def as_report(rows: DataFrame, run_id: str, kind: str) -> DataFrame:
    """One row of JSON a row: what is appended to a table of reports."""
    return rows.select(F.lit(run_id).alias("run_id"), F.lit(kind).alias("kind"), F.to_json(F.struct("*")).alias("report"))


def parse_json_object(text: str) -> dict:
    """A JSON object from a model's answer: the whole text, or its outermost braces."""
    try:
        found = json.loads(text)
    except ValueError:
        found = json.loads(text[text.index("{") : text.rindex("}") + 1])
    if not isinstance(found, dict):
        raise ValueError("not a JSON object")
    return found
