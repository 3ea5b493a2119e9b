"""Table functions called from SQL against the DataFrame operators; errors at analysis; models that answer badly."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import tables
from folioscope.functions import text as tx
from folioscope.operators import segment


@pytest.fixture(scope="module")
def docs(spark):
    tables.register(spark)
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab Cd\n魔法星_9") for _ in range(n)) for n in (1, 39, 40, 41, 60, 72, 73, 100, 333, 5000)] + [None, "", "😀" * 90]
    return spark.createDataFrame([(f"d{k}", t, k) for k, t in enumerate(texts)], "document_id string, text string, k int")


def test_windows_equal_the_operator(spark, docs):
    got = spark.sql("SELECT document_id, k, window_index, window_start, window_end, text FROM text_windows(TABLE({d}), 40, 0.2, 10)", d=docs).collect()
    chapters = docs.where(F.length("text") > 0).select("document_id", F.concat("document_id", F.lit("_c")).alias("chapter_id"), F.lit(0).alias("chapter_index"), F.lit(0).alias("start_idx"), F.length("text").alias("end_idx"), F.length("text").alias("char_count"))
    other = segment.windows(chapters, docs, size=40, overlap=0.2, least=10, most=60).join(docs.select("document_id", "k"), "document_id")
    want = other.select("document_id", "k", "window_index", "window_start", "window_end", "text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 150


def test_tokens_of_a_key_equal_the_expression(spark, docs):
    pairs = docs.withColumn("half", F.expr("k div 2")).select("half", "text")
    got = spark.sql("SELECT half, token, tf, len FROM token_counts(TABLE({d}) PARTITION BY half)", d=pairs)
    each = pairs.select("half", F.explode(tx.tokens(F.col("text"))).alias("token"))
    want = each.groupBy("half", "token").agg(F.count(F.lit(1)).alias("tf")).join(each.groupBy("half").agg(F.count(F.lit(1)).alias("len")), "half")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("half", "token", "tf", "len").collect()))
    assert spark.sql("SELECT * FROM token_counts(TABLE({d}) PARTITION BY half)", d=pairs.limit(0)).count() == 0


class Moody:
    """Bad JSON first, a list of spans with a stray entry then; never an answer where the text says so."""

    def __init__(self):
        self.calls = 0

    def complete(self, messages):
        self.calls += 1
        text = messages[-1]["content"]
        if "never" in text or self.calls % 2:
            return "sorry", {}
        return "Here: " + json.dumps({"spans": [{"summary": text, "salience_score": "high"}, "stray", {"summary": 7, "salience_score": 1}]}) + " bye", {}


def test_extraction_tries_again_and_tells_errors(spark):
    spark.udtf.register("moody_spans", tables.extractor(Moody, lambda t: [{"role": "user", "content": t}], attempts=3))
    rows = spark.createDataFrame([(1, "x"), (2, "never"), (3, None)], "id int, text string").coalesce(1)
    got = {}
    for r in spark.sql("SELECT * FROM moody_spans(TABLE({d}))", d=rows).collect():
        got.setdefault(r["id"], []).append((r["span_index"], r["summary"], r["salience_score"], r["error"] is not None))
    assert got[1] == [(0, "x", None, False), (1, "7", 1.0, False)]
    assert got[2] == [(None, None, None, True)]
    assert got[3][0][:2] == (0, "")


def test_wrong_arguments_are_errors_before_anything_runs(spark, docs):
    for sql, told in (
        ("SELECT * FROM text_windows(TABLE({d}), 0, 0.2, 10)", "size above 0"),
        ("SELECT * FROM text_windows(TABLE(SELECT k FROM {d}), 40, 0.2, 10)", "a column named text"),
        ("SELECT * FROM text_windows(TABLE(SELECT text, k AS window_index FROM {d}), 40, 0.2, 10)", "columns that the table has: window_index"),
        ("SELECT * FROM token_counts('text')", "takes a table"),
    ):
        with pytest.raises(Exception, match=told):
            spark.sql(sql, d=docs).schema  # noqa: B018
