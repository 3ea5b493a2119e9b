"""Hubs that hold a third of all spans, files of batch requests, window selection, predictions."""

import json

import pytest
from pyspark.sql import functions as F

from folioscope.operators import extraction, hubs
from folioscope.sources import files


def spans_of(spark, n=300):
    rows = [(f"d{k % 2}", f"s{k:03d}", f"d{k % 2}_c{k // 50}", f"w{k // 10}", k * 10 // 2, ["common", f"e{k % 7}", "common", None] if k % 3 == 0 else [f"e{k % 7}"], "mixed" if k % 5 else None) for k in range(n)]
    return spark.createDataFrame(rows, "document_id string, span_id string, chapter_id string, window_id string, span_start_idx int, entities array<string>, span_type string")


def test_a_hub_of_a_third_of_all_spans_is_many_blocks(spark):
    edges = hubs.hub_edges(spans_of(spark), 8)
    common = edges.where("hub_id = 'entity::common' AND document_id = 'd0'")
    sizes = [r["n"] for r in common.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 50 and len(sizes) >= 6 and max(sizes) < 20
    assert edges.where("span_id = 's000'").count() == 2  # an entity named twice is one edge; no type, no edge


def test_expansion_does_not_depend_on_blocks(spark):
    spans = spans_of(spark)
    seeds = spark.createDataFrame([("q", "d0", "s000", 1.0), ("q", "d0", "s006", 0.5), ("r", "d1", "s003", 2.0)], "query_id string, document_id string, span_id string, weight double")
    got = [sorted(map(tuple, hubs.expand(seeds, hubs.hub_edges(spans, b), 6).collect())) for b in (4, 10_000)]
    assert got[0] == got[1] and len(got[0]) == 12
    assert not {r[2] for r in got[0]} & {"s000", "s006"} - {"s003"}


def test_structure_edges(spark):
    spans = spans_of(spark, 120)
    chapters = spans.select("document_id", "chapter_id").distinct().withColumn("chapter_index", F.substring_index("chapter_id", "c", -1).cast("int"))
    windows = spans.select("document_id", "chapter_id", "window_id").distinct().withColumn("window_index", F.substring("window_id", 2, 9).cast("int"))
    edges = hubs.structure_edges(spans, windows, chapters).collect()
    by = {}
    for r in edges:
        by.setdefault(r["edge_type"], []).append((r["from_id"], r["to_id"]))
    for d in (0, 1):
        ordered = sorted((r["span_start_idx"], r["span_id"]) for r in spans.where(F.col("document_id") == f"d{d}").collect())
        assert {(a[1], b[1]) for a, b in zip(ordered, ordered[1:])} <= set(by["NEXT_SPAN_IN_TEXT"])
    assert len(by["NEXT_SPAN_IN_TEXT"]) == 118 and len(by["IN_CHAPTER"]) == len(by["IN_WINDOW"]) == 120
    assert sorted(by["NEXT_CHAPTER"]) == [(f"d{d}_c{k}", f"d{d}_c{k + 1}") for d in (0, 1) for k in (0, 1)]


def test_batch_files_hold_no_more_than_their_cap(spark, tmp_path):
    requests = spark.range(2503).select(F.format_string("w%05d", "id").alias("custom_id"), F.to_json(F.struct(F.col("id").alias("n"))).alias("line")).repartition(7)
    got = extraction.write_batch_files(requests, str(tmp_path / "batch"), 500)
    assert sorted((r["file"], r["lines"]) for r in got.collect()) == [(k, 500) for k in range(5)] + [(5, 3)]
    parts = [[json.loads(x)["n"] for f in d.glob("*.txt") for x in f.read_text().splitlines()] for d in sorted((tmp_path / "batch").glob("file=*"))]
    assert sorted(x for p in parts for x in p) == list(range(2503)) and all(len(list(d.glob("*.txt"))) == 1 for d in (tmp_path / "batch").glob("file=*"))


def test_unknown_windows_are_errors(spark):
    windows = spark.createDataFrame([("d", f"w{k}", 1, k) for k in range(4)], "document_id string, window_id string, chapter_index int, window_index int")
    with pytest.raises(ValueError, match="windows not found: w9, x"):
        extraction.select_windows(windows, ["w1,w9", "x"])
    with pytest.raises(ValueError, match="reaches 6, but there are 4"):
        extraction.select_windows(windows, ranges=["2-6"])
    assert extraction.select_windows(windows, ["w1"], ["3-4"]).count() == 3


def test_predictions_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("q1", 0.5), ("q2", 1.0)], "question_id string, recall double")
    files.write_jsonl(rows, str(tmp_path / "p"))
    assert sorted(map(tuple, files.read_predictions(spark, str(tmp_path / "p"), "question_id string, recall double").collect())) == [("q1", 0.5), ("q2", 1.0)]
    (tmp_path / "none.jsonl").write_text("\n \n")
    with pytest.raises(ValueError):
        files.read_predictions(spark, str(tmp_path / "none.jsonl"))


def test_spans_on_the_same_hubs_are_scored_once(spark):
    # 3,000 spans on three sets of hubs; hubs in blocks of 3 spans were 333 rows a question and hub before
    rows = [("d", f"s{k:04d}", [f"e{k % 3}"], "mixed") for k in range(3000)]
    spans = spark.createDataFrame(rows, "document_id string, span_id string, entities array<string>, span_type string")
    seeds = spark.createDataFrame([("q", "d", "s0000", 1.0), ("q", "d", "s0003", 1.0), ("r", "d", "s0001", 2.0)], "query_id string, document_id string, span_id string, weight double")
    found = hubs.expand(seeds, hubs.hub_edges(spans, 3), 4)
    got = {q: [r["span_id"] for r in sorted(found.collect(), key=lambda r: r["rank"]) if r["query_id"] == q] for q in ("q", "r")}
    assert got == {"q": ["s0006", "s0009", "s0012", "s0015"], "r": ["s0004", "s0007", "s0010", "s0013"]}
    written = [f for f in spark.read.parquet(*{f.rsplit("/", 1)[0] for f in found.inputFiles() if "-classes-" in f}).collect()]
    assert len(written) == 6  # three heads, each on two hubs
