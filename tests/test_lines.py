"""Line numbers in files of many splits, and errors that tell file and line."""

import json

import pytest
from pyspark.sql import functions as F

from folioscope.sources import files, lines


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_numbers_in_files_of_many_splits(spark, tmp_path, small_splits):
    want = set()
    for name, n in (("a.txt", 3000), ("b c.txt", 7), ("long.txt", 40), ("none.txt", 0)):
        rows = ["" if k % 5 == 3 else f"{name} {k} " + "é" * (k % 11 if name != "long.txt" else 3000 * (k % 3 == 0)) for k in range(n)]
        (tmp_path / name).write_text("".join(r + "\n" for r in rows), encoding="utf-8")
        want |= {(name, k + 1, r) for k, r in enumerate(rows)}
    (tmp_path / "open.txt").write_text("one\r\n\r\nlast without an end")
    want |= {("open.txt", 1, "one"), ("open.txt", 2, ""), ("open.txt", 3, "last without an end")}
    found = lines.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = [(r["file"].rsplit("/", 1)[1].replace("%20", " "), r["line"], r["value"]) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    assert lines.numbered_lines(spark, str(tmp_path), "b*.txt").count() == 7


def test_an_error_tells_the_right_line(spark, tmp_path, small_splits):
    good = [json.dumps({"id": k, "name": "n" * (k % 50)}) for k in range(2000)]
    schema = "id long, name string"
    path = tmp_path / "rows.jsonl"
    path.write_text("\n".join(["", *good, "  "]))
    rows = lines.read_json_lines(spark, str(path), schema, ("id",))
    assert rows.agg(F.sum("id"), F.max("line"), F.count("id")).first()[:] == (1999 * 1000, 2001, 2000)
    for broken, at in (('{"id": 1, "name"', 1500), ('{"name": "no id"}', 3), ("[1, 2]", 1999), ('{"id": "x"}', 1000), ("17", 77)):
        path.write_text("\n".join([*good[: at - 1], broken, *good[at:]]))
        with pytest.raises(Exception, match=rf"bad line: rows\.jsonl:{at}: "):
            lines.read_json_lines(spark, str(path), schema, ("id",)).collect()


def test_a_bad_question_is_told_by_its_line(spark, tmp_path):
    one = lambda k: json.dumps({"question_id": f"q{k}", "query": "?", "expected_chapters": [{"chapter_id": "c1", "weight": 1.0}]})
    (tmp_path / "set.jsonl").write_text("\n".join([one(1), "", one(2), json.dumps({"question_id": "q3", "expected_chapters": []}), one(4)]))
    with pytest.raises(Exception, match=r"bad question line: set\.jsonl:4: "):
        files.read_questions(spark, str(tmp_path / "set.jsonl")).collect()
