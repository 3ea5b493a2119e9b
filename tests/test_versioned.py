"""The versioned store: crashes, pinned readers, two writers, seeds, migrations, scopes and clean-up."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from folioscope.sources.versioned import Conflict, VersionedTable

FORM = "document_id string, span_id string, value int, created_at int"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), FORM)


def held(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def spans(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "spans"), FORM, ["document_id", "span_id"], ["document_id"], 4)
    assert table.create() and not table.create()
    table.upsert(frame(spark, *((f"d{k % 5}", f"s{k}", k, 1) for k in range(20))))
    return table


def test_upsert_keeps_first_times_and_other_parts(spark, spans):
    before = spans.snapshot()
    spans.upsert(frame(spark, ("d0", "s0", 100, 9), ("d0", "s99", 99, 9)))
    after = spans.snapshot()
    rows = {r[1]: r for r in held(spans.read())}
    assert rows["s0"] == ("d0", "s0", 100, 1) and rows["s99"] == ("d0", "s99", 99, 9) and len(rows) == 21
    assert sum(before.parts[k] != after.parts[k] for k in before.parts) == 1  # the other parts are carried over by name
    assert len(held(spans.read(before.version))) == 20


def test_a_failing_write_leaves_the_snapshot(spark, spans):
    before, want = spans.snapshot(), held(spans.read())
    broken = frame(spark, ("d1", "s1", 5, 5)).withColumn("value", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(PySparkException):
        spans.upsert(broken)
    assert spans.snapshot() == before and held(spans.read()) == want
    spans.vacuum()
    assert held(spans.read()) == want


def test_readers_keep_their_snapshot(spark, spans):
    reader, want = spans.read(), held(spans.read())
    spans.delete(frame(spark, ("d1", "", 0, 0)).select("document_id"), ["document_id"])
    spans.replace(frame(spark, ("d2", "new", 1, 1)), ["document_id"])
    assert held(reader) == want
    assert {r[1] for r in held(spans.read()) if r[0] in ("d1", "d2")} == {"new"}
    spans.replace(frame(spark), ["document_id"], frame(spark, ("d3", "", 0, 0)))
    assert not [r for r in held(spans.read()) if r[0] == "d3"]


def test_two_writers(spark, spans, monkeypatch):
    """The later of two writers of one version starts again on what the earlier one wrote; a fixed base is an error."""
    other = VersionedTable(spark, spans.path, FORM, spans.keys, spans.bucket_by, 4)
    stage, calls = spans._stage, []

    def slow(rows):
        out = stage(rows)
        if not calls:
            other.upsert(frame(spark, ("d0", "other", 1, 1)))
        calls.append(1)
        return out

    monkeypatch.setattr(spans, "_stage", slow)
    spans.upsert(frame(spark, ("d0", "mine", 2, 2)))
    assert len(calls) == 2 and {"mine", "other"} <= {r[1] for r in held(spans.read())}
    old = spans.snapshot(1)
    with pytest.raises(Conflict):
        other.replace_parts([0], frame(spark), old)


def test_seeds_and_updates(spark, spans):
    assert spans.seed("first", frame(spark, ("d9", "seed", 1, 1)))
    at = spans.snapshot()
    assert not spans.seed("first", frame(spark, ("d9", "seed", 2, 2))) and spans.snapshot() == at
    spans.update_column(frame(spark, ("d9", "seed", 7, 0)).select("document_id", "span_id", "value"), "value")
    assert ("d9", "seed", 7, 1) in held(spans.read())


def test_migrations(spark, spans):
    """An older schema is read through the steps; the first write, or migrate, stores the new one."""
    steps = [lambda rows: rows.withColumn("score", F.col("value") * 2), lambda rows: rows.withColumnRenamed("score", "twice").drop("value")]
    form = "document_id string, span_id string, created_at int, twice int"
    new = VersionedTable(spark, spans.path, form, spans.keys, spans.bucket_by, 4, migrations=steps)
    assert new.snapshot().schema_version == 0 and new.read().columns == ["document_id", "span_id", "created_at", "twice"]
    want = held(new.read())
    assert new.migrate() and not new.migrate()
    assert new.snapshot().schema_version == 2 and held(new.read()) == want and len(held(spans.read(1))) == 20
    new.append(spark.createDataFrame([("d0", "more", 1, 4)], form))
    assert len(held(new.read())) == 21


def test_vacuum_and_missing_table(spark, spans, tmp_path):
    for k in range(3):
        spans.upsert(frame(spark, ("d0", "s0", k, 1)))
    want = held(spans.read())
    spans.vacuum(2)
    assert spans.versions() == [3, 4] and held(spans.read()) == want and len(held(spans.read(3))) == 20
    assert len(spans.folder.names("data")) == 3
    with pytest.raises(FileNotFoundError):
        VersionedTable(spark, str(tmp_path / "none"), FORM, ["span_id"]).read()
    with pytest.raises(ValueError):
        VersionedTable(spark, str(tmp_path / "none"), FORM, ["span_id"], ["document_id"])
