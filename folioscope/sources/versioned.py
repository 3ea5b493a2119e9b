"""Versioned tables in a folder that all executors share: snapshots, swapped by one atomic rename of a manifest.

A table's rows lie in parts (`data/snap=<id>/part=<n>`); a manifest (`manifests/<version>.json`) names the folders of
each part, the schema with its version, the seeds applied and further properties. A write puts new folders beside the
old ones and then renames its manifest into place; until then, and if it fails, readers see the version before. Two
writers that began at one version want the same name: the later one sees a Conflict and starts again from the new
version. Nothing is changed in place, so a reader keeps its snapshot until `vacuum` takes it.

Parts are buckets of `bucket_by` (columns of the key), or an integer column of the rows. An operation rewrites the
parts it touches and carries the other ones over by name, so its cost follows them and not the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store

Migration = Callable[[DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was about to write."""


@dataclass(frozen=True)
class Snapshot:
    version: int
    schema_version: int
    schema: T.StructType
    parts: dict[int, list[str]] = field(default_factory=dict)
    seeds: tuple[str, ...] = ()
    properties: dict = field(default_factory=dict)
    operation: str = "create"

    def to_json(self) -> str:
        held = {k: v for k, v in self.__dict__.items() if k not in ("schema", "parts")}
        return json.dumps(held | {"schema": self.schema.jsonValue(), "parts": {str(k): v for k, v in sorted(self.parts.items())}}, indent=1)

    @classmethod
    def from_json(cls, text: str) -> Snapshot:
        held = json.loads(text)
        held |= {"schema": T.StructType.fromJson(held["schema"]), "parts": {int(k): v for k, v in held["parts"].items()}, "seeds": tuple(held["seeds"])}
        return cls(**held)


class Folder:
    """The file operations a table needs, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf, self.path = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path
        self.gateway = spark.sparkContext._gateway
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        path = self._path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> None:
        """The whole file under a name that must be free: written aside and renamed."""
        aside = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self._path(aside), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(self.fs.makeQualified(self._path(aside)), self.fs.makeQualified(self._path(name)), options)
        except Py4JJavaError as error:
            self.delete(aside)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise Conflict(name) from error
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class VersionedTable:
    """A table of rows with a key; `migrations[k]` takes rows of schema version k to version k + 1."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], bucket_by: Sequence[str] | None = None, buckets: int = 16, part: str | None = None, migrations: Sequence[Migration] = ()):
        self.spark, self.path, self.keys, self.buckets, self.part = spark, path.rstrip("/"), list(keys), buckets, part
        self.bucket_by, self.migrations = list(bucket_by or keys), list(migrations)
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        if not set(self.bucket_by) <= set(self.keys):
            raise ValueError("buckets are of columns of the key")
        self.folder = Folder(spark, self.path)

    # --- snapshots ---

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.folder.names("manifests") if n.endswith(".json")]

    def snapshot(self, version: int | None = None) -> Snapshot:
        found = self.versions()
        if version is None and not found:
            raise FileNotFoundError(f"no table at {self.path}")
        return Snapshot.from_json(self.folder.read(f"manifests/{found[-1] if version is None else version:012d}.json"))

    def create(self, properties: dict | None = None) -> bool:
        """An empty first version; False if there is a table."""
        if self.versions():
            return False
        try:
            self._put(Snapshot(0, len(self.migrations), self.schema, properties=properties or {}))
        except Conflict:
            return False
        return True

    def read(self, version: int | None = None, parts: Sequence[int] | None = None, of: Snapshot | None = None) -> DataFrame:
        """Rows of a snapshot, the last one by default, brought to the present schema; of some parts only, if given."""
        at = of or self.snapshot(version)
        folders = [f"{self.path}/data/{f}" for k, fs in at.parts.items() if parts is None or k in parts for f in fs]
        if not folders:
            rows = self.spark.createDataFrame([], at.schema)
        else:
            inside = T.StructType([*(f for f in at.schema if f.name != self.part), T.StructField("part", T.IntegerType())])
            rows = self.spark.read.schema(inside).option("basePath", f"{self.path}/data").parquet(*folders)
            if parts is not None:
                rows = rows.where(F.col("part").isin(*parts))
            rows = rows.select(*(F.col("part").alias(f.name) if f.name == self.part else F.col(f.name) for f in at.schema))
        for step in self.migrations[at.schema_version :]:
            rows = step(rows)
        return rows.select(*self.schema.names) if at.schema_version < len(self.migrations) else rows

    # --- writes ---

    def overwrite(self, rows: DataFrame, **properties) -> Snapshot:
        return self._commit("overwrite", lambda at: (self._stage(rows), at.properties | properties))

    def append(self, rows: DataFrame, **properties) -> Snapshot:
        """rows beside those held, as further folders of their parts."""

        def change(at: Snapshot):
            new = self._stage(rows)
            held = self._current(at)
            return {k: held.get(k, []) + new.get(k, []) for k in {*held, *new}}, at.properties | properties

        return self._commit("append", change)

    def upsert(self, rows: DataFrame, keep: tuple[str, ...] = ("created_at",)) -> Snapshot:
        """rows over those of the same key; columns in `keep` stay as they were first written."""
        return self._rewrite("upsert", lambda: self.parts_of(rows), lambda old: store.upsert(old, rows, self.keys, keep))

    def delete(self, gone: DataFrame, on: Sequence[str] | None = None) -> Snapshot:
        """Rows whose columns `on` (the key by default) are in `gone` leave; without the bucket's columns all parts are read."""
        on = list(on or self.keys)
        narrow = self.part is None and set(self.bucket_by) <= set(on)
        return self._rewrite("delete", (lambda: self.parts_of(gone)) if narrow else None, lambda old: store.without(old, gone, on))

    def replace(self, rows: DataFrame, scope: Sequence[str], scopes: DataFrame | None = None) -> Snapshot:
        """All rows of the scopes that `rows` (or `scopes`, for those that are to be empty) names give way to `rows`."""
        named = (rows if scopes is None else scopes).select(*scope).distinct()
        narrow = self.part is None and set(self.bucket_by) <= set(scope)
        return self._rewrite("replace", (lambda: self.parts_of(named)) if narrow else None, lambda old: store.without(old, named, list(scope)).unionByName(rows))

    def update_column(self, values: DataFrame, column: str, on: Sequence[str] | None = None) -> Snapshot:
        on = list(on or self.keys)
        narrow = self.part is None and set(self.bucket_by) <= set(on)
        return self._rewrite("update", (lambda: self.parts_of(values)) if narrow else None, lambda old: store.update_column(old, values, on, column))

    def seed(self, name: str, rows: DataFrame) -> bool:
        """Upsert rows once under a name; a second call, or one of another writer, changes nothing."""
        if name in self.snapshot().seeds:
            return False
        self._rewrite("seed", lambda: self.parts_of(rows), lambda old: store.upsert(old, rows, self.keys, ()), seed=name)
        return True

    def migrate(self) -> bool:
        """Write the table in its present schema; readers of an older one are served by the steps until then."""
        if self.snapshot().schema_version == len(self.migrations):
            return False
        self._rewrite("migrate", None, lambda old: old)
        return True

    def append_to(self, base: Snapshot, rows: DataFrame, **properties) -> Snapshot:
        """`rows` beside those of `base`; a Conflict if another version has come since."""
        staged = self._stage(rows)
        parts = {k: base.parts.get(k, []) + staged.get(k, []) for k in {*base.parts, *staged}}
        return self._put(replace(base, version=base.version + 1, parts=parts, properties=base.properties | properties, operation="append"))

    def replace_parts(self, parts: Sequence[int], rows: DataFrame, base: Snapshot, **properties) -> Snapshot:
        """`rows` in place of whole parts of `base`; a Conflict if another version has come since."""
        staged = self._stage(rows)
        return self._put(replace(base, version=base.version + 1, parts={k: v for k, v in base.parts.items() if k not in parts} | staged, properties=base.properties | properties, operation="replace_parts"))

    def vacuum(self, keep: int = 1) -> None:
        """Forget all but the last `keep` versions, and delete the folders that none of those names."""
        versions = self.versions()
        kept = versions[-keep:]
        named = {f.split("/")[0] for v in kept for fs in self.snapshot(v).parts.values() for f in fs}
        for v in versions[:-keep]:
            self.folder.delete(f"manifests/{v:012d}.json")
        for snap in self.folder.names("data"):
            if snap not in named:
                self.folder.delete(f"data/{snap}")

    # --- helpers ---

    def part_column(self) -> Column:
        return F.col(self.part) if self.part else F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def parts_of(self, rows: DataFrame) -> list[int]:
        """The parts that rows fall into: at most as many numbers as the table has parts."""
        return [r["part"] for r in rows.select(self.part_column().alias("part")).distinct().collect()]

    def _stage(self, rows: DataFrame) -> dict[int, list[str]]:
        snap = f"snap={uuid.uuid4().hex}"
        dealt = rows.select(*self.schema.names).withColumn("part", self.part_column())
        dealt = dealt.drop(self.part) if self.part else dealt
        dealt.hint("rebalance", "part").write.option("compression", "zstd").partitionBy("part").parquet(f"{self.path}/data/{snap}")
        return {int(n[5:]): [f"{snap}/{n}"] for n in self.folder.names(f"data/{snap}") if n.startswith("part=")}

    def _current(self, at: Snapshot) -> dict[int, list[str]]:
        """The parts of a snapshot in the present schema."""
        return at.parts if at.schema_version == len(self.migrations) else self._stage(self.read(of=at))

    def _rewrite(self, operation: str, touched: Callable[[], list[int]] | None, change: Callable[[DataFrame], DataFrame], seed: str | None = None) -> Snapshot:
        def whole(at: Snapshot):
            behind = at.schema_version < len(self.migrations)  # then all parts are written in the present schema
            parts = None if touched is None or behind else touched()
            new = self._stage(change(self.read(of=at, parts=parts)))
            return {k: v for k, v in at.parts.items() if parts is not None and k not in parts} | new, at.properties

        return self._commit(operation, whole, seed)

    def _commit(self, operation: str, change: Callable, seed: str | None = None, attempts: int = 5) -> Snapshot:
        for attempt in range(attempts):
            at = self.snapshot()
            if seed and seed in at.seeds:
                return at
            parts, properties = change(at)
            new = Snapshot(at.version + 1, len(self.migrations), self.schema, parts, (*at.seeds, *([seed] if seed else [])), properties, operation)
            try:
                return self._put(new)
            except Conflict:
                if attempt == attempts - 1:
                    raise
        raise AssertionError

    def _put(self, snapshot: Snapshot) -> Snapshot:
        self.folder.put_new(f"manifests/{snapshot.version:012d}.json", snapshot.to_json())
        return snapshot
