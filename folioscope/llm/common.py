"""Shared helpers: scratch tables in the cluster's shared folder, bounded caches, batches of whole texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import shared_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder; a lost executor re-reads them instead of recomputing their lineage."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/folioscope-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = self.paths[name] = f"{self.base}/{name}-{uuid.uuid4().hex[:6]}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")  # this job's shuffle files are of no use once its table stands
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def even_labels(spark: SparkSession, n: int) -> list[int]:
    """n numbers of which hashing over n partitions sends one to each: groups of like size, one a task."""
    found: dict[int, int] = {}
    at, step = 0, 12 * n + 100
    while len(found) < n:
        for r in spark.range(at, at + step).select(F.col("id").cast("int").alias("x"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).collect():
            found.setdefault(r["p"], r["x"])
        at += step
    return [found[k] for k in range(n)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_text(name: str) -> Column:
    """An id as text, so that a null among longs does not turn a batch's ids into floats."""
    return F.col(name).cast("string").alias(name)


def key_back(kind: T.DataType) -> Callable[[str | None], object]:
    """From key_text's form back to the id's own type."""
    if isinstance(kind, T.IntegralType):
        return lambda x: None if x is None else int(x)
    return lambda x: x


class Memo(dict):
    """A mapping filled on demand by fn and emptied when it holds `limit` entries: constant memory."""

    def __init__(self, fn: Callable, limit: int):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.fn(key)
        return value


def whole_texts(values: Iterable) -> Iterator[str]:
    """Null texts as empty ones; a lone surrogate, which UTF-8 cannot hold, as '?'."""
    for x in values:
        yield x if isinstance(x, str) else ""


def slices(pdf: pd.DataFrame, texts: pd.Series, most: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Parts of a batch with about `most` characters each, so that a step's memory follows text, not rows."""
    sizes = texts.str.len().fillna(0).cumsum()
    for _, part in pdf.groupby((sizes // most).to_numpy(), sort=True):
        yield part
