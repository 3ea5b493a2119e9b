"""Tables written to the folder that all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master without it, a local folder made once; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that they share")
        found = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_open: list[list[tuple[SparkSession, str]]] = []


def delete(spark: SparkSession, path: str, on_exit: bool = False) -> None:
    """Delete a folder now, or when the driver ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(where) if on_exit else files.delete(where, True)


@contextmanager
def scope() -> Iterator[None]:
    """Tables settled inside are deleted at the end; what is still wanted of them must be written by then."""
    _open.append([])
    try:
        yield
    finally:
        for spark, path in _open.pop():
            delete(spark, path)


def fresh(spark: SparkSession, name: str) -> str:
    """A folder's name that nothing has yet; it goes with the innermost open scope, else when the driver ends."""
    path = f"{shared_dir(spark)}/folioscope-{name}-{uuid.uuid4().hex}"
    delete(spark, path, on_exit=True)
    if _open:
        _open[-1].append((spark, path))
    return path


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a stored table: what several branches read is computed once, and a lost executor costs no lineage."""
    path = fresh(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
