"""Lines of text files with their numbers, and JSON lines whose errors tell file and line.

A file of many splits is read by many tasks, none of which knows how many lines lie before its own. A task's rows bear
consecutive ids in the order they are read, so a line's place in its split is its id less the least one of the split;
a first pass brings one row a split, the least id and the number of lines, and running sums of those over a file's
splits give each split its first line. Lines themselves are never shuffled for it, sorted or brought to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

CORRUPT = "__corrupt"


def _read(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    source = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    where = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")
    return source.text(path).select("value", *where, F.monotonically_increasing_id().alias("id"))


def numbered_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, line, value): all lines, empty ones too, numbered from 1 in each file.

    Files must not change between the two passes. Empty files have no lines; the table of splits is broadcast only
    where Spark finds it small.
    """
    splits = _read(spark, path, glob).groupBy("file", "split").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    first = splits.select("file", "split", "least", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.col("before") + F.col("id") - F.col("least") + 1
    return _read(spark, path, glob).join(first, ["file", "split"]).select("file", number.alias("line"), "value")


def place(kind: str) -> Column:
    """`kind`, file, line and the beginning of a line, as errors tell them."""
    return F.concat(F.lit(f"{kind}: "), F.regexp_extract("file", r"([^/]*)$", 1), F.lit(":"), F.col("line").cast("string"), F.lit(": "), F.left("value", F.lit(80)))


def read_json_lines(spark: SparkSession, path: str, schema: str | StructType, required: tuple[str, ...] = (), glob: str | None = None) -> DataFrame:
    """(file, line, and the schema's columns) of JSON lines, blank lines aside.

    A line that is no JSON object of this schema, or lacks a required field, is an error that tells where it stands,
    raised when any column of the schema is read (a bare count reads none).
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kept = numbered_lines(spark, path, glob).where(F.trim("value") != "")
    strict = StructType(list(schema.fields)).add(CORRUPT, StringType())
    parsed = kept.withColumn("row", F.from_json("value", strict, {"columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col("row").isNull() | F.col(f"row.{CORRUPT}").isNotNull() | ~F.trim("value").startswith("{")
    for name in required:
        bad = bad | F.col("row")[name].isNull()
    checked = parsed.withColumn("row", F.when(bad, F.raise_error(place("bad line")).cast(strict)).otherwise(F.col("row")))
    return checked.select("file", "line", *(F.col("row")[f.name].alias(f.name) for f in schema.fields))
