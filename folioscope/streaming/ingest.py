"""Documents as a stream: new files become normalised documents, chapters and windows as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import document_id, normalize_text
from ..operators import segment


def documents(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(document_id, text, path, arrived) of whole UTF-8 files that appear under `path`."""
    raw = spark.readStream.option("pathGlobFilter", glob).text(path, wholetext=True)
    text = normalize_text(F.col("value"))
    return raw.select(text.alias("text"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("arrived")).withColumn("document_id", document_id(F.col("text")))


def write_windows(stream: DataFrame, out: str, checkpoint: str, **settings) -> StreamingQuery:
    """Each batch's chapters and windows, appended under `out`; a document seen again replaces itself."""

    def batch(docs: DataFrame, _: int) -> None:
        docs = docs.dropDuplicates(["document_id"]).persist()
        chapters = segment.chapters(docs)
        for name, rows in (("chapters", chapters), ("windows", segment.windows(chapters, docs, **settings))):
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id").parquet(f"{out}/{name}")
        docs.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of runs of events at most `gap` apart: the merging of intervals, over time."""
    by = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key)
    return by.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


