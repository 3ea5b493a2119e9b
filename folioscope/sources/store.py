"""Tables as the store: keyed reads, upserts, cascades, counts. State is parquet; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files are fewer than they are; a table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def table_counts(spark: SparkSession, tables: dict[str, DataFrame | None]) -> DataFrame:
    """(name, n) of each table, 0 for one that is absent."""
    out = None
    for name, df in tables.items():
        row = spark.range(1).select(F.lit(name).alias("name"), F.lit(0).cast("long").alias("n")) if df is None else df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def latest_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in `order`."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """new over old by key; columns in `keep` stay as they were first written."""
    kept = [c for c in keep if c in old.columns and c in new.columns]
    first = old.select(*keys, *(F.col(c).alias(f"__{c}") for c in kept))
    merged = new.join(first, keys, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in kept}).drop(*(f"__{c}" for c in kept))
    return without(old, new, keys).unionByName(merged)


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose key is not in `gone`: what a cascade leaves of a dependent table."""
    return rows.join(gone.select(*keys), keys, "left_anti")


def cascade(tables: dict[str, DataFrame], gone: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    return {name: without(df, gone, keys) for name, df in tables.items()}


def update_column(rows: DataFrame, values: DataFrame, keys: list[str], column: str) -> DataFrame:
    new = values.select(*keys, F.col(column).alias("__new"))
    return rows.join(new, keys, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def by_ids(rows: DataFrame, wanted: DataFrame, key: str, position: str) -> DataFrame:
    """rows of the wanted ids with the position at which each was first asked for; absent ids are left out."""
    first = wanted.groupBy(key).agg(F.min(position).alias(position))
    return rows.join(first, key)


def like_search(rows: DataFrame, words: str, columns: list[str]) -> DataFrame:
    """rows one of whose columns holds `words`, letter case aside."""
    wanted, hit = words.lower(), F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c)), F.lit(wanted))
    return rows.where(hit)


def write_by_document(rows: DataFrame, path: str) -> None:
    """Overwrite only the documents that `rows` holds."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id").parquet(path)


def checked_texts(docs: DataFrame) -> DataFrame:
    """docs, failing where a text's length is not the recorded one."""
    return docs.withColumn("text", F.when(F.assert_true(F.length("text") == F.col("total_chars"), F.concat(F.lit("length changed: "), F.col("document_id"))).isNull(), F.col("text")))
