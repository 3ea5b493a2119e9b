"""Tables of the store: column names and types, empty tables, and rows brought into a table's form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The store's tables. Lists are arrays and times are timestamps here.
TABLES: dict[str, str] = {
    "documents": "document_id string, title string, author string, source_path string, normalized_path string, total_chars long, total_chapters long, content_hash string, created_at timestamp",
    "chapters": "chapter_id string, document_id string, chapter_index int, chapter_title string, start_idx int, end_idx int, char_count int",
    "candidate_windows": "window_id string, document_id string, chapter_id string, window_index int, window_start int, window_end int, text string, uncovered_text string",
    "spans": "span_id string, document_id string, chapter_id string, window_id string, span_index_in_window int, window_start int, window_end int, span_type string, summary string, entities array<string>, salience_score double, start_anchor_quote string, end_anchor_quote string, key_quote string, span_start_idx int, span_end_idx int, located_text string, locator_confidence double, locator_status string, created_at timestamp",
    "locator_candidates": "id long, span_id string, start_idx int, end_idx int, confidence double, strategy string",
    "extraction_failures": "id long, window_id string, span_id string, stage string, reason string, attempts int, raw_output string, created_at timestamp",
    "center_span_clusters": "cluster_id string, document_id string, center_span_id string, cluster_type string, cluster_name string, summary string, member_span_ids array<string>, confidence double",
    "span_edges": "edge_id string, document_id string, from_id string, to_id string, from_type string, to_type string, edge_type string, weight double",
    "embedding_cache": "cache_key string, provider string, model string, dimensions int, input_text string, vector array<double>, created_at timestamp",
    "reports": "run_id string, document_id string, kind string, report string, created_at timestamp",
}
DEFAULTS = {"uncovered_text": "", "locator_status": "failed", "locator_confidence": 0.0}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def stale(df: DataFrame, name: str) -> list[str]:
    """Columns of the table that df lacks or holds under another type."""
    have = {f.name: f.dataType for f in df.schema}
    return [f.name for f in schema(name) if have.get(f.name) != f.dataType]


def decoded(df: DataFrame, name: str) -> DataFrame:
    """df in the table's form: JSON lists become arrays, text becomes timestamps, absent columns their defaults.

    A list kept as `<column>_json` is read from there; unreadable lists are empty ones, unreadable times null.
    """
    out = []
    for f in schema(name):
        listed = f"{f.name}_json"
        if isinstance(f.dataType, T.ArrayType) and (listed in df.columns or dict(df.dtypes).get(f.name) == "string"):
            text = F.col(listed if listed in df.columns else f.name)
            value = F.coalesce(F.from_json(text, f.dataType.simpleString()), F.array().cast(f.dataType))
        elif f.name not in df.columns:
            value = F.lit(DEFAULTS.get(f.name)).cast(f.dataType)
        elif isinstance(f.dataType, T.TimestampType):
            value = F.try_to_timestamp(F.col(f.name).cast("string"))
        else:
            value = F.col(f.name).cast(f.dataType)
        out.append(value.alias(f.name))
    return df.select(*out)
