"""The corpus pipeline: five stages of the training-data operators over `documents`, each on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import langid, neardup, packing, quality, suffixes
from folioscope.llm.common import Scratch, table


#: Bytes of the repeated strings that go: a passage of over 50 words of prose has more.
PASSAGE = 240


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or lie far from the bulk of their language and source, go.

    Null and empty texts fail; repeated rows are judged alike; columns may have any name.
    """
    return quality.judged(docs).where("kept").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or unlike every language learned, go.

    Null and empty texts have no letters; without any labelled document all go; repeated rows are judged alike.
    """
    models = langid.train(docs, F.lit(True))
    return langid.identify(docs, models, carry=True).where(~F.col("rejected")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays.

    Texts without words stay; rows with one id are one document, of which one row stays; ids are integers or null.
    """
    return neardup.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of PASSAGE bytes that repeat are taken out of the texts; all documents stay.

    Characters that a cut runs through go with it. Null texts stay null, shorter ones whole; repeated rows lose their
    text; an empty table stays empty.
    """
    left = suffixes.deduplicated(docs, PASSAGE)
    text = F.when(F.col("row.text").isNotNull(), suffixes.as_text(F.col("raw")))
    own = {"text": text, "n_chars": F.length(text).cast("long")}
    return left.select(*(own.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens from at most 32 documents: one row a piece, with its token ids and place.

    Null and empty texts are their end id alone; repeated rows are packed as often as they stand.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), packing.Limits(documents=32))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("best_fit_packing", best_fit_packing),
]

#: Estimates, models and sketches are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage keeps is written and read again as the next one's documents."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
