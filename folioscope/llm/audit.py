"""Interaction audit of document filters: what each removes alone, after others, and over all orders of application.

Words are exploded and aggregated twice, by (document, word) and by document, which gives totals and distinct words;
texts are dealt out by document before, so that both aggregations need no further shuffle. The other flags join by
outer joins. A document's flags are the bits of a mask, and one aggregation counts every mask with conditional columns:
2^n of them for n filters, each for all documents, for those labelled good and for those labelled toxic. Every order
and step is then arithmetic on a row of counts a part.

Documents are rows: rows that repeat an id are counted each, and share the labels of their id. Null texts are empty
ones, a null language is the part ''. A null id has no labels, is no repeat, and makes none of others. Of several
label rows of an id any one that says so counts. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space between words, symbols of filter D.
SPACE, SYMBOLS = "[\\x20\\x09-\\x0D]+", "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Replicas of the table of repeated texts, over which the copies of one text are dealt.
SALTS = 32


def word_counts(keyed: DataFrame) -> DataFrame:
    """(doc_id, tag, n_words, n_distinct) of keyed (doc_id, tag, text), for texts that have words.

    The split leaves an empty part before a leading space and behind a trailing one; they are no words, but the one
    that is put before every text counts its rows, by which the totals of repeated rows are divided.
    """
    parts = keyed.select("doc_id", "tag", F.explode(F.concat(F.array(F.lit(" ")), F.split("text", SPACE))).alias("word"))
    each = parts.groupBy("doc_id", "tag", "word").agg(F.count(F.lit(1)).alias("n"))
    real, rows = ~F.col("word").isin("", " "), F.max(F.when(F.col("word") == " ", F.col("n")))
    sums = each.groupBy("doc_id", "tag").agg(rows.alias("rows"), F.sum(F.when(real, F.col("n"))).alias("total"), F.count(F.when(real, 1)).alias("n_distinct"))
    return sums.where("n_distinct > 0").select("doc_id", "tag", F.expr("total div rows").alias("n_words"), "n_distinct")


def repeats(rows: DataFrame) -> DataFrame:
    """rows (doc_id, digest, ...) with `repeat`: a smaller id holds the same text. Copies of one text are dealt over SALTS."""
    least = rows.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id")
    dealt = least.select("digest", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(dealt, ["digest", "salt"], "left")
    return met.withColumn("repeat", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))).drop("digest", "salt", "first_id")


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, A, B, C, D, E) of each row of docs (doc_id, text, lang) with labels (doc_id, quality, toxic).

    A: under 200 words; B: under half of the words distinct; C: capitals over 3 in 100 code points; D: a symbol;
    E: the text of a smaller id.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("tag"), text.alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
    counted = word_counts(keyed.select("doc_id", "tag", "text").repartition("doc_id", "tag"))
    capitals = F.length("text") - F.length(F.translate("text", CAPITALS, ""))
    own = keyed.select("doc_id", "tag", "part", (100 * capitals > 3 * F.length("text")).alias("C"), F.rlike("text", F.lit(SYMBOLS)).alias("D"), F.unhex(F.sha2("text", 256)).alias("digest"))
    own = repeats(own).withColumnRenamed("repeat", "E")
    says = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    met = own.join(says, "doc_id", "left").alias("o").join(counted.alias("c"), F.expr("o.doc_id <=> c.doc_id AND o.tag = c.tag"), "left")
    words, distinct = F.coalesce("c.n_words", F.lit(0)), F.coalesce("c.n_distinct", F.lit(0))
    no = F.lit(False)
    return met.select("part", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), (words < 200).alias("A"), (100 * distinct < 50 * words).alias("B"), "C", "D", "E")


def mask_counts(flags: DataFrame, filters: Sequence[str]) -> DataFrame:
    """(part, mask, n, good, toxic): one row for each of the 2^n masks of failed filters, zeros included."""
    mask = sum((F.when(F.col(f), 1 << k).otherwise(0) for k, f in enumerate(filters)), F.lit(0))
    masks = range(1 << len(filters))
    kinds = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    sums = [F.count_if((F.col("mask") == m) & cond).alias(f"{kind}_{m}") for kind, cond in kinds.items() for m in masks]
    counted = flags.select("part", "good", "toxic", mask.alias("mask")).groupBy("part").agg(*sums)
    rows = F.array(*(F.struct(F.lit(m).alias("mask"), *(F.col(f"{kind}_{m}").alias(kind) for kind in kinds)) for m in masks))
    return counted.select("part", F.inline(rows))


def interactions(counts: DataFrame, filters: Sequence[str]) -> DataFrame:
    """One row a part, order of the filters and step, from the counts of masks.

    Columns: kept, removed, redundant, unique_fails, good_lost, toxic_lost, and shapley: what the step's filter
    removes, summed over all orders.
    """
    steps = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, k in enumerate(order, 1):
            steps.append(f"struct('{''.join(filters[i] for i in order)}' AS filter_order, {step} AS step, {1 << k} AS own, {before} AS before)")
            before |= 1 << k
    met = counts.withColumn("s", F.explode(F.expr(f"array({', '.join(steps)})"))).select("part", "mask", "n", "good", "toxic", "s.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda cond, of="n": F.sum(F.when(cond, F.col(of)).otherwise(0))
    found = met.groupBy("part", "filter_order", "step", "own").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"), total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    over = Window.partitionBy("part", "own")
    return found.withColumn("shapley", F.sum("removed").over(over)).drop("own")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over docs (doc_id, text, lang); other columns are ignored, whatever their names."""
    flags = flagged(docs.select("doc_id", "text", "lang"), labels.select("doc_id", "quality", "toxic"))
    return interactions(mask_counts(flags, "ABCDE"), "ABCDE")
