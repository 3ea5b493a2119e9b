"""The op queries: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import align, ann, audit, bpe, chat, langid, lm, neardup, packing, quality, suffixes, topk, urls
from .common import table


class ChatDigest:
    """Folds a conversation's assembled turns, read back from their ids, into the contract's figures."""

    SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def __init__(self, conv_id):
        self.conv_id, self.n, self.loss_chars, self.formatted = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def add(self, row) -> None:
        ids, mask = row.ids.tolist(), row.loss_mask.tolist()
        role, text = chat.disassemble(ids, self.path)
        self.turns.update(f"{role}\n{text}\n".encode())
        trained = chat.masked_text(ids, mask, self.path)
        self.loss.update(trained.encode())
        self.n += 1
        self.loss_chars += len(trained)
        self.formatted += len(row.rendered)

    def result(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted


#: Bytes that a passage of over 50 words has at least; op1 counts them beside the strings of 400 that it removes.
PASSAGE = 240


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), report=(PASSAGE,))
    size = F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long")
    return left.select(F.col("row.doc_id").alias("doc_id"), size.alias("n_bytes"), (size - F.octet_length("raw")).alias("n_removed"), "n_spans", F.sha2("raw", 256).alias("kept_sha256"), F.col("covered")[0].alias("n_passage"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def held_out(modulus: int):
    """Documents kept from training: crc32 of the id as text leaves 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 2, F.lit(False))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    models = langid.train(docs, ~held_out(4))
    found = langid.identify(docs, models)
    return found.select("doc_id", held_out(4).alias("held_out"), "lang_pred", "score", "rejected")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), keep_text=False)
    return judged.select(F.col("row.doc_id").alias("doc_id"), *(F.col(f"s.{c}").alias(c) for c in quality.STATS), F.col("failed").alias("base_failed"), "kept", "distance")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(fixed).alias("text"))
    segments = chat.format_chat(rows.unionByName(extra), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return chat.in_order(segments, ChatDigest, ChatDigest.SCHEMA)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = {
        "ids_sha256": (T.StringType(), lambda ids, _: hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()),
        "decoded_sha256": (T.StringType(), lambda _, text: hashlib.sha256(text.encode()).hexdigest()),
    }
    return bpe.bpe_encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digest)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out(7))
    return scored.select("doc_id", held_out(7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: Host, path, verdict.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.drop("token_ids")


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_suffixes": op1_suffixes,
    "op2_minhash": op2_minhash,
    "op3_langid": op3_langid,
    "op4_quality": op4_quality,
    "op5_chat_format": op5_chat_format,
    "op6_bpe": op6_bpe,
    "op7_topk": op7_topk,
    "op8_urls": op8_urls,
    "op9_lm": op9_lm,
    "op10_packing": op10_packing,
    "op11_audit": op11_audit,
    "op12_alignment": op12_alignment,
    "op13_ann": op13_ann,
}

#: Answers that DuckDB can give by itself.
ORACLES: dict[str, str] = {
    "op7_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 10
    """,
    "op11_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
        f AS (
            SELECT part, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic,
                (CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END)
                || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END)
                || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > first_id THEN 'E' ELSE '' END) AS fails
            FROM w
        ),
        m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS own, left(filter_order, step - 1) AS before FROM o, range(1, 6) t(step)),
        r AS (
            SELECT part, filter_order, step, own,
                coalesce(sum(n) FILTER (NOT contains(fails, own) AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (contains(fails, own) AND NOT gone), 0) AS removed,
                coalesce(sum(n) FILTER (contains(fails, own) AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
                coalesce(sum(good) FILTER (contains(fails, own) AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (contains(fails, own) AND NOT gone), 0) AS toxic_lost
            FROM (SELECT *, regexp_matches(fails, '[' || before || '0]') AS gone FROM m, s) GROUP BY part, filter_order, step, own
        )
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
            CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
    """,
    "op13_ann": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda x, y: x + y)) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 10
    """,
}
