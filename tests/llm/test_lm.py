import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import lm, queries


def test_base_score_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.op9_lm(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).alias("held")).collect()
    tokens = {r["doc_id"]: [*lm._words(r["text"]), None] for r in docs}
    counts: Counter = Counter()
    for r in docs:
        if not r["held"]:
            counts.update(tokens[r["doc_id"]])
    N, V = sum(counts.values()), len(counts)
    for r in docs:
        g, own = got[r["doc_id"]], tokens[r["doc_id"]]
        assert (g["held_out"], g["n_tokens"], g["train_tokens"]) == (r["held"], len(own), N)
        assert g["n_known"] == sum(counts[t] > 0 for t in own)
        assert math.isclose(g["base_score"], sum(math.log10((counts[t] + 1) / (N + V + 1)) for t in own), rel_tol=1e-9)
    held = [got[r["doc_id"]] for r in docs if r["held"]]
    assert sum(g["score"] for g in held) > sum(g["base_score"] for g in held)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_mixture_equals_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "CHUNK", 50)
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("a b c d e".split()) for _ in range(rnd.randint(0, 20))) for _ in range(40)] + [None, "", "A a", "a b c", "a b c"]
    docs = spark.createDataFrame([(k, t, k % 5 != 0, 1) for k, t in enumerate(texts)], "doc_id long, text string, use boolean, score int").repartition(3)
    seen = {}
    real = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda *a: seen.setdefault("w", real(*a)))
    got = {r["doc_id"]: r["score"] for r in lm.lm_scores(docs, F.col("use"), order).collect()}
    grams, contexts = Counter(), Counter()
    split = [["<"] * (order - 1) + [w.decode() for w in lm._words(t)] + ["</>"] for t in texts]
    for k, ts in enumerate(split):
        if k % 5:
            for at in range(order - 1, len(ts)):
                for n in range(1, order + 1):
                    grams[tuple(ts[at - n + 1 : at + 1])] += 1
                    contexts[tuple(ts[at - n + 1 : at])] += 1
    N, V, w = contexts[()], len([g for g in grams if len(g) == 1]), seen["w"]
    for k, ts in enumerate(split):
        total = 0.0
        for at in range(order - 1, len(ts)):
            bucket, p = 0, [1 / (V + 1)]
            for n in range(1, order + 1):
                c = contexts[tuple(ts[at - n + 1 : at])]
                p.insert(0, grams[tuple(ts[at - n + 1 : at + 1])] / c if c else 0)
                if c and n > 1:
                    bucket = (n - 2) * lm.CONTEXTS + min(c.bit_length(), lm.CONTEXTS - 1)
            total += math.log10(sum(x * y for x, y in zip(w[bucket] if bucket < len(w) else [1 / (order + 1)] * (order + 1), p)))
        assert math.isclose(got[k], total, rel_tol=1e-9, abs_tol=1e-9), k


def test_em_weights_are_distributions_and_prefer_what_predicts():
    w = lm.learn_weights(np.array([1, 1, 20, 20]), np.array([100.0, 10, 100, 10]), np.array([[0, 0.01], [0, 0.01], [0.8, 0.01], [0.5, 0.01]]), 1000)
    assert np.allclose(w.sum(1), 1) and w[20, 0] > 0.9 and w[1, 0] < 0.01


def test_longer_contexts_predict_held_out_texts_better(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    held = queries.held_out(7)
    totals = [lm.lm_scores(docs, ~held, k).where(held).agg(F.sum("score")).first()[0] for k in (1, 2)]
    assert totals[1] > totals[0]


def test_repeated_rows_and_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 1000)
    rnd = random.Random(1)
    long = " ".join(rnd.choice("abcdefghij") for _ in range(30_000))
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, long), (None, "x")], "doc_id long, text string")
    got = lm.lm_scores(docs, F.lit(True)).collect()
    assert sorted(r["n_tokens"] for r in got) == [2, 3, 3, 30_001]
    assert len({r["score"] for r in got if r["n_tokens"] == 3}) == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.lm_scores(docs, F.lit(True)).count() == 0
