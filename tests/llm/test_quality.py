import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import quality
from folioscope.llm.common import Scratch


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    seen = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if seen[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["a", "b", "é", "😀", " ", " ", "\n", "\t", "#", "|", "\x0b", "\xa0"]) for _ in range(rnd.randint(0, 80))) for _ in range(200)]
    texts += [None, "", " \n ", "a b c d e a b c d e", "x " * 30, "same line\nsame line\n\n\nsame line"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in rows.select("id", quality.statistics(F.col("text")).alias("s")).select("id", "s.*").collect():
        assert tuple(r[c] for c in quality.STATS) == plain(texts[r["id"]]), texts[r["id"]]


def concentrated(x, m, cov, steps):
    floor = np.diag(np.array(quality.FLOORS) ** 2)
    for _ in range(steps):
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)
        near = x[d <= np.sort(d)[int(np.ceil(quality.SHARE * len(d))) - 1]]
        m, cov = near.mean(0), quality.consistency(quality.P, quality.SHARE) * np.cov(near.T, bias=True) + floor
    return m, cov


def sample(seed, contaminated):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(400, quality.P)) * (1, 2, 1, 3, 0.5) + (5, 4, 1, 0, 0)
    x[:, 1] += 2 * x[:, 0]
    x[:contaminated] += (25, -20, 5, 5, 5)
    return x


def estimated(spark, x):
    rows = spark.createDataFrame([("a", "s", *map(float, v)) for v in x], "lang string, source string, " + ", ".join(f"x{k} double" for k in range(quality.P)))
    got = quality.estimates(rows, Scratch(spark)).first()
    w = np.zeros((quality.P, quality.P))
    w[np.tril_indices(quality.P)] = got["w"]
    return np.array(got["m"]), np.linalg.inv(w.T @ w)


def test_mcd_reaches_the_least_determinant_of_many_random_starts(spark):
    """FAST-MCD by brute force: concentration from 500 random elemental starts finds nothing better."""
    for seed, contaminated in ((3, 40), (4, 90)):
        x = sample(seed, contaminated)
        m, cov = estimated(spark, x)
        rng = np.random.default_rng(seed)
        best = np.inf
        for _ in range(500):
            part = x[rng.choice(len(x), quality.P + 1, replace=False)]
            _, own = concentrated(x, part.mean(0), np.cov(part.T, bias=True) + np.diag(np.array(quality.FLOORS) ** 2), quality.STEPS)
            best = min(best, np.linalg.slogdet(own)[1])
        assert np.linalg.slogdet(cov)[1] <= best + 0.1
        clean = x[contaminated:]
        assert np.all(np.abs(m - clean.mean(0)) < 0.8)


def test_concentration_equals_plain_steps(spark):
    x = sample(5, 30)
    m, cov = estimated(spark, x)
    again, cov2 = concentrated(x, m, cov, 1)
    assert np.allclose(again, m, atol=0.15) and np.allclose(cov2, cov, rtol=0.1, atol=0.1)


def test_very_long_and_repeated_rows(spark):
    rnd = random.Random(1)
    long = " ".join(str(rnd.random()) for _ in range(30_000))
    docs = spark.createDataFrame([(1, long, "en", "s"), (1, long, "en", "s"), (2, "x " * 40_000, "en", "s")], "doc_id long, text string, lang string, source string")
    got = quality.judged(docs).select("row.doc_id", "s.n_words", "kept").collect()
    assert sorted((r["doc_id"], r["n_words"], r["kept"]) for r in got) == [(1, 30_000, True), (1, 30_000, True), (2, 40_000, False)]


def test_verdicts_keep_plain_documents_and_drop_symbol_soup(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    good = [" ".join(word() for _ in range(rnd.randint(60, 300))) for _ in range(150)]
    soup = [" ".join(word() + "###$$$" for _ in range(80)) for _ in range(10)]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(good + soup)] + [(900, None, None, None, 1), (900, None, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int")
    got = quality.judged(docs).select("row.doc_id", "kept", "failed").collect()
    assert len(got) == len(rows)
    assert all(r["kept"] == (r["doc_id"] < 150) for r in got)
    assert quality.judged(docs.limit(0)).count() == 0
    assert quality.judged(docs).select("row.*").columns == docs.columns


def test_cutoff_is_a_quantile_and_drops_thin_soup(spark):
    assert abs(1 - quality._gamma_p(quality.P / 2, quality.CUTOFF / 2) - 1e-5) < 1e-7
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    good = [" ".join(word() for _ in range(rnd.randint(60, 300))) for _ in range(150)]
    soup = [" ".join(word() + "|" * (k % 16 < 7) for k in range(96)) for _ in range(10)]  # 8 symbols in 100 characters
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(good + soup)], "doc_id long, text string, lang string, source string")
    got = quality.judged(docs).select("row.doc_id", "kept", "distance").collect()
    assert all(r["kept"] == (r["doc_id"] < 150) for r in got)
    assert all(30 < r["distance"] < 50 for r in got if r["doc_id"] >= 150)
