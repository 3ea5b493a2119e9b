import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import langid, queries

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def test_probabilities_of_a_word_sum_to_one_over_continuations():
    counts = {"x": Counter("the then there cat cab a bab the the".split()), "y": Counter("der die das dass".split())}
    m = langid.fit(counts)
    for prefix in ("", "th", "ca"):
        whole = m.score_words([prefix])[0]
        longer = m.score_words([prefix + c for c in LETTERS])
        for k in range(2):
            # p(end | prefix) plus p(letter | prefix) over the letters stays a share of one
            head = sum(math.exp(s) for s in longer[:, k])
            assert 0 < math.exp(whole[k]) <= 1 and head <= 1.0001


def plain_model(counts, order):
    """Interpolated Kneser-Ney from dictionaries: a function from a word to its log probability."""
    raw = [Counter() for _ in range(order + 1)]
    for word, n in counts.items():
        seq = "<" + word + ">"
        for p in range(1, len(seq)):
            for k in range(1, min(order, p + 1) + 1):
                raw[k][seq[p - k + 1 : p + 1]] += n
    left = [{} for _ in range(order + 1)]
    for k in range(2, order + 1):
        for g in raw[k]:
            left[k - 1].setdefault(g[1:], set()).add(g[0])
    count = [None] * (order + 1)
    for k in range(1, order + 1):
        count[k] = {g: c if k == order or (k > 1 and g[0] == "<") or g not in left[k] else len(left[k][g]) for g, c in raw[k].items()}
    discount, after = [None] * (order + 1), [None] * (order + 1)
    for k in range(1, order + 1):
        ones, twos = (sum(c == n for c in count[k].values()) for n in (1, 2))
        discount[k] = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        after[k] = {}
        for g, c in count[k].items():
            total, kinds = after[k].get(g[:-1], (0, 0))
            after[k][g[:-1]] = total + c, kinds + 1

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(count[1]) + 1)
        if gram[:-1] not in after[k]:
            return p(gram[1:])
        total, kinds = after[k][gram[:-1]]
        return max(count[k].get(gram, 0) - discount[k], 0) / total + discount[k] * kinds / total * p(gram[1:])

    def score(word):
        seq = "<" + word + ">"
        return sum(math.log(p(seq[max(0, at - order + 1) : at + 1])) for at in range(1, len(seq)))

    return score


def test_scores_equal_a_plain_kneser_ney():
    rnd = random.Random(12)
    make = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9)))
    counts = {lang: Counter(make(letters) for _ in range(400)) for lang, letters in (("x", "aabbcde"), ("y", "aeiéß"))}
    models = langid.fit(counts)
    words = [make("abcdeiéßz") for _ in range(300)] + list(counts["x"])[:50] + ["", "a", "zzzzzz"]
    got = models.score_words(words)
    for k, lang in enumerate(models.langs):
        plain = plain_model(counts[lang], langid.ORDER)
        assert np.allclose(got[:, k], [plain(w) for w in words], rtol=1e-9)


def test_calibrated_rejection(spark):
    """Other scripts, shuffled letters, code and foreign tongues go; languages learned stay, also two in one text."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    models = langid.train(docs, ~queries.held_out(4))
    clean = [r["text"] for r in docs.where(queries.held_out(4) & (F.length("text") > 400)).orderBy("doc_id").limit(80).collect()]
    code = "def f(x): return sum(map(int, x.split())) if x else None; import numpy as np; class Foo(Bar): pass; for k, v in zip(a, b): out.append(k ** v)"
    odd = [langid.shuffled(t) for t in clean[:40]] + ["Это просто русский текст который не похож на другие языки совсем " * 3, code, "qxz zzkq wvvx jjqk xxkj qqqz vwxz " * 5]
    mixed = [a[:300] + " " + b[:300] for a, b in zip(clean, clean[1:])]
    rows = [(k, t) for k, t in enumerate(clean + mixed + odd)]
    got = {r["doc_id"]: r["rejected"] for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), models).collect()}
    assert [got[k] for k in range(len(rows))] == [False] * len(clean + mixed) + [True] * len(odd)


def test_ties_long_texts_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "abc abd", "x", 0.5), (2, "abc abd", "y", 0.5)] * 40, "doc_id long, text string, lang string, score double")
    models = langid.train(docs, F.lit(True))
    odd = spark.createDataFrame([(1, "abc", "z", "s", True), (2, "abc " * 100_000, "z", "s", True)], "doc_id long, text string, lang_pred string, score string, rejected boolean")
    got = sorted((r["doc_id"], r["lang_pred"], round(r["score"], 3)) for r in langid.identify(odd, models).collect())
    assert got[0] == (1, "x", 0.5) and got[1][1] == "x"
    assert langid.identify(odd, models, carry=True).select("row.*").columns == odd.columns


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op3_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, n = got.select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count(F.lit(1))).first()
    assert n > 100 and right > 0.97
    assert got.where("rejected").count() <= 0.005 * n


def test_undefined_texts_and_empty_training(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "123 !!", "en"), (3, "hello there", "en"), (3, "hello there", None), (None, "", "fr")], "doc_id long, text string, lang string")
    models = langid.train(docs, F.lit(True), sample=10)
    got = sorted((r["doc_id"] or -1, r["lang_pred"], r["score"]) for r in langid.identify(docs, models).collect())
    assert [g[1] for g in got if g[0] in (-1, 1, 2)] == ["und"] * 3
    nothing = langid.train(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), models).count() == 0
    carried = langid.identify(docs, models, carry=True).select("row.*", "rejected")
    assert carried.columns == ["doc_id", "text", "lang", "rejected"] and carried.count() == 5
