"""Language identification with interpolated Kneser-Ney character models.

Each language's model predicts the letters of a word and its end from at most ORDER - 1 characters before them.
Models are kept together in one sorted array of n-gram hashes an order, with a column of log probabilities for
each language, and one of context hashes with log back-off weights. A text belongs to the language with the
lowest cross-entropy a predicted character. How sharp the scores are, and from which cross-entropy on a text is
rejected, is calibrated on texts kept out of the counts: the limit of a language lies halfway between what its own
texts reach at most and what the same texts, their letters shuffled, reach at least.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import key_back, key_text, slices

ORDER = 5
#: Expected number of sampled documents a language: the bound on what the models are fitted on.
SAMPLE = 500
#: One sampled document in so many calibrates instead of being counted.
CALIBRATE = 5
#: Languages up to which the shares of the sample are written into the plan; beyond, they are joined.
MOST_LANGS = 500
WORDS_KEPT = 150_000
#: Where a language's limit lies between its own calibration texts (0) and these with their letters shuffled (1).
BETWEEN = 0.5
#: Predicted characters below which a text is not rejected for its cross-entropy.
MIN_LETTERS = 50

_runs = re.compile(r"[^\W\d_]+")
START, END = 2, 3
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def letter_runs(token: str) -> list[str]:
    return [r for r in _runs.findall(token.lower()) if any(map(str.isalpha, r))]


def _hashes(words: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of every predicted character: its word's number; hashes of the 1..ORDER characters up to it; its place in the word.

    The first element of each word is its start mark, which is context only.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    text = "".join(chr(START) + w + chr(END) for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - np.repeat(starts, sizes)
    rolled, before = [], np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for _ in range(ORDER):
            here = (before ^ codes) * MULTIPLIER
            here ^= here >> np.uint64(29)
            rolled.append(here)
            before = np.concatenate(([np.uint64(0)], here[:-1])) if len(here) else here
    return word, rolled, place


@dataclass
class Models:
    langs: list[str]
    grams: list[np.ndarray]  # per order, sorted
    logp: list[np.ndarray]  # per order, [gram, language]
    contexts: list[np.ndarray]  # per order, sorted hashes of the characters before the last
    backoff: list[np.ndarray]  # per order, [context, language]
    floor: np.ndarray  # log probability of a character never seen
    temperature: float = 0.1
    limit: np.ndarray | None = None  # highest cross-entropy that is not rejected

    def score_words(self, words: list[str]) -> np.ndarray:
        """[word, language] sums of log probabilities, the number of predicted characters last."""
        out = np.zeros((len(words), len(self.langs) + 1))
        if not words:
            return out
        word, rolled, place = _hashes(words)
        at = np.flatnonzero(place > 0)
        total = np.zeros((len(at), len(self.langs)))
        open_ = np.arange(len(at))
        for order in range(ORDER, 0, -1):
            fits = open_[place[at[open_]] >= order - 1]
            late = open_[place[at[open_]] < order - 1]
            if len(fits):
                found, hit = _find(self.grams[order - 1], rolled[order - 1][at[fits]])
                total[fits[hit]] += self.logp[order - 1][found[hit]]
                fits = fits[~hit]
                if order > 1 and len(fits):
                    found, hit = _find(self.contexts[order - 1], rolled[order - 2][at[fits] - 1])
                    total[fits[hit]] += self.backoff[order - 1][found[hit]]
                open_ = np.concatenate((fits, late))
            else:
                open_ = late
        total[open_] += self.floor
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(word[at], total[:, k], len(words))
        out[:, -1] = np.bincount(word[at], minlength=len(words))
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _one_language(words: list[str], counts: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Per order: unique grams, their contexts, log probabilities; unique contexts, their log back-off weights."""
    word, rolled, place = _hashes(words)
    weight = counts[word].astype(float)
    kinds = []
    for order in range(1, ORDER + 1):
        at = np.flatnonzero(place >= max(order - 1, 1))
        gram, first, inverse = np.unique(rolled[order - 1][at], return_index=True, return_inverse=True)
        kinds.append({"gram": gram, "raw": np.bincount(inverse, weight[at]), "suffix": rolled[order - 2][at][first] if order > 1 else np.zeros(len(gram), np.uint64), "context": rolled[order - 2][at[first] - 1] if order > 1 else np.zeros(len(gram), np.uint64), "anchored": place[at][first] == order - 1})
    lower = None
    for order, k in enumerate(kinds, 1):
        count = k["raw"].copy()
        if order < ORDER:  # how many different characters stand before it
            suffix, left = np.unique(kinds[order]["suffix"], return_counts=True)
            found, hit = _find(suffix, k["gram"])
            inner = hit & ~(k["anchored"] & (order > 1))
            count[inner] = left[found[inner]]
        ones, twos = (count == 1).sum(), (count == 2).sum()
        discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        context, inverse = np.unique(k["context"], return_inverse=True)
        total, types = np.bincount(inverse, count), np.bincount(inverse)
        weight_left = discount * types / total
        if order == 1:
            base = np.full(len(count), 1 / (len(count) + 1))
            k["floor"] = math.log(weight_left[0] / (len(count) + 1))
        else:
            base = lower["p"][_find(lower["gram"], k["suffix"])[0]]
        k["p"] = np.maximum(count - discount, 0) / total[inverse] + weight_left[inverse] * base
        k["contexts"], k["backoff"] = context, np.log(weight_left)
        lower = k
    return kinds


def fit(word_counts: dict[str, Counter]) -> Models:
    """Models of each language from its word counts, laid out by order."""
    langs = sorted(lang for lang, words in word_counts.items() if words)
    own = []
    for lang in langs:
        words = sorted(word_counts[lang])
        own.append(_one_language(words, np.array([word_counts[lang][w] for w in words])))
    m = Models(langs, [], [], [], [], np.array([k[0]["floor"] for k in own]))
    for order in range(1, ORDER + 1):
        grams = np.unique(np.concatenate([k[order - 1]["gram"] for k in own])) if own else np.zeros(0, np.uint64)
        contexts = np.unique(np.concatenate([k[order - 1]["contexts"] for k in own])) if own else np.zeros(0, np.uint64)
        backoff = np.zeros((len(contexts), len(langs)))
        for j, k in enumerate(own):
            backoff[_find(contexts, k[order - 1]["contexts"])[0], j] = k[order - 1]["backoff"]
        # a gram that a language lacks: its back-off weight for the context, and its value one order below
        suffix, context = np.zeros(len(grams), np.uint64), np.zeros(len(grams), np.uint64)
        for k in own:
            at = _find(grams, k[order - 1]["gram"])[0]
            suffix[at], context[at] = k[order - 1]["suffix"], k[order - 1]["context"]
        if order == 1:
            logp = np.tile(m.floor, (len(grams), 1))
        else:
            logp = m.logp[-1][_find(m.grams[-1], suffix)[0]] + backoff[_find(contexts, context)[0]]
        for j, k in enumerate(own):
            logp[_find(grams, k[order - 1]["gram"])[0], j] = np.log(k[order - 1]["p"])
        m.grams.append(grams), m.logp.append(logp), m.contexts.append(contexts), m.backoff.append(backoff)
    return m


class Scorer:
    """Sums a text's words; scores of words are kept in a bounded memory."""

    def __init__(self, models: Models):
        self.models, self.at, self.table = models, {}, np.zeros((0, len(models.langs) + 1))

    def texts(self, texts: list[str]) -> np.ndarray:
        split = [t.split() for t in texts]
        new = {w for words in split for w in words if w not in self.at}
        if len(new) + len(self.at) > WORDS_KEPT:
            self.at, self.table = {}, self.table[:0]
            new = {w for words in split for w in words}
        if new:
            tokens = list(new)
            runs = [letter_runs(t) for t in tokens]
            each = self.models.score_words([r for rs in runs for r in rs])
            owner = np.repeat(np.arange(len(tokens)), [len(rs) for rs in runs])
            sums = np.stack([np.bincount(owner, each[:, k], len(tokens)) for k in range(each.shape[1])], 1)
            base = len(self.at)
            self.at.update((t, base + k) for k, t in enumerate(tokens))
            self.table = np.concatenate((self.table, sums))
        get = self.at.__getitem__
        out = np.zeros((len(split), self.table.shape[1]))
        for k, words in enumerate(split):
            if words:
                out[k] = self.table[np.fromiter(map(get, words), np.int64, len(words))].sum(0)
        return out


def _training(docs: DataFrame, use: Column, sample: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """The labelled rows that are fitted on: an even sample by hash of the id, `sample` a language as expected."""
    labelled = docs.where(use & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(key_text(id_col), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    draw = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / float(1 << 30)
    few = sizes.limit(MOST_LANGS + 1).collect()
    if len(few) <= MOST_LANGS:  # shares as a constant of the plan: texts are drawn where they are read
        share = F.create_map(*(F.lit(x) for r in few for x in (r["lang"], float(sample) / r["n"]))) if few else F.lit(None).cast("map<string,double>")
        drawn = labelled.where(draw < F.try_element_at(share, F.col("lang")))
    else:
        drawn = labelled.join(sizes, "lang").where(draw * F.col("n") < sample)
    return drawn.select(F.pmod(F.xxhash64(F.lit("calibrate"), id_col), F.lit(CALIBRATE)).alias("part"), "lang", "text")


def _count_words(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        counts: Counter = Counter()
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            counts.update((lang, r) for token in text.split() for r in letter_runs(token))
        yield pd.DataFrame([(lang, w, n) for (lang, w), n in counts.items()], columns=["lang", "word", "n"])


def train(docs: DataFrame, use: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Models:
    """Fit and calibrate on a bounded sample of the rows of `docs` that `use` admits."""
    rows = _training(docs, use, sample, id_col, text_col, lang_col)
    counted = rows.where(F.col("part") > 0).select("lang", "text").mapInPandas(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    word_counts: dict[str, Counter] = {}
    for lang, word, n in counted.collect():
        word_counts.setdefault(lang, Counter())[word] = n
    models = fit(word_counts)
    if models.langs:
        calibrate(models, rows.where(F.col("part") == 0).select("lang", "text"))
    return models


def shuffled(text: str) -> str:
    """A text's words with their letters dealt anew among all of them: its alphabet without its language."""
    words = [r for token in text.split() for r in letter_runs(token)]
    letters = list("".join(words))
    random.Random(len(letters)).shuffle(letters)
    dealt = iter(letters)
    return " ".join("".join(next(dealt) for _ in w) for w in words)


def calibrate(models: Models, rows: DataFrame) -> None:
    """Set temperature (highest likelihood of the true languages) and each language's limit; without texts, none."""
    L = len(models.langs)

    def run(batches):
        scorer = Scorer(models)
        for pdf in batches:
            texts = list(pdf["text"])
            yield pd.DataFrame({"lang": pdf["lang"], "sums": scorer.texts(texts).tolist(), "other": scorer.texts([shuffled(t) for t in texts]).tolist()})

    seen = rows.mapInPandas(run, "lang string, sums array<double>, other array<double>").collect()
    seen = [(models.langs.index(r["lang"]), np.array(r["sums"]), np.array(r["other"])) for r in seen if r["lang"] in models.langs and r["sums"][-1] > 0]
    models.limit = np.full(L, np.inf)
    if not seen:
        return
    truth, entropy, other = np.array([k for k, _, _ in seen]), *(np.array([-s[j][:L] / s[j][L] for s in seen]) for j in (1, 2))
    steps = (0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5)
    best = max(steps, key=lambda t: np.log(_posterior(entropy, t)[np.arange(len(truth)), truth].clip(1e-12)).sum())
    models.temperature = best
    long = np.array([s[1][L] >= MIN_LETTERS for s in seen])
    for k in range(L):
        own = long & (truth == k)
        if own.any():
            models.limit[k] = (1 - BETWEEN) * entropy[own, k].max() + BETWEEN * other[own].min(1).min()


def _posterior(entropy: np.ndarray, temperature: float) -> np.ndarray:
    z = -(entropy - entropy.min(1, keepdims=True)) / temperature
    e = np.exp(z)
    return e / e.sum(1, keepdims=True)


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(id, lang_pred, score, cross_entropy, rejected) of every whole text; with `carry`, (row, rejected) with
    the columns of `docs` in the struct `row`.

    lang_pred is `und` (score 0, rejected) for null texts and texts without letters, or if nothing was learned.
    Texts with fewer than MIN_LETTERS predicted characters are not rejected otherwise; texts may be of any length.
    Ties go to the language that sorts first. Repeated rows are judged alike; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(models)  # bounded by the sample that it was fitted on
    L = len(models.langs)

    def judge(texts: list[str], scorer: Scorer) -> list[tuple]:
        sums = scorer.texts(texts)
        out: list[tuple] = [("und", 0.0, None, True)] * len(texts)
        some = np.flatnonzero(sums[:, L] > 0) if L else np.zeros(0, int)
        if len(some):
            entropy = -sums[some, :L] / sums[some, L : L + 1]
            p, k = _posterior(entropy, models.temperature), entropy.argmin(1)
            for i, row, j, letters in zip(some, range(len(some)), k, sums[some, L], strict=True):
                h = float(entropy[row, j])
                out[i] = (models.langs[j], float(p[row, j]), h, bool(letters >= MIN_LETTERS and models.limit is not None and h > models.limit[j]))
        return out

    if carry:
        packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[text_col].alias("text"))
        schema = T.StructType([packed.schema["row"], T.StructField("rejected", T.BooleanType())])
        return packed.mapInArrow(_carry(shared, judge), schema)

    back = key_back(docs.schema[id_col].dataType)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for pdf in batches:
            rows = []
            for part in slices(pdf, pdf.iloc[:, 1]):
                texts = [x if isinstance(x, str) else "" for x in part.iloc[:, 1]]
                rows += [(back(key), *found) for key, found in zip(part.iloc[:, 0], judge(texts, scorer), strict=True)]
            yield pd.DataFrame(rows, columns=schema.names, dtype=object)

    return docs.select(key_text(id_col), text_col).mapInPandas(run, schema)


def _carry(shared, judge):
    def run(batches):
        import pyarrow as pa

        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            flags = []
            for part in _by_chars([x or "" for x in texts]):
                flags += [r[3] for r in judge(part, scorer)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flags, pa.bool_())], names=["row", "rejected"])

    return run


def _by_chars(texts: list[str], most: int = 2_000_000) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part
