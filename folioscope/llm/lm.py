"""Language-model scoring by deleted interpolation.

The probability of a token after the ORDER - 1 before it is a mixture of its relative frequencies after contexts of
every length and the uniform one; the weights depend on how long a context was seen and how often, and are learned by
expectation-maximisation on deleted counts: each training token is predicted from all the others, that is from counts
less its own.

Counting is done on packed arrays. Documents are cut into chunks of about CHUNK tokens; a chunk sends each
n-gram that it holds once, as a 64-bit hash with its count, to the bucket that the hash belongs to; the bucket
adds up and answers each chunk with the totals. Frequent n-grams thus weigh no more than one entry a chunk, and
no n-gram becomes a row. There are as many buckets as chunks, so neither grows with the corpus. Each order is counted
by a job of its own, whose shuffle files go before the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, even_labels, key_back, key_text

ORDER = 3
CHUNK = 400_000
CONTEXTS = 24  # buckets of context frequency, by powers of two, for each length of context
EM_STEPS = 30
CELLS = 8000  # of the deleted counts' histogram in a bucket
OCTAVES = 30  # of probability that its bins span
END = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xC2B2AE3D27D4EB4F)

_TOKENS = "chunk string, words binary, tokens binary, sizes binary, ids array<string>, train binary"


def _words(text) -> list[bytes]:
    """Lower-cased (A-Z) words of a text: bytes know no white space but the six of the definition."""
    return text.encode("utf-8", "replace").lower().split() if isinstance(text, str) else []


def tokenized(docs: DataFrame, train: Column, id_col: str, text_col: str) -> DataFrame:
    """Chunks of documents: hashes of the distinct words, documents' words as numbers into them."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers: dict[bytes, int] = {}
        flat, sizes, ids, kept, held = [], [], [], [], 0

        def flush() -> pd.DataFrame:
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in numbers), np.uint64, len(numbers))
            row = (uuid.uuid4().hex, hashes.tobytes(), np.concatenate(flat).tobytes() if flat else b"", np.array(sizes, np.int64).tobytes(), list(ids), np.array(kept, bool).tobytes())
            numbers.clear(), flat.clear(), sizes.clear(), ids.clear(), kept.clear()
            return pd.DataFrame([row], columns=["chunk", "words", "tokens", "sizes", "ids", "train"])

        for pdf in batches:
            for key, text, used in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], pdf.iloc[:, 2], strict=True):
                words = _words(text)
                flat.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)))
                sizes.append(len(words)), ids.append(key), kept.append(bool(used))
                held += len(words) + 1
                if held >= CHUNK:
                    yield flush()
                    held = 0
        if ids:
            yield flush()

    return docs.select(key_text(id_col), text_col, train.alias("train")).mapInPandas(run, _TOKENS)


def _pair(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (before * MIX) ^ (token + (before >> np.uint64(31)))
        h = (h ^ (h >> np.uint64(29))) * END
        return h ^ (h >> np.uint64(32))


class Tokens:
    """A chunk's documents, each with an end behind its words; what lies before a document is an end, too."""

    def __init__(self, row):
        words, tokens = np.frombuffer(row.words, np.uint64), np.frombuffer(row.tokens, np.int32)
        sizes = np.frombuffer(row.sizes, np.int64)
        self.sizes, self.train = sizes + 1, np.frombuffer(row.train, bool)
        ends = np.cumsum(self.sizes) - 1
        self.first = ends - sizes
        self.token = np.empty(len(tokens) + len(sizes), np.uint64)
        inner = np.ones(len(self.token), bool)
        inner[ends] = False
        self.token[inner] = words[tokens] if len(tokens) else 0
        self.token[ends] = END
        self.place = np.arange(len(self.token)) - np.repeat(self.first, self.sizes)
        self.used = np.repeat(self.train, self.sizes)

    def grams(self, order: int) -> np.ndarray:
        """Hash of every token with the order - 1 before it."""
        h = np.zeros(len(self.token), np.uint64)
        for back in range(order - 1, 0, -1):
            before = np.full(len(self.token), END)
            inner = np.flatnonzero(self.place >= back)
            before[inner] = self.token[inner - back]
            h = _pair(h, before)
        return _pair(h, self.token) if order > 1 else self.token


def _planes(sorted_keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane: the high planes are nearly all zero."""
    return np.diff(sorted_keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin in a sorted array: buckets are equal ranges of the hash."""
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def totals(chunks: DataFrame, order: int, labels: list[int]) -> DataFrame:
    """(chunk, kind, bucket, width, counts, tokens, types): for each chunk's n-grams of a bucket, in their order, the
    counts over all training documents; tokens and types of the bucket stand in one row of no chunk."""

    def send(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                t = Tokens(row)
                keys, inverse = np.unique(t.grams(order), return_inverse=True)
                counts = np.bincount(inverse, t.used, len(keys)).astype(np.uint32)
                cuts = _cuts(keys, len(labels))
                parts = [(labels[b], b, row.chunk, _planes(keys[i:j]), counts[i:j].tobytes()) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
                yield pd.DataFrame(parts, columns=["label", "bucket", "chunk", "keys", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        parts = [_unplanes(k) for k in pdf["keys"]]
        unique, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        sums = np.bincount(inverse, np.concatenate([np.frombuffer(c, np.uint32) for c in pdf["counts"]]), len(unique)).astype(np.int64)
        found, at = [], 0
        narrow = np.uint32 if not len(sums) or sums.max() < 1 << 32 else np.uint64
        for chunk, keys in zip(pdf["chunk"], parts, strict=True):
            part = sums[inverse[at : at + len(keys)]].astype(narrow)
            found.append((chunk, order, bucket, part.itemsize, part.view(np.uint8).reshape(len(part), -1).T.tobytes(), None, None))
            at += len(keys)
        found.append((None, order, bucket, 0, b"", int(sums.sum()), int((sums > 0).sum())))
        return pd.DataFrame(found, columns=["chunk", "kind", "bucket", "width", "counts", "tokens", "types"])

    sent = chunks.mapInPandas(send, "label int, bucket int, chunk string, keys binary, counts binary").repartition(len(labels), "label")
    return sent.groupBy("label").applyInPandas(add, "chunk string, kind int, bucket int, width int, counts binary, tokens long, types long")


class Chunk(Tokens):
    """A chunk with the totals of its n-grams: what deleted counts and scores are computed from."""

    def __init__(self, row, answers: pd.DataFrame, order: int):
        super().__init__(row)
        self.ids, self.counts = list(row.ids), []
        for k in range(1, order + 1):
            unique, inverse = np.unique(self.grams(k), return_inverse=True)
            mine = answers[answers["kind"] == k].sort_values("bucket")
            each = [np.frombuffer(c, np.uint8).reshape(w, -1).T.copy().view(np.uint32 if w == 4 else np.uint64).ravel() for w, c in zip(mine["width"], mine["counts"], strict=True)]
            found = np.concatenate(each).astype(np.int64) if each else np.zeros(0, np.int64)
            if len(found) != len(unique):
                raise RuntimeError(f"{len(found)} totals for {len(unique)} n-grams")
            self.counts.append(found[inverse])

    def components(self, N: int, deleted: bool) -> tuple[np.ndarray, list[np.ndarray]]:
        """Context bucket, and estimates from the longest context to none, of training tokens less themselves or of all."""
        at = self.used if deleted else slice(None)
        ends = self.counts[0][-1] if len(self.token) else 0  # how many documents: what stands before their first tokens
        bucket = np.zeros(len(self.token[at]), np.int64)
        estimates = [(self.counts[0][at] - deleted) / max(N - deleted, 1)]
        for k in range(1, len(self.counts)):
            context = np.concatenate((self.counts[k - 1][:1], self.counts[k - 1][:-1]))
            context[self.place == 0] = ends
            context = context[at] - deleted
            p = np.divide(self.counts[k][at] - deleted, context, out=np.zeros(len(context)), where=context > 0)
            bucket = np.where(context > 0, (k - 1) * CONTEXTS + np.minimum(np.frexp(context)[1], CONTEXTS - 1), bucket)
            estimates.insert(0, p)
        return bucket, estimates


def bins_of(order: int) -> int:
    return max(4, round(CELLS ** (1 / order)))


def _log_bin(p: np.ndarray, bins: int) -> np.ndarray:
    depth = -np.log2(np.maximum(p, 1e-300)) * (bins - 2) / OCTAVES
    return np.where(p > 0, np.clip(depth + 1, 1, bins - 1), 0).astype(np.int64)


def learn_weights(bucket: np.ndarray, n: np.ndarray, estimates: np.ndarray, V: int, steps: int = EM_STEPS) -> np.ndarray:
    """[context bucket, (estimates ..., uniform)] by expectation-maximisation over binned deleted counts.

    n tokens lie in a bin; `estimates` has their mean estimates, one column an order.
    """
    p = np.column_stack((estimates, np.full(len(n), 1 / (V + 1))))
    size = int(bucket.max(initial=0)) + 1
    weights = np.full((size, p.shape[1]), 1 / p.shape[1])
    for _ in range(steps):
        mixed = weights[bucket] * p
        share = mixed / mixed.sum(1, keepdims=True) * n[:, None]
        new = np.stack([np.bincount(bucket, share[:, k], size) for k in range(p.shape[1])], 1) + 1e-3
        weights = new / new.sum(1, keepdims=True)
    return weights


def lm_scores(docs: DataFrame, train: Column, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Tokens are the text's words and one end; `train` (boolean, not null) says which documents are counted; `order` is
    the longest n-gram's. base_score is the add-one unigram's log10 probability, score the interpolated model's. Null
    and empty texts consist of their end. Repeated rows are counted and scored as often as they stand; an empty table
    gives no rows; without training documents base_score and score are the uniform model's.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    chunks = scratch.write("chunks", tokenized(docs, train, id_col, text_col))
    labels = even_labels(spark, max(8, chunks.count()))
    each = [scratch.write(f"totals{k}", totals(chunks, k, labels)) for k in range(1, order + 1)]
    facts = each[0].where(F.col("chunk").isNull()).agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    N, V = int(facts["n"] or 0), int(facts["v"] or 0)
    counted = each[0]
    for more in each[1:]:
        counted = counted.unionByName(more)
    answers = counted.where(F.col("chunk").isNotNull()).select("chunk", "kind", "bucket", "width", "counts")
    pairs = lambda: chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    bins, names = bins_of(order), [f"p{k}" for k in range(order, 0, -1)]

    def deleted(mine: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        key, estimates = Chunk(next(mine.itertuples(index=False)), found, order).components(N, True)
        for p in estimates:
            key = key * bins + _log_bin(p, bins)
        cells, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
        return pd.DataFrame({"key": cells, "n": n} | {c: np.bincount(inverse, p, len(cells)) for c, p in zip(names, estimates, strict=True)})

    schema = "key long, n long, " + ", ".join(f"{c} double" for c in names)
    histogram = pairs().applyInPandas(deleted, schema).groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n", *names))).orderBy("key")
    held = scratch.write("deleted", histogram).toPandas()  # at most about CONTEXTS * order * CELLS rows
    n = held["n"].to_numpy(float)
    weights = learn_weights(held["key"].to_numpy(np.int64) // bins**order, n, held[names].to_numpy(float) / n[:, None], V)
    full = np.full((max(1, order - 1) * CONTEXTS, order + 1), 1 / (order + 1))  # buckets never seen in training
    full[: len(weights)] = weights
    kind = docs.schema[id_col].dataType
    back = key_back(kind)
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))])

    def score(mine: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(next(mine.itertuples(index=False)), found, order)
        bucket, estimates = c.components(N, False)
        w = full[bucket]
        p = np.log10(sum((w[:, k] * e for k, e in enumerate(estimates)), w[:, -1] / (V + 1)))
        c1 = c.counts[0]
        sums = [np.add.reduceat(x, c.first) for x in ((c1 > 0).astype(np.int64), np.log10((c1 + 1) / (N + V + 1)), p)]
        out = {id_col: [back(k) for k in c.ids], "n_tokens": c.sizes, "n_known": sums[0], "train_tokens": np.full(len(c.sizes), N), "base_score": sums[1], "score": sums[2]}
        return pd.DataFrame({k: pd.Series(v, dtype=object if k == id_col else None) for k, v in out.items()})

    return pairs().applyInPandas(score, schema)
