"""Exact inner-product search: candidates by descending norm, SVD-rotated partial sums, Cauchy-Schwarz pruning.

Vectors are rotated by the singular vectors of the whole set, so that few leading coordinates carry most of an
inner product; the rest is bounded by the product of the residual norms. A candidate is scored exactly, in
integers, only if that bound reaches the query's tenth best score so far. Queries and candidates travel as packed
chunks of at most CHUNK vectors; each chunk of candidates meets each chunk of queries once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

CHUNK = 2048
LEADING = 16
SCALE = 1024
EXACT = float(1 << 53)  # integer sums below it are exact in doubles

_CHUNK_SCHEMA = "dim int, chunk string, largest double, ids binary, vectors binary"


def clean(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, dim, norm, v): floors of the scaled components as doubles; rows with null or non-finite parts leave."""
    v = F.transform(vector_col, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    wrong = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    kept = rows.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & ~wrong).select(F.col(id_col).cast("long").alias("vec_id"), F.size(vector_col).alias("dim"), v.alias("v"))
    return kept.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in column]).reshape(len(column), dim) if len(column) else np.zeros((0, dim))


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By dimension, the right singular vectors of all vectors: from d x d sums, added up before they are shuffled."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                m = _matrix(part["v"], dim)
                sums[dim] = sums.get(dim, 0) + m.T @ m
        yield pd.DataFrame([(dim, i, row.tolist()) for dim, s in sums.items() for i, row in enumerate(s)], columns=["dim", "i", "row"])

    parts = vectors.select("dim", "v").mapInPandas(run, "dim int, i int, row array<double>")
    flat = parts.select("dim", "i", F.posexplode("row").alias("j", "x")).groupBy("dim", "i", "j").agg(F.sum("x").alias("x"))
    out: dict[int, np.ndarray] = {}
    for dim, i, j, x in flat.collect():
        out.setdefault(dim, np.zeros((dim, dim)))[i, j] = x
    out.setdefault(0, np.zeros((0, 0)))
    return {dim: np.linalg.eigh((s + s.T) / 2)[1][:, ::-1] for dim, s in out.items()}


def chunks(vectors: DataFrame, size: int = CHUNK) -> DataFrame:
    """Packed chunks; each holds vectors of one dimension in the order in which they come."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for dim, part in pdf.groupby("dim", sort=False):
                for at in range(0, len(part), size):
                    cut = part.iloc[at : at + size]
                    ids = cut["vec_id"].to_numpy(np.int64)
                    rows.append((dim, f"{ids[0]}-{ids[-1]}-{at}", float(cut["norm"].max()), ids.tobytes(), _matrix(cut["v"], dim).tobytes()))
            yield pd.DataFrame(rows, columns=["dim", "chunk", "largest", "ids", "vectors"])

    return vectors.select("vec_id", "dim", "norm", "v").mapInPandas(run, _CHUNK_SCHEMA)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integer-valued doubles; Python integers where a sum could pass 2^53, held to 64 bits."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).sum(1).max() * np.abs(b).max() < EXACT:
        return (a @ b.T).astype(np.int64)
    big = [[int(x) for x in row] for row in b]
    out = [[sum(int(x) * y for x, y in zip(q, c, strict=True)) for c in big] for q in a]
    return np.array([[min(max(s, -(1 << 63)), (1 << 63) - 1) for s in row] for row in out], np.int64)


class Best:
    """The k best of each query of a chunk, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, rotation: np.ndarray):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.rotated = vectors @ rotation
        self.lead = self.rotated[:, :LEADING]
        self.rest = np.linalg.norm(self.rotated[:, LEADING:], axis=1)
        self.norms = np.linalg.norm(vectors, axis=1)
        self.scores = np.zeros((len(ids), 0), np.int64)
        self.found = np.zeros((len(ids), 0), np.int64)

    def floor(self) -> np.ndarray:
        return self.scores[:, -1].astype(float) if self.scores.shape[1] == self.k else np.full(len(self.ids), -np.inf)

    def meet(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray) -> None:
        norms = np.linalg.norm(vectors, axis=1)
        order = np.argsort(-norms, kind="stable")
        for at in range(0, len(order), 512):
            self._block(ids[order[at : at + 512]], vectors[order[at : at + 512]], norms[order[at : at + 512]], rotation)

    def _block(self, ids, vectors, norms, rotation) -> None:
        floor = self.floor()
        slack = 1e-9 * self.norms * norms[0] + 1e-6
        rows = np.flatnonzero(self.norms * norms[0] + slack >= floor)  # norms descend: the first bounds the block
        if not len(rows):
            return
        rotated = vectors @ rotation
        bound = self.lead[rows] @ rotated[:, :LEADING].T + np.outer(self.rest[rows], np.linalg.norm(rotated[:, LEADING:], axis=1))
        alive = (bound + slack[rows, None] >= floor[rows, None]) & (self.ids[rows, None] != ids[None, :])
        columns = np.flatnonzero(alive.any(0))
        if not len(columns):
            return
        scores = exact_scores(self.vectors[rows], vectors[columns])
        alive = alive[:, columns]
        new_scores, new_found = [], []
        for i in range(len(self.ids)):
            new_scores.append(self.scores[i]), new_found.append(self.found[i])
        for n, i in enumerate(rows):
            s = np.concatenate((self.scores[i][self.scores[i] != _NONE], scores[n, alive[n]]))
            f = np.concatenate((self.found[i][self.scores[i] != _NONE], ids[columns][alive[n]]))
            keep = np.lexsort((f, -s))[: self.k]
            new_scores[i], new_found[i] = s[keep], f[keep]
        self.scores = np.stack([_pad(s, self.k) for s in new_scores])
        self.found = np.stack([_pad(f, self.k) for f in new_found])

    def rows(self) -> list[tuple[int, int, int]]:
        return [(int(q), int(f), int(s)) for q, ss, ff in zip(self.ids, self.scores, self.found, strict=True) for s, f in zip(ss, ff, strict=True) if s != _NONE]


_NONE = np.iinfo(np.int64).min


def _pad(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate((x, np.full(k - len(x), _NONE))) if len(x) < k else x


def top_k(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller id.

    Candidates are all rows of the query's dimension but those that bear its id. Vectors that are null or hold
    null or non-finite components take no part; of fewer than k candidates all are returned; repeated rows are
    candidates as often as they stand, but a repeated query is answered once. An empty table gives no rows.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    vectors = scratch.write("vectors", clean(rows, id_col, vector_col))
    turn = rotations(vectors)
    largest = [(r["dim"], r["vec_id"], np.array(r["v"])) for r in vectors.orderBy(F.desc("norm"), "vec_id").limit(CHUNK).collect()]
    head = {d: (np.array([i for d2, i, _ in largest if d2 == d], np.int64), np.stack([v for d2, _, v in largest if d2 == d])) for d in {d for d, _, _ in largest}}
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    candidates = chunks(vectors.repartitionByRange(groups, F.desc("norm")).sortWithinPartitions(F.desc("norm")))
    candidates = candidates.withColumn("g", F.pmod(F.xxhash64("chunk", "largest"), F.lit(groups)).cast("int"))
    asked = vectors.where(is_query).dropDuplicates(["vec_id", "dim"])
    queries = chunks(asked).select("dim", F.col("chunk").alias("q_chunk"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    queries = queries.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = candidates.join(queries.hint("merge"), ["g", "dim"]).sortWithinPartitions("q_chunk", F.desc("largest"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, current = None, None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.q_chunk != current:
                    if best is not None:
                        yield pd.DataFrame(best.rows(), columns=["query_id", "vec_id", "score"])
                    current = r.q_chunk
                    best = Best(np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.q_vectors).reshape(len(r.q_ids) // 8, r.dim), k, turn[r.dim])
                    if r.dim in head:  # a floor from the longest vectors of all, which prunes from the first block on
                        start = Best(best.ids, best.vectors, k, turn[r.dim])
                        start.meet(*head[r.dim], turn[r.dim])
                        floor = start.floor()
                        best.floor = lambda own=best, least=floor: np.maximum(Best.floor(own), least)
                best.meet(np.frombuffer(r.ids, np.int64), np.frombuffer(r.vectors).reshape(len(r.ids) // 8, r.dim), turn[r.dim])
        if best is not None:
            yield pd.DataFrame(best.rows(), columns=["query_id", "vec_id", "score"])

    found = met.mapInPandas(run, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
