"""Nearest neighbours as a block matrix join: int8 tiles bound every distance, what may be near is computed in doubles.

A vector x is kept as int8 codes c with one scale s; |x - s c| is its error. A tile is the integer product of a block
of query codes and one of candidate codes: the distance of two vectors lies within the sum of their errors of the
distance of their codes. The (k + 1)th smallest upper bound of a query in a tile, or what its heap holds, is its limit;
only candidates whose lower bound is within it are computed again, exactly, and go through the query's heap. No bound
is estimated, so that nothing near is lost: recall is 1, and the answer does not depend on how blocks fall.

Copies of one vector are folded before: only the k + 1 smallest ids of equal vectors can be among anyone's k nearest,
equal query vectors are searched for once, and their answers are dealt over SALTS. Rows with one id are one vector: of
several different ones the one whose bytes digest first. Vectors that are null, empty or zero, or hold null or
non-finite components, take no part; vectors of other dimensions do not meet. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BLOCK = 2048
SALTS = 16
#: Components of one product: sums of 1024 products of int8 codes are exact in single precision.
DEPTH = 1024


def clean(rows: DataFrame, is_query: Column, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, asked, dim, key, raw): vectors that take part, packed as doubles, with a digest of their bytes."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    wrong = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0)
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asked"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~wrong & some)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [(np.asarray(x, float) + 0.0).tobytes() for x in pdf["v"]]  # -0 is 0
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "asked": pdf["asked"], "dim": [len(x) // 8 for x in raw], "key": [hashlib.blake2b(x, digest_size=16).digest() for x in raw], "raw": raw})

    return kept.mapInPandas(run, "vec_id long, asked boolean, dim int, key binary, raw binary")


def first_of(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The first `most` rows of each `by`, cut before they are shuffled as well."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("n") <= most).drop("n")


def codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and error of each vector; the error is rounded up."""
    largest = np.abs(vectors).max(1)
    scale = np.where(largest > 0, largest / 127, 1.0)
    scale = np.where(np.isfinite(1 / scale), scale, 1.0)  # below the smallest normal numbers the codes are 0
    code = np.rint(vectors / scale[:, None]).astype(np.int8)
    rest = vectors / scale[:, None] - code
    error = np.sqrt((rest * rest).sum(1)) * scale * (1 + 1e-9)
    return code, scale, error


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int8 codes, exact: single-precision products of at most DEPTH components, added as doubles."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], DEPTH):
        out += a[:, at : at + DEPTH].astype(np.float32) @ b[:, at : at + DEPTH].astype(np.float32).T
    return out


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, squares added from the first component on; scaled where they leave the doubles."""
    gaps = a - b
    with np.errstate(over="ignore"):
        total = np.zeros(len(a))
        for k in range(a.shape[1]):
            total += gaps[:, k] * gaps[:, k]
    out = np.sqrt(total)
    odd = np.flatnonzero(~np.isfinite(total) | (total < 1e-290))
    for i in odd:
        with np.errstate(over="ignore"):
            half = np.abs(a[i] / 2 - b[i] / 2)  # differences of large numbers may pass the largest one
            top = half.max()
            out[i] = 0.0 if top == 0 else 2 * (top * np.sqrt(np.sum((half / top) ** 2)))
    return out


def packed(rows: DataFrame, name: str, block: int, extra: str = "") -> DataFrame:
    """Blocks of at most `block` vectors of one dimension: (dim, name, name_raw), with the members of each if asked."""
    schema = f"dim int, {name} string, {name}_raw binary, {name}_{extra or 'keys'} array<{'array<long>' if extra else 'binary'}>"
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def row(dim: int) -> pd.DataFrame:
            part = held.pop(dim)
            digest = hashlib.blake2b(b"".join(k for k, _, _ in part), digest_size=12).hexdigest()
            return pd.DataFrame([(dim, digest, b"".join(r for _, r, _ in part), [list(m) for _, _, m in part] if extra else [k for k, _, _ in part])], columns=columns)

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                held.setdefault(r.dim, []).append((r.key, r.raw, r.members if extra else None))
                if len(held[r.dim]) == block:
                    yield row(r.dim)
        for dim in list(held):
            yield row(dim)

    return rows.mapInPandas(run, schema)


class Heaps:
    """For each query of a block the `most` nearest (distance, id), as heaps whose top is the farthest."""

    def __init__(self, vectors: np.ndarray, most: int):
        self.vectors, self.most = vectors, most
        self.code, self.scale, self.error = codes(vectors)
        self.square = (self.code.astype(np.int64) ** 2).sum(1) * self.scale**2
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in vectors]
        self.limit = np.full(len(vectors), np.inf)
        self.computed = 0

    def meet(self, vectors: np.ndarray, members: list) -> None:
        code, scale, error = codes(vectors)
        square = (code.astype(np.int64) ** 2).sum(1) * scale**2
        with np.errstate(over="ignore", invalid="ignore"):
            both = self.square[:, None] + square[None, :]
            near = both - 2 * self.scale[:, None] * scale[None, :] * products(self.code, code)
            slack = 1e-6 * np.sqrt(both)  # the subtraction loses digits where codes nearly agree
            middle = np.sqrt(np.maximum(near, 0))
            spread = self.error[:, None] + error[None, :] + slack
            low, high = middle - spread, middle + spread
        unsure = ~np.isfinite(low)
        low[unsure], high[unsure] = -np.inf, np.inf
        if high.shape[1] >= self.most:
            limit = np.minimum(self.limit, np.partition(high, self.most - 1, axis=1)[:, self.most - 1])
        else:
            limit = self.limit
        q, c = np.nonzero(low <= limit[:, None])
        for at in range(0, len(q), 1 << 16):
            rows, columns = q[at : at + (1 << 16)], c[at : at + (1 << 16)]
            for i, d, j in zip(rows.tolist(), exact(self.vectors[rows], vectors[columns]).tolist(), columns.tolist(), strict=True):
                self._push(i, d, members[j])
        self.computed += len(q)
        self.limit = np.array([-h[0][0] if len(h) == self.most else np.inf for h in self.heaps])

    def _push(self, i: int, distance: float, ids) -> None:
        heap = self.heaps[i]
        for x in ids:
            if len(heap) < self.most:
                heapq.heappush(heap, (-distance, -int(x)))
            elif (-distance, -int(x)) > heap[0]:
                heapq.heapreplace(heap, (-distance, -int(x)))
            else:
                break  # ids ascend: the rest is farther still

    def rows(self, keys: list) -> pd.DataFrame:
        flat = [(key, -d, -x) for key, heap in zip(keys, self.heaps, strict=True) for d, x in heap]
        return pd.DataFrame(flat, columns=["key", "score", "vec_id"])


def nearest(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows nearest to each query row, itself left out, ties to the smaller id."""
    spark = rows.sparkSession
    scratch, most = Scratch(spark), k + 1  # one more than asked, for a query is left out of its own answer
    vectors = scratch.write("vectors", first_of(clean(rows, is_query, id_col, vector_col), "vec_id", "key", 1))
    few = first_of(vectors.select("vec_id", "dim", "key", "raw"), "key", "vec_id", most)
    members = few.groupBy("key", "dim").agg(F.any_value("raw").alias("raw"), F.array_sort(F.collect_list("vec_id")).alias("members"))
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    candidates = packed(members, "c", BLOCK, "members").withColumn("g", F.pmod(F.xxhash64("c"), F.lit(groups)).cast("int"))
    asked = vectors.where("asked")
    queries = packed(asked.groupBy("key", "dim").agg(F.any_value("raw").alias("raw")), "q", BLOCK)
    queries = queries.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = candidates.join(queries.hint("merge"), ["g", "dim"]).sortWithinPartitions("q")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps, keys, current = None, [], None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if (r.q, r.dim) != current:
                    if heaps is not None:
                        yield heaps.rows(keys)
                    current, keys = (r.q, r.dim), list(r.q_keys)
                    heaps = Heaps(np.frombuffer(r.q_raw).reshape(-1, r.dim), most)
                heaps.meet(np.frombuffer(r.c_raw).reshape(-1, r.dim), list(r.c_members))
        if heaps is not None:
            yield heaps.rows(keys)

    found = met.mapInPandas(run, "key binary, score double, vec_id long")
    answers = found.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("score", "vec_id"))).where(F.col("n") <= most).drop("n")
    dealt = answers.groupBy("key").agg(F.collect_list(F.struct("score", "vec_id")).alias("near")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = asked.select(F.col("vec_id").alias("query_id"), "key", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt")).join(dealt, ["key", "salt"])
    own = F.slice(F.array_sort(F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))), 1, k)
    return each.select("query_id", F.posexplode(own).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
