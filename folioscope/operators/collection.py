"""A collection of vectors laid out in cells, searched exactly by reading few of them.

Centroids are fitted on a bounded sample; every vector lies in the cell of its nearest centroid, one part of a
versioned table a cell. For each document and cell the table of reaches holds how many vectors there are and how far
the farthest lies from the centroid. By the triangle inequality (for inner products by Cauchy-Schwarz) no vector of a
cell is nearer to a query than its centroid's distance less the reach. A query looks into its most promising cells
until k vectors have been seen, and then only into those whose bound reaches its kth score.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import uuid5_hex
from ..sources.scratch import settled
from ..sources.versioned import Conflict, Snapshot, VersionedTable
from .index import nearest, top_k

METRICS = ("cosine", "dot", "euclid", "manhattan")
#: Scores are rounded to 9 digits; bounds must not fall short of that.
SLACK = 1e-8


def placed_form(metric: str, vectors: np.ndarray) -> np.ndarray:
    """Vectors as cells see them: unit ones under cosine, zero vectors as they are."""
    if metric != "cosine":
        return vectors
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def gaps(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[a, b] distances to centroids: by components under manhattan, else straight."""
    if metric == "manhattan":
        return np.stack([np.abs(a - c).sum(1) for c in b], 1)
    return np.stack([np.sqrt(((a - c) ** 2).sum(1)) for c in b], 1)


def fit_centroids(metric: str, sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """At most `cells` means: far starts one after the other, then rounds of moving to the mean of what is nearest."""
    points = placed_form(metric, sample)
    chosen = [points[0]]
    away = gaps(metric, points, points[:1])[:, 0]
    while len(chosen) < min(cells, len(points)) and away.max() > 0:
        chosen.append(points[int(away.argmax())])
        away = np.minimum(away, gaps(metric, points, np.array(chosen[-1:]))[:, 0])
    centroids = np.array(chosen)
    for _ in range(rounds):
        nearest_of = gaps(metric, points, centroids).argmin(1)
        moved = np.array([points[nearest_of == k].mean(0) if (nearest_of == k).any() else c for k, c in enumerate(centroids)])
        if np.allclose(moved, centroids):
            break
        centroids = moved
    return centroids


class VectorCollection:
    """Vectors of one size: (point_id, span_id, document_id, vector), one a span; a search stays in a query's document."""

    FORM = "cell int, point_id string, span_id string, document_id string, vector array<double>, gap double"
    REACHES = "document_id string, cell int, n long, reach double"

    def __init__(self, spark: SparkSession, path: str, size: int, metric: str = "cosine", cells: int = 32, sample: int = 20_000):
        """`cells` centroids, fitted when the first vectors come on at most `sample` of them, chosen by hash of the id."""
        if metric not in METRICS:
            raise ValueError(f"unknown distance: {metric}")
        self.spark, self.path, self.size, self.metric, self.cells, self.sample = spark, path, size, metric, cells, sample
        self.table = VersionedTable(spark, path, self.FORM, ["span_id"], part="cell")

    def recreate(self) -> None:
        if not self.table.create():
            self.table.overwrite(self.spark.createDataFrame([], self.FORM), centroids=None, reaches=None)

    def read(self, of: Snapshot | None = None, cells: list[int] | None = None) -> DataFrame:
        return self.table.read(of=of, parts=cells).select("point_id", "span_id", "document_id", "vector")

    # --- layout ---

    def centroids(self, at: Snapshot) -> np.ndarray | None:
        name = at.properties.get("centroids")
        return np.array(json.loads(self.table.folder.read(name))) if name else None

    def reaches(self, at: Snapshot) -> DataFrame:
        name = at.properties.get("reaches")
        return self.spark.read.schema(self.REACHES).parquet(f"{self.path}/{name}") if name else self.spark.createDataFrame([], self.REACHES)

    def _fitted(self, rows: DataFrame) -> tuple[str | None, np.ndarray | None]:
        drawn = [r["vector"] for r in rows.orderBy(F.xxhash64("span_id"), "span_id").limit(self.sample).select("vector").collect()]
        if not drawn:
            return None, None
        centroids, name = fit_centroids(self.metric, np.array(drawn, float), self.cells), f"centroids/{uuid.uuid4().hex}.json"
        self.table.folder.put_new(name, json.dumps(centroids.tolist()))
        return name, centroids

    def _placed(self, rows: DataFrame, centroids: np.ndarray) -> DataFrame:
        metric = self.metric

        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    away = gaps(metric, placed_form(metric, np.stack([np.asarray(v, float) for v in pdf["vector"]])), centroids)
                    cell = away.argmin(1)
                    yield pdf.assign(cell=cell.astype(np.int32), gap=away[np.arange(len(pdf)), cell])[["cell", "point_id", "span_id", "document_id", "vector", "gap"]]

        return rows.mapInPandas(run, self.FORM)

    def upsert(self, rows: DataFrame, attempts: int = 5) -> None:
        """Vectors of a span replace those it had; only the cells that lose or gain a vector are written anew."""
        wrong = F.raise_error(F.concat(F.lit("vector size of "), "span_id", F.lit(" is not "), F.lit(str(self.size))))
        checked = F.when(F.size("vector") == self.size, F.col("vector")).otherwise(wrong.cast("array<double>"))
        new = rows.select(uuid5_hex(F.col("span_id")).alias("point_id"), "span_id", "document_id", F.transform(checked, lambda x: x.cast("double")).alias("vector")).dropDuplicates(["span_id"])
        new = settled(new, "vectors")
        for attempt in range(attempts):
            try:
                return self._upsert(new)
            except Conflict:
                if attempt == attempts - 1:
                    raise

    def _upsert(self, new: DataFrame) -> None:
        at = self.table.snapshot()
        name, centroids = at.properties.get("centroids"), self.centroids(at)
        if centroids is None:
            name, centroids = self._fitted(new)
            if centroids is None:
                return
        placed = settled(self._placed(new, centroids), "placed")
        stored = self.table.read(of=at)
        ids = placed.select("span_id")
        left = stored.select("span_id", "cell").join(ids, "span_id", "left_semi").select("cell")
        touched = [r["cell"] for r in left.unionByName(placed.select("cell")).distinct().collect()]
        both = self.table.read(of=at, parts=touched).join(ids, "span_id", "left_anti").unionByName(placed)
        reach = both.groupBy("document_id", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("reach"))
        reaches = f"reaches/{uuid.uuid4().hex}"
        self.reaches(at).where(~F.col("cell").isin(*touched)).unionByName(reach).write.parquet(f"{self.path}/{reaches}")
        self.table.replace_parts(touched, both, at, centroids=name, reaches=reaches)

    def vacuum(self, keep: int = 1) -> None:
        """Forget all but the last `keep` versions, with the centroids and reaches that none of them names."""
        self.table.vacuum(keep)
        named = {n for v in self.table.versions() for n in self.table.snapshot(v).properties.values() if n}
        for kind in ("centroids", "reaches"):
            for name in self.table.folder.names(kind):
                if f"{kind}/{name}" not in named:
                    self.table.folder.delete(f"{kind}/{name}")

    # --- reading ---

    def count(self) -> int:
        return self.read().count()

    def retrieve(self, wanted: DataFrame) -> DataFrame:
        """(span_id, vector) of the wanted spans (span_id) that are held."""
        return self.read().join(wanted.select("span_id").distinct(), "span_id", "left_semi").select("span_id", "vector")

    def _best(self, distance: Column, norm: Column, reach: Column) -> Column:
        """The highest score that a vector within `reach` of a centroid can have."""
        least = F.greatest(F.lit(0.0), distance - reach)
        if self.metric == "cosine":  # unit vectors at distance d have cosine 1 - d² / 2
            return 1 - least * least / 2
        return distance + norm * reach if self.metric == "dot" else -least

    def bounds(self, queries: DataFrame, at: Snapshot, k: int) -> DataFrame:
        """(query_id, document_id, cell, n, best, first): cells of each query's document, what they can score at best,
        and whether they are among those looked into first."""
        metric, size, centroids = self.metric, self.size, self.centroids(at)
        kind = queries.schema["query_id"].dataType.simpleString()

        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                if any(v is None or len(v) != size for v in pdf["vector"]):
                    raise ValueError(f"a query's vector has not {size} components")
                q = placed_form(metric, np.stack([np.asarray(v, float) for v in pdf["vector"]]))
                away = q @ centroids.T if metric == "dot" else gaps(metric, q, centroids)
                n = len(centroids)
                yield pd.DataFrame({"query_id": np.repeat(pdf["query_id"].to_numpy(), n), "document_id": np.repeat(pdf["document_id"].to_numpy(), n), "cell": np.tile(np.arange(n, dtype=np.int32), len(pdf)), "distance": away.ravel(), "norm": np.repeat(np.linalg.norm(q, axis=1), n)})

        met = queries.select("query_id", "document_id", "vector").mapInPandas(run, f"query_id {kind}, document_id string, cell int, distance double, norm double")
        met = met.join(self.reaches(at), ["document_id", "cell"]).withColumn("best", self._best(F.col("distance"), F.col("norm"), F.col("reach")))
        before = Window.partitionBy("query_id", "document_id").orderBy(F.desc("best"), "cell").rowsBetween(Window.unboundedPreceding, -1)
        return met.select("query_id", "document_id", "cell", "n", "best", (F.coalesce(F.sum("n").over(before), F.lit(0)) < k).alias("first"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, document_id, span_id, score, rank): the k nearest of each query (query_id, document_id, vector), exactly."""
        return self.searched(queries, k)[0]

    def searched(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """The answer, and which cells each query looked into: (query_id, document_id, cell, first)."""
        at = self.table.snapshot()
        form = f"query_id {queries.schema['query_id'].dataType.simpleString()}, document_id string, span_id string, score double, rank int"
        if self.centroids(at) is None:
            return self.spark.createDataFrame([], form), self.spark.createDataFrame([], form).selectExpr("query_id", "document_id", "rank AS cell", "true AS first")
        asked = queries.select("query_id", "document_id", "vector")
        cells = settled(self.bounds(asked, at, k), "cells")
        by = ["query_id", "document_id"]
        near = settled(self._scan(asked, cells.where("first"), at, k), "near")
        reached = top_k(near, by, k, [F.desc("score"), F.asc("span_id")]).groupBy(*by).agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("kth"))
        open_ = cells.where("NOT first").join(reached, by, "left").where((F.coalesce("found", F.lit(0)) < k) | (F.col("best") >= F.col("kth") - SLACK))
        rest = settled(open_.select(*by, "cell", "first"), "rest")
        every = near.unionByName(self._scan(asked, rest, at, k))
        best = top_k(every, by, k, [F.desc("score"), F.asc("span_id")])
        return best.select(*by, "span_id", "score", F.col("rank").cast("int").alias("rank")), cells.where("first").select(*by, "cell", "first").unionByName(rest)

    def _scan(self, asked: DataFrame, looked: DataFrame, at: Snapshot, k: int) -> DataFrame:
        """The k nearest in each of the cells looked into; other cells are not read."""
        wanted = sorted(r["cell"] for r in looked.select("cell").distinct().collect())
        held = self.table.read(of=at, parts=wanted).select("document_id", "cell", "span_id", "vector")
        each = asked.join(looked.select("query_id", "document_id", "cell"), ["query_id", "document_id"])
        return nearest(each.select("query_id", "document_id", "cell", "vector"), held, ["document_id", "cell"], "query_id", "span_id", k, self.metric).select("query_id", "document_id", "span_id", "score")
