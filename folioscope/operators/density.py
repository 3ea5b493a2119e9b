"""Density clusters of vectors: core distances, a minimum spanning tree over mutual reachability, flat views of it.

The mutual reachability of two points is the greatest of their distance and both core distances. All vectors of a
scope meet once, in pairs of blocks: a block alone sends on a spanning tree of its own points, two blocks one of the edges
between them. An edge outside these trees is the heaviest of a cycle, so the least spanning tree lies within them, and
Boruvka rounds over edges alone find it: every component takes its least edge, components that are joined become one,
and edges between two components shrink to the least. Rounds halve the components, whatever the size of a scope.

Points that edges up to `eps` connect are a cluster if they are enough, and noise if not (DBSCAN*). One tree answers
every view; a view's parameters make its hash, so that views stand beside each other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settled
from .index import SALTS, euclid, nearest, top_k

#: Points a block holds about; a pair's distances are held at a time.
BLOCK = 2048


def usable(points: DataFrame, scope: list[str], id_col: str) -> DataFrame:
    """(scope, dim, id, vector): one row an id, without null or empty vectors and those of null or non-finite components."""
    vector = F.transform("vector", lambda x: x.cast("double"))
    rows = points.select(*scope, id_col, vector.alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where((F.size("vector") > 0) & fine & F.col(id_col).isNotNull())
    return rows.groupBy(*scope, id_col).agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))


def core_distances(rows: DataFrame, scope: list[str], id_col: str, samples: int, block: int = BLOCK) -> DataFrame:
    """`rows` with `core`: the distance to the `samples`-th nearest other point (the farthest, if there are fewer; 0 alone)."""
    by = [*scope, "dim"]
    near = nearest(rows.withColumnRenamed(id_col, "of"), rows, by, "of", id_col, samples, "euclid", block, others=True)
    kept = top_k(near, [*by, "of"], samples, [F.desc("score"), F.asc(id_col)]).groupBy(*by, F.col("of").alias(id_col)).agg((-F.min("score") + 0).alias("core"))
    return rows.join(kept, [*by, id_col], "left").withColumn("core", F.coalesce("core", F.lit(0.0)))


def block_tree(rank: np.ndarray, core: np.ndarray, x: np.ndarray, left: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(w, i, j): a least spanning tree of points, or of the edges between the first `left` of them and the rest; ties by rank."""
    n = len(x)
    reach = lambda a, b: np.maximum(np.maximum(euclid(x[a], x[b]), core[a][:, None]), core[b][None, :])
    low, high = slice(0, left), slice(left, n)
    there = reach(low, high) if left else reach(high, high)
    back = np.ascontiguousarray(there.T) if left else there
    best, source = np.full(n, np.inf), np.zeros(n, np.int64)
    tie = np.full(n, np.iinfo(np.int64).max)
    out = np.zeros(n, bool)
    open_ = np.full(n, np.inf)  # best, without the points that are in the tree
    weights, froms, tos = np.zeros(n - 1), np.zeros(n - 1, np.int64), np.zeros(n - 1, np.int64)
    now = 0
    for step in range(n - 1):
        out[now], open_[now] = True, np.inf
        side, w = (high, there[now]) if now < left or not left else (low, back[now - left])
        at = np.flatnonzero((w <= best[side]) & ~out[side])
        if len(at):
            w, at = w[at], at + side.start
            pair = np.minimum(rank[at], rank[now]) * n + np.maximum(rank[at], rank[now])
            better = (w < best[at]) | (pair < tie[at])
            at, w = at[better], w[better]
            best[at], open_[at], source[at], tie[at] = w, w, now, pair[better]
        least = np.flatnonzero(open_ == open_.min())
        now = int(least[np.argmin(tie[least])]) if len(least) > 1 else int(least[0])
        weights[step], froms[step], tos[step] = best[now], source[now], now
    return weights, froms, tos


def block_trees(rows: DataFrame, scope: list[str], id_col: str, block: int = BLOCK) -> DataFrame:
    """(scope, w, a, b), a < b: the edges of every block pair's tree; `rows` has (scope, dim, id, core, vector).

    Rows meet the sizes of their scope over SALTS; a pair of blocks is one key, so a scope's pairs are as many tasks.
    """
    by = [*scope, "dim"]
    kind = rows.schema[id_col].dataType.simpleString()
    sizes = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).join(sizes, [*by, "salt"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(id_col, F.lit(1)), "blocks").cast("int"))
    packed = dealt.groupBy(*by, "blocks", "block").agg(F.collect_list(F.struct(F.col(id_col).alias("id"), "core", F.col("vector").alias("v"))).alias("points"))
    packed = settled(packed, "blocks")
    left = packed.select(*by, F.col("block").alias("low"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("high"), F.col("points").alias("p"))
    right = packed.select(*by, F.explode(F.sequence(F.lit(0), "block")).alias("low"), F.col("block").alias("high"), F.col("points").alias("q"))
    right = right.withColumn("q", F.when(F.col("low") < F.col("high"), F.col("q")).otherwise(F.slice("q", 1, 0)))
    first = F.when(F.col("low") < F.col("high"), F.size("p")).otherwise(0).alias("left")
    met = left.join(right, [*by, "low", "high"]).select(*scope, first, F.concat("p", "q").alias("points"))
    met = met.select(*scope, "left", F.transform("points", lambda r: r["id"]).cast(f"array<{kind}>").alias("ids"), F.transform("points", lambda r: r["core"]).alias("core"), F.transform("points", lambda r: r["v"]).alias("vectors"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                ids = np.asarray(r["ids"])
                rank = np.empty(len(ids), np.int64)
                rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
                w, i, j = block_tree(rank, np.asarray(r["core"], float), np.stack(r["vectors"]), r["left"])
                first = rank[i] < rank[j]
                yield pd.DataFrame({**{c: [r[c]] * len(w) for c in scope}, "w": w, "a": ids[np.where(first, i, j)], "b": ids[np.where(first, j, i)]})

    schema = [*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in scope), "w double", f"a {kind}", f"b {kind}"]
    return met.mapInPandas(run, ", ".join(schema))


def joined(edges: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """Least spanning forest (scope, w, a, b) of edges with a < b, and (scope, id, root) of their points, by Boruvka rounds.

    Edges are ordered by (w, a, b), so no two are equal and the forest is one. A round takes each component's least
    edge; where two components take the same one the smaller is a root, and the others find their root by doubling.
    Only counts come to the driver.
    """
    least = F.min(F.struct("w", "a", "b", "other")).alias("e")
    open_ = settled(edges.groupBy(*scope, "a", "b").agg(F.min("w").alias("w")).select(*scope, F.col("a").alias("u"), F.col("b").alias("v"), "w", "a", "b"), "edges")
    points = open_.select(*scope, F.col("u").alias("id")).unionByName(open_.select(*scope, F.col("v").alias("id"))).distinct()
    labels = settled(points.withColumn("root", F.col("id")), "labels")
    forest = None
    while open_.limit(1).count():
        ends = open_.select(*scope, F.col("u").alias("node"), F.col("v").alias("other"), "w", "a", "b").unionByName(open_.select(*scope, F.col("v").alias("node"), F.col("u").alias("other"), "w", "a", "b"))
        taken = settled(ends.groupBy(*scope, "node").agg(least).select(*scope, "node", "e.*"), "taken")
        tree = taken.select(*scope, "w", "a", "b").distinct()
        forest = tree if forest is None else forest.unionByName(tree)
        back = taken.select(*scope, F.col("node").alias("other"), F.col("other").alias("theirs"))
        both = taken.select(*scope, "node", "other").join(back, [*scope, "other"])
        root = F.when((F.col("theirs") == F.col("node")) & (F.col("node") < F.col("other")), F.col("node")).otherwise(F.col("other"))
        up = settled(both.select(*scope, "node", root.alias("up")), "up")
        while True:  # two doublings a job
            twice = up
            for _ in range(2):
                above = twice.select(*scope, F.col("node").alias("up"), F.col("up").alias("top"))
                twice = twice.join(above, [*scope, "up"]).select(*scope, "node", F.col("top").alias("up"))
            before = up.select(*scope, "node", F.col("up").alias("old"))
            higher = settled(twice.join(before, [*scope, "node"]).select(*scope, "node", "up", (F.col("up") != F.col("old")).alias("moved")), "up")
            up = higher.drop("moved")
            if not higher.where("moved").limit(1).count():
                break
        name = lambda c: up.select(*scope, F.col("node").alias(c), F.col("up").alias(f"{c}_root"))
        labels = settled(labels.join(name("root"), [*scope, "root"], "left").select(*scope, "id", F.coalesce("root_root", "root").alias("root")), "labels")
        moved = open_.join(name("u"), [*scope, "u"]).join(name("v"), [*scope, "v"]).where("u_root != v_root")
        ordered = moved.select(*scope, F.least("u_root", "v_root").alias("u"), F.greatest("u_root", "v_root").alias("v"), F.struct("w", "a", "b").alias("e"))
        open_ = settled(ordered.groupBy(*scope, "u", "v").agg(F.min("e").alias("e")).select(*scope, "u", "v", "e.*"), "edges")
    return (edges.select(*scope, "w", "a", "b").limit(0) if forest is None else settled(forest, "forest")), labels


def spanning_tree(points: DataFrame, scope: list[str], id_col: str, samples: int = 5, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(points with core, tree): the core distances (scope, id, core), and the least spanning forest (scope, w, a, b).

    A scope's points of unlike lengths are not connected. Points without a usable vector (null, empty, null or
    non-finite components) take no part; rows of one id count once; points of one vector lie at distance 0. An
    empty table gives empty ones. Scope columns are not null.
    """
    if samples < 1:
        raise ValueError("samples must be at least 1")
    rows = settled(core_distances(usable(points, scope, id_col), scope, id_col, samples), "core")
    return rows.select(*scope, id_col, "core"), joined(block_trees(rows, scope, id_col, block), scope)[0]


def params_hash(samples: int, eps: float, least: int) -> str:
    """What tells views apart."""
    import hashlib

    return hashlib.sha256(f"dbscan*|{samples}|{eps!r}|{least}".encode()).hexdigest()[:16]


def views(core: DataFrame, tree: DataFrame, scope: list[str], id_col: str, settings: Sequence[tuple[float, int]], samples: int) -> DataFrame:
    """(scope, id, params_hash, cluster, size, membership_score) of every point that has a core distance, in each view.

    A view is a pair (eps, least); all views go through the same rounds. `cluster` is the least id of the cluster, null
    for noise (size 0, score 0). A member's score is the least core distance in its cluster over its own; 1 where its
    own is 0.
    """
    if any(least < 2 or not eps >= 0 for eps, least in settings):
        raise ValueError("a cluster has two points or more, within a distance of 0 or more")
    told = F.array(*(F.struct(F.lit(params_hash(samples, eps, least)).alias("params_hash"), F.lit(float(eps)).alias("eps"), F.lit(least).alias("least")) for eps, least in settings))
    by = [*scope, "params_hash"]
    near = tree.select("*", F.explode(told).alias("view")).where(F.col("w") <= F.col("view.eps"))
    _, labels = joined(near.select(*scope, F.col("view.params_hash").alias("params_hash"), "w", "a", "b"), by)
    each = core.select("*", F.explode(told).alias("view")).select(*core.columns, "view.params_hash", "view.least")
    held = each.join(labels.select(*by, F.col("id").alias(id_col), "root"), [*by, id_col], "left")
    facts = held.where(F.col("root").isNotNull()).groupBy(*by, "root", "least").agg(F.min(id_col).alias("cluster"), F.count(F.lit(1)).alias("size"), F.min("core").alias("densest"))
    facts = facts.where(F.col("size") >= F.col("least")).drop("least")
    score = F.when(F.col("cluster").isNull(), 0.0).when(F.col("core") == 0, 1.0).otherwise(F.col("densest") / F.col("core"))
    out = held.join(facts, [*by, "root"], "left")
    return out.select(*scope, id_col, "params_hash", "cluster", F.coalesce("size", F.lit(0)).cast("long").alias("size"), score.alias("membership_score"))


def representatives(viewed: DataFrame, scope: list[str], id_col: str, k: int = 5) -> DataFrame:
    """(scope, params_hash, cluster, size, representatives): each cluster with its k members of the best scores."""
    keys = [*scope, "params_hash", "cluster"]
    best: Column = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("membership_score"), F.asc(id_col)))
    ranked = viewed.where(F.col("cluster").isNotNull()).withColumn("n", best).where(F.col("n") <= k)
    listed = ranked.groupBy(*keys, "size").agg(F.array_sort(F.collect_list(F.struct("n", F.col(id_col).alias("id")))).alias("r"))
    return listed.select(*keys, "size", F.transform("r", lambda x: x["id"]).alias("representatives"))
