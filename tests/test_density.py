"""Density clusters against a plain implementation: the tables' vectors by label, ties, noise, unusable vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import density, index

TYPES = "label int, vec_id long, vector array<double>"


def plain(points, samples):
    """{label: (ids, mutual reachability, core)} of [(label, id, vector)]."""
    out = {}
    for label in {p[0] for p in points}:
        ids = sorted(p[1] for p in points if p[0] == label)
        x = np.array([next(p[2] for p in points if p[:2] == (label, k)) for k in ids], float)
        d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
        others = np.sort(np.where(np.eye(len(ids), dtype=bool), np.inf, d), 1)
        core = others[:, min(samples, len(ids) - 1) - 1] if len(ids) > 1 else np.zeros(1)
        out[label] = ids, np.maximum(d, np.maximum(core[:, None], core[None])), core
    return out


def kruskal(ids, m):
    parent, got = list(range(len(ids))), []

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for w, i, j in sorted((m[i, j], i, j) for i in range(len(ids)) for j in range(i + 1, len(ids))):
        if root(i) != root(j):
            parent[root(j)] = root(i)
            got.append((w, ids[i], ids[j]))
    return got


def clusters(ids, m, core, eps, least):
    """{id: (cluster, size, score)} by flooding."""
    out, left = {}, set(range(len(ids)))
    while left:
        part, todo = set(), [min(left)]
        while todo:
            k = todo.pop()
            part.add(k)
            todo += [j for j in left - part if m[k, j] <= eps and j not in todo]
        left -= part
        for k in part:
            out[ids[k]] = (min(ids[j] for j in part), len(part), min(core[j] for j in part) / core[k] if core[k] else 1.0) if len(part) >= least else (None, 0, 0.0)
    return out


def check(spark, points, samples, block, views):
    rows = spark.createDataFrame(points, TYPES)
    core, tree = density.spanning_tree(rows, ["label"], "vec_id", samples, block)
    expected = plain(points, samples)
    got = {(r["label"], r["vec_id"]): r["core"] for r in core.collect()}
    assert got == pytest.approx({(label, k): c for label, (ids, _, core_) in expected.items() for k, c in zip(ids, core_)}, abs=1e-9)
    edges = sorted((r["label"], r["w"], r["a"], r["b"]) for r in tree.collect())
    for label, (ids, m, _) in expected.items():
        mine = [e[1:] for e in edges if e[0] == label]
        assert sum(e[0] for e in mine) == pytest.approx(sum(e[0] for e in kruskal(ids, m))) and len(mine) == len(ids) - 1
    every = density.views(core, tree, ["label"], "vec_id", views, samples).collect()
    for eps, least in views:
        found = [r for r in every if r["params_hash"] == density.params_hash(samples, eps, least)]
        assert len(found) == len(got)
        for label, (ids, m, core_) in expected.items():
            want = clusters(ids, m, core_, eps, least)
            for r in (r for r in found if r["label"] == label):
                cluster, size, score = want[r["vec_id"]]
                assert (r["cluster"], r["size"]) == (cluster, size) and r["membership_score"] == pytest.approx(score), (label, r["vec_id"])
    return core, tree


def test_equals_a_plain_implementation_on_the_vectors_by_label(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("label < 3").collect()
    points = [(r["label"], r["vec_id"], [float(x) for x in r["embedding"]]) for r in rows]
    core, tree = check(spark, points, 3, 16, [(1.25, 3)])
    views = density.views(core, tree, ["label"], "vec_id", [(1.25, 3)], 3)
    for r in density.representatives(views, ["label"], "vec_id", 2).collect():
        best = sorted((-v["membership_score"], v["vec_id"]) for v in views.where((F.col("label") == r["label"]) & (F.col("cluster") == r["cluster"])).collect())
        assert r["representatives"] == [k for _, k in best[:2]]


def test_ties_copies_and_points_alone(spark):
    """A grid whose neighbours are all equally far, copies of one vector, a scope of one point, another scope all noise."""
    grid = [(0, 5 * i + j, [float(i), float(j)]) for i in range(5) for j in range(5)]
    copies = [(1, k, [1.0, 1.0]) for k in range(20)] + [(1, 30, [9.0, 9.0])]
    far = [(3, k, [10.0**k, 0.0]) for k in range(6)]
    check(spark, [*grid, *copies, (2, 0, [1.0, 2.0]), *far], 2, 7, [(1.0, 2), (0.0, 2)])


def test_unusable_vectors_repeated_rows_and_empty_tables(spark):
    rows = [(0, 1, [0.0, 1.0]), (0, 1, [0.0, 1.0]), (0, 2, [0.0, 1.5]), (0, 3, None), (0, 4, []), (0, 5, [float("nan"), 1.0]), (0, 6, [1.0]), (0, 7, [None, 1.0]), (0, None, [0.0, 1.0])]
    points = spark.createDataFrame(rows, TYPES)
    core, tree = density.spanning_tree(points, ["label"], "vec_id", 4)
    assert sorted((r["vec_id"], r["core"]) for r in core.collect()) == [(1, 0.5), (2, 0.5), (6, 0.0)]
    assert [(r["w"], r["a"], r["b"]) for r in tree.collect()] == [(0.5, 1, 2)]
    assert density.spanning_tree(points.limit(0), ["label"], "vec_id")[1].count() == 0
    assert density.params_hash(3, 1.0, 2) != density.params_hash(3, 1.0, 3)
    with pytest.raises(ValueError):
        density.views(core, tree, ["label"], "vec_id", [(1.0, 1)], 4)


def test_distances_by_products_are_those_by_differences():
    rnd = np.random.default_rng(3)
    for scale in (1e-6, 1.0, 1e5):
        x, y = (rnd.normal(size=(n, 64)) * scale for n in (90, 70))
        x[:20] = y[0]  # copies
        x[20:40] = y[1] + rnd.normal(size=(20, 64)) * 1e-9 * scale  # nearly copies
        want = np.round(np.sqrt(((x[:, None] - y[None]) ** 2).sum(2)), 9)
        assert np.array_equal(index.euclid(x, y), want), scale


def test_two_blocks_meet_by_the_edges_between_them():
    rnd = np.random.default_rng(4)
    x, core = np.round(rnd.normal(size=(70, 3)), 1), np.round(rnd.uniform(0, 0.5, 70), 1)  # with ties
    rank = rnd.permutation(70)
    w, i, j = density.block_tree(rank, core, x, 40)
    assert len(w) == 69 and all((a < 40) != (b < 40) for a, b in zip(i, j, strict=True))
    m = np.maximum(np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9), np.maximum(core[:, None], core[None]))
    m[:40, :40], m[40:, 40:] = np.inf, np.inf
    order = np.argsort(rank)
    want = sorted((v, a, b) for v, a, b in kruskal(range(70), m[np.ix_(order, order)]))
    assert sorted((v, *sorted((int(rank[a]), int(rank[b])))) for v, a, b in zip(w, i, j, strict=True)) == want
